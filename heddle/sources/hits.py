"""Search requests and answers of a meta search as rows (S2, S13). All of it is expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import engine_error
from ..functions.options import valid_range
from ..functions.text import parse_date
from ..functions.urls import site_scoped, valid_site

#: An answer: hits whose `engines` and `positions` run side by side but may differ in length, and pairs of engine and message of any length.
ANSWER = """results array<struct<title: string, url: string, content: string, engine: string, publishedDate: string, engines: array<string>, positions: array<int>, score: double>>,
unresponsive_engines array<array<string>>"""
REQUEST = "query string, limit int, time_range string, language string, site string"
#: Results where a request asks for no number (fixed value).
SEARCH_LIMIT = 10


def credited(hit: Column) -> Column:
    """The engines that gave a hit: the list, else the single field, else none; each with its own position there, 0 where it isn't told."""
    one = F.when(F.coalesce(hit["engine"], F.lit("")) != "", F.array(hit["engine"])).otherwise(F.array().cast("array<string>"))
    engines = F.when(F.coalesce(F.size(hit["engines"]), F.lit(0)) > 0, hit["engines"]).otherwise(one)
    return F.transform(engines, lambda e, i: F.struct(e.alias("engine"), F.coalesce(F.get(hit["positions"], i), F.lit(0)).alias("position")))


def hits(answers: DataFrame) -> DataFrame:
    """query_id, merged_rank (from 1), title, url, snippet, engine, published_date, score, credits for answers (query_id, json). Text that isn't an answer gives no rows."""
    parsed = answers.select("query_id", F.from_json("json", ANSWER)["results"].alias("results"))
    each = parsed.select("query_id", F.posexplode("results").alias("at", "hit")).where("hit IS NOT NULL")
    text = lambda c: F.coalesce(F.col(f"hit.{c}"), F.lit(""))
    return each.select(
        "query_id", (F.col("at") + 1).alias("merged_rank"), text("title").alias("title"), text("url").alias("url"), text("content").alias("snippet"), text("engine").alias("engine"),
        text("publishedDate").alias("published_date"), F.coalesce("hit.score", F.lit(0.0)).alias("score"), credited(F.col("hit")).alias("credits"),
    )


#: An answer of the other kind of search: hits with a date as the engine writes it.
DATED = "results array<struct<title: string, url: string, snippet: string, date: string>>"


def dated(answers: DataFrame, engine: str, now: Column) -> DataFrame:
    """query_id, merged_rank, title, url, snippet, engine, published_date (to the minute, '' where it can't be read) for answers (query_id, json) whose hits have dates."""
    each = answers.select("query_id", F.posexplode(F.from_json("json", DATED)["results"]).alias("at", "hit")).where("hit IS NOT NULL")
    text = lambda c: F.coalesce(F.col(f"hit.{c}"), F.lit(""))
    return each.select("query_id", (F.col("at") + 1).alias("merged_rank"), text("title").alias("title"), text("url").alias("url"), text("snippet").alias("snippet"), F.lit(engine).alias("engine"), parse_date(text("date"), now).alias("published_date"))


def credits(found: DataFrame) -> DataFrame:
    """One row for each engine that gave a hit: its own position (0: unknown), the merged rank, and whether no other engine gave it. found: hits()."""
    sole = (F.size("credits") == 1).alias("sole")
    return found.select("query_id", "merged_rank", "url", "score", sole, F.explode("credits").alias("c")).select("query_id", "c.engine", "c.position", "merged_rank", "url", "score", "sole")


def failures(answers: DataFrame) -> DataFrame:
    """query_id, engine, message, class: engines that an answer reports as failed. Pairs without an engine's name are left out, a missing message is ''."""
    parsed = answers.select("query_id", F.explode(F.from_json("json", ANSWER)["unresponsive_engines"]).alias("pair"))
    named = parsed.select("query_id", F.get("pair", F.lit(0)).alias("engine"), F.coalesce(F.get("pair", F.lit(1)), F.lit("")).alias("message")).where("engine <> ''")
    return named.withColumn("class", engine_error(F.col("message")))


def requests(bodies: DataFrame, most: int) -> DataFrame:
    """request_id, error, and query (scoped by the site), limit, time_range, language, site for request bodies (request_id, json).

    error: why a request is refused; null if it isn't. A limit below one is the usual one, and none is above `most`.
    """
    r = bodies.select("request_id", F.from_json("json", REQUEST).alias("r"), F.col("json"))
    told = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    whole = F.try_parse_json("json").isNotNull() & F.rlike("json", F.lit(r"^\s*\{"))
    error = (
        F.when(~F.coalesce(whole, F.lit(False)), "invalid JSON body")
        .when(told("query") == "", "query is required")
        .when(~valid_range(told("time_range")), "time_range must be one of: day, week, month, year")
        .when((told("site") != "") & ~valid_site(told("site")), "site must be a bare hostname, e.g. reddit.com")
    )
    limit = F.least(F.when(F.col("r.limit") >= 1, F.col("r.limit")).otherwise(F.lit(SEARCH_LIMIT)), F.lit(most))
    return r.select("request_id", error.alias("error"), site_scoped(told("query"), told("site")).alias("query"), limit.alias("limit"), told("time_range").alias("time_range"), told("language").alias("language"), told("site").alias("site"))


def results(asked: DataFrame, found: DataFrame) -> DataFrame:
    """The hits that each accepted request is answered with, up to its limit. asked: requests(); found: hits(), whose query_id is the request's."""
    good = asked.where("error IS NULL").select(F.col("request_id").alias("query_id"), "limit")
    return found.join(good, "query_id").where(F.col("merged_rank") <= F.col("limit")).drop("limit", "credits", "score")
