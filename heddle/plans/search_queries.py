"""Queries over searches: requests and answers as JSON, made of the event log (a user's day is a search, an event a hit)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..sources import hits
from ..sources.tables import table
from .registry import query

_E = "(SELECT *, user_id * 1000 + epoch_us(ts) // 86400000000 % 1000 AS query_id, (['click', 'view', 'purchase'])[event_id % 3 + 1] AS other FROM events)"


def _events(spark, sf_dir) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    other = F.get(F.array(F.lit("click"), F.lit("view"), F.lit("purchase")), (F.col("event_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("us", us)
    return rows.withColumn("query_id", F.col("user_id") * 1000 + F.expr("us div 86400000000") % 1000).withColumn("other", other)


def _answers(spark, sf_dir) -> DataFrame:
    """JSON of each search's answer: hits in the order of event_id, some credited to a list of engines with as many positions, fewer or none, some to a single engine or to none; failures as pairs of any length."""
    n = F.col("event_id")
    engines = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.array("event_type")).when(n % 11 == 4, F.array().cast("array<string>")).otherwise(F.array("event_type", "other"))
    positions = F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, F.array((n % 9 + 1).cast("int"))).when(n % 4 == 2, F.array((n % 9 + 1).cast("int"), (n % 7 + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    single = F.when(n % 10 != 0, F.col("event_type"))
    hit = F.struct(n.alias("n"), F.concat(F.lit("https://e.example/"), (n % 50).cast("string")).alias("url"), F.concat(F.lit("Title "), n.cast("string")).alias("title"), single.alias("engine"), engines.alias("engines"), positions.alias("positions"), (n % 13 / 4).alias("score"), F.lit(1).alias("unknown"))
    q = F.col("query_id")
    failed = F.when(q % 4 == 0, F.array(F.array(F.lit("click"), F.lit("timeout")), F.array(F.lit("view")))).when(q % 4 == 1, F.array(F.array(F.lit(""), F.lit("x")), F.array().cast("array<string>"), F.array(F.lit("view"), F.lit("Suspended: CAPTCHA"), F.lit("more")))).when(q % 4 == 2, F.array().cast("array<array<string>>"))
    rows = _events(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("results"))
    json = F.to_json(F.struct("results", failed.alias("unresponsive_engines")))
    return rows.select("query_id", F.when(q % 17 == 3, F.concat(F.lit("<html>"), json)).otherwise(json).alias("json"))


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY event_id) AS merged_rank FROM {_E})"
_CREDITS = f"""SELECT query_id, merged_rank, event_id, unnest(engines) AS engine, unnest(range(len(engines))) AS i, len(engines) = 1 AS sole, CASE event_id % 4 WHEN 1 THEN [event_id % 9 + 1] WHEN 2 THEN [event_id % 9 + 1, event_id % 7 + 1] ELSE [] END AS pos
  FROM (SELECT *, CASE WHEN event_id % 5 = 0 OR (event_id % 5 <> 1 AND event_id % 11 = 4) THEN CASE WHEN event_id % 10 <> 0 THEN [event_type] ELSE [] END WHEN event_id % 5 = 1 THEN [event_type] ELSE [event_type, other] END AS engines FROM {_RANKED}) WHERE query_id % 17 <> 3"""


@query("search_credits", f"SELECT query_id, engine, coalesce(pos[i + 1], 0)::INT AS position, merged_rank::INT AS merged_rank, 'https://e.example/' || event_id % 50 AS url, (event_id % 13) / 4 AS score, sole FROM ({_CREDITS})")
def search_credits(spark, sf_dir):
    """Every engine that gave a hit with its own position, padded where the answer tells too few."""
    return hits.credits(hits.hits(_answers(spark, sf_dir)))


@query("search_failures", f"""SELECT query_id, engine, message, CASE message WHEN 'timeout' THEN 'timeout' WHEN '' THEN 'unknown' ELSE 'captcha' END AS class FROM (SELECT DISTINCT query_id FROM {_E} WHERE query_id % 17 <> 3),
  (VALUES (0, 'click', 'timeout'), (0, 'view', ''), (1, 'view', 'Suspended: CAPTCHA')) v(k, engine, message) WHERE query_id % 4 = k""")
def search_failures(spark, sf_dir):
    """The engines that answers report as failed; nameless pairs are left out."""
    return hits.failures(_answers(spark, sf_dir))


_LIMITS = "CASE query_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 500 WHEN 3 THEN -1 END"


@query("search_results", f"""SELECT query_id, merged_rank::INT AS merged_rank, 'Title ' || event_id AS title, 'https://e.example/' || event_id % 50 AS url, '' AS snippet, CASE WHEN event_id % 10 <> 0 THEN event_type ELSE '' END AS engine, '' AS published_date
  FROM {_RANKED} WHERE query_id % 17 <> 3 AND query_id % 23 NOT IN (1, 2, 3, 4) AND merged_rank <= least(CASE WHEN {_LIMITS} >= 1 THEN {_LIMITS} ELSE 10 END, 20)""")
def search_results(spark, sf_dir):
    """Requests (declared by search: limits of all kinds, some bodies refused) answered with their first hits, twenty at most."""
    return hits.results(hits.requests(_bodies(spark, sf_dir), 20), hits.hits(_answers(spark, sf_dir)))


def _bodies(spark, sf_dir) -> DataFrame:
    q = F.col("query_id")
    limit = F.when(q % 5 == 0, 3).when(q % 5 == 1, 0).when(q % 5 == 2, 500).when(q % 5 == 3, -1)
    body = F.to_json(F.struct(F.when(q % 23 != 1, F.concat(F.lit("query "), q.cast("string"))).alias("query"), limit.alias("limit"), F.when(q % 23 == 2, "decade").when(q % 2 == 0, "week").alias("time_range"), F.when(q % 23 == 3, "a b.com").when(q % 3 == 0, "reddit.com").alias("site"), F.lit(True).alias("extra")))
    rows = _events(spark, sf_dir).select("query_id").distinct()
    return rows.select(q.alias("request_id"), F.when(q % 23 == 4, F.concat(F.lit("<"), body)).otherwise(body).alias("json"))


@query("search_requests", f"""SELECT query_id AS request_id, CASE query_id % 23 WHEN 4 THEN 'invalid JSON body' WHEN 1 THEN 'query is required' WHEN 2 THEN 'time_range must be one of: day, week, month, year' WHEN 3 THEN 'site must be a bare hostname, e.g. reddit.com' END AS error,
  CASE WHEN query_id % 23 = 4 THEN NULL WHEN {_LIMITS} >= 1 THEN least({_LIMITS}, 20) ELSE 10 END::INT AS "limit", CASE WHEN query_id % 23 NOT IN (1, 4) THEN CASE WHEN query_id % 23 = 3 THEN 'site:a b.com ' WHEN query_id % 3 = 0 THEN 'site:reddit.com ' ELSE '' END || 'query ' || query_id END AS query
  FROM (SELECT DISTINCT query_id FROM {_E})""")
def search_requests(spark, sf_dir):
    """Request bodies as options, or why they are refused."""
    rows = hits.requests(_bodies(spark, sf_dir), 20)
    bad = F.col("error") == "invalid JSON body"
    return rows.select("request_id", "error", F.when(~F.coalesce(bad, F.lit(False)), F.col("limit")).alias("limit"), F.when(~F.coalesce(F.col("error").isin("invalid JSON body", "query is required"), F.lit(False)), F.col("query")).alias("query"))


_FORMS = "['Oct 5, 2026', (event_id % 9 + 1) || ' days ago', 'yesterday', '2026-0' || (event_id % 9 + 1) || '-02', (event_id % 70) || ' hours ago']"


@query("dated_results", f"""WITH r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY event_id)::INT AS merged_rank, event_id, ({_FORMS})[event_id % 5 + 1] AS d FROM {_E})
SELECT query_id, merged_rank, 'T' || event_id AS title, 'https://e.example/' || event_id AS url, 'backup' AS engine, CASE event_id % 5 WHEN 0 THEN '2026-10-05T00:00:00Z' WHEN 3 THEN d || 'T00:00:00Z'
  WHEN 1 THEN strftime(date_trunc('minute', TIMESTAMP '2026-11-26 12:34:56' - INTERVAL 1 DAY * (event_id % 9 + 1)), '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN strftime(date_trunc('minute', TIMESTAMP '2026-11-26 12:34:56' - INTERVAL 1 HOUR * (event_id % 70)), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS published_date FROM r""")
def dated_results(spark, sf_dir):
    """Answers of a search whose hits have dates in words (declared by event_id), at a fixed time."""
    n = F.col("event_id")
    said = (
        F.when(n % 5 == 0, "Oct 5, 2026").when(n % 5 == 1, F.concat((n % 9 + 1).cast("string"), F.lit(" days ago"))).when(n % 5 == 2, "yesterday")
        .when(n % 5 == 3, F.concat(F.lit("2026-0"), (n % 9 + 1).cast("string"), F.lit("-02"))).otherwise(F.concat((n % 70).cast("string"), F.lit(" hours ago")))
    )
    hit = F.struct(n.alias("n"), F.concat(F.lit("T"), n.cast("string")).alias("title"), F.concat(F.lit("https://e.example/"), n.cast("string")).alias("url"), said.alias("date"))
    answers = _events(spark, sf_dir).groupBy("query_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(hit)).alias("results"))).alias("json"))
    return hits.dated(answers, "backup", F.lit("2026-11-26 12:34:56").cast("timestamp")).drop("snippet")


@query("first_hits", f"""SELECT query_id, event_id, rank::INT AS rank, 3 AS lim FROM (SELECT query_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, event_id) AS rank FROM {_E}) WHERE rank <= 3
  UNION ALL SELECT query_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, event_id)::INT, 0 FROM {_E}""")
def first_hits(spark, sf_dir):
    """Each search's events by value, three of them, and all of them where the limit is none."""
    rows = _events(spark, sf_dir).select("query_id", "event_id", "value")
    both = [ranking.top_rows(rows, ["query_id"], [F.desc("value"), "event_id"], n).drop("value").withColumn("lim", F.lit(n)) for n in (3, 0)]
    return both[0].unionByName(both[1])
