"""Ranked results: merging two rankings, credits of engines, degradation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import engine_error
from ..functions.urls import merge_key
from .asof import counts_before


def interleave(primary: DataFrame, backup: DataFrame, limit: int = 0) -> DataFrame:
    """Two rankings (query_id, rank from 1, url, others alike) as one: primary first, then in turn, each page once.

    A page is known by its merge key, within one ranking too; limit <= 0 keeps all. Gives rank and source anew.
    """
    rows = primary.withColumn("source", F.lit(0)).unionByName(backup.withColumn("source", F.lit(1)))
    rows = rows.withColumn("ord", F.col("rank") * 2 + F.col("source"))
    once = Window.partitionBy("query_id", F.coalesce(merge_key(F.col("url")), F.lit(""))).orderBy("ord")
    rows = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).drop("nth", "ord")
    return rows.where(F.col("rank") <= limit) if limit > 0 else rows


def first_seen(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """Distinct by first occurrence (A22): an aggregate, so a key with very many rows is reduced before it is shuffled."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__first")).select("__first.*")


def top_rows(rows: DataFrame, by: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first `limit` rows of each group with their rank (W1, O3); limit <= 0 keeps all."""
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return rows.where(F.col("rank") <= limit) if limit > 0 else rows


def with_rest(rows: DataFrame, by: str, order: list[Column | str], label: str, limit: int) -> DataFrame:
    """The first rows of each group, and one `… N more` row for the others."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("all", F.count("*").over(Window.partitionBy(by)))
    more = F.concat(F.lit("… "), (F.col("all") - limit).cast("string"), F.lit(" more"))
    return ranked.where(F.col("rank") <= limit + 1).select(by, "rank", F.when(F.col("rank") <= limit, F.col(label)).otherwise(more).alias(label))


def engine_rows(hits: DataFrame) -> DataFrame:
    """Rows and sole rows of each engine, every credited engine counted (A1, A5). hits: engines (array)."""
    sole = (F.size("engines") == 1).cast("int").alias("sole")
    each = hits.select(F.explode("engines").alias("engine"), sole)
    return each.groupBy("engine").agg(F.count("*").alias("n_rows"), F.sum("sole").alias("n_sole"))


def failed_engines(failures: DataFrame) -> DataFrame:
    """Failures by engine and class (A3). failures: engine, message."""
    return failures.groupBy("engine", engine_error(F.col("message")).alias("class")).agg(F.count("*").alias("n"))


def silent_engines(searches: DataFrame, rows: DataFrame, failures: DataFrame, width: int) -> DataFrame:
    """engine, n_silent: searches that gave rows, but none of an engine that was known by then and did not fail openly.

    searches: query_id, at (a number; with query_id the order of the answers); rows, failures: query_id, engine. An engine
    is known from the first search on that names it, be it by a row or by a failure. It is silent in all searches with rows from
    there on but for those that name it, so searches are counted before each engine's first one (stretches
    of `width`) and never paired with engines.
    """
    keys = ["query_id", "engine"]
    named = rows.select(*keys).unionByName(failures.select(*keys)).where("engine <> ''").distinct()
    first = named.join(searches, "query_id").groupBy("engine").agg(F.min(F.struct("at", "query_id")).alias("first")).select("engine", "first.*")
    answered = searches.join(rows.select("query_id").distinct(), "query_id", "left_semi")
    before = counts_before(answered, first, "at", "query_id", width).select("engine", "before")
    met = named.join(answered, "query_id", "left_semi").groupBy("engine").agg(F.count("*").alias("met"))
    total = answered.agg(F.count("*").alias("n")).scalar()
    silent = total - F.col("before") - F.coalesce("met", F.lit(0))
    return before.join(met, "engine", "left").select("engine", silent.alias("n_silent")).where("n_silent > 0")


def degradation(critical: list[str], rows: DataFrame, failures: DataFrame, searches: DataFrame) -> DataFrame:
    """The first critical engine that is missing from each search, and why.

    critical: engines in their order; rows: query_id, engine; failures: query_id, engine, message; searches: query_id.
    """
    keys = ["query_id", "engine"]
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    # of several reports of one engine the last counts
    why = failures.groupBy(*keys).agg(F.max("message").alias("message"), F.lit(True).alias("failed"))
    want = F.posexplode(F.array(*[F.lit(e) for e in critical])).alias("pos", "engine")
    grid = searches.select("query_id", want).join(n, keys, "left").join(why, keys, "left")
    reason = F.when(F.col("failed"), F.concat("engine", F.lit(": "), engine_error(F.col("message")))).when(F.coalesce("n", F.lit(0)) == 0, F.concat("engine", F.lit(": no results")))
    missing = grid.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("query_id").agg(F.min_by("reason", "pos").alias("reason"))
    return searches.join(missing, "query_id", "left").select("query_id", F.coalesce("reason", F.lit("")).alias("reason"))
