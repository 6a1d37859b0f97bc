"""Event time: sessions, windows and interval joins. The same functions take a table or a stream.

A stream is told how late its rows may come: state that no row can change any more goes, later rows are left out, and in append
mode a session, a window or a row without a partner comes out as soon as it is settled. Of a table nothing is late.
These go beyond the service that the library follows, which knows processing time alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_time(rows: DataFrame, at: str, late: str | None) -> DataFrame:
    """A stream's rows with their watermark, `late` behind the latest time seen; a table as it is."""
    return rows.withWatermark(at, late) if late and rows.isStreaming else rows


def sessions(rows: DataFrame, by: list[str], at: str, gap: str | Column, measures: dict[str, Column], late: str | None = None) -> DataFrame:
    """by, start, stop and the measures of each session: rows of a key that are no more than `gap` apart.

    stop is the last row's time plus the gap. gap may be a column, so that kinds of events end at different times; a row
    with a null time or gap belongs to no session.
    """
    grouped = on_time(rows, at, late).groupBy(*by, F.session_window(at, gap).alias("w"))
    return grouped.agg(*[m.alias(n) for n, m in measures.items()]).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *measures)


def windows(rows: DataFrame, by: list[str], at: str, width: str, slide: str | None, measures: dict[str, Column], late: str | None = None) -> DataFrame:
    """by, start, stop and the measures of each window: tumbling, or every `slide` (a row is then in several)."""
    grouped = on_time(rows, at, late).groupBy(*by, F.window(at, width, slide).alias("w"))
    return grouped.agg(*[m.alias(n) for n, m in measures.items()]).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *measures)


def once(rows: DataFrame, ids: list[str], at: str, late: str) -> DataFrame:
    """Rows by their ids once: of a stream, repeats that come within `late` of the first go; of a table, all repeats."""
    return on_time(rows, at, late).dropDuplicatesWithinWatermark(ids) if rows.isStreaming else rows.dropDuplicates(ids)


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, within: int, how: str = "inner", late: str | None = None) -> DataFrame:
    """Left rows with the right rows of their key from the same instant up to `within` seconds later; how: inner or left_outer.

    The key alone would bring all rows of a busy key together. Time is cut into buckets of `within` seconds and the bucket is part of the key:
    a right row stands in its own bucket and the one before, so each pair meets exactly once and no task holds more than a key's bucket. Right
    columns other than the key come out with `right_` in front.
    """
    width = within * 1_000_000
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(width)).cast("long")
    a = on_time(left, at, late).withColumn("__bucket", bucket(F.col(at))).alias("a")
    there = on_time(right, at, late)
    there = there.select(*[F.col(c).alias(f"right_{c}") for c in there.columns])
    there = there.withColumn("__at", bucket(F.col(f"right_{at}"))).withColumn("__bucket", F.explode(F.array(F.col("__at"), F.col("__at") - 1))).drop("__at").alias("b")
    near = F.expr(f"a.__bucket = b.__bucket AND b.right_{at} >= a.{at} AND b.right_{at} <= a.{at} + INTERVAL {within} SECOND")
    for k in by:
        near = near & (F.col(f"a.{k}") == F.col(f"b.right_{k}"))
    others = [f"right_{c}" for c in right.columns if c not in by]
    return a.join(there, near, how).select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in others])


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives in append mode for all that its source holds now, as a table. Rows and state lie in `folder`; a second call goes on from there."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
