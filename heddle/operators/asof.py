"""As-of joins and counts before an instant: unions and running windows, cut by time so that no key is one task's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str], width: int) -> DataFrame:
    """Left rows with the columns `take` of their key's latest right row at or before them; null where there is none.

    at: a number. Of right rows of one instant the one with the largest `take` counts. A null key is a key like any other.
    Time is cut into stretches of `width`: within a stretch a running last value finds the right row, and what a stretch
    starts with is carried over from the stretches before, one row each. So a busy key is shared out by stretches.
    """
    bucket = F.floor(F.col(at) / F.lit(width)).cast("long").alias("__bucket")
    seen = right.select(*by, bucket, F.col(at).alias("__at"), F.struct(*take).alias("__took"))
    last = seen.groupBy(*by, "__bucket").agg(F.max_by("__took", F.struct("__at", "__took")).alias("__end"))
    asked = left.select(*[F.col(c) for c in left.columns], bucket, F.col(at).alias("__at"), F.lit(None).cast(seen.schema["__took"].dataType).alias("__took"), F.lit(True).alias("__asked"))
    both = asked.unionByName(seen, allowMissingColumns=True)
    # right rows of the same instant come first
    running = Window.partitionBy(*by, "__bucket").orderBy("__at", F.col("__asked").asc_nulls_first(), "__took").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("__within", F.last("__took", ignorenulls=True).over(running)).where("__asked")
    stretches = asked.select(*by, "__bucket").distinct().withColumn("__end", F.lit(None).cast(last.schema["__end"].dataType)).unionByName(last)
    stretches = stretches.groupBy(*by, "__bucket").agg(F.max("__end").alias("__end"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(*by, "__bucket", F.last("__end", ignorenulls=True).over(before).alias("__carried")).where("__carried IS NOT NULL").alias("c")
    same = F.lit(True)
    for k in [*by, "__bucket"]:
        same = same & F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}"))
    found = F.coalesce(F.col("w.__within"), F.col("c.__carried"))
    return within.alias("w").join(carried, same, "left").select(*[F.col(f"w.{c}") for c in left.columns], *[found[c].alias(c) for c in take])


def counts_before(log: DataFrame, asked: DataFrame, at: str, tie: str, width: int) -> DataFrame:
    """Rows of `asked` with `before`, the number of log rows strictly before them by (at, tie).

    Counted within stretches of `width` and added to the sum of the stretches before, so that an order over all rows
    needs no task of its own; only the stretches' sums, a number each, are put in order by one.
    """
    both = log.select(at, tie, F.lit(1).alias("__log")).unionByName(asked.withColumn("__log", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("__bucket", F.floor(F.col(at) / F.lit(width)).cast("long"))
    sums = both.groupBy("__bucket").agg(F.sum("__log").alias("n"))
    offsets = sums.select("__bucket", F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("__upto"))
    # a log row at the very place of an asked one isn't before it
    running = Window.partitionBy("__bucket").orderBy(at, tie, "__log").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("__here", F.sum("__log").over(running)).where("__log = 0")
    return counted.join(offsets, "__bucket").select(*asked.columns, (F.col("__here") + F.coalesce("__upto", F.lit(0))).alias("before"))
