"""Logs and metrics: counters, histograms, gauges, percentiles, trailing counts and onsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exponential_bounds(start: float, factor: float, n: int) -> list[float]:
    return [start * factor**i for i in range(n)]


def linear_bounds(start: float, width: float, n: int) -> list[float]:
    return [start + width * i for i in range(n)]


def histogram(rows: DataFrame, by: list[str], value: Column, bounds: Sequence[float]) -> DataFrame:
    """Cumulative buckets of each group: le (null is +Inf), n; with sum and count (A7, A8). One pass, no join with the bounds."""
    sums = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = rows.groupBy(*by).agg(*sums, F.count(value).alias("count"), F.sum(value).alias("sum"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("count").alias("n")))
    return one.select(*by, "count", "sum", F.explode(F.array(*cells)).alias("c")).select(*by, "c.le", "c.n", "count", "sum")


def last_values(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Gauge: the value set last (A10)."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("last"))


#: Accuracy of the approximate quantiles that bracket an exact one: ranks within n / ACCURACY.
ACCURACY = 1000


def _near(rows: DataFrame, by: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """by, place, value, upto, n: the values around each place asked for, with the rows of their group up to and with them.

    places: names and shares of the way from the least value to the largest. Nulls don't count. Approximate quantiles a little before and
    behind a place bracket it; then rows before the bracket are counted, and only the values within are put in order, a few
    thousandths of a group (all of it if it has no more than ACCURACY rows).
    """
    margin = 4 / ACCURACY
    there = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    ends = [min(1.0, max(0.0, q + side)) for q in places.values() for side in (-margin, margin)]
    bounds = there.groupBy(*by).agg(F.percentile_approx("__v", ends, ACCURACY).alias("__ends"), F.count("*").alias("n"))
    small = F.col("n") <= ACCURACY
    asked = F.array(*[F.struct(F.lit(p).alias("place"), F.when(~small, F.get("__ends", F.lit(2 * i))).alias("low"), F.when(~small, F.get("__ends", F.lit(2 * i + 1))).alias("high")) for i, p in enumerate(places)])
    each = there.join(bounds.select(*by, "n", asked.alias("__asked")), by).select(*by, "n", "__v", F.explode("__asked").alias("p")).where("p.high IS NULL OR __v <= p.high")
    # what is below the bracket is one row
    held = F.when(F.col("p.low").isNull() | (F.col("__v") >= F.col("p.low")), F.col("__v"))
    counts = each.groupBy(*by, F.col("p.place").alias("place"), held.alias(value)).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(*by, "place").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).where(F.col(value).isNotNull()).drop("c")


def indexed_percentile(rows: DataFrame, by: list[str], value: str, q: float, rule: str) -> DataFrame:
    """A percentile that is one of the values: rule `near` takes round-half-even(q (n-1)) (A16), `floor` int(n q), n-1 at most."""
    n = F.col("n")
    at = (F.bround(F.lit(q) * (n - 1)) if rule == "near" else F.least(n - 1, F.floor(n * F.lit(q)))).cast("long")
    return _near(rows, by, value, {"at": q}).where(F.col("upto") > at).groupBy(*by).agg(F.min(value).alias("percentile"))


def linear_percentiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation between the two nearest values (A15), a column for each name of qs."""
    n, v = F.col("n"), F.col(value).cast("double")
    ends = []
    for name, q in qs.items():
        place, own = F.lit(q) * (n - 1), F.col("place") == name
        for side, at in (("a", F.floor(place)), ("z", F.ceil(place))):
            ends.append(F.min(F.when(own & (F.col("upto") > at), v)).alias(f"{name}_{side}"))
        ends.append(F.max(place - F.floor(place)).alias(f"{name}_w"))
    found = _near(rows, by, value, qs).groupBy(*by).agg(*ends)
    c = F.col
    return found.select(*by, *(F.round(c(f"{x}_a") + (c(f"{x}_z") - c(f"{x}_a")) * c(f"{x}_w"), 6).alias(x) for x in qs))


def trailing_count(rows: DataFrame, by: str, seconds: str, width: int, include_now: bool) -> DataFrame:
    """Events of the same key in [t - width, t) (W8), or [t - width, t] with peers (W9), as column `load`."""
    w = Window.partitionBy(by).orderBy(seconds)
    until = F.count("*").over(w.rangeBetween(-width, 0))
    peers = F.count("*").over(w.rangeBetween(0, 0))
    return rows.withColumn("load", until if include_now else until - peers)


def onsets(rows: DataFrame, by: str, seconds: str, gap: int, tie: str) -> DataFrame:
    """Events after more than `gap` seconds of quiet, and each key's first (W7). Of events at one instant the one with the smallest `tie` comes first."""
    before = F.lag(seconds).over(Window.partitionBy(by).orderBy(seconds, tie))
    return rows.withColumn("quiet", F.col(seconds) - before).where(F.col("quiet").isNull() | (F.col("quiet") > gap)).drop("quiet")


def load_before(events: DataFrame, log: DataFrame, by: str, seconds: str, width: int) -> DataFrame:
    """Rows of another log in [t - width, t) before each event (J10): a union and one window, no range join."""
    both = events.withColumn("is_log", F.lit(0)).unionByName(log.select(by, seconds).withColumn("is_log", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(seconds)
    load = F.sum("is_log").over(w.rangeBetween(-width, 0)) - F.sum("is_log").over(w.rangeBetween(0, 0))
    return both.withColumn("load", load).where("is_log = 0").drop("is_log")


def presence_by_load(rows: DataFrame, by: str, seconds: str, width: int, present: Column, bounds: Sequence[int], tie: str) -> DataFrame:
    """Share of rows with a property by the number of rows before them within `width`.

    Rows before are those earlier in (time, tie) order, so ties of time that stand before count.
    """
    w = Window.partitionBy(by).orderBy(seconds, tie)
    n = F.row_number().over(w) - 1
    old = F.count("*").over(Window.partitionBy(by).orderBy(seconds).rangeBetween(Window.unboundedPreceding, -width - 1))
    load = n - old
    bucket = F.when(load < bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        bucket = bucket.when(load < b, i)
    rows = rows.withColumn("bucket", bucket.otherwise(len(bounds)))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(present).alias("n_present")).withColumn("share", F.round(F.col("n_present") / F.col("n"), 4))
