"""Counters and histograms of a stream: cumulative since its start, one row a change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.logs import histogram


def counter(rows: DataFrame, labels: list[str], amount: Column | None = None) -> DataFrame:
    """labels, total: events, or the sum of `amount`, by labels. For a stream write it in update mode."""
    return rows.groupBy(*labels).agg((F.count("*") if amount is None else F.sum(amount)).alias("total"))


def distribution(rows: DataFrame, labels: list[str], value: Column, bounds: Sequence[float]) -> DataFrame:
    """labels, le, n, count, sum: cumulative buckets by labels, all of a label set's when one changes. For a stream write it in update mode."""
    return histogram(rows, labels, value, bounds)


def exposition(totals: DataFrame, name: str, labels: list[str], value: str = "total") -> DataFrame:
    """line: each row as `name{label="value",...} number`, the text form that scrapers read."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = [F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels]
    return totals.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))
