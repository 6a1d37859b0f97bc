"""Sketches as stored columns: distinct counts and quantiles of small spans, merged into larger ones without the rows. An extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers' exponent of the distinct count (error of 1.04 / sqrt(2**P)), and the quantile sketch's accuracy.
P, K = 12, 200


def sketched(rows: DataFrame, by: list[str], counted: str, measured: str) -> DataFrame:
    """by, n, and as binary columns what a span knows: `distinct` of one column, `quantiles` of another (nulls left out)."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(counted, F.lit(P)).alias("distinct"), F.call_function("kll_sketch_agg_double", F.col(measured).cast("double"), F.lit(K)).alias("quantiles")
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The same columns for larger spans."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.call_function("kll_merge_agg_double", F.col("quantiles"), F.lit(K)).alias("quantiles"))


def distinct(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(sketch: Column, q: float) -> Column:
    return F.call_function("kll_sketch_get_quantile_double", sketch, F.lit(q))
