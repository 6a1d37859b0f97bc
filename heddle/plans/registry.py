"""Where queries are registered, and helpers for writing their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir), with DuckDB SQL for the same rows if SQL can say it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def values(rows: list[tuple], names: str) -> str:
    """The rows as a VALUES table of DuckDB."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names})"


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The same rows as a DataFrame, for queries over cases that no table has."""
    return spark.createDataFrame(rows, schema)


def spread(rows: DataFrame, by: str, cases: list[tuple], schema: str) -> DataFrame:
    """Rows with the columns of a case each, declared by the number in `by`: what tables don't have, for as many rows as they have."""
    fixed = table_of(rows.sparkSession, [(i, *c) for i, c in enumerate(cases)], f"case_no long, {schema}")
    # a handful of cases
    return rows.join(F.broadcast(fixed), F.pmod(rows[by], F.lit(len(cases))) == F.col("case_no")).drop("case_no")


def spread_sql(table: str, by: str, cases: list[tuple], names: str) -> str:
    """The same in DuckDB."""
    return f"(SELECT s.*, c.* EXCLUDE (case_no) FROM {table} s JOIN {values([(i, *c) for i, c in enumerate(cases)], 'case_no, ' + names).replace(' AS t(', ' AS c(')} ON s.{by} % {len(cases)} = c.case_no)"
