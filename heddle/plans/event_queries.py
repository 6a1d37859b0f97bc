"""Queries over event time, as-of joins and stored sketches of the event log. All of them are extensions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, sketches
from ..sources.tables import shared_dir, table, written
from ..streaming import event_time
from .log_queries import _events
from .registry import query

_US = "epoch_us(ts)"
_DAY = 86_400_000_000


def _timed(spark, sf_dir) -> DataFrame:
    return _clocked(_events(spark, sf_dir))


def _clocked(events: DataFrame) -> DataFrame:
    """Events with their time as an instant, whatever the session's time zone."""
    return events.withColumn("at", F.timestamp_micros("us")).select("event_id", "user_id", "event_type", "value", "us", "at")


_SESSIONS = f"""WITH g AS (SELECT *, CASE WHEN {_US} - lag({_US}) OVER w <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, {_US.replace('ts', 'min(ts)')} AS start_us, {_US.replace('ts', 'max(ts)')} + 43200000000 AS stop_us, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS n_errors, round(max(value), 6) AS most FROM n GROUP BY user_id, k)"""


def _sessions(rows: DataFrame, late: str | None = None) -> DataFrame:
    measures = {"n": F.count("*"), "n_errors": F.count_if(F.col("event_type") == "error"), "most": F.round(F.max("value"), 6)}
    out = event_time.sessions(rows, ["user_id"], "at", "12 hours", measures, late)
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n", "n_errors", "most")


@query("sessions", f"{_SESSIONS} SELECT * FROM s")
def sessions(spark, sf_dir):
    """Each user's sessions, which half a day of quiet ends."""
    return _sessions(_timed(spark, sf_dir))


@query("closed_sessions", f"{_SESSIONS} SELECT * FROM s WHERE stop_us <= (SELECT max({_US}) FROM events) // 1000 * 1000 - 3600000000")
def closed_sessions(spark, sf_dir):
    """The same events read as a stream whose rows may come an hour late: the sessions that no further row could change."""
    whole = table(spark, sf_dir, "events")
    # as a pattern, so that the table may be one file or a folder of files
    stream = spark.readStream.schema(whole.schema).parquet(f"{sf_dir}/events.parque[t]")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return event_time.drained(_sessions(_clocked(stream.withColumn("us", us)), "1 hour"), f"{shared_dir(spark)}/s-{uuid.uuid4().hex}")


@query("sliding_windows", f"""SELECT event_type, w * 21600000000 AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, {_US} // 21600000000 - i AS w FROM events, (SELECT unnest([0, 1, 2, 3]) AS i)) GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    """Counts and means of each kind of event in every day that starts at 0, 6, 12 or 18 o'clock."""
    out = event_time.windows(_timed(spark, sf_dir), ["event_type"], "at", "24 hours", "6 hours", {"n": F.count("*"), "mean": F.round(F.avg("value"), 6)})
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n", "mean")


@query("followed_errors", f"""SELECT e.event_id, count(v.event_id) AS n_after, min({_US.replace('ts', 'v.ts')} - {_US.replace('ts', 'e.ts')}) AS first_after FROM (SELECT * FROM events WHERE event_type = 'error') e
  LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') v ON v.user_id = e.user_id AND v.ts >= e.ts AND {_US.replace('ts', 'v.ts')} <= {_US.replace('ts', 'e.ts')} + 21600000000 GROUP BY 1""")
def followed_errors(spark, sf_dir):
    """Each error with its user's other events in the six hours after it, none included."""
    rows = _timed(spark, sf_dir)
    both = event_time.interval_join(rows.where("event_type = 'error'"), rows.where("event_type <> 'error'"), ["user_id"], "at", 21600, "left_outer")
    return both.groupBy("event_id").agg(F.count("right_event_id").alias("n_after"), F.min(F.col("right_us") - F.col("us")).alias("first_after"))


@query("values_as_of", """SELECT e.event_id, v.event_id AS seen, v.value FROM (SELECT * FROM events WHERE event_type = 'error') e
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def values_as_of(spark, sf_dir):
    """What each error's user had viewed last by then."""
    rows = _timed(spark, sf_dir)
    views = rows.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("seen"), "value")
    return asof.as_of(rows.where("event_type = 'error'").select("event_id", "user_id", "us"), views, ["user_id"], "us", ["seen", "value"], 7 * _DAY).select("event_id", "seen", "value")


@query("merged_sketches", """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS levels_agree, true AS median_close FROM events GROUP BY 1""")
def merged_sketches(spark, sf_dir):
    """Hourly sketches, stored, merged to days and then to all, and to all at once; beside the exact figures (3 % of rank, 5 % of a count)."""
    rows = _timed(spark, sf_dir).withColumn("hour", F.expr("us div 3600000000"))
    hours = written(sketches.sketched(rows, ["event_type", "hour"], "user_id", "value"))
    days = sketches.merged(hours.withColumn("day", F.expr("hour div 24")), ["event_type", "day"])
    whole = sketches.merged(days, ["event_type"]).select("event_type", "n", "distinct", sketches.quantile(F.col("quantiles"), 0.5).alias("median"))
    direct = sketches.merged(hours, ["event_type"]).select("event_type", F.col("distinct").alias("d2"), F.col("n").alias("n2"))
    exact = rows.join(whole.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("rank"))
    e, u = sketches.distinct(F.col("distinct")), F.col("users")
    return whole.join(direct, "event_type").join(exact, "event_type").select(
        "event_type", "n", "users", (F.abs(e - u) <= F.greatest(u * 0.05, F.lit(1))).alias("users_close"),
        ((F.col("n") == F.col("n2")) & (F.abs(sketches.distinct(F.col("d2")) - e) <= F.greatest(u * 0.05, F.lit(1)))).alias("levels_agree"), (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_close"),
    )
