"""Queries over the event log: event_type stands for an engine, value for a latency, user_id for a host, `error` for a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs
from ..sources.tables import table
from ..streaming import folds, metrics
from .registry import query


def _events(spark, sf_dir) -> DataFrame:
    # from the wall-clock time, so the session's time zone doesn't matter
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return table(spark, sf_dir, "events").withColumn("us", us).withColumn("s", F.floor(F.col("us") / 1000000))


_E = "(SELECT *, epoch_us(ts) // 1000000 AS s, epoch_us(ts) AS us FROM events)"
_BOUNDS = logs.exponential_bounds(0.05, 2, 14)


@query("counters", "SELECT event_type, user_id % 7 AS shard, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY 1, 2")
def counters(spark, sf_dir):
    """Counters by labels."""
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("shard")).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("latency_histogram", f"""SELECT event_type, le, count(CASE WHEN le IS NULL OR value <= le THEN 1 END) AS n, count(*) AS count, round(sum(value), 4) AS sum FROM events, (SELECT unnest([{', '.join(map(str, _BOUNDS))}, NULL]) AS le) GROUP BY 1, 2""")
def latency_histogram(spark, sf_dir):
    """Cumulative exponential buckets."""
    h = logs.histogram(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), _BOUNDS)
    return h.select("event_type", "le", "n", "count", F.round("sum", 4).alias("sum"))


@query("exposed_counters", "SELECT 'events_total{event_type=\"' || event_type || '\",shard=\"' || shard || '\"} ' || n AS line FROM (SELECT event_type, user_id % 7 AS shard, count(*) AS n FROM events GROUP BY 1, 2)")
def exposed_counters(spark, sf_dir):
    """Counters by labels as the lines that a scraper reads."""
    rows = table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 7)
    return metrics.exposition(metrics.counter(rows, ["event_type", "shard"]), "events_total", ["event_type", "shard"])


@query("linear_histogram", "SELECT le, count(CASE WHEN le IS NULL OR k <= le THEN 1 END) AS n FROM (SELECT user_id % 12 AS k FROM events), (SELECT unnest([0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, NULL]) AS le) GROUP BY 1")
def linear_histogram(spark, sf_dir):
    """Cumulative linear buckets."""
    h = logs.histogram(table(spark, sf_dir, "events"), [], F.col("user_id") % 12, logs.linear_bounds(0, 5, 9))
    return h.select("le", "n")


@query("uncached_latency", "SELECT event_type, count(*) AS calls, count(CASE WHEN event_id % 4 = 0 THEN 1 END) AS hits, round(avg(value) FILTER (event_id % 4 <> 0), 6) AS mean FROM events GROUP BY 1")
def uncached_latency(spark, sf_dir):
    """Cache hits (declared: every fourth event) count as calls and not in the latency."""
    hit = F.col("event_id") % 4 == 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(hit).alias("hits"), F.round(F.avg(F.when(~hit, F.col("value"))), 6).alias("mean"))


@query("gauges", "SELECT user_id, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1")
def gauges(spark, sf_dir):
    """A10: the value set last."""
    return logs.last_values(table(spark, sf_dir, "events"), ["user_id"], "value", ["ts", "event_id"])


@query("engine_summaries", "SELECT user_id, string_agg(event_type || '=' || n, ', ' ORDER BY event_type) AS engines FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def engine_summaries(spark, sf_dir):
    """Counts as one text, by name."""
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pair = F.struct("event_type", F.concat("event_type", F.lit("="), F.col("n").cast("string")).alias("t"))
    return each.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["t"]), ", ").alias("engines"))


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    """Percentiles by linear interpolation."""
    return logs.linear_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("near_percentiles", "SELECT event_type, value AS percentile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = round_even(0.9 * (n - 1), 0)::BIGINT")
def near_percentiles(spark, sf_dir):
    """Percentiles at the nearest index, halves to even."""
    return logs.indexed_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.9, "near")


@query("floor_percentiles", "SELECT event_type, value AS percentile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(n - 1, floor(n * 0.9))")
def floor_percentiles(spark, sf_dir):
    """Percentiles at the floored index."""
    return logs.indexed_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.9, "floor")


@query("daily_shares", "SELECT ts::DATE::VARCHAR AS day, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_errors, round(count(CASE WHEN event_type = 'error' THEN 1 END) / count(*), 4) AS share FROM events GROUP BY 1")
def daily_shares(spark, sf_dir):
    """Counts and shares by day."""
    bad = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), bad.alias("n_errors"), F.round(bad / F.count("*"), 4).alias("share"))


@query("presence_by_load", f"""WITH w AS (SELECT event_type, (SELECT count(*) FROM {_E} o WHERE o.user_id = e.user_id AND (o.s, o.event_id) < (e.s, e.event_id) AND o.s >= e.s - 86400) AS load FROM {_E} e)
SELECT CASE WHEN load < 1 THEN 0 WHEN load < 2 THEN 1 WHEN load < 4 THEN 2 ELSE 3 END AS bucket, count(*) AS n, count(CASE WHEN event_type <> 'error' THEN 1 END) AS n_present, round(count(CASE WHEN event_type <> 'error' THEN 1 END) / count(*), 4) AS share FROM w GROUP BY 1""")
def presence_by_load(spark, sf_dir):
    """Share of successes by the load of the day before."""
    return logs.presence_by_load(_events(spark, sf_dir), "user_id", "s", 86400, F.col("event_type") != "error", (1, 2, 4), "event_id")


@query("busiest_windows", f"SELECT user_id, max(c1) AS per_hour, max(c2) AS per_day FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS c1, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS c2 FROM {_E}) GROUP BY 1")
def busiest_windows(spark, sf_dir):
    """Most events in any trailing hour and day, both ends counted."""
    rows = logs.trailing_count(_events(spark, sf_dir), "user_id", "s", 3600, True).withColumnRenamed("load", "c1")
    return logs.trailing_count(rows, "user_id", "s", 86400, True).groupBy("user_id").agg(F.max("c1").alias("per_hour"), F.max("load").alias("per_day"))


@query("loads_before", f"SELECT event_id, (SELECT count(*) FROM {_E} o WHERE o.user_id = e.user_id AND o.s >= e.s - 21600 AND o.s < e.s) AS load FROM {_E} e")
def loads_before(spark, sf_dir):
    """Events in the six hours before, the same instant left out."""
    return logs.trailing_count(_events(spark, sf_dir), "user_id", "s", 21600, False).select("event_id", "load")


@query("load_of_errors", f"SELECT event_id, (SELECT count(*) FROM {_E} o WHERE o.event_type <> 'error' AND o.user_id = e.user_id AND o.s >= e.s - 43200 AND o.s < e.s) AS load FROM {_E} e WHERE event_type = 'error'")
def load_of_errors(spark, sf_dir):
    """Other events in the twelve hours before each error."""
    rows = _events(spark, sf_dir).select("event_id", "event_type", "user_id", "s")
    return logs.load_before(rows.where("event_type = 'error'"), rows.where("event_type <> 'error'"), "user_id", "s", 43200).select("event_id", F.col("load").cast("long").alias("load"))


@query("onsets", f"SELECT user_id, count(*) AS n_onsets, min(event_id) AS first FROM (SELECT user_id, event_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM {_E}) WHERE gap IS NULL OR gap > 900 GROUP BY 1")
def onsets(spark, sf_dir):
    """Events after more than 900 seconds of quiet."""
    return logs.onsets(_events(spark, sf_dir), "user_id", "s", 900, "event_id").groupBy("user_id").agg(F.count("*").alias("n_onsets"), F.min("event_id").alias("first"))


_HOUR = 3_600_000_000


@query("quota_admissions", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {_E}),
b(user_id, k, event_id, admitted, sent) AS (SELECT user_id, k, event_id, us, [us] FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, event_id, a, list_append(live, a) FROM (SELECT e.user_id, e.k, e.event_id, list_filter(b.sent, lambda t: t > e.us - {72 * _HOUR}) AS live,
    CASE WHEN len(list_filter(b.sent, lambda t: t > e.us - {72 * _HOUR})) >= 3 THEN greatest(e.us, list_filter(b.sent, lambda t: t > e.us - {72 * _HOUR})[-3] + {72 * _HOUR}) ELSE e.us END AS a FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1))
SELECT event_id, admitted FROM b""")
def quota_admissions(spark, sf_dir):
    """Three admissions in any 72 hours, booked ahead."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us")
    return folds.fold(rows, "user_id", ["us", "event_id"], lambda: folds.RollingQuota(3, 72 * _HOUR), ["us"]).select("event_id", "admitted")


@query("refused_calls", f"""WITH RECURSIVE e AS (SELECT user_id, us, event_id % 9 = 0 AS held, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {_E}),
b(user_id, k, sent, hold, outcome) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], 0::BIGINT, '' FROM e
  UNION ALL SELECT user_id, k, CASE WHEN held THEN sent WHEN due - us > {24 * _HOUR} THEN live ELSE list_append(live, due) END, CASE WHEN held THEN greatest(hold, us + {6 * _HOUR}) ELSE hold END, CASE WHEN held THEN 'held' WHEN due - us > {24 * _HOUR} THEN 'quota_exhausted' ELSE 'sent' END
    FROM (SELECT *, CASE WHEN len(live) >= 3 THEN greatest(w, live[-3] + {72 * _HOUR}) ELSE w END AS due
      FROM (SELECT e.user_id, e.k, e.us, e.held, b.sent, b.hold, greatest(e.us, b.hold) AS w, list_filter(b.sent, lambda t: t > greatest(e.us, b.hold) - {72 * _HOUR}) AS live FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)))
SELECT user_id, outcome, count(*) AS n FROM b WHERE k > 0 GROUP BY 1, 2""")
def refused_calls(spark, sf_dir):
    """A quota with holds (declared: every ninth event), and refusals beyond a day's wait."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us", F.when(F.col("event_id") % 9 == 0, "hold").otherwise("call").alias("kind"), F.lit(6 * _HOUR).alias("amount"))
    out = folds.fold(rows, "user_id", ["us", "event_id"], lambda: folds.RollingQuota(3, 72 * _HOUR, 24 * _HOUR), ["us", "kind", "amount"])
    return out.groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


@query("cancelled_calls", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, us, event_id % 4 = 1 AS cancels, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {_E}),
b(user_id, k, event_id, sent, last, outcome, admitted) AS (SELECT DISTINCT user_id, 0::BIGINT, -1::BIGINT, []::BIGINT[], NULL::BIGINT, '', NULL::BIGINT FROM e
  UNION ALL SELECT user_id, k, event_id, CASE WHEN cancels THEN CASE WHEN list_contains(sent, last) THEN list_filter(sent, lambda t: t <> last) ELSE sent END ELSE list_append(live, due) END, CASE WHEN cancels THEN NULL ELSE due END, CASE WHEN NOT cancels THEN 'sent' WHEN list_contains(sent, last) THEN 'cancelled' ELSE 'unknown' END, CASE WHEN NOT cancels THEN due END
    FROM (SELECT *, CASE WHEN len(live) >= 3 THEN greatest(us, live[-3] + {72 * _HOUR}) ELSE us END AS due FROM (SELECT e.user_id, e.k, e.event_id, e.us, e.cancels, b.sent, b.last, list_filter(b.sent, lambda t: t > e.us - {72 * _HOUR}) AS live FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)))
SELECT event_id, outcome, admitted FROM b WHERE k > 0""")
def cancelled_calls(spark, sf_dir):
    """T5: callers that give up (declared: every fourth event cancels its user's call before it), whose bookings are withdrawn."""
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us", before.alias("amount"), F.when(F.col("event_id") % 4 == 1, "cancel").otherwise("call").alias("kind"), F.col("event_id").alias("call"))
    return folds.fold(rows, "user_id", ["us", "event_id"], lambda: folds.RollingQuota(3, 72 * _HOUR), ["us", "kind", "amount", "call"]).select("event_id", "outcome", "admitted")


@query("spaced_sends", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {_E}),
b(user_id, k, event_id, sent, wait) AS (SELECT user_id, k, event_id, us, 0::BIGINT FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id, greatest(e.us, b.sent + {5 * _HOUR}), greatest(e.us, b.sent + {5 * _HOUR}) - e.us FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT event_id, sent, wait FROM b""")
def spaced_sends(spark, sf_dir):
    """Sends at least five hours apart."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us")
    return folds.fold(rows, "user_id", ["us", "event_id"], lambda: folds.Spaced(5 * _HOUR), ["us"]).select("event_id", "sent", "wait")


@query("completion_spacing", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, us, trunc(value * 1000000)::BIGINT AS took, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {_E}),
b(user_id, k, event_id, sent, wait, done) AS (SELECT user_id, k, event_id, us, 0::BIGINT, us + took FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, event_id, s, s - us, s + took FROM (SELECT e.*, greatest(e.us, b.done + {5 * _HOUR}) AS s FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1))
SELECT event_id, sent, wait FROM b""")
def completion_spacing(spark, sf_dir):
    """A least delay from the last completion (values stand for seconds), without jitter."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us", (F.col("value") * 1000000).cast("long").alias("took"))
    return folds.fold(rows, "user_id", ["us", "event_id"], lambda: folds.Spaced(5 * _HOUR, True), ["us", "took"]).select("event_id", "sent", "wait")


@query("cache_outcomes", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, us, event_id % 10 = 0 AS bypass, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {_E}),
b(user_id, k, event_id, outcome, stored) AS (SELECT user_id, k, event_id, CASE WHEN bypass THEN 'bypass' ELSE 'miss' END, us FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.bypass THEN 'bypass' WHEN e.us - b.stored < {24 * _HOUR} THEN 'hit' ELSE 'miss' END, CASE WHEN NOT e.bypass AND e.us - b.stored < {24 * _HOUR} THEN b.stored ELSE e.us END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT event_id, outcome, stored FROM b""")
def cache_outcomes(spark, sf_dir):
    """Hits and misses of a cache that keeps a day from the store; every tenth call goes past it."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us", (F.col("event_id") % 10 == 0).alias("bypass"))
    return folds.fold(rows, "user_id", ["us", "event_id"], lambda: folds.TtlCache(24 * _HOUR), ["us", "bypass"]).select("event_id", "outcome", "stored")


@query("lru_outcomes")
def lru_outcomes(spark, sf_dir):
    """A cache of 20 kB and thirty days over all keys: one order of all events, folded range by range."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us", (F.col("value") * 20).cast("long").alias("size"), (F.col("event_id") % 11 == 0).alias("refresh"))
    return folds.fold(rows, None, ["us", "event_id"], lambda: folds.LruBytes(20000, ttl=720 * _HOUR), ["user_id", "size", "us", "refresh"]).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("evicted").alias("evicted"))


@query("shared_flights", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, us, us + {24 * _HOUR} AS stop, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {_E}),
b(user_id, k, event_id, role, leader, until) AS (SELECT user_id, k, event_id, 'leader', event_id, stop FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.us < b.until THEN 'follower' ELSE 'leader' END, CASE WHEN e.us < b.until THEN b.leader ELSE e.event_id END, CASE WHEN e.us < b.until THEN b.until ELSE e.stop END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT event_id, role, leader FROM b""")
def shared_flights(spark, sf_dir):
    """Calls that share one under way (declared: each takes a day)."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us", (F.col("us") + 24 * _HOUR).alias("stop"))
    return folds.fold(rows, "user_id", ["us", "event_id"], folds.SingleFlight, ["us", "stop", "event_id"]).select("event_id", "role", "leader")


@query("method_holds", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, us, event_type = 'error' AND NOT (event_id % 3 = 0 AND event_id % 2 = 0) AS holds, event_type = 'error' AS failed, greatest({600_000_000}, trunc(value * {_HOUR})::BIGINT) AS length,
  row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {_E}),
b(user_id, k, allowed, until) AS (SELECT DISTINCT user_id, 0::BIGINT, true, 0::BIGINT FROM e
  UNION ALL SELECT e.user_id, e.k, e.us >= b.until, CASE WHEN holds THEN greatest(b.until, e.us + length) WHEN NOT failed AND e.us >= b.until THEN 0 ELSE b.until END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT user_id, allowed, count(*) AS n FROM b WHERE k > 0 GROUP BY 1, 2""")
def method_holds(spark, sf_dir):
    """Holds after failures, ten minutes at least (values stand for Retry-After in hours); every third failure is an upstream's, every second meets the last method."""
    n = F.col("event_id")
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us", (F.col("event_type") == "error").alias("failed"), (F.col("value") * _HOUR).cast("long").alias("after"), (n % 3 == 0).alias("upstream"), (n % 2 == 0).alias("last"))
    return folds.fold(rows, "user_id", ["us", "event_id"], lambda: folds.Holds(600_000_000), ["us", "failed", "after", "upstream", "last"]).groupBy("user_id", "allowed").agg(F.count("*").alias("n"))


@query("byte_budgets", """WITH RECURSIVE d AS (SELECT doc_id % 50 AS bundle, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS k FROM documents),
b(bundle, k, doc_id, kept, used) AS (SELECT bundle, k, doc_id, n_chars <= 30000, CASE WHEN n_chars <= 30000 THEN n_chars ELSE 0 END FROM d WHERE k = 1
  UNION ALL SELECT d.bundle, d.k, d.doc_id, b.used + d.n_chars <= 30000, CASE WHEN b.used + d.n_chars <= 30000 THEN b.used + d.n_chars ELSE b.used END FROM b JOIN d ON d.bundle = b.bundle AND d.k = b.k + 1)
SELECT doc_id, kept, used FROM b""")
def byte_budgets(spark, sf_dir):
    """Documents of a bundle (doc_id % 50) within 30,000 characters; what doesn't fit is skipped and later ones may fit."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 50).alias("bundle"))
    return folds.fold(rows, "bundle", ["doc_id"], lambda: folds.Budget(30000), ["n_chars"]).select("doc_id", "kept", "used")


@query("metrics_round_trip", """SELECT 'events_total' AS name, 'counter' AS type, event_type, (user_id % 7)::VARCHAR AS shard, count(*)::DOUBLE AS value FROM events GROUP BY ALL
  UNION ALL SELECT 'last_value', 'gauge', event_type, NULL, arg_max(value, (ts, event_id)) FROM events GROUP BY event_type""")
def metrics_round_trip(spark, sf_dir):
    """Counters and gauges written as scrapers read them, in one commit, and read back."""
    import uuid

    from ..sources import lines
    from ..sources.tables import shared_dir

    lines.register(spark)
    events = table(spark, sf_dir, "events")
    label = lambda **c: F.map_from_arrays(F.array(*[F.lit(k) for k in c]), F.array(*[x.cast("string") for x in c.values()]))
    counts = events.groupBy("event_type", (F.col("user_id") % 7).alias("shard")).agg(F.count("*").cast("double").alias("value"))
    counts = counts.select(F.lit("events_total").alias("name"), F.lit("counter").alias("type"), label(event_type=F.col("event_type"), shard=F.col("shard")).alias("labels"), "value")
    last = logs.last_values(events, ["event_type"], "value", ["ts", "event_id"]).select(F.lit("last_value").alias("name"), F.lit("gauge").alias("type"), label(event_type=F.col("event_type")).alias("labels"), F.col("last").alias("value"))
    path = f"{shared_dir(spark)}/m-{uuid.uuid4().hex}"
    counts.write.format("exposition").option("path", path).mode("overwrite").save()
    last.write.format("exposition").option("path", path).mode("append").save()
    back = spark.read.format("exposition").option("path", path).load()
    return back.select("name", "type", F.col("labels")["event_type"].alias("event_type"), F.try_element_at("labels", F.lit("shard")).alias("shard"), "value")


@query("benchmark_round_trip", """WITH r AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'miss' ELSE 'ok' END AS grade, (page_id % 40) / 8 AS seconds, length(html) AS chars FROM pages)
SELECT 'item' AS kind, NULL AS candidate, url, NULL AS grade, NULL::DOUBLE AS seconds, NULL::BIGINT AS chars, NULL::BIGINT AS n, NULL::BIGINT AS n_ok FROM pages
UNION ALL SELECT 'result', 'plain', url, grade, seconds, chars, NULL, NULL FROM r UNION ALL SELECT 'summary', 'plain', NULL, NULL, NULL, NULL, count(*), count(CASE WHEN grade = 'ok' THEN 1 END) FROM r""")
def benchmark_round_trip(spark, sf_dir):
    """Pages as a benchmark's items, results and summary (grades declared by page_id), lines of three kinds in one folder, and read back."""
    import uuid

    from ..sources import lines
    from ..sources.tables import shared_dir

    lines.register(spark)
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    items = pages.select("url", F.array(F.substring("html", 1, 9)).alias("phrases"))
    results = pages.select("url", F.lit("plain").alias("candidate"), F.when(n % 5 == 0, "miss").otherwise("ok").alias("grade"), (n % 40 / 8).alias("seconds"), F.length("html").cast("long").alias("chars"))
    summary = results.groupBy("candidate").agg(F.count("*").alias("n"), F.count_if(F.col("grade") == "ok").alias("n_ok"))
    path = f"{shared_dir(spark)}/b-{uuid.uuid4().hex}"
    for i, rows in enumerate((items, results, summary)):
        lines.full(rows).write.format("benchmark_lines").option("path", path).mode("append" if i else "overwrite").save()
    return spark.read.format("benchmark_lines").option("path", path).load().select("kind", "candidate", "url", "grade", "seconds", "chars", "n", "n_ok")
