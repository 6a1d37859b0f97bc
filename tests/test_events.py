"""Event time in batches and streams, as-of joins, counts before an instant, sketches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import asof, ranking, sketches
from heddle.streaming import event_time

START = dt.datetime(2026, 1, 1)
ROWS = "id long, user string, at timestamp, kind string"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def streamed(spark, tmp_path, name, batches, schema, transform):
    """Rows of a stream that gets one file a batch, in order, and what its batches dropped as too late."""
    source = tmp_path / f"{name}-in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
        part = next((tmp_path / f"{name}-{i}").glob("*.parquet"))
        part.rename(source / f"{i}.parquet")
        # files are taken by their time
        os.utime(source / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = transform(stream)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    dropped = sum(o.numRowsDroppedByWatermark for p in run.recentProgress for o in p.stateOperators)
    return spark.read.schema(out.schema).parquet(str(tmp_path / f"{name}-out")).collect(), dropped


def by_user(rows, late=None):
    return event_time.sessions(rows, ["user"], "at", "10 minutes", {"n": F.count("*")}, late)


def test_sessions(spark):
    """A row exactly the gap after the last one belongs to its session; kinds may have gaps of their own; null times have none."""
    rows = [(1, "a", at(0), "x"), (2, "a", at(10), "x"), (3, "a", at(20.1), "x"), (4, "b", at(5), "x"), (5, "a", None, "x")]
    df = spark.createDataFrame(rows, ROWS)
    got = {(r["user"], r["start"], r["stop"], r["n"]) for r in by_user(df).collect()}
    assert got == {("a", at(0), at(20), 2), ("a", at(20.1), at(30.1), 1), ("b", at(5), at(15), 1)}
    gap = F.when(F.col("id") == 1, "5 minutes").otherwise("10 minutes")
    assert {r["n"] for r in event_time.sessions(df.where("user = 'a'"), ["user"], "at", gap, {"n": F.count("*")}).collect()} == {1}
    assert by_user(df.limit(0)).collect() == []


def test_streamed_sessions(spark, tmp_path):
    """Rows that come out of order but in time join their session, across batches; later ones are dropped; open sessions stay inside."""
    batches = [
        [(1, "a", at(0), "x"), (2, "b", at(3), "x")],
        [(3, "a", at(14), "x"), (4, "a", at(7), "x")],  # 7 ties 0 and 14 together
        [(5, "b", at(60), "x")],  # the watermark goes to 40, and late rows are told by it one batch on
        [(10, "b", at(61), "x")],
        [(6, "a", at(2), "x"), (7, "b", at(55), "x"), (8, "a", at(41), "x")],  # 2 is too late
        [(9, "c", at(200), "x")],
    ]
    got, dropped = streamed(spark, tmp_path, "sessions", batches, ROWS, lambda s: by_user(s, "20 minutes"))
    assert dropped == 1
    assert {(r["user"], r["start"], r["stop"], r["n"]) for r in got} == {("a", at(0), at(24), 3), ("b", at(3), at(13), 1), ("b", at(55), at(71), 3), ("a", at(41), at(51), 1)}
    on_time = [r for b in batches for r in b if r[0] != 6]
    whole = {(r["user"], r["start"], r["stop"], r["n"]) for r in by_user(spark.createDataFrame(on_time, ROWS)).collect()}
    assert {(r["user"], r["start"], r["stop"], r["n"]) for r in got} == {r for r in whole if r[0] != "c"}


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_interval_join(spark, tmp_path, how):
    """Pairs within the width, both ends counted, over bucket borders; the same from a stream with late rows."""
    rng = random.Random(4)
    width = 600
    lefts = [(i, rng.choice("ab"), at(rng.randrange(0, 400) / 2), "l") for i in range(60)] + [(100, "a", at(0), "l"), (101, "z", at(10), "l")]
    rights = [(i, rng.choice("ab"), at(rng.randrange(0, 400) / 2), "r") for i in range(60)] + [(100, "a", at(10), "r"), (101, "a", at(0), "r")]

    def want(ls, rs):
        pairs = {(x[0], y[0]) for x in ls for y in rs if x[1] == y[1] and 0 <= (y[2] - x[2]).total_seconds() <= width}
        return pairs if how == "inner" else pairs | {(x[0], None) for x in ls if x[0] not in {p[0] for p in pairs}}

    def joined(rows, late=None):
        return event_time.interval_join(rows.where("kind = 'l'"), rows.where("kind = 'r'"), ["user"], "at", width, how, late).select("id", "right_id")

    df = spark.createDataFrame(lefts + rights, ROWS)
    got = [tuple(r) for r in joined(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want(lefts, rights)
    rows = sorted(lefts + rights, key=lambda r: r[2])
    batches = [rows[:60], rows[60:], [(900, "q", at(10_000), "l"), (900, "q", at(10_000), "r")], [(904, "q", at(10_001), "l")], [(901, "a", at(0), "l"), (902, "q", at(20_000), "l"), (902, "q", at(20_000), "r")], [(903, "q", at(20_001), "r")]]
    got, dropped = streamed(spark, tmp_path, f"join-{how}", batches, ROWS, lambda s: joined(s, "1 minute"))
    got = {tuple(r) for r in got if r["id"] < 900}
    assert got == want(lefts, rights) and dropped >= 1


def test_repeats(spark, tmp_path):
    rows = [[(1, "a", at(0), "x"), (1, "a", at(1), "x")], [(1, "a", at(2), "x"), (2, "a", at(2), "x")]]
    got, _ = streamed(spark, tmp_path, "once", rows, ROWS, lambda s: event_time.once(s, ["id"], "at", "1 hour"))
    assert sorted(r["id"] for r in got) == [1, 2]
    assert event_time.once(spark.createDataFrame(rows[0] + rows[1], ROWS), ["id"], "at", "1 hour").count() == 2


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of(spark, width):
    """Equal to a scan, however time is cut; null keys are a key, and the larger of two right rows of one instant counts."""
    rng = random.Random(width)
    left = [(i, rng.choice(["a", "b", None, "never"]), rng.randrange(-50, 200)) for i in range(150)]
    right = [(rng.choice(["a", "b", None]), rng.randrange(-50, 200), rng.randrange(9)) for _ in range(60)] + [("a", 5, 1), ("a", 5, 2)]
    got = asof.as_of(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, t long, v long"), ["k"], "t", ["v"], width).collect()
    assert len(got) == len(left)
    for r in got:
        seen = [(t, v) for k, t, v in right if k == r["k"] and t <= r["t"]]
        assert r["v"] == (max(seen)[1] if seen else None)


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_counts_before(spark, width):
    rng = random.Random(width)
    log = [(rng.randrange(100), i) for i in range(80)]
    asked = [(rng.randrange(-5, 110), rng.randrange(80), f"x{i}") for i in range(40)] + [(*log[0], "same place")]
    got = asof.counts_before(spark.createDataFrame(log, "t long, i long"), spark.createDataFrame(asked, "t long, i long, name string"), "t", "i", width).collect()
    assert sorted((r["name"], r["before"]) for r in got) == sorted((n, sum(x < (t, i) for x in log)) for t, i, n in asked)


def test_silent_engines(spark):
    """An engine counts from the search on that first names it, by a row or a failure, and not in searches without rows."""
    searches = [(1, 10), (2, 20), (3, 20), (4, 30), (5, 40)]
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (4, "a"), (5, "c")]
    failures = [(3, "d"), (4, "b"), (4, ""), (5, "d")]
    make = lambda x, s: spark.createDataFrame(x, s)
    for width in (1, 15, 1000):
        got = ranking.silent_engines(make(searches, "query_id long, at long"), make(rows, "query_id long, engine string"), make(failures, "query_id long, engine string"), width).collect()
        # a: not in 5; b: not in 5, failed in 4; c: known from 5 on; d: known from 3 on, not in 4
        assert {(r["engine"], r["n_silent"]) for r in got} == {("a", 1), ("b", 1), ("d", 1)}


def test_sketches(spark):
    """Merged over two levels or at once, a sketch is within its error of the exact figures."""
    rows = spark.range(40_000).select((F.col("id") % 50).alias("hour"), (F.col("id") % 3000).alias("user"), (F.col("id") % 1009).cast("double").alias("v"))
    hours = sketches.sketched(rows, ["hour"], "user", "v")
    days = sketches.merged(hours.withColumn("day", F.floor(F.col("hour") / 24)), ["day"])
    read = [sketches.distinct(F.col("distinct")).alias("d"), sketches.quantile(F.col("quantiles"), 0.9).alias("q"), "n"]
    a, b = sketches.merged(days, []).select(*read).first(), sketches.merged(hours, []).select(*read).first()
    assert a["n"] == b["n"] == 40_000 and abs(b["d"] - 3000) < 150 and abs(a["d"] - 3000) < 150 and abs(a["q"] - 908) < 35 and abs(b["q"] - 908) < 35
