"""Hits, requests, lines as data sources, token tables, self-threads."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import threads
from heddle.operators.tokens import replace_tokens
from heddle.sources import hits, lines
from heddle.sources.tables import checkpoints


def test_ragged_hits(spark):
    answer = {
        "results": [
            {"url": "u1", "engines": ["a", "b"], "positions": [3], "score": 1.5}, {"url": "u2", "engine": "a"}, {"url": "u3", "engines": [], "engine": "c", "positions": [7]}, {"url": "u4", "engine": ""}, None, {"url": "u5", "engines": ["", "b"], "positions": [1, 2, 9]}, {"url": "u6", "engines": ["a"], "positions": None},
        ],
        "unresponsive_engines": [["a", "timeout", "x"], ["b"], [], ["", "boom"], ["c", "CAPTCHA"]],
        "more": {"unknown": 1},
    }
    docs = spark.createDataFrame([(1, json.dumps(answer)), (2, "<html>"), (3, None), (4, "{}"), (5, '{"results": []}')], "query_id long, json string")
    found = hits.hits(docs)
    got = [(r["merged_rank"], r["engine"], r["position"], r["sole"]) for r in hits.credits(found).orderBy("merged_rank", "position").collect()]
    assert got == [(1, "b", 0, False), (1, "a", 3, False), (2, "a", 0, True), (3, "c", 7, True), (6, "", 1, False), (6, "b", 2, False), (7, "a", 0, True)]
    assert found.count() == 6 and {r["query_id"] for r in found.collect()} == {1}
    assert sorted((r["engine"], r["message"], r["class"]) for r in hits.failures(docs).collect()) == [("a", "timeout", "timeout"), ("b", "", "unknown"), ("c", "CAPTCHA", "captcha")]


def test_requests(spark):
    bodies = ['{"query": "q"}', '{"query": "q", "limit": 7, "site": "reddit.com", "time_range": "day"}', '{"query": "q", "limit": -1}', '{"query": "q", "limit": 99}', '{"limit": 1}', "nonsense", "[1]", '{"query": "q", "time_range": "hour"}', '{"query": "q", "site": "a/b"}', None]
    got = hits.requests(spark.createDataFrame(list(enumerate(bodies)), "request_id long, json string"), 50).orderBy("request_id").collect()
    assert [(r["error"] or "")[:12] for r in got] == ["", "", "", "", "query is req", "invalid JSON", "invalid JSON", "time_range m", "site must be", "invalid JSON"]
    assert [(r["query"], r["limit"]) for r in got[:4]] == [("q", 10), ("site:reddit.com q", 7), ("q", 10), ("q", 50)]


def test_exposition(spark, tmp_path):
    """Any label and number comes back; a write is there whole or not at all; a failed one leaves what was there."""
    lines.register(spark)
    path = str(tmp_path / "metrics")
    odd = ['a"b', "back\\slash", "new\nline", "", "é{}=,", "\\n", '\\"']
    numbers = [0.0, 1.0, -2.5, 1e300, float("inf"), float("-inf"), 0.1, 123456789012345.0]
    rows = [("m_total", "counter", {"l": o, "k": "x"}, n) for o, n in zip(odd, numbers, strict=False)] + [("plain", None, {}, numbers[-1]), ("nan", "gauge", {}, float("nan"))]
    df = spark.createDataFrame(rows, "name string, type string, labels map<string,string>, value double")
    df.repartition(4).write.format("exposition").option("path", path).mode("overwrite").save()
    read = lambda: spark.read.format("exposition").option("path", path).load()
    key = lambda r: (r[0], r[1], tuple(sorted(r[2].items())), "nan" if math.isnan(r[3]) else r[3])
    assert sorted(map(repr, map(key, read().collect()))) == sorted(map(repr, map(key, rows)))
    boom = F.udf(lambda x: 1 / 0 if x == "plain" else x)
    with pytest.raises(Exception, match="ZeroDivision"):
        df.withColumn("name", boom("name")).repartition(4).write.format("exposition").option("path", path).mode("overwrite").save()
    assert read().count() == len(rows)
    df.limit(2).write.format("exposition").option("path", path).mode("append").save()
    assert read().count() == len(rows) + 2
    df.limit(0).write.format("exposition").option("path", path).mode("overwrite").save()
    assert read().count() == 0 and spark.read.format("exposition").option("path", str(tmp_path / "none")).load().count() == 0
    (tmp_path / "metrics" / "stray.txt").write_text("stray 1\n")
    assert read().count() == 0


def test_foreign_metrics(spark, tmp_path):
    lines.register(spark)
    text = '# HELP a b\n# TYPE a counter\na{x="1",y="2",} 3 1700000000\nb 4e1\n\nbad line here\nc{x="}"} NaN\nd x\n# TYPE b gauge\nb 5'
    (tmp_path / "part.txt").write_text(text)
    (tmp_path / lines.LIST).write_text('["part.txt"]')
    got = spark.read.format("exposition").option("path", str(tmp_path)).load().collect()
    assert [(r["name"], r["type"], r["labels"]) for r in got] == [("a", "counter", {"x": "1", "y": "2"}), ("b", None, {}), ("c", None, {"x": "}"}), ("b", "gauge", {})]
    assert got[0]["value"] == 3 and got[1]["value"] == 40 and math.isnan(got[2]["value"])


def test_benchmark_lines(spark, tmp_path):
    lines.register(spark)
    rows = ['{"url": "u", "phrases": ["a", 1]}', '{"url": "u", "grade": "ok", "seconds": 3, "chars": 7.5, "new": {}}', '{"candidate": "c", "n": 5, "n_ok": "x"}', "[1]", "nonsense", "{}", '{"grade": null}']
    (tmp_path / "part.txt").write_text("\n".join(rows))
    (tmp_path / lines.LIST).write_text('["part.txt"]')
    got = spark.read.format("benchmark_lines").option("path", str(tmp_path)).load().collect()
    assert [(r["kind"], r["url"], r["phrases"], r["grade"], r["seconds"], r["chars"], r["n"], r["n_ok"]) for r in got] == [
        ("item", "u", ["a", "1"], None, None, None, None, None), ("result", "u", None, "ok", 3.0, None, None, None), ("summary", None, None, None, None, None, 5, None), ("other", None, None, None, None, None, None, None), ("result", None, None, None, None, None, None, None),
    ]


@pytest.mark.parametrize("most", [200_000, 0])
def test_tokens(spark, monkeypatch, most):
    """One pass: what is put in isn't read again, tokens that share a beginning stay apart, and texts without any are left alone."""
    import re

    from heddle.operators import tokens as module

    monkeypatch.setattr(module, "MOST_BROADCAST", most)
    rng = random.Random(5)
    table = [("t/a", "x t/b y"), ("t/b", ""), ("t/c", None), ("t/ab", "long"), ("t/a", "z never"), ("t/unused", "u")]
    texts = [None, "", "no token", "t/a", "t/at/b", "t/a t/ab t/b t/zz."] + [" ".join(rng.choice(["t/a", "t/b", "t/c", "t/ab", "t/q", "w", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("token", F.lit("own"))
    out = {r["id"]: r["body"] for r in replace_tokens(df, "id", "body", spark.createDataFrame(table, "token string, replacement string"), "t/[a-z]+").collect()}
    said = {"t/a": "x t/b y", "t/b": "", "t/c": "", "t/ab": "long", "t/unused": "u"}
    assert out == {i: t if t is None else re.sub("t/[a-z]+", lambda m: said.get(m[0], m[0]), t) for i, t in enumerate(texts)}


def plain_self_thread(posts, root):
    """Up while the author is the same, down over first replies."""
    by_id = {p[0]: p for p in posts}
    above, at = [], root
    while (up := by_id.get(by_id[at][1])) and up[3].lower() == by_id[root][3].lower():
        above.insert(0, up[0])
        at = up[0]
    chain, at = [], root
    while True:
        replies = sorted((p[2], p[0]) for p in posts if p[1] == at and p[3].lower() == by_id[root][3].lower())
        if not replies:
            return above, chain
        at = replies[0][1]
        chain.append(at)


def test_self_threads(spark):
    checkpoints(spark)
    rng = random.Random(10)
    talks = {t: [(i, rng.randrange(i) if i and rng.random() < 0.9 else None, rng.randrange(100), rng.choice(["Ann", "ann", "Bob"])) for i in range(rng.randint(1, 25))] for t in range(6)}
    talks[99] = [(i, i - 1 if i else None, 0, "Ann") for i in range(150)]
    rows = spark.createDataFrame([(t, *p) for t, posts in talks.items() for p in posts], "thread long, id long, parent long, pos long, author string").repartition(3)
    asked = spark.createDataFrame([(t, p[0]) for t, posts in talks.items() for p in posts if t != 99] + [(99, 70)], "thread long, id long")
    got = {}
    for r in threads.self_thread(rows, asked).orderBy("place").collect():
        got.setdefault((r["thread"], r["root"]), []).append((r["place"], r["id"]))
    for t, posts in talks.items():
        for p in posts:
            if t == 99 and p[0] != 70:
                continue
            above, below = plain_self_thread(posts, p[0])
            assert got[t, p[0]] == [(i - len(above), x) for i, x in enumerate(above)] + [(0, p[0])] + [(i + 1, x) for i, x in enumerate(below)]
