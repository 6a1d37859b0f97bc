"""Recursive documents: taken apart, put together, malformed ones."""

import json
import random

from pyspark.sql import functions as F

from heddle.sources import trees
from heddle.sources.tables import checkpoints


def rows_of(spark, shape, docs):
    checkpoints(spark)
    texts = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return [r.asDict() for r in trees.flatten(spark.createDataFrame(texts, "thread long, json string"), shape).orderBy("thread", "kind", "pos").collect()]


def test_nested(spark):
    tree = {"id": 1, "children": [{"id": 2, "author": "", "text": None, "children": [{"id": 3, "author": "a", "text": "x", "extra": [1]}]}, {"id": 4, "text": "no author"}, None, 7, "bad", [1], {"id": 5, "author": "b", "children": "none"}]}
    got = rows_of(spark, "nested", [tree, "not json", None, "[]", "{}", '{"id": 9, "children": {"a": {"id": 1, "author": "x"}}}'])
    assert [(r["thread"], r["id"], r["parent"], r["author"], r["text"], r["depth"], r["pos"]) for r in got] == [(0, "3", "2", "a", "x", 1, 0), (0, "4", "1", "", "no author", 0, 1), (0, "5", "1", "b", "", 0, 2)]


def test_listing(spark):
    def comment(i, up, replies="", author="u", body="hello"):
        return {"kind": "t1", "data": {"id": i, "parent_id": up, "author": author, "body": body, "replies": replies}}

    def listing(*children):
        return {"kind": "Listing", "data": {"children": list(children)}}

    gone = comment("b", "t1_a", listing(comment("c", "t1_b")), "[deleted]", "[removed]")
    kept = comment("d", "t3_p", "", "[deleted]", "[Removed]")
    blank = comment("e", "t3_p", None, "", "")
    more = {"kind": "more", "data": {"count": 7, "parent_id": "t3_p", "children": ["x", "y"]}}
    on = {"kind": "more", "data": {"count": 0, "parent_id": "t1_c", "children": ["z"]}}
    below = {"kind": "more", "data": {"count": -1, "parent_id": "t1_d", "children": ["q", "r"]}}
    doc = [listing({"kind": "t3", "data": {"id": "p"}}), listing(comment("a", "t3_p", listing(gone, on)), "bad", kept, blank, more, {"kind": "odd"}, below)]
    got = rows_of(spark, "listing", [doc])
    assert [(r["id"], r["parent"], r["depth"], r["pos"]) for r in got if r["kind"] == "comment"] == [("a", "p", 0, 0), ("c", "b", 2, 1), ("d", "p", 0, 2)]
    assert [(r["text"], r["parent"], r["hidden"], r["children"]) for r in got if r["kind"] == "gap"] == [("continue", "c", 0, None), ("more", "p", 7, ["x", "y"]), ("more", "d", -1, ["q", "r"])]
    missing = trees.hidden_replies(spark.createDataFrame(got, "thread long, kind string, text string, hidden long, children array<string>")).collect()
    assert [tuple(r) for r in missing] == [(0, 9)]


def test_posts(spark):
    post = lambda u: {"uri": u, "author": {"handle": "h"}, "record": {"text": u}}
    doc = {"thread": {"post": post("r"), "replies": [{"blocked": True, "replies": [{"notFound": True, "replies": [{"post": post("b")}]}, {"post": post("c")}]}, {"post": post("d"), "replies": [{"post": post("e")}]}]}}
    assert [(r["id"], r["parent"]) for r in rows_of(spark, "posts", [doc])] == [("b", "r"), ("c", "r"), ("d", "r"), ("e", "d")]


def test_round_trip(spark):
    """Random forests, a chain of sixty and repeated threads: what nest() puts together flatten() gives back in order."""
    rng = random.Random(8)
    forest = [(t, i, rng.randrange(i) if i and rng.random() < 0.9 else None) for t in range(12) for i in range(rng.randrange(1, 25))] + [(99, i, i - 1 if i else None) for i in range(60)]
    rows = spark.createDataFrame([(t, i + 1, None if up is None else up + 1, i) for t, i, up in forest], "thread long, id long, parent long, pos long").repartition(3)
    checkpoints(spark)

    def node(r, inner):
        return F.concat(F.lit('{"id":'), r["id"].cast("string"), F.lit(',"author":"a","children":['), inner, F.lit("]}"))

    docs = trees.nest(rows, node).select("thread", F.concat(F.lit('{"id":0,"children":['), "json", F.lit("]}")).alias("json"))
    got = {(r["thread"], int(r["id"]), int(r["parent"])) for r in trees.flatten(docs, "nested").collect()}
    assert got == {(t, i + 1, 0 if up is None else up + 1) for t, i, up in forest}
    assert trees.flatten(docs.limit(0), "nested").collect() == []
    deepest = trees.flatten(docs.where("thread = 99"), "nested").agg(F.max("depth")).first()[0]
    assert deepest == 59
