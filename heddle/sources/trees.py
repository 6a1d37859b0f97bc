"""Recursive thread documents (JSON text) as flat rows and back.

A Spark struct cannot recurse, so a document is a VARIANT and is taken apart level by level: each round explodes the children of
all nodes of a level at once, in every document, until a level is empty. A thread of d levels takes d rounds, whatever the
number of threads; each round's nodes are checkpointed, so a lost executor costs one round. nest() is the way back,
from the deepest level up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.threads import with_depth

#: Bodies of comments whose authors are gone, which say nothing (fixed values).
REMOVED = ("", "[removed]", "[deleted]", "[ Removed by Reddit ]")
#: What stands in front of the ids of comments and of posts (fixed values).
ID_MARKS = ("t1_", "t3_")


def _at(node: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, path, kind)


def _said(node: Column, path: str) -> Column:
    return F.coalesce(_at(node, path), F.lit(""))


def _bare(fullname: Column) -> Column:
    """An id without its mark."""
    return F.when(F.substring(fullname, 1, 3).isin(*ID_MARKS), F.substr(fullname, F.lit(4))).otherwise(fullname)


@dataclass(frozen=True)
class Shape:
    """Where a kind of document has its parts.

    top: path of the first level's nodes; root: the id that they answer; below: path of a node's children; each(node, up) gives what a
    node says: kind (comment, gap or null for neither), id, parent, author, text, hidden, children; next_up(node, up) is the
    id that its children answer.
    """

    top: str
    root: str
    below: str
    each: Callable[[Column, Column], dict[str, Column]]
    next_up: Callable[[Column, Column], Column]


def _nested_node(n: Column, up: Column) -> dict[str, Column]:
    live = (_said(n, "$.author") != "") | (_said(n, "$.text") != "")
    return {"kind": F.when(live, "comment"), "id": _at(n, "$.id"), "parent": up, "author": _said(n, "$.author"), "text": _said(n, "$.text")}


def _listing_node(n: Column, up: Column) -> dict[str, Column]:
    kind, author, body = _at(n, "$.kind"), _said(n, "$.data.author"), _said(n, "$.data.body")
    removed = author.isin("", "[deleted]") & body.isin(*REMOVED)
    count = F.coalesce(_at(n, "$.data.count", "long"), F.lit(0).cast("long"))
    ids = F.when(count != 0, F.coalesce(_at(n, "$.data.children", "array<string>"), F.array().cast("array<string>")))
    more = kind == "more"
    return {
        "kind": F.when((kind == "t1") & ~removed, "comment").when(more, "gap"),
        "id": F.when(~more, _at(n, "$.data.id")), "parent": _bare(_said(n, "$.data.parent_id")), "author": F.when(~more, author),
        "text": F.when(~more, body).when(count == 0, "continue").otherwise("more"), "hidden": F.when(more, count), "children": F.when(more, ids),
    }


def _post_node(n: Column, up: Column) -> dict[str, Column]:
    uri = _said(n, "$.post.uri")
    return {"kind": F.when(uri != "", "comment"), "id": uri, "parent": up, "author": _said(n, "$.post.author.handle"), "text": _said(n, "$.post.record.text")}


#: nested (G1): nodes with `children`; one without author and text is left out but stays its children's parent.
#: listing (G2, P8, G5): two listings, post and comments; comments name their parents; what was removed goes and its replies stay; `more` entries are gaps.
#: posts (G3): posts with `replies`; a placeholder is left out and its children answer the one above it.
SHAPES = {
    "nested": Shape("$.children", "$.id", "$.children", _nested_node, lambda n, up: _at(n, "$.id")),
    "listing": Shape("$[1].data.children", "$[0].data.children[0].data.id", "$.data.replies.data.children", _listing_node, lambda n, up: up),
    "posts": Shape("$.thread.replies", "$.thread.post.uri", "$.replies", _post_node, lambda n, up: F.when(_said(n, "$.post.uri") != "", _said(n, "$.post.uri")).otherwise(up)),
}


def flatten(docs: DataFrame, shape: str) -> DataFrame:
    """thread, kind, id, parent, author, text, depth, pos, hidden, children for documents (thread, json).

    Comments and gaps of a thread are numbered apart, each in pre-order; depth is the number of comments and left-out nodes above. A gap says
    `more`, with the number of hidden replies and their ids, or `continue`. A text that isn't JSON, and a child that isn't
    an object, give no rows; unknown fields are left out. Threads are told apart by `thread`.
    """
    way = SHAPES[shape]

    def children(level: DataFrame, path: str) -> DataFrame:
        each = F.posexplode(F.coalesce(_at(F.col("node"), path, "array<variant>"), F.array().cast("array<variant>"))).alias("at", "child")
        found = level.select("thread", "path", "up", "depth", each)
        objects = found.where(F.startswith(F.schema_of_variant("child"), F.lit("OBJECT")))
        return objects.select("thread", F.concat("path", F.array("at")).alias("path"), "up", F.col("depth").alias("depth"), F.col("child").alias("node")).checkpoint()

    first = docs.select("thread", F.try_parse_json("json").alias("node"))
    level = first.select("thread", F.array().cast("array<int>").alias("path"), _at(F.col("node"), way.root).alias("up"), F.lit(0).alias("depth"), "node")
    level, out = children(level, way.top), None
    while True:
        said = way.each(F.col("node"), F.col("up"))
        none = {"hidden": F.lit(None).cast("long"), "children": F.lit(None).cast("array<string>")}
        rows = level.select("thread", "path", *[c.alias(k) for k, c in (none | said).items()], "depth").where("kind IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
        below = level.withColumn("up", way.next_up(F.col("node"), F.col("up"))).withColumn("depth", F.col("depth") + 1)
        level = children(below, way.below)
        if level.isEmpty():
            break
    order = Window.partitionBy("thread", "kind").orderBy("path")
    return out.withColumn("pos", F.row_number().over(order) - 1).select("thread", "kind", "id", "parent", "author", "text", "depth", "pos", "hidden", "children")


def hidden_replies(gaps: DataFrame) -> DataFrame:
    """thread, missing: replies behind `more` gaps, by their count or else their ids."""
    n = F.when(F.col("hidden") > 0, F.col("hidden")).otherwise(F.size("children")).cast("long")
    return gaps.where("kind = 'gap' AND text = 'more'").groupBy("thread").agg(F.sum(n).alias("missing"))


def nest(rows: DataFrame, node: Callable[[Column, Column], Column]) -> DataFrame:
    """thread, json: the nodes of each thread's top rows, children inside their parents, joined by commas.

    rows: thread, id, parent, pos and what node(own, inner) needs; node gives a row's JSON text, inner is that of its children ('' without any).
    A row whose parent isn't there is at the top. One round a level, from the deepest up; a row's text is
    written once for each level above it.
    """
    deep = with_depth(rows).checkpoint()
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("json")))), lambda x: x["json"]), ",")
    inner = None
    for d in range(deep.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = deep.where(F.col("depth") == d)
        level = level.withColumn("inner", F.lit("")) if inner is None else level.join(inner, ["thread", "id"], "left").fillna("", ["inner"])
        said = level.select("thread", "parent", "pos", node(F.struct(*[F.col(c) for c in rows.columns]), F.col("inner")).alias("json"))
        if d == 0:
            return said.groupBy("thread").agg(joined(F.col("json")).alias("json"))
        inner = said.groupBy("thread", F.col("parent").alias("id")).agg(joined(F.col("json")).alias("inner")).checkpoint()
    return deep.groupBy("thread").agg(F.lit("").alias("json"))


def expand_gaps(thread: DataFrame, gaps: DataFrame, more: DataFrame, rounds: int = 3, batch: int = 100) -> DataFrame:
    """Fills gaps from a table of answers until nothing changes or the rounds are over.

    thread: thread, id, pos; gaps: thread, id (a child that is missing, with its pos);
    more: thread, id, pos, child (an answer to a request for `id`, with children that it opens). Each round asks for up to
    `batch` ids of each thread in their order. Rows that are there already are left as they are.
    """
    for _ in range(rounds):
        nth = F.row_number().over(Window.partitionBy("thread").orderBy("pos", "id"))
        ask = gaps.withColumn("nth", nth).where(F.col("nth") <= batch).select("thread", "id")
        got = more.join(ask, ["thread", "id"], "left_semi")
        known = thread.select("thread", "id").distinct()
        new = got.select("thread", "id", "pos").dropDuplicates(["thread", "id"]).join(known, ["thread", "id"], "left_anti")
        opened = got.where("child IS NOT NULL").select("thread", F.col("child").alias("id"), "pos").dropDuplicates(["thread", "id"])
        thread = thread.unionByName(new).checkpoint()
        gaps = gaps.join(ask, ["thread", "id"], "left_anti").unionByName(opened).join(thread.select("thread", "id"), ["thread", "id"], "left_anti").checkpoint()
        if gaps.isEmpty() or new.isEmpty():
            break
    return thread
