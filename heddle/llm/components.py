"""Connected components of an undirected graph, by union-find within parts and alternating stars between them; joins that split hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import drop, stored

#: Rows of a key that one task may get in a join, unless there are more than MOST_HOT such keys.
HOT, MOST_HOT = 2000, 200_000
#: Edges of a part, which one task joins.
EDGES = 500_000


def hot_rows(total: int) -> int:
    """Rows from which on a key counts as hot: of `total` rows never more than MOST_HOT keys are."""
    return max(HOT, total // MOST_HOT)


def join_by_size(rows: DataFrame, table: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row a key and in column `rows` the number of rows it meets.

    Keys with very many rows are joined in broadcast (their number is bounded by total / hot_rows), so
    the rows of one key are never brought together. how: inner or left.
    """
    most = hot_rows(total)
    others = [c for c in table.columns if c not in (*on, "rows")]
    hot = F.broadcast(table.where(F.col("rows") > most).select(*on, *others, F.lit(True).alias("__hot")))
    marked = rows.join(hot, on, "left")
    first = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot IS NULL").drop("__hot", *others)
    return first.unionByName(rest.join(table.where(F.col("rows") <= most).select(*on, *others), on, how))


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Each node's larger (large) or smaller neighbours are tied to the smallest of its neighbourhood.

    The minimum is an aggregate with map-side combine; it comes back to the neighbours by a join that doesn't
    gather the neighbours of a node with very many of them.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("rows"))
    near = join_by_size(both, least, ["a"], 2 * total)
    if large:
        tied = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each can reach over them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part's edges as stars: each node with the smallest it can reach within the part."""
    cols = [(np.asarray(b.column("a")), np.asarray(b.column("b"))) for b in batches]
    if cols:
        node, root = roots(*(np.concatenate([c[i] for c in cols]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    edges: a, b (long); direction, repeats and loops don't matter. The edges are read in parts of EDGES; a task joins its part by
    union-find. If there are several parts, their stars are joined by rounds of large and small stars over all nodes. Each round is
    written to the shared folder, so a lost executor costs that round at most; a round's table goes when the next is there.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    parts = -(-links.count() // EDGES)
    dealt = links.repartition(parts) if parts > 1 else links.coalesce(1)
    within = dealt.mapInArrow(_joined, "a long, b long")
    if parts <= 1:
        return within.select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = stored(within.where("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, before = mark, now
        large = stored(_star(now, True, mark["n"]))
        now = stored(_star(large, False, mark["n"]))
        drop(before)
        drop(large)
