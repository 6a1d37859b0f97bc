"""Exact top-k inner products with a KD-tree in each shard.

Vectors are dealt into shards by the top splits of one KD-tree, fitted on a
bounded sample; a cell with more vectors than a shard may hold (one vector very often,
say) is dealt into several. A shard's tree splits at the median of the widest dimension down
to small leaves; every node has the tight bounding box of its vectors. The largest
inner product that a query can have with a box is the sum over dimensions
of the better of its two sides. Nodes are taken from a heap, best bound first; a node's children
get their bounds when it is opened, and the search ends where the best bound
left can't beat the kth best hit.

A query first searches the shard it lies in. Its kth best hit there goes with
it, and only to shards whose boxes can beat it, where the search starts from that.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import bounded, stored

#: Vectors of a leaf, vectors of a shard, queries in a packed block.
LEAF, SHARD, BLOCK = 48, 16384, 256
#: Vectors that the top splits are fitted on, and shards' boxes (bytes) that are sent to all tasks at a time.
SAMPLE, BOX_BYTES = 20_000, 32 << 20
_HIT = "query long, query_id long, vec_id long, score long"
_BLOCK = "dim int, cell int, piece int, low binary, high binary, least_id long, query binary, ids binary, vectors binary, known binary, known_id binary, hit_query binary, hit_query_id binary, hit_id binary, hit_score binary"
_SENT = "dim int, cell int, piece int, query binary, ids binary, vectors binary, known binary, known_id binary"
_NO_ID = np.iinfo(np.int64).max
#: Components are cut off here, so that no sum overflows a double; scores at the ends of long.
_MOST, _ENDS = 1e150, float(2**63 - 1024)


class Tree:
    """Nodes with boxes, two children side by side or a leaf's rows; vectors in the order of the leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.arange(len(x))
        first, last, child, low, high = [0], [len(x)], [-1], [x.min(0)], [x.max(0)]
        at = 0
        while at < len(first):
            a, z = first[at], last[at]
            spread = high[at] - low[at]
            if z - a > LEAF and spread.size and spread.max() > 0:
                widest, half = int(spread.argmax()), (z - a) // 2
                own = order[a:z]
                own[:] = own[np.argpartition(x[own, widest], half)]
                child[at] = len(first)
                for b, e in ((a, a + half), (a + half, z)):
                    first.append(b)
                    last.append(e)
                    child.append(-1)
                    low.append(x[order[b:e]].min(0))
                    high.append(x[order[b:e]].max(0))
            at += 1
        self.rows, self.ids, self.x = order, ids[order], x[order]
        self.first, self.last, self.child = first, last, child
        self.low, self.high = np.array(low), np.array(high)
        self.least_id = [int(self.ids[a:z].min()) for a, z in zip(first, last, strict=True)]
        self.leaves = 0

    def search(self, q: np.ndarray, k: int, known: float = -np.inf, known_id: int = _NO_ID, own: int = -1) -> list[tuple[int, int]]:
        """The up to k best (score, id) that beat what is known; own: the query's row here, or -1."""
        best: list[tuple[float, int]] = []  # a heap whose top is the worst: smallest score, largest id
        kth, kth_id = known, known_id
        todo = [(-np.inf, self.least_id[0], 0)]
        positive = q > 0
        while todo:
            bound, least, node = heapq.heappop(todo)
            if -bound < kth or -bound == kth and least >= kth_id:
                break
            c = self.child[node]
            if c >= 0:
                bounds = np.where(positive, self.high[c : c + 2], self.low[c : c + 2]) @ q
                for i in (0, 1):
                    heapq.heappush(todo, (-float(bounds[i]), self.least_id[c + i], c + i))
                continue
            self.leaves += 1
            a, z = self.first[node], self.last[node]
            score = self.x[a:z] @ q
            for i in np.flatnonzero(score >= kth).tolist():
                s, n = float(score[i]), int(self.ids[a + i])
                if self.rows[a + i] == own or s < kth or s == kth and n >= kth_id:
                    continue
                (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (s, -n))
                if len(best) == k:
                    kth, kth_id = best[0][0], -best[0][1]
        return [(int(np.clip(s, -_ENDS, _ENDS)), -n) for s, n in best]


def top_splits(x: np.ndarray, cells: int) -> list[tuple[int, float, int]]:
    """Splits of a KD-tree with up to `cells` leaves: (dimension, value, first child) a node, or (-1, 0, cell)."""
    out: list[tuple[int, float, int]] = [(-1, 0.0, 0)]
    todo, made = [(0, np.arange(len(x)), cells)], 0
    while todo:
        node, rows, n = todo.pop(0)
        spread = np.ptp(x[rows], axis=0) if len(rows) and x.shape[1] else np.zeros(1)
        if n > 1 and spread.max() > 0:
            d = int(spread.argmax())
            value = float(np.quantile(x[rows, d], (n // 2) / n))
            left = x[rows, d] < value
            if left.any():
                out[node] = (d, value, len(out))
                todo += [(len(out), rows[left], n // 2), (len(out) + 1, rows[~left], n - n // 2)]
                out += [(-1, 0.0, 0), (-1, 0.0, 0)]
                continue
        out[node] = (-1, 0.0, made)
        made += 1
    return out


def cells_of(x: np.ndarray, splits: list[tuple[int, float, int]]) -> np.ndarray:
    """The cell that each vector falls into."""
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        d, value, then = splits[node]
        if d < 0:
            out[rows] = then
        elif len(rows):
            right = x[rows, d] >= value
            todo += [(then, rows[~right]), (then + 1, rows[right])]
    return out


def _whole(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of each component, as doubles (whole numbers, exact up to sums of 2**53)."""
    flat = col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten()
    return np.clip(np.floor(256.0 * np.asarray(flat).astype(np.float64).clip(-_MOST, _MOST)), -_MOST, _MOST).reshape(len(col), dim)


def _routed(splits: dict[int, list[tuple[int, float, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                x = _whole(own.column("embedding"), dim)
                cells = cells_of(x, splits[dim]) if dim in splits else np.zeros(len(x), np.int32)
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("vec_id"), own.column("is_query"), own.column("dim"), pa.array(cells), raw], names=["row", "vec_id", "is_query", "dim", "cell", "vector"])

    return run


def _vectors(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in col.combine_chunks()), np.float64).reshape(len(col), dim)


def _packed(x) -> bytes:
    return np.asarray(x, np.int64).tobytes()


def _home(k: int):
    """The shard's box, and its own queries, searched in it, in blocks with their hits and kth hits."""

    def run(table: pa.Table) -> pa.Table:
        dim, cell, piece = (table[c][0].as_py() for c in ("dim", "cell", "piece"))
        ids, rows = np.asarray(table["vec_id"].combine_chunks()), np.asarray(table["row"].combine_chunks())
        x = _vectors(table["vector"], dim)
        query = np.flatnonzero(np.asarray(table["is_query"].combine_chunks()))
        tree = Tree(ids, x) if len(query) else None
        out = [[dim, cell, piece, x.min(0).tobytes(), x.max(0).tobytes(), int(ids.min())] + [None] * 9]
        for a in range(0, len(query), BLOCK):
            own = query[a : a + BLOCK]
            found = [sorted(tree.search(x[r], k, own=r)) for r in own]
            known = [f[0][0] if len(f) == k else None for f in found]
            # of hits with the kth score the largest id is the last
            last = [max(n for s, n in f if s == w) if w is not None else _NO_ID for f, w in zip(found, known, strict=True)]
            hits = [(rows[r], ids[r], n, s) for r, f in zip(own, found, strict=True) for s, n in f]
            floor = np.array([-np.inf if w is None else w for w in known])
            out.append([dim, cell, piece, None, None, None, rows[own].tobytes(), ids[own].tobytes(), x[own].tobytes(), floor.tobytes(), _packed(last), *(_packed([h[i] for h in hits]) for i in range(4))])
        fields = [c.split() for c in _BLOCK.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.table([pa.array([r[i] for r in out], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return run


def _sent(boxes: list[dict]):
    """Each block's queries that may find a better hit in a shard, one row a shard."""
    by_dim: dict[int, tuple] = {}
    for dim in {b["dim"] for b in boxes}:
        own = [b for b in boxes if b["dim"] == dim]
        by_dim[dim] = own, *(np.array([np.frombuffer(b[c], np.float64) for b in own]).reshape(len(own), dim) for c in ("low", "high")), np.array([b["least_id"] for b in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["dim"] not in by_dim:
                    continue
                own, low, high, least = by_dim[r["dim"]]
                query, ids, last = (np.frombuffer(r[c], np.int64) for c in ("query", "ids", "known_id"))
                known, q = np.frombuffer(r["known"], np.float64), np.frombuffer(r["vectors"], np.float64).reshape(len(ids), r["dim"])
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                reach = (bound > known[:, None]) | ((bound == known[:, None]) & (least < last[:, None]))
                for j in np.flatnonzero(reach.any(0)):
                    b, i = own[j], reach[:, j]
                    if (b["cell"], b["piece"]) != (r["cell"], r["piece"]):
                        out.append((r["dim"], b["cell"], b["piece"], query[i].tobytes(), ids[i].tobytes(), q[i].tobytes(), known[i].tobytes(), last[i].tobytes()))
            kinds = [pa.int32()] * 3 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _SENT.split(", ")])

    return run


def _away(k: int):
    """Queries of other shards, searched in this one from what they know."""

    def run(vectors: pa.Table, blocks: pa.Table) -> pa.Table:
        hits: list[tuple[int, int, int, int]] = []
        if vectors.num_rows and blocks.num_rows:
            dim = vectors["dim"][0].as_py()
            tree = Tree(np.asarray(vectors["vec_id"].combine_chunks()), _vectors(vectors["vector"], dim))
            for r in blocks.to_pylist():
                query, ids, last = (np.frombuffer(r[c], np.int64) for c in ("query", "ids", "known_id"))
                q, known = np.frombuffer(r["vectors"], np.float64).reshape(len(ids), dim), np.frombuffer(r["known"], np.float64)
                for i in range(len(ids)):
                    hits += [(query[i], ids[i], n, s) for s, n in tree.search(q[i], k, float(known[i]), int(last[i]))]
        return pa.table([pa.array([h[i] for h in hits], pa.int64()) for i in range(4)], names=["query", "query_id", "vec_id", "score"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [np.concatenate([np.empty(0, np.int64), *(np.frombuffer(v, np.int64) for v in b.column(c).to_pylist())]) for c in ("hit_query", "hit_query_id", "hit_id", "hit_score")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "query_id", "vec_id", "score"])


def _splits(valid: DataFrame, shard_size: int) -> tuple[dict[int, list[tuple[int, float, int]]], int]:
    """The top splits for each length of vectors that needs any, from a bounded sample; and the number of vectors."""
    cores = valid.sparkSession.sparkContext.defaultParallelism
    counts = {r["dim"]: r["count"] for r in valid.groupBy("dim").count().collect()}
    cells = {d: max(-(-n // shard_size), min(2 * cores, n // 2048)) for d, n in counts.items()}
    some = {d: c for d, c in cells.items() if c > 1}
    out = {}
    for dim, n in some.items():
        part = min(1.0, SAMPLE / counts[dim])
        luck = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30))
        drawn = valid.where((F.col("dim") == dim) & (luck < int(part * (1 << 30)))).select("embedding").limit(2 * SAMPLE).toArrow()
        if drawn.num_rows:
            out[dim] = top_splits(_whole(drawn["embedding"], dim), n)
    return out, sum(counts.values())


def top_products(vectors: DataFrame, queries: Column, k: int = 5, shard_size: int = SHARD) -> DataFrame:
    """For each row of vectors (vec_id, embedding) where `queries` holds, its k best other rows: query_id, rank, vec_id, score.

    score: the inner product of floor(256 x) over the components; ties go to the
    smaller vec_id. Only vectors of equal length are compared. Rows whose vec_id or vector is null, or
    that hold a null or non-finite component, take no part. Repeated rows are candidates each, also for each other,
    and queries each. Fewer rows than k: all of them. Other columns are ignored.

    Scores are exact up to 2**53; larger ones are sums of doubles, and those beyond a long are its nearest end
    (components beyond 1e150 count as that).
    """
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    valid = valid.withColumn("dim", F.size("embedding"))
    splits, _ = _splits(valid, shard_size)
    numbered = bounded(valid.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "is_query", "dim", "embedding"))
    routed = stored(numbered.mapInArrow(_routed(splits), "row long, vec_id long, is_query boolean, dim int, cell int, vector binary"))
    # one row a cell; a cell of too many vectors is dealt by a hash of the row's number
    full = routed.groupBy("dim", "cell").count().where(F.col("count") > 2 * shard_size).select("dim", "cell", F.ceil(F.col("count") / shard_size).cast("int").alias("pieces"))
    dealt = routed.join(full, ["dim", "cell"], "left").withColumn("piece", F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    blocks = stored(dealt.groupBy("dim", "cell", "piece").applyInArrow(_home(k), _BLOCK))
    asked = blocks.where("query IS NOT NULL")
    here = asked.select("hit_query", "hit_query_id", "hit_id", "hit_score").mapInArrow(_unpacked, _HIT)
    # the shards' boxes, some at a time: each part is of a bounded size
    boxes = blocks.where("query IS NULL").select("dim", "cell", "piece", "low", "high", "least_id")
    size = boxes.agg(F.sum(F.octet_length("low") * 2 + 64).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // BOX_BYTES))
    sent = None
    for p in range(parts):
        own = [r.asDict() for r in boxes.where(F.pmod(F.xxhash64("dim", "cell", "piece"), F.lit(parts)) == p).collect()]
        part = asked.select("dim", "cell", "piece", "query", "ids", "vectors", "known", "known_id").mapInArrow(_sent(own), _SENT)
        sent = part if sent is None else sent.unionByName(part)
    away = dealt.groupBy("dim", "cell", "piece").cogroup(sent.groupBy("dim", "cell", "piece")).applyInArrow(_away(k), _HIT)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return here.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Op 7: every fiftieth vector against all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM s WHERE rank <= 5
"""
