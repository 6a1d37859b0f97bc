"""A byte-level convolutional quality classifier in numpy.

Filters over WIDTH consecutive bytes slide over the whole text. Their responses
are max-pooled over overlapping chunks of CHUNK bytes, a small hidden layer turns
each chunk's maxima into a logit, and the mean of a text's logits gives one
probability. A filter is a table of weights by place and byte value; for scoring two
neighbouring places are joined into one table of 65,536 rows.

The fit takes a bounded sample of labelled rows (SAMPLE_ROWS and SAMPLE_BYTES)
with all their chunks; the scores cover every chunk of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import chunks, release, text_bytes
from .session import bounded

WIDTH, FILTERS, HIDDEN = 6, 24, 12
#: Bytes of a block; blocks of a chunk, and blocks from one chunk's start to the next.
BLOCK, SPAN, STRIDE = 64, 6, 5
#: Rows and bytes of text that the fit may take, and its rounds.
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS = 4000, 10_000_000, 8


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each followed by zeros (WIDTH at least) to whole blocks; and n + 1 offsets in blocks."""
    size = np.diff(offs)
    blocks = (size + WIDTH + BLOCK - 1) // BLOCK
    at = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(at[-1]) * BLOCK + WIDTH, np.uint8)
    where = np.arange(len(data)) + np.repeat(at[:-1] * BLOCK - offs[:-1], size)
    out[where] = data
    return out, at


def chunk_starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each chunk's text, and its first and last-but-one block."""
    n = np.maximum(1, -(-(np.diff(at) - (SPAN - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = at[:-1][text] + k * STRIDE
    return text, first, np.minimum(first + SPAN, at[1:][text])


class Net:
    """Filters (WIDTH x 256 x FILTERS), their biases, and the two dense layers."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w = {
            "filters": (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.25).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": (rng.standard_normal((FILTERS, HIDDEN)) / np.sqrt(FILTERS)).astype(np.float32),
            "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32),
            "out_shift": np.zeros(1, np.float32),
        }

    def logits(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = np.tanh(most + self.w["shift"])
        h = np.tanh(m @ self.w["hidden"] + self.w["hidden_shift"])
        return m, h, h @ self.w["out"] + self.w["out_shift"][0]

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> None:
        """x: chunks as rows of bytes; y: their texts' labels. Adam; the gradient of a maximum goes to where it was reached."""
        rng = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        t, places = 0, x.shape[1] - WIDTH + 1
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            order = rng.permutation(len(x))
            for a in range(0, len(x), 128):
                rows = order[a : a + 128]
                b = x[rows].astype(np.int64)
                conv = self.w["filters"][0][b[:, :places]]
                for j in range(1, WIDTH):
                    conv += self.w["filters"][j][b[:, j : j + places]]
                arg = conv.argmax(1)
                most = np.take_along_axis(conv, arg[:, None, :], 1)[:, 0]
                m, h, z = self.logits(most)
                d = (1 / (1 + np.exp(-z)) - y[rows]) * weight[rows] / len(rows)
                dh = d[:, None] * self.w["out"] * (1 - h * h)
                dm = (dh @ self.w["hidden"].T) * (1 - m * m)
                g = {"out": h.T @ d, "out_shift": np.array([d.sum()]), "hidden": m.T @ dh, "hidden_shift": dh.sum(0), "shift": dm.sum(0), "filters": np.zeros_like(self.w["filters"])}
                which = np.broadcast_to(np.arange(FILTERS), arg.shape)
                for j in range(WIDTH):
                    np.add.at(g["filters"][j], (np.take_along_axis(b, arg + j, 1), which), dm)
                t += 1
                for k, v in self.w.items():
                    gk = g[k].astype(np.float32) + 1e-5 * v
                    first[k] = 0.9 * first[k] + 0.1 * gk
                    second[k] = 0.999 * second[k] + 0.001 * gk * gk
                    v -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)

    def pairs(self) -> list[np.ndarray]:
        f = self.w["filters"]
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]


def scores(net: Net, tables: list[np.ndarray], data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each text's probability."""
    text, at = padded(data, offs)
    two = text[:-1].astype(np.int32) * 256 + text[1:]
    n = int(at[-1])
    most = np.empty((n + 1, FILTERS), np.float32)
    step = 256
    # a text's last places would read on into the next one; the same run of zeros stands before them
    crossing = ((at[1:] * BLOCK)[:, None] - np.arange(1, WIDTH)).reshape(-1)
    crossing.sort()
    for a in range(0, n, step):
        z = min(n, a + step)
        conv = tables[0][two[a * BLOCK : z * BLOCK]]
        for j in range(1, len(tables)):
            conv += tables[j][two[a * BLOCK + 2 * j : z * BLOCK + 2 * j]]
        lo, hi = np.searchsorted(crossing, (a * BLOCK, z * BLOCK))
        conv[crossing[lo:hi] - a * BLOCK] = -np.inf
        most[a:z] = conv.reshape(z - a, BLOCK, FILTERS).max(1)
    most[n] = -np.inf
    of, first, end = chunk_starts(at)
    spans = np.stack([first, end], 1).reshape(-1)
    pooled = np.maximum.reduceat(most, spans, axis=0)[::2]
    z = net.logits(pooled)[2]
    mean = np.bincount(of, z, len(offs) - 1) / np.bincount(of, minlength=len(offs) - 1)
    return 1 / (1 + np.exp(-mean))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        text, at = padded(data, offs)
        of, first, _ = chunk_starts(at)
        bounds = np.searchsorted(of, np.arange(len(offs)))
        rows, out = [], []  # every chunk of every row
        for i in range(len(offs) - 1):
            for k in range(bounds[i + 1] - bounds[i]):
                a = first[bounds[i] + k] * BLOCK
                end = at[i + 1] * BLOCK
                rows.append(i)
                out.append(text[a : min(a + SPAN * BLOCK + WIDTH - 1, end)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), batch.column("label").take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], names=["doc_id", "label", "chunk"])


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Net | None:
    """A net fitted on a bounded sample of labels (doc_id, label 0/1) of docs for which `train` holds.

    The sample has whole texts, none of more than an eighth of sample_bytes.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & F.coalesce(train, F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not n:
        return None
    luck = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30))
    part = F.when(F.col("label") == 1, min(1.0, sample_rows / 2 / n.get(1, 1))).otherwise(min(1.0, sample_rows / 2 / n.get(0, 1)))
    drawn = F.broadcast(known.where(luck < part * (1 << 30)))  # about sample_rows rows
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # whole texts of each label up to half of the bytes, by luck
    before = F.sum(size).over(Window.partitionBy("label").orderBy(luck, "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    taken = docs.select("doc_id", "text").join(drawn, "doc_id").where(size <= sample_bytes // 8).withColumn("upto", before).where(F.col("upto") <= sample_bytes // 2)
    found = bounded(taken.select("doc_id", "text", "label")).mapInArrow(_examples, "doc_id long, label int, chunk binary").orderBy("doc_id", "chunk").toArrow()
    if not found.num_rows:
        return None
    y = np.asarray(found["label"]).astype(np.float32)
    x = np.zeros((len(y), SPAN * BLOCK + WIDTH - 1), np.uint8)
    data, offs = text_bytes(found["chunk"])
    size = np.diff(offs)
    x[np.repeat(np.arange(len(y)), size), np.arange(len(data)) - np.repeat(offs[:-1], size)] = data
    _, inverse, count = np.unique(np.asarray(found["doc_id"]), return_inverse=True, return_counts=True)
    weight = 1.0 / count[inverse]
    for v in (0, 1):
        if (y == v).any():
            weight[y == v] *= 0.5 / weight[y == v].sum()
    net = Net()
    net.train(x, y, (weight * len(y)).astype(np.float32))
    return net


def _scorer(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pairs()
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            parts = [scores(net, tables, d, o) for _, _, d, o in chunks(data, offs)]
            out = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate([np.zeros(0), *parts]).astype(np.float64))], names=[*out.schema.names, "score"])
            release()

    return run


def judge(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of docs (doc_id, text) other than text, with score (0 to 1) and predicted (1 from 0.5 on).

    labels: doc_id, label (0 or 1; others are left out; of several for a doc_id the larger counts). `train` is a condition
    on doc_id; only labels for which it holds are looked at. A null or empty text is one chunk of padding and gets
    a score like any other. Without usable labels every score is 0.5. Repeated rows stay; columns named score or
    predicted are replaced.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted", "text")]
    net = fit(docs, labels, train, sample_rows)
    if net is None:
        out = docs.select(*own).withColumn("score", F.lit(0.5))
    else:
        out = bounded(docs.select(*own, "text")).mapInArrow(_scorer(net), docs.select(*own).schema.add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """Op 4 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    out = judge(docs, labels, ~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
