"""Texts as blocks of coded words, and packed messages between blocks and hash buckets.

A block is one row: the hashes of its distinct words and, for every word of its
texts, a code into them, most frequent word first. Blocks are cut within
the partitions of the input and written once, bucketed by their numbers, so that
every later pass reads the same blocks where their answers are sent, without
reading, splitting or shuffling a text again.

Blocks and buckets talk in packed arrays: a message holds all that one block
has for one bucket, in the bucket's order. Messages are cut out of one sorted
array by its offsets; a bucket for which a block has nothing gets none. The
number of buckets follows the bytes of all texts, not the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, chunks, release, text_bytes
from .session import bounded, default_block, stored_by

_SCHEMA = "__block long, n_bytes long, sizes binary, vocab binary, codes binary, spelled binary, spelled_at binary, rest binary"
#: Parts of a table of blocks.
_MOST_PARTS = 20_000
#: A count of this and more stands in an array of its own, in 64 bits.
_BIG = 255


def _planes(x: np.ndarray) -> bytes:
    """Small numbers as four planes of bytes, which compress far better than the numbers themselves."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _block(table: pa.Table, lower: bool, spell: bool, number: int) -> pa.RecordBatch:
    data, offs = text_bytes(table["text"])
    hashes, sizes, starts, ends = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, _, d, o in chunks(data, offs):
        w = Words(d, o, lower=lower)
        hashes.append(w.hash)
        sizes.append(np.diff(w.of))
        if spell:
            starts.append(w.start + offs[i])
            ends.append(w.end + offs[i])
    every = np.concatenate(hashes)
    vocab, first, codes = distinct_any(every)
    count = np.bincount(codes, minlength=len(vocab))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    spelled, spelled_at = b"", b""
    if spell:
        a, z = np.concatenate(starts)[first[order]], np.concatenate(ends)[first[order]]
        size = z - a
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        take = np.repeat(a - at[:-1], size) + np.arange(int(at[-1]))
        spelled, spelled_at = data[take].tobytes(), at.tobytes()
    rest = _ipc(table.drop_columns(["text"]))
    cols = [[number], [len(data)], [np.concatenate(sizes).astype(np.int64).tobytes()], [vocab[order].tobytes()], [_planes(rank[codes])], [spelled], [spelled_at], [rest]]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.large_binary()).cast(pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(cols)], names=names)


def _pack(batches: Iterator[pa.RecordBatch], lower: bool, spell: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Whole rows of about `most` bytes to a block."""
    base = TaskContext.get().partitionId() << 32
    waiting: list[pa.RecordBatch] = []
    held = made = 0
    for batch in batches:
        _, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most - held, "right")) - 1)
            waiting.append(batch.slice(at, to - at))
            held += int(offs[to] - offs[at])
            at = to
            if held >= most or at < batch.num_rows:
                yield _block(pa.Table.from_batches(waiting), lower, spell, base + made)
                waiting, held, made = [], 0, made + 1
                release()
    if waiting:
        yield _block(pa.Table.from_batches(waiting), lower, spell, base + made)
        release()


def coded_blocks(docs: DataFrame, lower: bool, spell: bool = False, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Blocks of docs (text and any other columns, which go along unread), stored, and the number of buckets for them.

    lower: words with A-Z lower-cased; spell: the words' bytes are kept too. A null text has no words; no text is cut in two.
    """
    spark = docs.sparkSession
    most = block_bytes or default_block(spark)
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(int(-(-total // most)), min(3 * spark.sparkContext.defaultParallelism, int(total // (1 << 18)) + 1), 1)
    return stored_by(bounded(docs, most).mapInArrow(lambda b: _pack(b, lower, spell, most), _SCHEMA), "__block", parts_of(n)), n


def parts_of(n: int) -> int:
    """Parts of the tables of blocks and answers."""
    return min(n, _MOST_PARTS)


class Coded:
    """A block's texts: their words' codes, words a text, and hashes of the words that the codes name."""

    def __init__(self, row: pa.Table) -> None:
        raw = lambda c: row[c][0].as_py()
        self.number = raw("__block")
        self.size = np.frombuffer(raw("sizes"), np.int64)
        self.vocab = np.frombuffer(raw("vocab"), U64)
        self.codes = _from_planes(raw("codes"))
        self.of = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self._row = row

    @property
    def rest(self) -> pa.Table:
        """The rows' other columns."""
        return pa.ipc.open_stream(self._row["rest"][0].as_buffer()).read_all()

    @property
    def spelled(self) -> list[bytes]:
        """The bytes of each word."""
        data, at = self._row["spelled"][0].as_py(), np.frombuffer(self._row["spelled_at"][0].as_py(), np.int64).tolist()
        return [data[a:z] for a, z in zip(at, at[1:], strict=False)]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash: a range of its low half."""
    return ((h & U64(0xFFFFFFFF)) * U64(n)) >> U64(32)


def short_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket and a 32-bit fingerprint within it, in one number that sorts by bucket."""
    return (bucket_of(h, n) << U64(32)) | (h >> U64(32))


def whole_keys(h: np.ndarray) -> np.ndarray:
    """All 64 bits of a hash, its halves exchanged, so that it sorts by bucket."""
    return (h << U64(32)) | (h >> U64(32))


def bucket_starts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the part of each of n buckets begins in sorted whole_keys(), and the end."""
    first = [-(-(b << 32) // n) << 32 for b in range(n)]
    return np.append(np.searchsorted(keys, np.array(first, U64)), len(keys))


def _offsets(cuts: np.ndarray, width: int) -> pa.Buffer:
    return pa.py_buffer((cuts * width).astype(np.int32))


def cut_binary(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """x[cuts[i]:cuts[i + 1]] as the i-th binary value, without copies."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, _offsets(cuts, x.itemsize), pa.py_buffer(np.ascontiguousarray(x))])


def _by_byte(cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first byte of each value stands if each message has its values' bytes one kind after another, and the step to the next kind."""
    size = np.diff(cuts)
    step = np.repeat(size, size)
    return np.arange(int(cuts[-1])) + (width - 1) * np.repeat(cuts[:-1], size), step


def cut_prints(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Sorted 32- or 64-bit values cut into messages, each with its highest bytes first: these run on and compress to nothing."""
    width = x.itemsize
    raw = x.astype(f">u{width}").view(np.uint8).reshape(-1, width)
    at, step = _by_byte(cuts, width)
    out = np.empty(width * len(x), np.uint8)
    for b in range(width):
        out[at + b * step] = raw[:, b]
    return cut_binary(out, width * cuts)


def prints_of(column: pa.ChunkedArray, kind=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The values of cut_prints(), of all rows behind one another, and the offsets of each row's."""
    width = np.dtype(kind).itemsize
    raw, offs = all_of(column, np.uint8)
    cuts = offs // width
    at, step = _by_byte(cuts, width)
    out = np.empty((int(cuts[-1]), width), np.uint8)
    for b in range(width):
        out[:, b] = raw[at + b * step]
    return out.reshape(-1).view(f">u{width}").astype(kind), cuts


def small_counts(x: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts of any size as a byte each, the large ones besides in 64 bits, cut like the items they belong to."""
    big = x >= _BIG
    before = np.concatenate([[0], np.cumsum(big)])
    return cut_binary(np.minimum(x, _BIG).astype(np.uint8), cuts), cut_binary(x[big].astype(np.int64), before[cuts])


def all_of(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column behind one another, and the offsets of each row's."""
    data, offs = text_bytes(column)
    return np.frombuffer(data.tobytes(), dtype), offs // np.dtype(dtype).itemsize


def counts_of(small: pa.ChunkedArray, big: pa.ChunkedArray) -> np.ndarray:
    """The counts of small_counts(), of all rows behind one another."""
    x = all_of(small, np.uint8)[0].astype(np.int64)  # a null has none
    x[x == _BIG] = all_of(big, np.int64)[0]
    return x


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the place of the first of each, and for every place its value's number."""
    return _numbered(key, np.argsort(key, kind="stable"))


def distinct_any(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As distinct() for unsigned 64-bit hashes, with the place of any one of each.

    Sorting numbers takes a third of the time of sorting their places, so the places stand in the low bits of what is sorted; keys that
    differ in these bits alone are put in order afterwards.
    """
    low = U64(max(len(key) - 1, 0).bit_length())
    packed = np.sort(key >> low << low | np.arange(len(key), dtype=U64))
    order = (packed & ((U64(1) << low) - U64(1))).view(np.int64)
    ordered = key[order]
    same = (packed[1:] >> low) == (packed[:-1] >> low)
    split = np.flatnonzero(same & (ordered[1:] != ordered[:-1]))
    if len(split):
        run = np.cumsum(np.append(True, ~same))
        mixed = np.flatnonzero(np.isin(run, run[split]))
        order[mixed] = order[mixed][np.argsort(key[order[mixed]])]
    return _numbered(key, order)


def _numbered(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ordered = key[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def each_row(work):
    """mapInArrow function: work(one-row table) for each block, giving a table or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = work(pa.Table.from_batches([batch.slice(i, 1)]))
                release()
                if out is not None and out.num_rows:
                    yield from out.combine_chunks().to_batches()

    return run


def with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """The blocks with the columns of their answers, numbered by level; all lie bucketed alike, so nothing is shuffled."""
    for level, told in enumerate(answers):
        blocks = blocks.join(told.select("__block", *(F.col(c).alias(f"{c}{level}") for c in told.columns if c != "__block")), "__block", "left")
    return bounded(blocks)


def _merged(table: pa.Table) -> pa.Table:
    """A block's answers as one row, each column's bytes in the order of the buckets; numbers in `stats` are summed."""
    table = table.sort_by("bucket")
    cols = {"__block": table["__block"].slice(0, 1)}
    for c in table.column_names:
        if c == "stats":
            found = [s for s in table[c].to_pylist() if s]
            cols[c] = pa.array([[sum(x) for x in zip(*found, strict=True)] or None], pa.list_(pa.int64()))
        elif c not in ("bucket", "__block"):
            cols[c] = pa.array([all_of(table[c], np.uint8)[0].tobytes()], pa.binary())
    return pa.table(cols)


def answered(blocks: DataFrame, answers: list[DataFrame], ask, messages: str, answer, told: str, parts: int) -> DataFrame:
    """One exchange, stored: ask(block row) -> messages (bucket, __block, ...), answer(a bucket's messages) -> rows of `told`, merged by block."""
    asked = with_answers(blocks, answers).mapInArrow(each_row(ask), messages)
    back = asked.groupBy("bucket").applyInArrow(answer, told)
    merged = ", ".join(c for c in told.split(", ") if c.split()[0] != "bucket")
    return stored_by(back.groupBy("__block").applyInArrow(_merged, merged), "__block", parts)
