"""Benchmark decontamination by edit distance over words.

A document leaks an item if some of its passages is within `rate` times the
item's words of it, counted in inserted, deleted and replaced words (letters and
digits only, lower-cased, so punctuation, case and white space don't count).

1. CGK: the windows at every word of a text, and those of the items, are read by
   the same random walks, which repeat or pass each word by a random bit of the
   word and the step. Words edited in or out are caught up with, so edit
   distance becomes Hamming distance between the embeddings.
2. Bit sampling: in each of WALKS walks, TABLES samples of SAMPLE places of the
   embedding make a key each. A document's window and an item's meet if they share
   a key; this is the only source of candidates. Windows are of the item's size, rounded
   down to one of SIZES. A document has one at every word; an item has several, moved by a sixth of
   a window, padded where they reach beyond it. So each leak has many chances: the sampling meets 0.95
   and more of passages with the most edits allowed, and nearly all with fewer (see the tests).
3. The items' keys are a table. A Bloom filter of them (of a bounded size) goes to the
   tasks that read the corpus, once; a window that passes is joined with the items
   by its keys, in broadcast if the table is small, beyond that by a shuffle that spares the keys with very many windows.
4. What meets is confirmed by the exact edit distance of the item to any passage around the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import join_by_size
from .kernels import U64, Words, chunks, mix64, release, text_bytes
from .session import bounded, stored

#: Share of an item's words that may be edited.
RATE = 0.2
WALKS, TABLES, SAMPLE = 2, 4, 5
#: Words of the windows.
SIZES = (1, 2, 3, 4, 5, 6, 7, 10, 15, 22, 33, 50)
#: Bits of the filter for a key, its most bits, probes besides the one in front, and the front's most bits.
KEY_BITS, MOST_BITS, PROBES, FRONT_BITS = 96, 1 << 30, 3, 1 << 24
#: Rows of the items' keys, and of found documents, that a broadcast may hold.
MOST_BROADCAST = 200_000
#: Bytes of text embedded at a time.
PIECE = 1 << 17
_PAD = U64(0)


@cache
def _places(walk: int, size: int) -> np.ndarray:
    """The sampled places of each table: one in each of as many equal ranges of the embedding, so that they are spread."""
    rng = np.random.Generator(np.random.PCG64(1000 * size + walk))
    ranges = min(SAMPLE, size)
    return ((np.arange(ranges) + rng.random((TABLES, ranges))) * size / ranges).astype(np.int64)


@cache
def _factors(walk: int, size: int) -> np.ndarray:
    """Odd multipliers of each table's places for the two halves of its keys, and one number more."""
    rng = np.random.Generator(np.random.PCG64(7_000_000 + 1000 * size + walk))
    return rng.integers(0, 1 << 31, (TABLES, 2, SAMPLE + 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class Walk:
    """CGK embeddings of the word rows that begin at `begin`; a pad (0) is never passed. Place by place the words' low halves, and how far each is from its row's begin."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, walk: int, steps: int) -> None:
        bits = mix64(words ^ mix64(U64([walk + 1])))
        bits[words == _PAD] = 0
        self.walk, self.begin, self.low, self.high = walk, begin, words.astype(np.uint32), (words >> U64(32)).astype(np.uint32)
        at = begin.copy()
        self.words: list[np.ndarray] = []
        self.passed: list[np.ndarray] = []
        for j in range(steps):
            self.words.append(self.low.take(at))
            self.passed.append((at - begin).astype(np.uint8))
            move = bits.take(at)
            move >>= U64(j)
            move &= U64(1)
            at += move.view(np.int64)

    def front(self, size: int, table: int) -> np.ndarray:
        """The upper half of one table's keys: a sum over the sampled places."""
        factor = _factors(self.walk, size)[table, 0]
        places = _places(self.walk, size)[table]
        key = self.words[places[0]] * factor[0]
        for f, j in zip(factor[1:], places[1:], strict=False):
            key += self.words[j] * f
        key ^= factor[SAMPLE]
        return key

    def keys(self, size: int, table: int, front: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The whole keys of some rows, of which front() is given."""
        factor = _factors(self.walk, size)[table, 1]
        low = np.full(len(at), factor[SAMPLE])
        for f, j in zip(factor, _places(self.walk, size)[table], strict=False):
            low += self.high[self.begin[at] + self.passed[j][at]] * f
        return (front[at].astype(U64) << U64(32)) | low


def size_of(n: int) -> int:
    return max(s for s in SIZES if s <= n)


def tables_of(edits: int) -> list[tuple[int, int]]:
    """Walks and tables that an item is in; if no edit is allowed, embeddings are equal and one is enough."""
    return [(r, t) for r in range(WALKS) for t in range(TABLES)] if edits else [(0, 0)]


def item_windows(n: int, edits: int) -> list[int]:
    """First words of an item's windows: one at its beginning and, if edits are allowed, one more every sixth of a window.

    A window that begins in the item's last half of a window would hardly be sampled within the item.
    """
    size = size_of(n)
    return list(range(0, n - size // 2 + 1, max(1, size // 6))) if edits else [0]


def item_keys(words: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """Each key of an item, with the first word of its window."""
    size, begin = size_of(len(words)), np.array(item_windows(len(words), edits))
    rows = np.zeros((len(begin), size + 1), U64)
    for i, a in enumerate(begin):
        rows[i, : len(words[a : a + size])] = words[a : a + size]
    rows = rows.reshape(-1)
    walks: dict[int, Walk] = {}
    out = []
    for r, t in tables_of(edits):
        w = walks.setdefault(r, Walk(rows, np.arange(len(begin)) * (size + 1), r, size)) if r not in walks else walks[r]
        keys = w.keys(size, t, w.front(size, t), np.arange(len(begin)))
        out += list(zip(keys.view(np.int64).tolist(), begin.tolist(), strict=True))
    return out


def _items(batches: Iterator[pa.RecordBatch], rate: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("low"))
        w = Words(data, offs, lower=True, letters_only=True)
        full = np.flatnonzero(np.diff(w.of))
        rows = [w.hash[w.of[i] : w.of[i + 1]] for i in full]
        edits = [int(len(r) * rate + 1e-9) for r in rows]
        keys = [item_keys(r, d) for r, d in zip(rows, edits, strict=True)]
        cols = [
            batch.column("item_id").take(pa.array(full)), batch.column("item").take(pa.array(full)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int32()),
            pa.array(edits, pa.int32()), pa.array([size_of(len(r)) for r in rows], pa.int32()), pa.array([[a for a, _ in k] for k in keys], pa.list_(pa.int64())), pa.array([[b for _, b in k] for k in keys], pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "item", "words", "n", "edits", "size", "keys", "begins"])


class Filter:
    """Bloom filter of keys: a front, by the key's upper half, that rejects nearly all at once, and probes behind it."""

    def __init__(self, keys: int) -> None:
        fit = lambda x, low, high: max(low, min(high, 1 << int(np.ceil(np.log2(max(x, 1))))))
        self.front = fit(128 * keys, 1 << 16, FRONT_BITS)
        self.bits = fit(KEY_BITS * keys, 1 << 16, MOST_BITS)
        self.words = np.empty(0, U64)

    def fill(self, at: np.ndarray, mask: np.ndarray) -> None:
        """Sets the marks of all keys, merged by word."""
        self.words = np.zeros((self.front + self.bits) // 64, U64)
        self.words[at] = mask.view(U64)

    def at(self, key: np.ndarray, probe: int) -> np.ndarray:
        """Bit of the filter that a key's probe is; probe 0 is the front's."""
        if probe == 0:
            return key >> U64(64 - self.front.bit_length() + 1)
        return U64(self.front) + (mix64(key + U64(probe)) & U64(self.bits - 1))

    def marks(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and masks that the keys set."""
        at = np.concatenate([self.at(key, i) for i in range(PROBES + 1)])
        return (at >> U64(6)).view(np.int64), (U64(1) << (at & U64(63))).view(np.int64)

    def maybe(self, front: np.ndarray) -> np.ndarray:
        """Rows whose keys' upper halves may be some item's."""
        if not hasattr(self, "_open"):
            self._open = np.unpackbits(self.words[: self.front // 64].view(np.uint8), bitorder="little").astype(bool)
        return np.flatnonzero(self._open.take(front >> np.uint32(32 - self.front.bit_length() + 1)))

    def passing(self, key: np.ndarray) -> np.ndarray:
        """Which of the keys that the front lets through may be some item's."""
        found = np.arange(len(key))
        for i in range(1, PROBES + 1):
            at = self.at(key[found], i)
            found = found[(self.words[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1]
        return found


def candidates(w: Words, sizes: dict[int, tuple[int, int, bool]], known: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each size with the start words and keys of the windows whose keys may be an item's.

    sizes: window size -> words before and behind a window's start that an item may cover, and whether edits are allowed.
    """
    if not len(w.hash):
        return
    # a pad behind each text; places of the words in the padded row
    of = np.repeat(np.arange(len(w.of) - 1), np.diff(w.of))
    begin = np.arange(len(w.hash)) + of
    row = np.zeros(len(w.hash) + len(w.of) - 1, U64)
    row[begin] = w.hash
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in range(WALKS):
        own = {s: x for s, x in sizes.items() if r == 0 or x[2]}
        if not own:
            break
        walk = Walk(row, begin, r, max(own))
        for size, (_, _, edited) in own.items():
            for t in range(TABLES if edited else 1):
                front = walk.front(size, t)
                at = known.maybe(front)
                if len(at):
                    found.setdefault(size, []).append((at, walk.keys(size, t, front, at)))
    for size, parts in found.items():
        at, key = np.concatenate([a for a, _ in parts]), np.concatenate([k for _, k in parts])
        good = known.passing(key)
        if len(good):
            yield size, at[good], key[good]


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows that are equal in all columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    return number


def _passages(w: Words, at: np.ndarray, key: np.ndarray, words: int) -> np.ndarray:
    """One row for each text, key and different passage of `words` words from `at` on (fewer at a text's end)."""
    text = np.searchsorted(w.of, at, "right") - 1
    number = _numbered(text, key)
    for j in range(words):
        if number.max(initial=-1) + 1 == len(at):
            break
        word = np.where(at + j < w.of[text + 1], w.hash[np.minimum(at + j, len(w.hash) - 1)], _PAD)
        number = _numbered(number, word)
    return np.sort(np.unique(number, return_index=True)[1])


def _windows(batches: Iterator[pa.RecordBatch], sizes: dict[int, tuple[int, int, bool]], known) -> Iterator[pa.RecordBatch]:
    """Rows of (text, start, the words around the window, its first word among them, keys)."""
    for batch in batches:
        data, offs = text_bytes(batch.column("low"))
        for i, _, d, o in chunks(data, offs, PIECE):
            w = Words(d, o, lower=True, letters_only=True)
            for size, at, key in candidates(w, sizes, known.value):
                before, behind, edited = sizes[size]
                if not edited:
                    # equal passages are confirmed alike, so one says all; a key alone is of the few words that its walk reads
                    one = _passages(w, at, key, behind)
                    at, key = at[one], key[one]
                order = np.argsort(at, kind="stable")
                start, first = np.unique(at[order], return_index=True)
                keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(key[order].view(np.int64)))
                text = np.searchsorted(w.of, start, "right") - 1
                a, z = np.maximum(start - before, w.of[text]), np.minimum(start + behind, w.of[text + 1])
                region = pa.array([w.hash[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist(), strict=True)], pa.binary())
                row = pa.array(text + i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("print").take(row), pa.array(start - w.of[text], pa.int64()), region, pa.array(start - a, pa.int32()), keys], names=["doc_id", "print", "start", "region", "first", "keys"])
        release()


def edit_distance(item: np.ndarray, size: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Least edits between each item (row of words, of its size) and any passage of its region."""
    cols = np.arange(region.shape[1] + 1)
    d = np.zeros((len(item), len(cols)), np.int64)
    best = np.full(len(item), np.iinfo(np.int64).max)
    for i in range(int(size.max(initial=0))):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, :-1] + ((item[:, i : i + 1] != region) | (region == _PAD)), d[:, 1:] + 1)
        d = np.minimum.accumulate(new - cols, axis=1) + cols  # inserted words
        done = size == i + 1
        best[done] = d[done].min(1)
    return best


def _rows_of(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Words a .. z of each row, padded."""
    at = a[:, None] + np.arange(int((z - a).max(initial=0)))
    return np.where(at < z[:, None], data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else _PAD, _PAD)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose item is within its edits of a passage of the words around; each (document, place, item) of a batch once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = lambda c: np.asarray(batch.column(c))
        n, edits, place = col("n").astype(np.int64), col("edits").astype(np.int64), col("start") - col("begin")
        doc = batch.column("doc_id")
        _, once = np.unique(np.stack([np.asarray(doc.fill_null(0)), np.asarray(doc.is_null()).astype(np.int64), col("print"), place, col("item")]), axis=1, return_index=True)
        once = once[np.argsort(n[once], kind="stable")]  # rows of one width together
        region, ro = text_bytes(batch.column("region"))
        region, ro = np.frombuffer(region.tobytes(), U64), ro // 8
        words, wo = text_bytes(batch.column("words"))
        words, wo = np.frombuffer(words.tobytes(), U64), wo // 8
        at = ro[:-1] + col("first") - col("begin")  # where the item would begin
        good, least = [], []
        for i in range(0, len(once), 2048):
            r = once[i : i + 2048]
            a, z = np.maximum(at[r] - edits[r], ro[r]), np.minimum(at[r] + n[r] + edits[r], ro[r + 1])
            found = edit_distance(_rows_of(words, wo[r], wo[r + 1]), n[r], _rows_of(region, a, np.maximum(a, z)))
            good.append(r[found <= edits[r]])
            least.append(found[found <= edits[r]])
        take = pa.array(np.concatenate([np.empty(0, np.int64), *good]))
        cols = [batch.column(c).take(take) for c in ("doc_id", "print", "item_id", "n")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([np.empty(0, np.int64), *least]))], names=["doc_id", "print", "item_id", "item_words", "edits"])
        release()


def _joined(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """rows with the rows of a table of their key, keys with very many rows in broadcast."""
    counts = stored(rows.groupBy(on).agg(F.count("*").alias("rows")))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return join_by_size(rows, table.join(counts, on), [on], total)


def _leaks(docs: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame | None:
    """(doc_id, print of the text, item_id, item_words, edits), one or more for each leak; None without items."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    rows = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), F.lower("text").alias("low")).where("low IS NOT NULL").dropDuplicates(["item"])
    schema = f"item_id {kind.simpleString()}, item long, words binary, n int, edits int, size int, keys array<long>, begins array<int>"
    items = stored(bounded(rows).mapInArrow(lambda b: _items(b, rate), schema))
    pairs = items.select("item", F.explode(F.arrays_zip("keys", "begins")).alias("k")).select("item", F.col("k.keys").alias("key"), F.col("k.begins").alias("begin"))
    sizes = {}
    for r in items.select("size", "n", "edits", F.array_max("begins").alias("last")).groupBy("size").agg(F.max(F.col("last") + F.col("edits")).alias("before"), F.max(F.col("n") + F.col("edits")).alias("behind"), F.max("edits").alias("edits")).collect():
        sizes[r["size"]] = (r["before"], r["behind"], r["edits"] > 0)
    if not sizes:
        return None
    count = pairs.count()
    known = Filter(count)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, mask = known.marks(np.asarray(b.column("key")).view(U64))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask)], names=["at", "mask"])

    # at most a row for each word of the filter, whose bits are bounded
    told = pairs.select("key").mapInArrow(marks, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    known.fill(np.asarray(told["at"].combine_chunks()), np.asarray(told["mask"].combine_chunks()))
    shared = spark.sparkContext.broadcast(known)
    texts = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.lower("text").alias("low")))
    found = texts.mapInArrow(lambda b: _windows(b, sizes, shared), "doc_id long, print long, start long, region binary, first int, keys array<long>")
    known_items = items.select("item_id", "item", "words", "n", "edits")
    if count <= MOST_BROADCAST:
        met = found.withColumn("key", F.explode("keys")).drop("keys").join(F.broadcast(pairs), "key").join(F.broadcast(known_items), "item")
    else:
        # a passage that very many documents hold is a key, and then an item, with as many rows
        hits = stored(found).withColumn("key", F.explode("keys")).drop("keys")
        met = stored(_joined(hits, pairs, "key"))
        met = _joined(met, known_items, "item")
    return met.mapInArrow(_confirmed, f"doc_id long, print long, item_id {kind.simpleString()}, item_words int, edits long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, item_words, edits: the items that each document (doc_id, text) leaks, with the least edits.

    benchmark: item_id, text. Null and wordless texts and items leak nothing; an item of fewer than five words
    must stand unchanged. Repeated rows give one result. Other columns are ignored.
    """
    leaks = _leaks(docs, benchmark, rate)
    if leaks is None:
        kind = benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id long, item_id {kind}, item_words long, edits long")
    return leaks.groupBy("doc_id", "item_id", F.col("item_words").cast("long").alias("item_words")).agg(F.min("edits").alias("edits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that leak no item of benchmark, with all their columns. Rules as in find_leaks; rows go by doc_id and text."""
    leaks = _leaks(docs, benchmark, rate)
    if leaks is None:
        return docs
    gone = stored(leaks.select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print")).distinct())
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_print"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """Op 10 over all documents and the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
