"""Near-duplicate groups by HyperMinHash.

1. A text's distinct shingles become a sketch: each shingle's hash names a
   bucket, and a bucket keeps its smallest second hash, compressed to the count
   of leading zeros and a few mantissa bits. Texts with equal sets collapse to
   the one with the smallest doc_id before anything is compared.
2. Bands of compressed registers are hashed; sketches that share a band meet.
   The agreement of their registers, corrected for registers that agree by
   chance, estimates their Jaccard similarity; pairs clearly below the threshold
   go. What is left ties documents into families.
3. Inside a family, pairs are confirmed on their full shingle sets, skipping
   pairs that confirmed links join already. The links' connected components are
   the result.

Groups (of a band, or families) are compared in two steps, and tasks return
forests (at most one link a member), never all pairs. First each member goes to
one part of its group, of a bounded size, where also a few representatives of
the group are: members are compared with one another and with these. In a group
of copies this joins nearly all to one component, its core. Only if members
outside of the core are left in other parts do these visit the other parts, which costs them
times the parts.

Where that would cost more than WIDE rows a member - a family of pages made from one
template, alike but not alike enough - members meet by rare shingles instead. Shingles are
put in one order, rare ones first by bounded counts of all of them. Of two sets that reach
the threshold, one of the smaller one's first n - ceil(2t / (1 + t) n) + 1 shingles is
among the larger one's first n - ceil(t n) + 1, whatever the order is. So members are dealt again by those of
their first shingles that another member has too, which loses no link; the
template's shingles come late in the order, where nobody meets. Rows stay proportional to
the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, join_by_size
from .kernels import U64, Words, chunks, mix64, release, sequence_hash, text_bytes, windows
from .session import bounded, stored

#: Registers, registers in a band, and mantissa bits of a register (besides 6 bits of leading zeros).
REGISTERS, ROWS, MANTISSA = 160, 5, 10
#: Members of a part, bytes of its shingle sets, and representatives of a group in each part.
PART, PART_BYTES, REPRESENTATIVES = 1024, 16 << 20, 8
#: Rows a member that visits may cost, and cells of the counts that order shingles (8 MB).
WIDE, CELLS = 4, 1 << 20
#: Ids that a broadcast may hold; beyond it the same join is shuffled.
MOST_BROADCAST = 500_000
_SALT = mix64(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_UNSET = U64((1 << 64) - 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes; a shorter text is one shingle."""
    for _, _, d, o in chunks(data, offs):
        w = Words(d, o, lower=True)
        h, at = windows(w, k)
        cut = np.searchsorted(at, w.of)
        size = np.diff(w.of)
        whole = sequence_hash(w)
        for i in range(len(o) - 1):
            if size[i] >= k:
                yield np.unique(h[cut[i] : cut[i + 1]])
            else:
                yield whole[i : i + 1] if size[i] else np.empty(0, U64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The compressed registers of each non-empty set, one row a set.

    An empty bucket takes the smallest of a hash of its own over the whole set,
    so two sets agree in any bucket with the probability of their similarity.
    """
    n = len(sets)
    least = np.full((n, REGISTERS), _UNSET, U64)
    if n:
        every = np.concatenate(sets)
        row = np.repeat(np.arange(n), [len(s) for s in sets])
        bucket = ((every & U64(0xFFFFFFFF)) * U64(REGISTERS)) >> U64(32)
        np.minimum.at(least.reshape(-1), row * REGISTERS + bucket.astype(np.int64), mix64(every + U64(0x632BE59BD9B4E019)))
        for i in np.flatnonzero((least == _UNSET).any(1)):
            empty = np.flatnonzero(least[i] == _UNSET)
            step = max(1, (1 << 18) // len(sets[i]))
            for a in range(0, len(empty), step):
                j = empty[a : a + step]
                least[i, j] = mix64(sets[i][None, :] ^ _SALT[j][:, None]).min(1)
    part, exponent = np.frexp((least >> U64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint16)
    mantissa = ((part * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.uint16)
    return (zeros << MANTISSA) | mantissa


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash for each band of each sketch."""
    bands = regs.reshape(len(regs), -1, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=U64) * U64(0xD6E8FEB86659FD93), bands.shape[:2])
    for r in range(ROWS):
        key = mix64(key + bands[:, :, r] + U64(1))
    return key.view(np.int64)


def similarity(agree: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers and the sizes of the sets.

    Two different minima share a register when they fall into one cell; for
    loads a and b of a bucket this has the probability
    ab / (a + b)**2 * ln(2)**-1 / 2 * 2**-MANTISSA, which is taken off.
    """
    chance = (n * m) / (n + m) ** 2 * (0.5 / np.log(2)) * 2.0**-MANTISSA
    return (agree - chance) / (1 - chance)


class _Forest:
    """Labels of the rows of one group; joins are remembered as links."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.label[i], self.label[j]))
        self.label[self.label == b] = a
        self.links.append((i, j))


def _join_similar(left: np.ndarray, right: np.ndarray | None, regs: np.ndarray, n: np.ndarray, ids: np.ndarray, core: np.ndarray, least: float, confirm: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """Links of a forest over all pairs of left, or of left x right, whose estimate reaches `least` and that confirm."""
    forest = _Forest(len(regs))
    for k, i in enumerate(left):
        others = left[:k] if right is None else right[core[right] | (ids[right] < ids[i])]
        if not len(others):
            continue
        # the row that most of the others already hang on comes first: often nothing else is left to compare
        for to in (others[:1], others):
            to = to[forest.label[to] != forest.label[i]]
            if not len(to):
                continue
            close = similarity((regs[to] == regs[i]).mean(1), n[to], n[i])
            best = np.argsort(-close, kind="stable")
            for j in to[best[: int((close >= least).sum())]]:
                if forest.label[i] != forest.label[j] and (confirm is None or confirm(i, j)):
                    forest.join(i, j)
    return forest.links


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows in the order of the keys, with the groups' bounds."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        cols = [np.asarray(t[k].combine_chunks()) for k in keys]
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        rest = t.slice(at[-1])
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _fixed(col: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    data, _ = text_bytes(col)
    return data.view(dtype).reshape(-1, width)


def _links_in_groups(least: float, over: tuple[int, int] | None, visiting: bool):
    """mapInArrow function: forests of the (g, part, chunk) groups; with `over`, confirmed on the sets in column prints.

    All rows are compared with one another; if `visiting`, visitors with the rows that stay: with members
    of the core and with smaller ids of the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole_groups(batches, ["g", "part", "chunk"]):
            ids = np.asarray(t["id"].combine_chunks())
            n = np.asarray(t["n"].combine_chunks()).astype(float)
            visits = np.asarray(t["visits"].combine_chunks())
            core = np.asarray(t["core"].combine_chunks())
            regs = _fixed(t["sketch"], np.uint16, REGISTERS)
            pairs = np.flatnonzero(np.diff(bounds) == 2)
            out: list[tuple[int, int]] = []
            sets: Callable[[int], np.ndarray] | None = None
            if over:
                data, offs = text_bytes(t["prints"])
                sets = lambda i: np.frombuffer(data[offs[i] : offs[i + 1]].tobytes(), U64)
            else:
                a = bounds[pairs]
                close = similarity((regs[a] == regs[a + 1]).mean(1), n[a], n[a + 1])
                out += [(i, i + 1) for i in a[close >= least].tolist()] if not visiting else []
            for k in range(len(bounds) - 1):
                a, b = int(bounds[k]), int(bounds[k + 1])
                away = np.flatnonzero(visits[a:b])
                if b - a < 2 or visiting and not len(away) or b - a == 2 and not over and not visiting:
                    continue
                own = {}

                def confirm(i: int, j: int, a=a, own=own) -> bool:
                    for x in (i, j):
                        if x not in own:
                            own[x] = sets(a + x)
                    both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                    return over[1] * both >= over[0] * (len(own[i]) + len(own[j]) - both)

                rows = np.arange(b - a)
                links = _join_similar(away if visiting else rows, rows[~visits[a:b]] if visiting else None, regs[a:b], n[a:b], ids[a:b], core[a:b], least, confirm if over else None)
                out += [(a + i, a + j) for i, j in links]
            yield pa.RecordBatch.from_arrays([pa.array(ids[[i for i, _ in out]] if out else [], pa.int64()), pa.array(ids[[j for _, j in out]] if out else [], pa.int64())], names=["a", "b"])

    return run


def _sorted_groups(rows: DataFrame, work) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g", "part", "chunk").sortWithinPartitions("g", "part", "chunk").mapInArrow(work, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """First step: rows (g, id, parts, ...) in the part of their group by a hash of the id, and its representatives, those with the least hashes, in all parts."""
    luck = F.xxhash64("id", F.lit(7))
    part = F.pmod(luck, F.col("parts")).cast("int")
    # within a part the least hashes of a few equal ranges: known without ranking the group
    picked = F.pmod(F.xxhash64("id", F.lit(8)), F.ceil(F.col("size") / REPRESENTATIVES).cast("long")) == 0
    where = F.when(picked & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    return rows.withColumn("part", F.explode(where)).withColumn("chunk", F.lit(0)).withColumn("visits", F.lit(False)).withColumn("core", F.lit(False)).drop("parts", "size")


def _open(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """Rows of groups of several parts that `found` (node, component) leaves in several components, with core: whether they are in the largest; rest: members outside of it."""
    several = rows.where("parts > 1").join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    counts = several.groupBy("g", "c").agg(F.count("*").alias("members"))
    groups = counts.groupBy("g").agg(F.max(F.struct("members", "c")).alias("core"), F.sum("members").alias("rows"))
    groups = stored(groups.where("core.members < rows").select("g", "rows", F.col("core.c").alias("core_c"), (F.col("rows") - F.col("core.members")).alias("rest")))
    return join_by_size(several, groups, ["g"], total).withColumn("core", F.col("c") == F.col("core_c")).withColumn("chunks", F.ceil(F.col("rest") / PART).cast("int")).drop("component", "c", "core_c")


def _visits(own: DataFrame) -> DataFrame:
    """Second step for _open() rows: members outside of the core visit the other parts, in chunks of a part's size."""
    at = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")
    stay = own.withColumn("part", at).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("visits", F.lit(False))
    away = own.where("NOT core").withColumn("part", F.explode(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), at)))
    away = away.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(9)), F.col("chunks")).cast("int")).withColumn("visits", F.lit(True))
    return stay.unionByName(away).drop("parts", "size", "rest", "chunks")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's sets have a shingle of each cell."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        data, _ = text_bytes(batch.column("prints"))
        counts += np.bincount((np.frombuffer(data.tobytes(), U64) & U64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], names=["cell", "n"])


def first_shingles(prints: np.ndarray, counts: np.ndarray, over: tuple[int, int]) -> tuple[np.ndarray, int]:
    """A set's shingles that it meets others by, rare ones first, and how many of them a set of its size or larger meets it by.

    Of two sets with a similarity of `over` or more, these of the smaller one and those of the larger one have one in common.
    """
    n, (a, b) = len(prints), over
    ordered = prints[np.lexsort((prints, counts[(prints & U64(CELLS - 1)).astype(np.int64)]))]
    return ordered[: n + (-a * n // b) + 1], n + (-2 * a * n // (a + b)) + 1


def _first(batches: Iterator[pa.RecordBatch], counts, over: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("prints"))
        group, core = np.asarray(batch.column("g")).view(U64), np.asarray(batch.column("core"))
        every = np.frombuffer(data.tobytes(), U64)
        keys, own, index = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        for i in range(batch.num_rows):
            first, least = first_shingles(every[offs[i] // 8 : offs[i + 1] // 8], counts.value, over)
            keys.append(mix64(first + mix64(group[i : i + 1])))
            own.append(np.full(len(first), i))
            index.append(np.arange(len(first)) < least)
        at = np.concatenate(own)
        cols = [batch.column("id").take(pa.array(at)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(index)), pa.array(core[at]), batch.column("n").take(pa.array(at))]
        yield from pa.table(cols, names=["id", "g", "index", "core", "n"]).to_batches(max_chunksize=1 << 16)


def _met_by_shingles(own: DataFrame, over: tuple[int, int]) -> tuple[DataFrame, int, bool]:
    """_open() rows dealt anew by rare shingles: groups of members that may be linked, their rows, and whether one has several parts."""
    spark = own.sparkSession
    members = stored(own.select("id", "g", "n", "sketch", "prints", "core"))
    cells = members.select("prints").mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[np.asarray(cells["cell"].combine_chunks())] = np.asarray(cells["n"].combine_chunks())
    shared = spark.sparkContext.broadcast(counts)
    firsts = stored(members.select("id", "g", "n", "core", "prints").mapInArrow(lambda b: _first(b, shared, over), "id long, g long, index boolean, core boolean, n long"))
    # only where two meet, one of them outside of the core, and one by its fewer shingles
    sizes = firsts.groupBy("g").agg(F.count("*").alias("rows"), F.count_if("index").alias("by"), F.count_if(~F.col("core")).alias("rest"), F.sum(F.col("n") * 8).alias("bytes"))
    sizes = sizes.where("rows > 1 AND by > 0 AND rest > 0").select("g", "rows", F.col("rows").alias("size"), F.ceil(F.greatest(F.col("rows") / PART, F.col("bytes") / PART_BYTES)).cast("int").alias("parts"))
    sizes = stored(sizes)
    total = firsts.count()
    met = join_by_size(firsts.select("id", "g"), sizes, ["g"], total)
    return met.join(members.select("id", "n", "sketch", "prints"), "id"), total, not sizes.where("parts > 1").isEmpty()


def _linked(rows: DataFrame, several: bool, total: int, least: float, over: tuple[int, int] | None, by_shingles: bool = True) -> DataFrame:
    """Links (a, b) of forests that join all similar members of each group (g, id, n, sketch, size, parts, with `over` prints).

    several: some group has more than one part; total: rows of all groups. by_shingles: groups whose visits would cost too much are dealt by
    rare shingles (needs prints).
    """
    first = stored(_sorted_groups(_dealt(rows), _links_in_groups(least, over, False)))
    if not several:
        return first
    own = stored(_open(rows, components(first), total))
    costly = F.col("chunks") + F.when(F.col("core"), 0).otherwise(F.col("parts"))
    wide = F.lit(False)
    if over and by_shingles:
        costs = own.groupBy("g").agg((F.sum(costly) > WIDE * F.count("*")).alias("wide"), F.count("*").alias("rows"))
        own = join_by_size(own, stored(costs), ["g"], total)
        wide = F.col("wide")
    near = own.where(~wide)
    out = first.unionByName(_sorted_groups(_visits(near.drop("wide")), _links_in_groups(least, over, True)))
    far = own.where(wide)
    if not over or not by_shingles or far.isEmpty():
        return out
    met, n, more = _met_by_shingles(far, over)
    return out.unionByName(_linked(met, more, n, least, over, by_shingles=False))


def _keys(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """A hash of each set."""
    return np.array([int(mix64(s ^ U64(salt)).sum(dtype=U64)) if len(s) else 0 for s in sets], U64).view(np.int64)


_SALTS = 0, 0xA5A5A5A5A5A5A5A5


def _sketched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        for i, j, d, o in chunks(data, offs, 1 << 22):
            sets = list(shingle_sets(d, o, k))
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            regs = registers([sets[x] for x in full])
            sketch: list[bytes | None] = [None] * len(sets)
            for r, x in enumerate(full):
                sketch[x] = regs[r].tobytes()
            keys = [pa.array(_keys(sets, s)) for s in _SALTS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(size), *keys, pa.array(sketch, pa.binary())], names=["doc_id", "n", "key1", "key2", "sketch"])
        release()


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_fixed(pa.chunked_array([batch.column("sketch")]), np.uint16, REGISTERS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(np.asarray(batch.column("id")), keys.shape[1]))], names=["g", "id"])


def _with_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        for i, j, d, o in chunks(data, offs, 1 << 22):
            sets = list(shingle_sets(d, o, k))
            cols = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(_keys(sets, s)) for s in _SALTS), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), *cols], names=["id", "n", "key1", "key2", "prints"])
        release()


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |intersection| >= 80 * |union| of their
    distinct word shingles (threshold: 80 of 100), A-Z lower-cased. component_id
    is the smallest doc_id reachable over links; kept says that it is the row's own.

    A null or blank text has no shingles and is linked with nothing; a text of
    fewer words than a shingle is one shingle. Rows that share a doc_id are one document: if their
    texts' sets differ, the one with the most shingles (then the larger hash) is compared, and all of the rows
    have its component; each has its own n_shingles. A row without doc_id has no component and is kept.
    Other columns are ignored.

    A pair at the threshold is missed if it shares no band or its estimate
    strays by more than 4.6 deviations: together about 5 in a million.
    """
    texts = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sketches = stored(texts.mapInArrow(lambda b: _sketched(b, shingle), "doc_id long, n long, key1 long, key2 long, sketch binary"))
    total = sketches.count()
    own = F.struct("n", "key1", "key2")
    several = stored(sketches.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("counts"), F.count("*").alias("rows")).where("low <> counts").drop("low"))
    # a row's set is that of its document
    rows = sketches.withColumn("own", own)
    if not several.isEmpty():
        rows = join_by_size(rows, several, ["doc_id"], total, "left")
        rows = rows.withColumn("set", F.coalesce("counts", "own")).drop("counts")
    else:
        rows = rows.withColumn("set", F.col("own"))
    shown = rows.select("doc_id", "n", F.col("set.n").alias("m"), F.col("set.key1").alias("key1"), F.col("set.key2").alias("key2"), F.col("own") == F.col("set"), "sketch")
    shown = shown.toDF("doc_id", "n", "m", "key1", "key2", "its", "sketch")
    classes = stored(shown.where("m > 0 AND its").groupBy("key1", "key2", "m").agg(F.min("doc_id").alias("id"), F.min_by(F.col("sketch"), F.col("doc_id")).alias("sketch"), F.count("*").alias("rows")))
    nodes = classes.where("id IS NOT NULL").select("id", F.col("m").alias("n"), "sketch")

    share = threshold[0] / threshold[1]
    least = share - 4.6 * np.sqrt(share * (1 - share) / REGISTERS)
    bands = nodes.select("id", "sketch").mapInArrow(_banded, "g long, id long")
    sizes = stored(bands.groupBy("g").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("size", F.col("rows")))
    n_bands = total * (REGISTERS // ROWS)
    met = join_by_size(bands, sizes, ["g"], n_bands).withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    likely = _linked(met.join(nodes, "id"), not sizes.where(F.col("size") > PART).isEmpty(), n_bands, least, None)
    families = stored(components(likely))

    ids = families.select(F.col("node").alias("id"))
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    # the sets of the documents that nodes are named by; of several texts the one that counts
    sets = texts.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").mapInArrow(lambda b: _with_sets(b, shingle), "id long, n long, key1 long, key2 long, prints binary")
    sets = sets.groupBy("id").agg(F.max_by("prints", F.struct("n", "key1", "key2")).alias("prints"))
    family = families.select(F.col("node").alias("id"), F.col("component").alias("g"))
    members = stored(family.join(nodes, "id").join(sets, "id"))
    size = members.groupBy("g").agg(F.count("*").alias("rows"), F.sum(F.octet_length("prints")).alias("bytes"))
    size = stored(size.select("g", "rows", F.col("rows").alias("size"), F.ceil(F.greatest(F.col("rows") / PART, F.col("bytes") / PART_BYTES)).cast("int").alias("parts")))
    links = _linked(join_by_size(members, size, ["g"], total), not size.where("parts > 1").isEmpty(), total, least, threshold)
    found = components(links)

    named = classes.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key1", "key2", "m", "rows", F.coalesce("component", "id").alias("component"))
    shown = shown.drop("sketch", "its")
    empty = shown.where("m = 0").withColumn("component", F.lit(None).cast("long"))
    out = join_by_size(shown.where("m > 0"), named, ["key1", "key2", "m"], total, "left").unionByName(empty)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    """Op 1 over all documents: shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


#: DuckDB SQL of the query: all pairs that share a shingle, counted, and their reachable sets.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component AS component_id, w.doc_id = c.component AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id
"""
