"""How far the sources of a language are from each other and from the language as a whole, term by term.

Terms are counted by batches of texts in Arrow, then by Spark with map-side combine. The kept terms of a language are
dealt into blocks by hash, as many as its dense matrix of sources by terms has TILE_BYTES. A task turns a block into an
int64 tile, one row a source, and compares all pairs of its rows at once by broadcasting. It returns the block's sums, a
partial pair matrix, and for each source a heap of the block's most typical terms. Spark adds the matrices up and merges the heaps.

A block's work is bounded by TILE_BYTES and PAIR_BYTES; there are sources squared sums for a language, as many as the result has
rows. All shares and sums are exact 64-bit integers: a share is at most 1 + SCALE, the sum of a source's shares about SCALE, so
that no sum of squares over shares comes beyond SCALE squared by more than the number of terms changes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import join_by_size
from .kernels import chunks, release, text_bytes
from .session import bounded, default_block, stored

#: Bytes of a tile, and of the largest array that comparing its rows makes.
TILE_BYTES, PAIR_BYTES = 1 << 20, 16 << 20
#: Bytes of a text that are read at once; a longer one is read in pieces that end between terms.
PIECE_BYTES = 32 << 20
#: Blocks of texts that a batch has: the more texts at a time, the fewer rows to add up.
BATCH = 4
#: Shares are parts of so many; three steps of 1,000 keep the division within 64 bits.
STEP, STEPS = 1000, 3
#: Documents that a kept term has at least, and ranks of a source's terms.
LEAST_DOCS, TOP = 3, 200

#: Bytes of terms, A-Z lower-cased, and a space for all others: ASCII characters that are no letters.
_TERM = np.full(256, 32, np.uint8)
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123, dtype=np.uint8)
_TERM[128:] = np.arange(128, 256, dtype=np.uint8)

_COUNTED = "lang string, source string, term string, n long, docs long"
_NAMES = [c.split()[0] for c in _COUNTED.split(", ")]
_TILED = "lang string, source string, part string, item string, value long"


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """How often each of some texts has each of its terms: rows and codes in order, counts, and the terms that the codes name."""
    texts = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(_TERM[data])])
    lists = pc.ascii_split_whitespace(texts)
    found = pc.list_flatten(lists).dictionary_encode()
    code, names = np.asarray(found.indices).astype(np.int64), found.dictionary
    # texts that begin or end between terms have empty ones there
    full = np.asarray(pc.binary_length(names))[code] > 0 if len(names) else np.zeros(0, bool)
    cell, n = np.unique((np.asarray(pc.list_parent_indices(lists)) * max(len(names), 1) + code)[full], return_counts=True)
    row, code = np.divmod(cell, max(len(names), 1))
    return row, code, n, names


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text's bytes in runs of about `most`, none of which ends within a term (a longer term is in one run)."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data):
            gap = np.flatnonzero(_TERM[data[end : end + most]] == 32)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + most, len(data))
        yield data[at:end]
        at = end


def _term_counts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """_terms() of a batch's texts, run by run; each text is in one run."""
    for i, j, run, run_offs in chunks(data, offs, PIECE_BYTES):
        if j - i == 1 and len(run) > PIECE_BYTES:
            found = [_terms(p, np.array([0, len(p)])) for p in _pieces(run, PIECE_BYTES)]
            each = pa.table({"term": pa.chunked_array([names.take(pa.array(code)) for _, code, _, names in found]), "n": np.concatenate([n for _, _, n, _ in found])})
            whole = each.group_by("term").aggregate([("n", "sum")])
            size = whole.num_rows
            yield np.full(size, i), np.arange(size), np.asarray(whole["n_sum"].combine_chunks()), whole["term"].combine_chunks()
        else:
            row, code, n, names = _terms(run, run_offs)
            yield row + i, code, n, names


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By language, source and term: occurrences and documents of a run of texts. A row without a term stands for the group itself."""
    for batch in batches:
        pairs = pa.table({"lang": batch.column("lang"), "source": batch.column("source"), "row": pa.array(np.arange(batch.num_rows))})
        groups = pairs.group_by(["lang", "source"]).aggregate([("row", "list")])
        group = np.empty(batch.num_rows, np.int64)
        lists = groups["row_list"].combine_chunks()
        group[np.asarray(pc.list_flatten(lists))] = np.asarray(pc.list_parent_indices(lists))
        langs, sources, every = groups["lang"].combine_chunks(), groups["source"].combine_chunks(), groups.num_rows
        none = np.zeros(every, np.int64)
        yield from pa.table([langs, sources, pa.nulls(every, pa.string()), pa.array(none), pa.array(none)], names=_NAMES).to_batches()
        for row, code, n, names in _term_counts(*text_bytes(batch.column("text"))):
            cell, at = np.unique(group[row] * max(len(names), 1) + code, return_inverse=True)
            of, code = np.divmod(cell, max(len(names), 1))
            # sums of doubles are exact here: a run has fewer than 2**53 words
            sums = np.bincount(at, n, len(cell)).astype(np.int64)
            docs = np.bincount(at, minlength=len(cell))
            terms = pc.cast(names.take(pa.array(code)), pa.string())
            yield from pa.table([langs.take(pa.array(of)), sources.take(pa.array(of)), terms, pa.array(sums), pa.array(docs)], names=_NAMES).to_batches(max_chunksize=65_536)
            release()


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(STEP**STEPS * (counts + 1) / total), by long division, so that no product leaves 64 bits; counts < total."""
    out, left = np.divmod(counts + 1, total)
    for _ in range(STEPS):
        digit, left = np.divmod(left * STEP, total)
        out = out * STEP + digit
    return out + 1


def pair_sums(p: np.ndarray) -> np.ndarray:
    """For all rows s and t of a tile the sum over its terms of floor((p[s] - p[t])**2 / p[t])."""
    rows, terms = p.shape
    out = np.zeros((rows, rows), np.int64)
    step = max(1, PAIR_BYTES // max(1, 8 * rows * terms))
    for s in range(0, rows, step):
        apart = p[s : s + step, None, :] - p[None, :, :]
        apart *= apart
        apart //= p[None, :, :]
        out[s : s + step] = apart.sum(axis=2)
    return out


def _tile(top: int):
    """The function of a block: its groups (headers) and its terms in, partial pair sums and heaps out."""

    def tile(headers: pa.Table, terms: pa.Table) -> pa.Table:
        headers = headers.sort_by("source")
        terms = terms.sort_by("term")
        lang, sources = headers["lang"][0].as_py(), headers["source"].combine_chunks()
        kept, every, all_n = headers["kept"][0].as_py(), np.asarray(headers["n"]), headers["lang_n"][0].as_py()
        names = terms["term"].combine_chunks()
        lists = terms["by_source"].combine_chunks()
        flat = pc.list_flatten(lists)
        counts = np.zeros((len(sources), len(names)), np.int64)
        if len(flat):
            row = np.asarray(pc.index_in(pc.struct_field(flat, "source"), sources))
            counts[row, np.asarray(pc.list_parent_indices(lists))] = np.asarray(pc.struct_field(flat, "n"))
        p = shares(counts, every[:, None] + kept) if kept else counts
        q = shares(np.asarray(terms["total"]), all_n + kept) if kept else counts[:1].ravel()
        sums = pair_sums(p)
        one, other = np.nonzero(~np.eye(len(sources), dtype=bool))
        out = [("pair", one, pc.take(sources, pa.array(other)), sums[one, other])]
        for s in range(len(sources)):
            typical = np.flatnonzero((counts[s] > 0) & (p[s] > q))
            value = (p[s, typical] - q[typical]) ** 2 // q[typical]
            # terms are in UTF-8 order, so a stable sort breaks ties by it
            heap = np.argsort(-value, kind="stable")[:top]
            out.append(("term", np.full(len(heap), s), pc.take(names, pa.array(typical[heap])), value[heap]))
        n = [len(v) for *_, v in out]
        return pa.table({
            "lang": pa.array([lang] * sum(n), pa.string()),
            "source": pc.take(sources, pa.array(np.concatenate([s for _, s, _, _ in out]).astype(np.int64))),
            "part": pa.array([part for (part, *_), k in zip(out, n, strict=True) for _ in range(k)], pa.string()),
            "item": pa.concat_arrays([pc.cast(i, pa.string()) for _, _, i, _ in out]),
            "value": pa.array(np.concatenate([v for *_, v in out]).astype(np.int64)),
        })

    return tile


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The divergence of each (lang, source) group of docs (lang, source, text), as rows of lang, source, part, item, value and rank.

    part pair: item is each other source of the language and value the sum over the language's kept terms (0 if it has none); all
    ranks. part term: item is each kept term that the group has more of than the language, up to rank `top`. Kept are the terms
    in at least least_docs rows of a language. Null texts, langs and sources count as ''; rows are documents,
    repeated ones too. Ties go by UTF-8. Groups without terms have counts of 0. A language of one source has no pairs. No rows
    give no rows. Other columns of docs, whatever their names, change nothing.
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    seen = bounded(docs.select(*blank), BATCH * default_block(docs.sparkSession)).mapInArrow(_counted, _COUNTED)
    counts = stored(seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    terms = stored(of_term.where(F.col("docs") >= least_docs).drop("docs"))
    group_n = terms.select("lang", F.explode("by_source").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(group_n, ["lang", "source"], "left").fillna(0, ["n"])
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = sizes.join(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n")), "lang", "left").fillna(0, ["kept", "lang_n"])
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("kept") * F.col("sources") * 8 / tile_bytes))
    langs = stored(langs.withColumn("blocks", blocks))
    headers = groups.join(langs, "lang").select("lang", "source", "n", "kept", "lang_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    all_terms = langs.agg(F.sum("kept")).first()[0] or 0
    dealt = join_by_size(terms, langs.select("lang", "blocks", F.col("kept").alias("rows")), ["lang"], all_terms)
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "total", "by_source")
    tiles = headers.groupBy("lang", "block").cogroup(dealt.groupBy("lang", "block")).applyInArrow(_tile(top), _TILED)
    tiles = stored(tiles)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))
    heaps = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(heaps)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 11 over all documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS kept, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY w.lang, w.source, w.term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (gn.n + v.kept)::HUGEINT AS p,
         1 + 1000000000 * (k.total + 1) // (v.n + v.kept)::HUGEINT AS q
  FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
