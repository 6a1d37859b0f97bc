"""Removal of passages that an earlier document already has, by level-wise doubling.

Windows of `start` words are looked at first. A position stays a candidate for
the doubled length only if both halves repeat (start in at least two
documents), and so on up to `window` words, where the last doubling is cut to
the window and its two halves overlap. At the last level a window's words are
removed if the same words start in a document with a smaller doc_id.

Documents are cut into stored blocks of coded words, so texts are read and split
once. At each level a block sends its distinct window hashes to the buckets
of a hash range, packed as sorted arrays, and each bucket answers one bit a
hash: seen in another block (lower levels), or seen with a smaller doc_id (last
level). So no key, however frequent, has more than one entry per block in any
task, and the shuffle holds 4 bytes for a distinct lowest-level window of a
block. Lower levels only choose candidates, so their 32-bit fingerprints (unique
in a bucket up to chance) can only let too many through; the last level
compares 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Coded, all_of, answered, bucket_of, coded_blocks, cut_binary, cut_prints, distinct, each_row, parts_of, prints_of, short_keys, with_answers
from .kernels import U64, windows

_MESSAGE = "bucket long, __block long, prints binary, ids binary"
_ANSWER = "__block long, bucket long, bits binary"
_NO_ID = np.iinfo(np.int64).max


def _levels(start: int, window: int) -> list[int]:
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class _Words:
    """What windows() needs of a block: its words' hashes and where texts begin."""

    def __init__(self, coded: Coded) -> None:
        self.hash, self.of = coded.vocab[coded.codes], coded.of


class _Block:
    """A block's words and the windows that are still candidates."""

    def __init__(self, row: pa.Table, levels: list[int], n: int) -> None:
        self.levels, self.n, self.coded = levels, n, Coded(row)
        self.words = _Words(self.coded)
        self.text_of = np.repeat(np.arange(len(self.coded.size), dtype=np.int32), self.coded.size)
        ids = self.coded.rest["doc_id"].combine_chunks().cast(pa.int64())
        self.ids = np.asarray(ids.fill_null(_NO_ID)).astype(np.int64)
        self.repeats = np.ones(len(self.words.hash), bool)

    def candidates(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of this level's candidates and their first words."""
        k = self.levels[level]
        h, at = windows(self.words, k)
        if level:
            step = k - self.levels[level - 1]
            keep = self.repeats[at] & self.repeats[at + step]
            h, at = h[keep], at[keep]
        return h, at

    def dealt(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys by bucket, the buckets' cuts, each candidate's key, the smallest id of each key, and the candidates' first words."""
        h, at = self.candidates(level)
        edge = np.arange(self.n + 1, dtype=U64)
        if level < len(self.levels) - 1:
            u, _, number = distinct(short_keys(h, self.n))
            cuts = np.searchsorted(u, edge << U64(32))
        else:
            # The low half rotated to the front sorts by bucket.
            u, _, number = distinct((h << U64(32)) | (h >> U64(32)))
            u = (u << U64(32)) | (u >> U64(32))
            cuts = np.searchsorted(bucket_of(u, self.n), edge)
        least = np.full(len(u), _NO_ID)
        np.minimum.at(least, number, self.ids[self.text_of[at]])
        return u, cuts, number, least, at

    def ask(self, level: int) -> pa.Table:
        u, cuts, _, least, _ = self.dealt(level)
        full = np.flatnonzero(np.diff(cuts))
        cuts = np.append(cuts[full], cuts[-1])
        last = level == len(self.levels) - 1
        prints = cut_binary(u, cuts) if last else cut_prints((u & U64(0xFFFFFFFF)).astype(np.uint32), cuts)
        ids = cut_binary(least, cuts) if last else pa.array([b""] * len(full), pa.binary())
        return pa.table([pa.array(full + level * self.n, pa.int64()), pa.array(np.full(len(full), self.coded.number, np.int64)), prints, ids], names=["bucket", "__block", "prints", "ids"])

    def learn(self, level: int, row: pa.Table) -> None:
        """Keeps as repeated what the buckets' answers, or this block's own documents, show to be so."""
        u, cuts, number, least, at = self.dealt(level)
        sizes = np.diff(cuts)
        # each bucket's bits begin at a byte of their own
        bits = np.unpackbits(all_of(row[f"bits{level}"], np.uint8)[0])
        begin = np.cumsum(-(-sizes // 8)) - -(-sizes // 8)
        take = np.arange(int(sizes.sum())) + np.repeat(begin * 8 - cuts[:-1], sizes)
        told = bits[take].astype(bool)
        texts = self.text_of[at]
        if level < len(self.levels) - 1:
            most, first = np.zeros(len(u), np.int32), np.full(len(u), np.iinfo(np.int32).max, np.int32)
            np.maximum.at(most, number, texts)
            np.minimum.at(first, number, texts)
            good = (told | (most > first))[number]
        else:
            good = told[number] | (self.ids[texts] > least[number])
        self.repeats = np.zeros(len(self.words.hash), bool)
        self.repeats[at[good]] = True

    def kept(self) -> tuple[list[bytes], np.ndarray]:
        """Each text's kept words, and how many of its words are removed."""
        n, k = len(self.words.hash), self.levels[-1]
        edge = np.zeros(n + k + 1, np.int32)
        at = np.flatnonzero(self.repeats)
        edge[at] += 1
        edge[at + k] -= 1
        gone = np.cumsum(edge)[:n] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        of = self.words.of
        spelled = self.coded.spelled
        stays = self.coded.codes[~gone].tolist()
        cuts = (of - total[of]).tolist()
        texts = [b" ".join([spelled[c] for c in stays[a:z]]) for a, z in zip(cuts, cuts[1:], strict=False)]
        return texts, total[of[1:]] - total[of[:-1]]


def _answers(n: int, last: int):
    def answer(table: pa.Table) -> pa.Table:
        level = table["bucket"][0].as_py() // n
        prints, cuts = all_of(table["prints"], U64) if level == last else prints_of(table["prints"])
        u, _, number = distinct(prints)
        if level == last:
            ids = all_of(table["ids"], np.int64)[0]
            least = np.full(len(u), _NO_ID)
            np.minimum.at(least, number, ids)
            yes = least[number] < ids
        else:
            yes = (np.bincount(number, minlength=len(u)) > 1)[number]
        # all rows' bits in one go, each row's begun at a byte of its own
        size = np.diff(cuts)
        bytes_of = -(-size // 8)
        begin = np.concatenate([[0], np.cumsum(bytes_of)])
        spread = np.zeros(int(begin[-1]) * 8, bool)
        spread[np.arange(len(yes)) + np.repeat(begin[:-1] * 8 - cuts[:-1], size)] = yes
        return pa.table([table["__block"], table["bucket"], cut_binary(np.packbits(spread), begin)], names=["__block", "bucket", "bits"])

    return answer


def _replayed(row: pa.Table, levels: list[int], n: int, upto: int) -> _Block:
    block = _Block(row, levels, n)
    for level in range(upto):
        block.learn(level, row)
    return block


def substring_dedup(docs: DataFrame, window: int = 13, start: int = 4, block_bytes: int | None = None) -> DataFrame:
    """The documents with every word removed that such a repeated window covers.

    docs: doc_id (integer), text, and any other columns, which pass through.
    Returned: the same columns, text being the kept words joined by one space,
    then n_words and n_removed. Windows are judged on the input texts.

    A null or empty text has no words and becomes the empty text. Rows with one
    doc_id never remove words from each other; a null doc_id counts as larger
    than all others. Texts of fewer words than the window stay whole. A column
    named n_words or n_removed is replaced, one named __block left out.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "__block")]
    rows = docs.select("doc_id", "text", *others)
    blocks, n = coded_blocks(rows, lower=False, spell=True, block_bytes=block_bytes)
    levels = _levels(start, window)
    answers: list[DataFrame] = []
    for level in range(len(levels)):
        ask = lambda row, level=level: _replayed(row, levels, n, level).ask(level)
        answers.append(answered(blocks, answers, ask, _MESSAGE, _answers(n, len(levels) - 1), _ANSWER, parts_of(n)))

    schema = rows.schema.add("n_words", "long").add("n_removed", "long")
    names = schema.names

    def finish(row: pa.Table) -> pa.Table:
        block = _replayed(row, levels, n, len(levels))
        texts, removed = block.kept()
        cols = dict(zip(block.coded.rest.column_names, block.coded.rest.columns, strict=True))
        cols |= {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(block.coded.size), "n_removed": pa.array(removed, pa.int64())}
        return pa.table([cols[c] for c in names], names=names)

    out = with_answers(blocks, answers).mapInArrow(each_row(finish), schema)
    return out.select(*[c for c in docs.columns if c in out.columns and c not in ("n_words", "n_removed")], "n_words", "n_removed")


def query(spark, sf_dir: str) -> DataFrame:
    """Op 8 over all documents: windows of 13 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


#: DuckDB SQL of the query: a window's first document by its words, then the words that such windows cover.
SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT r, doc_id, i, hash(list_slice(ws, i, i + 12)) AS k, list_slice(ws, i, i + 12) AS v FROM w, unnest(range(1, len(ws) - 11)) AS t(i) WHERE len(ws) >= 13),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p
         FROM (SELECT r, i, coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY k, v) AS later FROM g) WHERE later),
cut AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(ps, i), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN cut USING (r)
"""
