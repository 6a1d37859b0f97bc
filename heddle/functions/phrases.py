"""Many phrases looked for in one pass over each text: the same ones in all texts, or each text's own."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases of an automaton; more are worked in blocks, one on the driver at a time.
BLOCK = 50_000


def phrases_found(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, phrase_id) for each text (key, text) that holds a phrase (phrase_id, phrase); empty phrases are in no text."""
    rows = phrases.where("length(phrase) > 0").select("phrase_id", "phrase")
    n = max(1, -(-rows.count() // BLOCK))
    key = texts.schema["key"].dataType
    out = None
    for b in range(n):
        by_text: dict[str, list[int]] = {}
        for r in rows.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == b).collect():
            by_text.setdefault(r["phrase"], []).append(r["phrase_id"])

        def run(batches: Iterator[pa.RecordBatch], by_text: dict[str, list[int]] = by_text) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for phrase, ids in by_text.items():
                automaton.add_word(phrase, ids)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    hits = {x for _, ids in automaton.iter(text) for x in ids} if text and by_text else ()
                    at += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=["key", "phrase_id"])

        part = texts.select("key", "text").mapInArrow(run, f"key {key.simpleString()}, phrase_id long")
        out = part if out is None else out.unionByName(part)
    return out


#: Bytes of a text times phrases, above which windows of the text are hashed instead of each phrase looked for alone.
ALONE = 1 << 24
#: Windows of a text that are hashed at a time.
WINDOWS = 1 << 20
#: Rows that are Python strings at a time; the rest of a batch stays in Arrow's buffers.
ROWS = 64


def _mixed(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of twice the size, from those of their halves."""
    return left * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + right


def count_held(text: str, phrases: list[str]) -> int:
    """How many of the phrases the text holds, repeats counted.

    In a long text the first bytes of each phrase, a power of two and at least half of it, are looked for among all windows of that
    size by their hashes, and the phrase itself at the places found: so the time doesn't grow with the product of both.
    """
    raw, wanted = text.encode(), Counter(p.encode() for p in phrases)
    if len(raw) * len(wanted) <= ALONE:
        return sum(n for p, n in wanted.items() if p in raw)
    held, sizes = 0, {}
    for p, n in wanted.items():
        if len(p) < 8:
            held += n * (p in raw)
        elif len(p) <= len(raw):
            sizes.setdefault(1 << (len(p).bit_length() - 1), []).append(p)
    for size, group in sizes.items():
        heads = np.frombuffer(b"".join(p[:size] for p in group), "<u8").reshape(len(group), -1)
        half = 8
        while heads.shape[1] > 1:
            heads, half = _mixed(heads[:, 0::2], heads[:, 1::2], half), 2 * half
        missing: dict[int, list[bytes]] = {}
        for h, p in zip(heads[:, 0].tolist(), group, strict=True):
            missing.setdefault(h, []).append(p)
        keys = np.unique(heads[:, 0])
        for start in range(0, len(raw) - size + 1, WINDOWS):
            part = np.frombuffer(raw, np.uint8, min(WINDOWS + size - 1, len(raw) - start), start)
            hashes, half = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, 8)).view("<u8")[:, 0], 8
            while half < size:
                hashes, half = _mixed(hashes[:-half], hashes[half:], half), 2 * half
            there = keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes
            for i in np.flatnonzero(there).tolist():
                left = missing[int(hashes[i])]
                for p in [p for p in left if raw.startswith(p, start + i)]:
                    held += wanted[p]
                    left.remove(p)
    return held


def share_held(text: Column, phrases: Column) -> Column:
    """Share of a row's own phrases that its text holds, in hundredths rounded as a double; null without any."""

    def share(t: str | None, said: list[str] | None) -> float | None:
        return None if t is None or not said else math.floor(count_held(t, said) / len(said) * 100 + 0.5) / 100

    @F.arrow_udf(T.DoubleType())
    def run(c: pa.Array, p: pa.Array) -> pa.Array:
        out: list[float | None] = []
        for i in range(0, len(c), ROWS):
            out += [share(t, said) for t, said in zip(c.slice(i, ROWS).to_pylist(), p.slice(i, ROWS).to_pylist(), strict=True)]
        return pa.array(out, pa.float64())

    return run(text, phrases)
