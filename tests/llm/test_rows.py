"""Exact dedup, fill-in-the-middle and the divergence audit: brute force and edge cases (test_formats compares them with their SQL)."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.llm import components, exact_dedup, fill_in_middle, source_divergence
from heddle.llm.kernels import text_bytes


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def judged(rows):
    """Plainly: {(doc_id, sha)} -> (keep_id, group_size), and how many rows each text keeps."""
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = {}
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, hashlib.sha256(text.encode()).hexdigest()] = (keep, len(ids))
    return out


@pytest.mark.parametrize(("words", "hot"), [(1 << 10, 2000), (1, 2000), (1 << 10, 3)])
def test_exact_dedup(spark, monkeypatch, words, hot):
    """Equal to brute force with a roomy filter, with one that is full, and with groups that count as hot."""
    rng = random.Random(3)
    texts = ["Straße", "STRASSE", "strasse", "É", "é", "", None, " ", "a\u0000b", "K", "K", "x" * 300_000, "X" * 300_000, *[f"text {i}" for i in range(300)]]
    rows = [(i, rng.choice(texts)) for i in range(900)] + [(1000 + i, "Hot Text") for i in range(500)]
    rows += [(7, "own"), (7, "own"), (7, "OWN"), (7, "another"), (None, "nobody"), (None, "Nobody"), (None, "text 1"), (5000, "hot text"), (5000, "hot text")]
    rng.shuffle(rows)
    monkeypatch.setattr(exact_dedup, "filter_words", lambda rows, memory: words)
    monkeypatch.setattr(components, "HOT", hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in ("keep_id", "kept", "__twice", "n", "rows", "digest", "slot", "page", "m"):
        docs = docs.withColumn(name, F.lit("other"))
    want = judged(rows)
    for texts_too in (True, False):
        out = exact_dedup.exact_dedup(docs, texts=texts_too)
        assert ("text" in out.columns) == texts_too and {"n", "rows", "digest"} <= set(out.columns)
        got = out.collect()
        assert len(got) == len(rows)
        assert all((r["keep_id"], r["group_size"]) == want[r["doc_id"], r["text_sha256"]] for r in got)
        kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len({lowered(t) for _, t in rows})
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        if texts_too:
            assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    assert exact_dedup.exact_dedup(docs.limit(0)).collect() == []


def test_alone_rows_are_not_shuffled(spark):
    """Of texts that differ only a handful pass the filter, and those are the only ones that meet."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 20, 0).otherwise(F.col("id"))).alias("text"))
    read = docs.select("doc_id", F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("__digest"))
    words = exact_dedup.filter_words(5000, 1 << 30)
    pages = exact_dedup.repeated_filter(read.select(F.col("__digest").alias("digest")), words)
    assert 20 <= exact_dedup._tested(read, pages, words).where("__twice").count() <= 25


def test_filter_size():
    sizes = [exact_dedup.filter_words(n, 1 << 30) for n in (0, 1, 10_000, 10**6, 10**12)]
    assert sizes[:2] == [exact_dedup.LEAST_WORDS] * 2 and sizes == sorted(sizes) and sizes[-1] <= exact_dedup.MOST_WORDS
    assert all(s & (s - 1) == 0 for s in sizes) and exact_dedup.filter_words(10**12, 1 << 22) < sizes[-1]


def plainly(doc_id, text):
    """(form, prefix, middle, suffix, output) by the contract."""
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    """Equal to slicing by code points, whatever the texts hold, and every text comes back."""
    odd = ["", None, "a", "\x1f", "\x1e", "\x1eb\x1ea\x1f\x1f", "\x1ea" * 9, "é👍🏽\n\r\t", "<P", "S>", "<<S>", "x<M>y", "<P<S<M", "$0\\1", "é" * 5, "\x1f\x1e" * 50]
    rng = random.Random(9)
    rows = [(i, odd[i % len(odd)] if i % 3 else "".join(rng.choice("ab\x1e\x1f<>PSM é👍\n") for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(None, "no id"), (5, "again"), (5, "again"), (601, "é👍\x1f " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("form", "output", "__units", "units", "digest", "a", "b"):
        docs = docs.withColumn(name, F.lit("other"))
    out = fill_in_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).collect() == []


def audited(rows, least=3, top=200):
    """{(lang, source, part, item): (value, rank)}, with Python's own integers."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))) for lang, source, text in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holds = collections.Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in holds.items() if n >= least)
        counts = {s: collections.Counter(t for _, source, terms in own if source == s for t in terms if holds[t] >= least) for s in {d[1] for d in own}}
        every = sum(counts.values(), collections.Counter())

        def p(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023

        ps, q = {s: p(c) for s, c in counts.items()}, p(every)
        for s in counts:
            pairs = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((ps[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] > 0 and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, i) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, i] = (v, rank)
    return out


@pytest.mark.parametrize(("tile", "top"), [(1 << 20, 200), (512, 5)])
def test_source_divergence(spark, tile, top):
    """Equal to brute force, in one block a language and in many."""
    rng = random.Random(11)
    vocabulary = [*[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)], "É", "é", "日本", "👍x", "ＡＢ", " "]
    signs = [" ", "\n", "1", "-", "\x00", "_", "[", "\x7f", "@", "{"]
    rows = []
    for _ in range(260):
        words = [rng.choice(vocabulary[: rng.choice([5, 40, len(vocabulary)])]) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice(["hot", "hot", "a", "b", None, "ü"]), "".join((x.upper() if rng.random() < 0.3 else x) + rng.choice(signs) for x in words)))
    rows += [("xx", "only", "one two one"), ("yy", "s1", "no term thrice"), ("yy", "s2", None), ("yy", "s3", "12 34")] + [("en", "hot", "same same row")] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    for name in ("term", "n", "docs", "kept", "block", "value", "rank"):
        docs = docs.withColumn(name, F.lit("other"))
    got = source_divergence.source_divergence(docs, top=top, tile_bytes=tile).collect()
    assert {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in got} == audited(rows, top=top)
    assert len(got) == len(audited(rows, top=top))
    assert source_divergence.source_divergence(docs.limit(0)).collect() == []


def test_shares_of_any_size():
    for total in (7, 10**9 + 7, 9 * 10**15):
        counts = [0, 1, total // 3, total - 2, total - 1]
        assert source_divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_pieces_of_a_long_text(monkeypatch):
    """A text that is read in pieces has the same terms and is one document; a term longer than a piece stays whole."""
    rng = random.Random(5)
    texts = ["", " ".join(rng.choice(["aa", "Bé", "ccc" * 40, "日本語"]) for _ in range(500)), "x" * 900, "short one", "1 " * 300]
    data, offs = text_bytes(pa.array(texts))
    want = {(i, t): n for i, x in enumerate(texts) for t, n in collections.Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(x))).items()}
    for most in (1 << 22, 64):
        monkeypatch.setattr(source_divergence, "PIECE_BYTES", most)
        found = [(int(r), names[int(c)].as_py(), int(x)) for row, code, n, names in source_divergence._term_counts(data, offs) for r, c, x in zip(row, code, n, strict=True)]
        assert {(r, t): n for r, t, n in found} == want and len(found) == len(want)


def test_pair_sums_in_steps(monkeypatch):
    p = np.random.default_rng(2).integers(1, 10**9, (9, 50))
    want = [[sum(int((a - b)) ** 2 // int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in p]
    for most in (1 << 24, 1):
        monkeypatch.setattr(source_divergence, "PAIR_BYTES", most)
        assert source_divergence.pair_sums(p).tolist() == want
