"""Near-duplicates, substring dedup and components against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest

from heddle.llm import components as components_module
from heddle.llm import near_dup, substring_dedup
from heddle.llm.components import components
from heddle.llm.kernels import Words, sequence_hash, text_bytes, windows

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, block string, n string, size string"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def corpus(seed, n=160):
    """Random texts, edited copies, chains, exact copies, shared passages, and odd cases."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Über", "ß", "A", "a"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(n)]
    passage = " ".join(rng.choices(vocab, k=30))
    for _ in range(n):
        words = rng.choice(texts[:n]).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(rng.choice([" ", "\n", "\t  "]).join(words))
    texts += [passage + " " + texts[0], texts[1] + "\n" + passage, passage, passage.upper()]
    texts += [None, "", "  \n", "one", "ONE", "one two three", "one two three", "x " * 3000, " ".join(rng.choices(vocab, k=8000)), "nospace" * 2000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t) for i, t in zip(ids, texts, strict=True)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "b", "n", "s") for i, t in rows], SCHEMA).repartition(parts)


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("part", "hot"), [(1024, 2000), (3, 2)])
def test_near_dup(spark, monkeypatch, part, hot):
    """All links of the fixture are found, also when groups are dealt into parts of three and most keys count as hot."""
    monkeypatch.setattr(near_dup, "PART", part)
    monkeypatch.setattr(components_module, "HOT", hot)
    rows = corpus(3)
    got = {r[0]: tuple(r)[1:] for r in near_dup.near_duplicates(frame(spark, rows), shingle=4).collect()}
    assert got == brute_components(rows, 4)


def test_family_grows_linearly(spark, monkeypatch):
    """In a family of 10,000 near copies no row is sent more than twice, besides the representatives; chains and strangers are found."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(10_000):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(120)] = f"x{rng.randrange(10_000_000)}"
        rows.append((i, " ".join(w)))
    chain = list(base)
    for i in range(40):
        chain[2 * i] = f"y{i}"  # ever farther from the base, each near the one before
        rows.append((20_000 + i, " ".join(chain)))
    rows += [(30_000 + i, " ".join(f"s{i}_{j}" for j in range(50))) for i in range(20)]
    dealt = []
    kept = near_dup._sorted_groups

    def counted(df, work):
        dealt.append(df.count())
        return kept(df, work)

    monkeypatch.setattr(near_dup, "_sorted_groups", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows, 4), shingle=4).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows if i >= 20_000}
    for i in range(39):
        a, b = sets[20_000 + i], sets[20_001 + i]
        assert (100 * len(a & b) >= 80 * len(a | b)) and got[20_001 + i] == got[20_000 + i]
    assert {got[i] for i in range(10_000)} == {0} and got[20_000] == 0
    assert all(got[i] == i for i in sets if i >= 30_000)
    bands = near_dup.REGISTERS // near_dup.ROWS
    families = dealt[-2:] if len(dealt) == 4 else dealt[-1:]
    assert families[0] < 1.2 * 10_060 and sum(families) < 3 * 10_060
    assert sum(dealt[: len(dealt) - len(families)]) < 3 * bands * 10_060


def test_first_shingles_meet():
    """Whatever the order, sets at the threshold and above meet by the first shingles of both, the smaller one's being fewer."""
    rng = np.random.Generator(np.random.PCG64(7))
    met = 0
    for _ in range(1500):
        counts = rng.integers(0, 50, near_dup.CELLS).astype(np.int64)
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        drop = rng.random(len(x)) < rng.choice([0, 0.05, 0.1, 0.2])
        y = np.unique(np.concatenate([x[~drop], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)]))
        both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if not len(y) or 100 * both < 80 * union:
            continue
        met += 1
        small, large = sorted((x, y), key=len)
        first, least = near_dup.first_shingles(small, counts, (80, 100))
        assert 1 <= least <= len(first) and len(np.intersect1d(first[:least], near_dup.first_shingles(large, counts, (80, 100))[0]))
    assert met > 500


def test_template_family_grows_linearly(spark, monkeypatch):
    """Pages that share four fifths of their shingles (similarity 0.67) and are not linked cost a few rows each; links among them are found."""
    monkeypatch.setattr(near_dup, "PART", 64)
    rng = random.Random(15)
    template = [f"t{i}" for i in range(163)]
    n, rows, want = 2500, [], {}
    for i in range(n):
        own = [f"u{i}_{j}" for j in range(40)]
        rows.append((i, " ".join(template + own)))
        want[i] = i
    for k in range(60):  # pages of their own with a few copies that differ in two words, spread over all parts
        own = [f"v{k}_{j}" for j in range(40)]
        for c in range(4):
            words = template + own
            words[rng.randrange(len(words))] = f"c{k}_{c}"
            rows.append((10_000 + 10 * k + c, " ".join(words)))
            want[10_000 + 10 * k + c] = 10_000 + 10 * k
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.64 < similar(3, 4) < 0.7 and 0.6 < similar(3, 10_000) < 0.7 and all(similar(10_000 + 10 * k, 10_000 + 10 * k + c) >= 0.9 for k in range(60) for c in range(4))
    dealt = []
    kept = near_dup._sorted_groups

    def counted(df, work):
        dealt.append(("prints" in df.columns, df.count()))
        return kept(df, work)

    monkeypatch.setattr(near_dup, "_sorted_groups", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows, 4), shingle=4).collect()}
    assert got == want
    families = [k for prints, k in dealt if prints]
    # at first each page is in one part, besides the representatives; then only copies meet, by some of their shingles
    assert len(families) >= 2 and families[0] < 2 * len(rows) and sum(families[1:]) < 8 * len(rows)


def test_rows_that_share_a_doc_id(spark):
    """Of several texts of one doc_id the one with the most shingles counts, whatever the order of the rows."""
    a, b = "a b c d e f g h i j", "k l m n o p q r s t u v"
    rows = [(5, a), (5, b), (7, a), (9, b), (3, a), (5, None)]
    want = sorted([(5, 6, 5, True), (5, 8, 5, True), (5, 0, 5, True), (7, 6, 3, False), (9, 8, 5, False), (3, 6, 3, True)])
    for order in (rows, rows[::-1]):
        assert sorted(tuple(r) for r in near_dup.near_duplicates(frame(spark, order)).collect()) == want


def test_near_dup_edges(spark):
    assert near_dup.near_duplicates(frame(spark, [(1, "a")]).limit(0)).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, None), (9, None), (8, "")]
    got = sorted((tuple(r) for r in near_dup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True), (None, 2, None, True), (None, 0, None, True), (9, 0, 9, True), (8, 0, 8, True)], key=repr)


def test_estimate_is_fair():
    """The corrected agreement of registers is near the Jaccard similarity, for small and large sets."""
    rng = np.random.Generator(np.random.PCG64(5))
    for n in (5, 60, 2000):
        errors = []
        for _ in range(60):
            every = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
            a, b = np.unique(every[: 2 * n]), np.unique(every[n:])
            r = near_dup.registers([a, b])
            errors.append(float(near_dup.similarity(np.array([(r[0] == r[1]).mean()]), np.array([len(a)]), len(b))[0]) - 1 / 3)
        assert abs(np.mean(errors)) < 0.04


@pytest.mark.parametrize("part", [500_000, 60])
def test_components(spark, monkeypatch, part):
    """Chains, stars and random graphs, in one part and in many."""
    monkeypatch.setattr(components_module, "EDGES", part)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 300)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def brute_substrings(rows, k):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (1 << 62 if i is None else i):
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "start"), [(13, 4), (5, 2), (3, 9), (13, 13)])
def test_substrings(spark, window, start):
    rows = corpus(8, 60)
    out = substring_dedup.substring_dedup(frame(spark, rows), window, start, block_bytes=5000)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect()), key=repr)
    assert got == brute_substrings(rows, window)
    assert out.columns == ["doc_id", "text", "lang", "block", "n", "size", "n_words", "n_removed"]


def test_substring_edges(spark):
    p = " ".join(f"p{i}" for i in range(13))
    rows = [(3, p), (3, p), (1, f"a {p} b {p}"), (None, p), (None, None), (7, ""), (8, p.upper())]
    out = substring_dedup.substring_dedup(frame(spark, rows))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect()), key=repr)
    assert got == brute_substrings(rows, 13)
    assert substring_dedup.substring_dedup(frame(spark, rows).limit(0)).count() == 0


def test_kernels():
    texts = ["a bb  ccc", None, "", " a\tbb\x0bccc ", "É é", "a", "bb ccc a bb"]
    import pyarrow as pa

    data, offs = text_bytes(pa.array(texts))
    w = Words(data, offs, lower=False)
    split = [(t or "").encode().split() for t in texts]
    assert np.diff(w.of).tolist() == [len(s) for s in split]
    flat = [x for s in split for x in s]
    for i, x in enumerate(flat):
        for j, y in enumerate(flat):
            assert (w.hash[i] == w.hash[j]) == (x == y)
    h, at = windows(w, 2)
    assert h[0] == h[list(at).index(3)] and len(h) == sum(max(0, len(s) - 1) for s in split)
    assert sequence_hash(w)[0] == sequence_hash(w)[3] != sequence_hash(w)[6]
