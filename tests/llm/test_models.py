"""Language model, language ID, quality and decontamination: exact parts against brute force, held-out accuracy, edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.llm import backoff_lm, blocks, decontamination, kernels, language_id, quality_cnn
from heddle.llm.kernels import Words, text_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")
DATA = "/root/testdata/sf0.01"


def tokens(t):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + [None]


def test_backoff_counts(spark):
    """Counts and base scores are exact on fixed rows; scores are proper and beat the base on held-out copies."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(50)] + ["Ü", "ß"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "never Seen before"), (1, "dup"), (None, "v1 v2"), (503, "z " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit("a")).repartition(3)
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = [r.asDict() for r in backoff_lm.score_texts(df, train, block_bytes=4000).collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((repr(i), held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows))
    assert sorted((repr(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["score"] < 0 for g in got)


class PlainAutomaton:
    """States, arcs and failure arcs as dictionaries, built from n-gram counts and walked a word at a time."""

    def __init__(self, texts, order=4):
        self.order = order
        count = collections.Counter()
        for t in texts:
            w = ["<s>", *tokens(t)]
            for k in range(1, order + 1):
                count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        words = {g[0]: c for g, c in count.items() if len(g) == 1 and g[0] != "<s>"}
        self.n, self.v = sum(words.values()), len(words)
        ones, twos = (sum(c == x for c in words.values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.states = {()} | {g for g, c in count.items() if len(g) < order and c >= 2 and None not in g}
        seen, once = collections.Counter(), collections.Counter()
        for g, c in count.items():
            if len(g) > 1 and g[:-1] in self.states:
                cell = len(g), int(backoff_lm._class(np.array([count[g[:-1]]]))[0])
                seen[cell] += c
                once[cell] += c if c == 1 else 0
        self.passed = {h: (once[x] + 0.5) / (seen[x] + 1) for h in self.states if h for x in [(len(h) + 1, int(backoff_lm._class(np.array([count[h]]))[0]))]}
        self.arcs = {}
        for w, c in [*words.items(), ("<unknown>", 0)]:
            self.arcs[(), w] = max(c - d, 0) / self.n + d * self.v / self.n / (self.v + 1) if self.n else 1.0
        for k in range(2, order + 1):
            for g, c in count.items():
                if len(g) == k and g[:-1] in self.states:
                    e = self.passed[g[:-1]]
                    self.arcs[g[:-1], g[-1]] = (1 - e) * c / count[g[:-1]] + e * self.arcs[g[1:-1], g[-1]]

    def target(self, h, w):
        g = (*h, w)
        while g not in self.states:
            g = g[1:]
        return g

    def step(self, state, w):
        p = 1.0
        while (state, w) not in self.arcs:
            if not state:
                w = "<unknown>"
                continue
            p, state = p * self.passed[state], state[1:]
        return p * self.arcs[state, w], self.target(state, w)

    def score(self, t):
        state, total = self.target((), "<s>"), 0.0
        for w in tokens(t):
            p, state = self.step(state, w)
            total += math.log10(p)
        return total


def repetitive(seed, n=90):
    """Texts with many repeated runs of words, whole copies and odd cases."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(30)] + ["Ü", "ß"]
    runs = [rng.choices(vocab, k=rng.randint(2, 7)) for _ in range(25)]
    texts = [" ".join(w for _ in range(rng.randint(0, 8)) for w in (rng.choice(runs) if rng.random() < 0.7 else rng.choices(vocab, k=2))) for _ in range(n)]
    return [*texts, *texts[:9], None, "", "never Seen before", "z y x " * 900]


def test_backoff_score_is_the_automatons(spark):
    """Every text's score is what a plain automaton gives, long texts read in parts included."""
    rows = [(i, t) for i, t in enumerate(repetitive(6))]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    plain = PlainAutomaton([t for i, t in rows if not held(i)])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = {r["doc_id"]: r["score"] for r in backoff_lm.score_texts(df, train, block_bytes=3000).collect()}
    assert max(len(s) for s in plain.states) == 3 and sum(len(s) == 3 for s in plain.states) > 50
    for i, t in rows:
        assert math.isclose(got[i], plain.score(t), rel_tol=1e-9, abs_tol=1e-9)


def test_backoff_is_a_distribution():
    """What a state's arcs and its failure arc lead to adds up to one, in the plain automaton that the scores equal."""
    plain = PlainAutomaton(repetitive(6))
    words = [w for h, w in plain.arcs if not h]
    for state in sorted(plain.states, key=repr)[::7]:
        assert abs(sum(plain.step(state, w)[0] for w in words) - 1) < 1e-9


def test_messages():
    """Fingerprints cut into messages come back as they were, empty messages too."""
    cuts = np.array([0, 0, 7, 500, 500, 1000])
    for kind, bits in ((np.uint32, 32), (np.uint64, 64)):
        x = np.sort(np.random.Generator(np.random.PCG64(1)).integers(0, (1 << bits) - 1, 1000, dtype=kind))
        back, at = blocks.prints_of(pa.chunked_array([blocks.cut_prints(x, cuts)]), kind)
        assert (back == x).all() and (at == cuts).all() and back.dtype == kind


def test_keys_sort_by_bucket():
    h = np.random.Generator(np.random.PCG64(2)).integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 7, 123, 4096):
        keys = np.sort(blocks.whole_keys(h))
        at = blocks.bucket_starts(keys, n)
        back = blocks.bucket_of((keys >> np.uint64(32)) | (keys << np.uint64(32)), n)
        assert at[0] == 0 and at[-1] == len(h) and (np.diff(back.astype(np.int64)) >= 0).all()
        assert all((back[a:z] == b).all() for b, (a, z) in enumerate(zip(at, at[1:], strict=False)))


def test_no_ngrams_are_merged():
    """Ten million different pairs of words that all lie in one bucket keep a count each, through question and answer."""
    side, n = 3200, 10_000_000
    words = kernels.mix64(np.arange(1, side + 1, dtype=np.uint64))
    number = np.arange(n)
    pairs = kernels.mix64(words[number // side] * np.uint64(0x2545F4914F6CDD1D) + words[number % side])
    keys, first, _ = blocks.distinct(blocks.whole_keys(pairs))
    assert len(keys) == n
    counts = first % 7
    small, big = blocks.small_counts(counts, np.array([0, n]))
    asked = pa.table({"bucket": [1], "__block": [0], "prints": blocks.cut_prints(keys, np.array([0, n])), "small": small, "big": big})
    told = backoff_lm._answers(1)(asked)
    assert (blocks.counts_of(told["small"], told["big"]) == counts).all()


def test_counts_of_any_size():
    """Counts beyond a byte and beyond 32 bits survive the messages."""
    x = np.array([0, 1, 254, 255, 256, 5_000_000_000, 1 << 60, 7])
    small, big = blocks.small_counts(x, np.array([0, 3, 3, 8]))
    assert blocks.counts_of(pa.chunked_array([small]), pa.chunked_array([big])).tolist() == x.tolist()
    rows = pa.table({"bucket": [5, 5], "__block": [0, 1], "prints": blocks.cut_prints(np.array([3, 9, 9], np.uint64), np.array([0, 2, 3]))})
    counts = [blocks.small_counts(np.array(c), np.array([0, len(c)])) for c in ([4_294_967_290, 2], [4_294_967_299])]
    for i, name in enumerate(("small", "big")):
        rows = rows.append_column(name, pa.chunked_array([pa.concat_arrays([c[i] for c in counts])]))
    out = backoff_lm._answers(2)(rows)
    assert blocks.counts_of(out["small"], out["big"]).tolist() == [4_294_967_290, 4_294_967_301, 4_294_967_301]


def test_backoff_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    nothing = backoff_lm.score_texts(df, F.lit(False)).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in nothing] == [(0, 0, 0.0, 0.0)] * 2
    assert backoff_lm.score_texts(df.limit(0)).collect() == []


def test_backoff_beats_base(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = backoff_lm.query(spark, DATA).where("held_out").collect()
    assert len(rows) == docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).count()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_segmentations_are_all_summed():
    """The forward sum equals the sum over all segmentations, by enumeration."""
    pieces = language_id.Pieces(sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b" ab", b"ba", b"aba"}))
    names = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b" ab", b"ba", b"aba"})
    rng = np.random.Generator(np.random.PCG64(1))
    p = rng.random((pieces.n, 2)) / 50
    at = {w: i for i, w in enumerate(names)}

    def total(w, c):
        sums = [1.0] + [0.0] * len(w)
        for i in range(1, len(w) + 1):
            sums[i] = sum(sums[j] * p[at[w[j:i]], c] for j in range(i) if w[j:i] in at)
        return sums[-1]

    data, offs = text_bytes(pa.array(["ababa b abba zz", "aba"]))
    word, bounds, inverse, of, count = language_id.words_of(data, offs)
    raw = word.tobytes()
    words = [raw[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]
    assert sorted(words) == [b" aba", b" ababa", b" abba", b" b", b" zz"] and of.tolist() == [0, 4, 5]
    got = language_id.likelihoods(pieces, word, bounds, p)
    for row, w in zip(got, words, strict=True):
        for c in range(2):
            assert math.isclose(row[c], math.log(total(w, c)), rel_tol=1e-9)


@pytest.mark.parametrize("size", [255, 257, 700, 10_000])
def test_long_runs_are_read_whole(size):
    """A run longer than a stretch gets the sum over all its segmentations, those across stretches included."""
    rng = random.Random(size)
    names = sorted({bytes([b]) for b in range(256)} | {w.encode() for w in (" a", "ab", "ba", "aba", "bab", "abababab", "漢字", "字漢", "字漢字")})
    pieces = language_id.Pieces(names)
    p = np.random.Generator(np.random.PCG64(2)).random((pieces.n, 2)) / 40
    at = {w: i for i, w in enumerate(names)}
    text = "".join(rng.choice(["a", "b", "ab", "漢字", "字"]) for _ in range(size))
    run = text.encode()[:size].decode(errors="ignore")
    data, offs = text_bytes(pa.array([run + " ab"]))
    word, bounds, inverse, _, _ = language_id.words_of(data, offs)
    got = language_id.likelihoods(pieces, word, bounds, p)
    w = b" " + run.encode()
    for c in range(2):
        sums, log = [1.0], 0.0  # of the last positions, scaled
        for i in range(1, len(w) + 1):
            now = sum(sums[-m] * p[at[w[i - m : i]], c] for m in range(1, min(i, pieces.longest, len(sums)) + 1) if w[i - m : i] in at)
            sums = [x / now for x in sums[-pieces.longest :]] + [1.0]
            log += math.log(now)
        assert math.isclose(got[inverse[0], c], log, rel_tol=1e-9)


def test_language_query_is_the_plain_model(spark):
    """Scores of the query's operator recomputed word by word and segmentation sum by segmentation sum."""
    rng = random.Random(3)
    words = {"en": ["the", "of", "and", "reading", "stone"], "de": ["der", "und", "die", "lesen", "Straße"], "zh": ["漢字学习", "中文"]}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randint(1, 12))), x) for i, x in enumerate(rng.choices(list(words), k=60))] + [(900, "of und 漢字" + "漢字" * 200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = language_id.vocabulary()
    pieces = language_id.Pieces(names)
    langs, p = language_id.fit(language_id.sample_texts(df, F.lit(True)), pieces)
    at = {w: i for i, w in enumerate(names)}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()}

    def log_sum(w, c):
        sums, log = [1.0], 0.0
        for i in range(1, len(w) + 1):
            now = sum(sums[-m] * p[at[w[i - m : i]], c] for m in range(1, min(i, pieces.longest, len(sums)) + 1) if w[i - m : i] in at)
            sums = [x / now for x in sums[-pieces.longest :]] + [1.0]
            log += math.log(now)
        return log

    for i, t, _ in rows:
        like = np.array([sum(log_sum(b" " + w.encode(), c) for w in t.lower().split()) for c in range(len(langs))])
        share = np.exp(like - like.max())
        share /= share.sum()
        assert got[i][0] == langs[int(share.argmax())] and math.isclose(got[i][1], share.max(), rel_tol=1e-6)


def test_language_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language_id.query(spark, DATA).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    rows = [(1, "the of and to", "en", "x"), (2, "der die und das", "de", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "123 !!! \n", "de", "x"), (6, "the " * 9000, "en", "x"), (7, "漢字" * 3000, "zh", "x"), (8, "é" * 5000 + "\U0001f600", None, "x"), (1, "the of and to", "en", "x"), (None, "und der", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "de" and by[7]["lang_pred"] == "zh" and by[6]["lang_pred"] == "en"
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5))
    assert {r["lang_pred"] for r in language_id.identify(df, F.lit(False)).collect()} == {"und"}
    clash = df.select("doc_id", "text", "lang", F.lit(1).alias("low"), F.lit(2).alias("letters"), F.lit(3).alias("row"))
    assert {(r["low"], r["letters"], r["row"]) for r in language_id.identify(clash).collect()} == {(1, 2, 3)}
    assert language_id.identify(df.limit(0)).collect() == []


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality_cnn.query(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, "good words here", 1), (2, None, 2), (3, "", 3), (4, "x" * 100_000, 4), (1, "good words here", 1), (None, "z", 5)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, 1), (None, 1), (2, None)], "doc_id long, label int")
    got = quality_cnn.judge(df, labels, F.lit(True)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality_cnn.judge(df, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality_cnn.judge(df.limit(0), labels, F.lit(True)).collect() == []


def test_quality_scores_are_the_plain_nets():
    """Each text's score recomputed by loops over chunks, places, filters and layers."""
    net = quality_cnn.Net(seed=9)
    rng = np.random.Generator(np.random.PCG64(8))
    for v in net.w.values():
        v += rng.standard_normal(v.shape).astype(np.float32) * 0.1
    texts = ["", "a", "x" * 63, "quality ü text " * 40, "z" * 2000, "ab" * 165]
    data, offs = text_bytes(pa.array(texts))
    got = quality_cnn.scores(net, net.pairs(), data, offs)
    f, w, b, step = net.w["filters"], quality_cnn.WIDTH, quality_cnn.BLOCK, quality_cnn.STRIDE
    for t, score in zip(texts, got, strict=True):
        raw = t.encode()
        blocks_of = (len(raw) + w + b - 1) // b
        raw = raw + b"\0" * (blocks_of * b - len(raw)) + b"\0" * w
        zs, at = [], 0
        while True:
            end = min(at + quality_cnn.SPAN, blocks_of)
            most = [max(sum(float(f[j, raw[i + j], k]) for j in range(w)) for i in range(at * b, end * b)) for k in range(quality_cnn.FILTERS)]
            m = [math.tanh(x + float(y)) for x, y in zip(most, net.w["shift"], strict=True)]
            h = [math.tanh(sum(m[i] * float(net.w["hidden"][i, j]) for i in range(len(m))) + float(net.w["hidden_shift"][j])) for j in range(quality_cnn.HIDDEN)]
            zs.append(sum(x * float(y) for x, y in zip(h, net.w["out"], strict=True)) + float(net.w["out_shift"][0]))
            if end == blocks_of:
                break
            at += step
        assert math.isclose(score, 1 / (1 + math.exp(-sum(zs) / len(zs))), rel_tol=1e-3), t[:10]


def test_every_byte_is_scored():
    """Chunks cover the text: a filter's largest response is found wherever it stands."""
    net = quality_cnn.Net()
    net.w["filters"][:] = 0
    for j, b in enumerate(b"needle"):
        net.w["filters"][j, b, 0] = 10
    for at in (0, 1, 383, 384, 5000, 9990):
        t = bytearray(b"." * 10_000)
        t[at : at + 6] = b"needle"
        text, starts = quality_cnn.padded(np.frombuffer(bytes(t), np.uint8), np.array([0, len(t)]))
        _, first, end = quality_cnn.chunk_starts(starts)
        assert first[0] == 0 and end[-1] == starts[-1] and (first[1:] <= end[:-1]).all()
        two = text[:-1].astype(np.int32) * 256 + text[1:]
        conv = sum(tab[two[2 * j : 2 * j + int(starts[-1]) * quality_cnn.BLOCK]] for j, tab in enumerate(net.pairs()))
        assert conv[:, 0].argmax() == at


def semi_global(a, b):
    d = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j - 1] + (x != y), d[j] + 1, new[j - 1] + 1))
        d = new
    return min(d)


def edited(seed, most, count=240):
    """Items and documents that each hold one of them with up to `most` of its words edited."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(3, 140))] for _ in range(count // 2)]
    docs = []
    for item in items * 2:
        w = list(item)
        for _ in range(rng.randint(0, int(len(w) * most + 1e-9))):
            at, op = rng.randrange(len(w)), rng.randint(0, 2)
            w[at : at + (op != 1)] = [] if op == 0 and len(w) > 1 else [rng.choice(vocab)]
        docs.append(" ".join(rng.choices(vocab, k=rng.randint(0, 40)) + w + rng.choices(vocab, k=rng.randint(0, 40))))
    return items, docs


def test_sampling_alone_reaches_its_recall():
    """Shared keys of sampled embeddings, without anything else, meet 0.9 and more of the leaks that brute force finds."""
    items, docs = edited(1, 0.2)
    data, offs = text_bytes(pa.array([" ".join(x) for x in items]))
    w = Words(data, offs, lower=True, letters_only=True)
    edits = [int(len(x) * 0.2 + 1e-9) for x in items]
    owner = collections.defaultdict(set)
    for i, d in enumerate(edits):
        for key, _ in decontamination.item_keys(w.hash[w.of[i] : w.of[i + 1]], d):
            owner[key].add(i)
    known = decontamination.Filter(len(owner))
    at, mask = known.marks(np.array(sorted(owner), np.int64).view(np.uint64))
    words = collections.defaultdict(int)
    for a, m in zip(at.tolist(), mask.view(np.uint64).tolist(), strict=True):
        words[a] |= m
    known.fill(np.array(list(words)), np.array(list(words.values()), np.uint64).view(np.int64))
    sizes = {decontamination.size_of(len(x)): (0, 0, True) for x in items}
    data, offs = text_bytes(pa.array(docs))
    texts = Words(data, offs, lower=True, letters_only=True)
    met = set()
    for _, start, keys in decontamination.candidates(texts, sizes, known):
        text = np.searchsorted(texts.of, start, "right") - 1
        met |= {(int(t), i) for t, k in zip(text, keys.view(np.int64).tolist(), strict=True) for i in owner.get(k, ())}
    need = {(n, n % len(items)) for n in range(len(docs)) if semi_global(items[n % len(items)], docs[n].split()) <= edits[n % len(items)]}
    assert len(need) > 200 and len(need & met) >= 0.95 * len(need)
    # the sampling chooses: hardly any pair of a document and another's item meets
    assert len(met - need) < 0.2 * len(items) * len(docs)


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_recall(spark, monkeypatch, most):
    """Edited items are found as brute force finds them, with the exact number of edits, by either join."""
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    items, docs = edited(2, 0.2)
    got = decontamination.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    # all pairs; an item that misses more of its words than it may be edited needs no distance
    bags, most_edits = [collections.Counter(d.split()) for d in docs], [int(len(x) * 0.2 + 1e-9) for x in items]
    near = [(n, i) for n, d in enumerate(bags) for i, x in enumerate(items) if sum((collections.Counter(x) - d).values()) <= most_edits[i]]
    need = {(n, i): e for n, i in near for e in [semi_global(items[i], docs[n].split())] if e <= most_edits[i]}
    assert len(need.keys() & got.keys()) >= 0.97 * len(need)
    assert all(c == semi_global(items[b], docs[a].split()) for (a, b), c in got.items())


def test_hot_passages(spark, monkeypatch):
    """An item that a hundred thousand documents hold is found in all, and its rows stay where they are."""
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    item = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame([(1, item), (2, "one two three four five six")], "item_id long, text string")
    docs = spark.range(100_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit(item), F.when(F.col("id") == 77, " one two three four five six").otherwise("")).alias("text"))
    got = decontamination.find_leaks(docs, items).groupBy("item_id").agg(F.count("*").alias("n"), F.max("edits").alias("e")).collect()
    assert sorted(map(tuple, got)) == [(1, 100_000, 0), (2, 1, 0)]
    rows = spark.range(100_000, numPartitions=8).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("key"))
    joined = decontamination._joined(rows, spark.createDataFrame([(-1, "x"), (-1, "y"), (50, "z")], "key long, item string"), "key")
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2 * 90_000 + 1 and max(sizes) < 30_000


def test_short_items_give_one_row_a_text(spark):
    items = spark.createDataFrame([(4, "solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "solo " * 500), (2, "x solo solo")], "doc_id long, text string")
    assert decontamination._leaks(docs, items, 0.2).count() == 2


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, None), (3, " !! "), (4, "solo"), (1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ALPHA, beta. gamma\ndelta epsilon y", 0), (2, "alpha beta gamma delta", 0), (3, None, 0), (4, "", 0), (5, "soloist", 0), (6, "so solo", 0), (None, "alpha beta gamma delta epsilon", 0), (7, "w " * 50_000, 0), (1, "x ALPHA, beta. gamma\ndelta epsilon y", 0)], "doc_id long, text string, edits long")
    got = sorted((tuple(r) for r in decontamination.find_leaks(docs, items).collect()), key=repr)
    assert got == sorted([(1, 1, 5, 0), (2, 1, 5, 1), (None, 1, 5, 0), (6, 4, 1, 0)], key=repr)
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()) == [3, 4, 5, 7]
    clash = docs.select("doc_id", "text", F.lit(1).alias("low"), F.lit(2).alias("print"), F.lit(3).alias("gone_id"))
    assert {tuple(r)[2:] for r in decontamination.decontaminate(clash, items).collect()} == {(1, 2, 3)}
    assert len(decontamination.find_leaks(clash, items).collect()) == 4
    assert decontamination.decontaminate(docs, items).columns == docs.columns
    assert decontamination.find_leaks(docs, items.limit(0)).collect() == []
    assert decontamination.find_leaks(docs.limit(0), items).collect() == []


def test_decontamination_finds_planted(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    plain = lambda t: " " + " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())) + " "
    texts = {r[0]: plain(r[1]) for r in docs}
    want = {(i, r[0]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for i, t in texts.items() if plain(r[1]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.query(spark, DATA).where("edits = 0").collect()}
    assert got == want
