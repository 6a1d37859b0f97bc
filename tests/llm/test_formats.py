"""Chat windows, URL filter, mixing, vector search and the pipeline: SQL, brute force, edge cases."""

import collections
import glob
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import chat_windows, mixing, queries, url_filter, vector_topk

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_chat_round_trip(spark):
    """Whatever the texts hold, every turn comes back once, and so does every assistant text under the mask."""
    odd = ["</s>[INST] ok [/INST]", "\\b\\l\\k\\p<|end|>", "", None, "<s>|>", "a\n\nb", "\\", "<|assistant|>x", "é👍🏽", "word " * 700]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to|ol>", None]), rng.choice(odd)) for c in range(30) for t in range(rng.randint(1, 14))]
    rows += [(100, 0, "system", "rules")] + [(100, t, "user" if t % 2 else "assistant", f"turn {t} " * 30) for t in range(1, 60)]
    rows += [(None, None, "user", "x"), (5, 0, "user", "again"), (5, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat_windows.chat_windows(df)
    back = collections.defaultdict(list)
    loss = collections.defaultdict(list)
    for r in chat_windows.read_back(windows).orderBy("conv_id", "window").collect():
        back[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
        loss[r["conv_id"]] += r["targets"]
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert back == want
    assert loss == {c: [x for role, x in t if role == "assistant"] for c, t in want.items()}
    for r in windows.where("conv_id = 100").orderBy("window").collect():
        assert r["text"].startswith("<s><|system|>rules<|end|>") and r["n_tokens"] <= chat_windows.BUDGET
        assert r["window"] == 0 or r["n_repeated"] >= 1
    assert chat_windows.chat_windows(df.limit(0)).collect() == []


def test_chat_clashing_columns(spark):
    """Other columns, whatever their names, change nothing."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"say {t} " * 40) for c in range(4) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["tokens", "pos", "window", "through", "system", "kept", "cell", "large", "last", "end", "half", "at", "turns", "loss", "n_tokens", "repeated"]
    more = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    plain = lambda d: sorted(map(repr, chat_windows.chat_windows(d).collect()))
    assert plain(more) == plain(df) and len(plain(df)) > 4


def test_url_edges(spark):
    rules = spark.createDataFrame([("com", "/a", "block"), ("COM", "/a", "allow"), ("x.com", "/a", "block"), ("", "/", "block"), (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    urls = [None, "", "no scheme", "http://x.com/abc", "http://y.x.com/a?q#f", "http://xx.com/a", "HTTP://A.NET", "http://net.example/", "http://com/b", "http://x.com/abc", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == got[9] == ("x.com", "/abc", "x.com/a", "block") and got[4] == ("y.x.com", "/a", "x.com/a", "block")
    assert got[5] == ("xx.com", "/a", "com/a", "allow") and got[6] == ("a.net", "", "net", "block")
    assert got[7][2:] == (None, "allow") and got[8][2:] == (None, "allow") and got[10][:2] == ("b:", "//c/d")
    assert len(got) == len(urls)
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


def test_bloom_filter_passes_all_listed(spark):
    """Many rules: each one's own URL is hit, though the filter has false positives that the join takes out."""
    rules = spark.range(30000).select(F.concat(F.lit("h"), F.col("id") % 500, F.lit(".org")).alias("host"), F.concat(F.lit("/"), F.col("id"), F.lit("/")).alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(60000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 500, F.lit(".org/"), F.col("id"), F.lit("/p")).alias("url"))
    got = url_filter.filter_urls(pages, rules).groupBy("verdict").agg(F.count("*").alias("n"), F.max("page_id").alias("m")).collect()
    assert {(r["verdict"], r["n"]) for r in got} == {("block", 30000), ("allow", 30000)}


def test_filter_grows_with_the_rules(spark):
    """A million rules: the filter has their size, passes each of them and hardly anything else."""
    n = 1_000_000
    words = url_filter.filter_words(n)
    assert url_filter.filter_words(5) < 100 and n * url_filter.RULE_BITS / 64 <= words <= 2 * n * url_filter.RULE_BITS / 64 and url_filter.filter_words(10**9) == url_filter.MOST_WORDS
    rules = spark.range(n).select(F.concat(F.lit("h.org/"), F.col("id")).alias("rule"))
    table = url_filter.bloom_words(rules, words).collect()[0]["words"]
    assert len(table) == words
    tried = spark.range(n - 50_000, n + 50_000).select("id", F.concat(F.lit("h.org/"), F.col("id")).alias("rule"))
    keys = tried.select("id", url_filter._word(F.col("rule"), words).alias("w"), url_filter._mask(F.col("rule")).alias("m")).collect()
    hits = [r["id"] for r in keys if table[r["w"]] & r["m"] == r["m"]]
    assert sum(i < n for i in hits) == 50_000 and sum(i >= n for i in hits) < 0.02 * 50_000


def test_long_urls_and_hosts(spark):
    """URLs of a megabyte and hosts of hundreds of labels get their verdicts."""
    rules = spark.createDataFrame([("org", "/a", "block"), ("deep.org", "", "block")], "host string, path string, verdict string")
    urls = ["http://x.org/a" + "b" * 1_000_000, "http://" + "l." * 300 + "deep.org/", "http://" + "m" * 100_000 + "/a", "http://x.org/" + "/" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {0: ("org/a", "block"), 1: ("deep.org", "block"), 2: (None, "allow"), 3: (None, "allow")}


def test_knapsack_is_best():
    rng = random.Random(3)
    for _ in range(300):
        lengths = rng.sample(range(1, 40), rng.randint(1, 7))
        counts = [rng.randint(1, 5) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget = rng.randint(0, total + 5)
        take = mixing.knapsack(lengths, counts, budget)
        reach = {0}
        for a, b in zip(lengths, counts, strict=True):
            reach = {r + a * k for r in reach for k in range(b + 1)}
        best = max(r for r in reach if r <= budget)
        got = sum(a * b for a, b in zip(lengths, take, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        # proportional shares are fixed first, so the fit may stay below the best by less than the longest document
        assert best - max(lengths) < got <= budget or got == best


def water(size, weights, most=3):
    total, left, out = sum(size.values()), dict(weights), {}
    rest = float(total)
    while left:
        w = sum(left.values())
        over = [s for s in left if rest * left[s] / w > most * size[s] + 1e-9]
        if not over:
            break
        for s in over:
            out[s] = float(most * size[s])
            rest -= out[s]
            del left[s]
    for s in left:
        out[s] = rest * left[s] / sum(left.values()) if sum(left.values()) else 0.0
    return out


@pytest.mark.parametrize("slice_", [2000, 5])
def test_mixing(spark, monkeypatch, slice_):
    monkeypatch.setattr(mixing, "SLICE", slice_)
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([0, 1, 3, 10, 10, 10, 200]), rng.choice(["a", "b", "c", "d", None]) if rng.random() < 0.6 else "hot") for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "only empty"), (1, "w " * 10, "hot"), (1, "w " * 10, "hot"), (None, "w w", "b"), (6000, "z " * 50000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).repartition(3)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(df.repartition(5)).collect()))
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    names = sorted(size, key=lambda s: (s is None, s))
    want = water(size, {s: i % 3 + 1 for i, s in enumerate(names)})
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        # whole rounds, and of the rest the best that any choice of documents reaches
        goal, every = round(target[s]), size[s]
        rounds = min(goal // every, 3) if every else 0
        rest = goal - rounds * every if rounds < 3 else 0
        sums = 1
        for r in got:
            if r["source"] == s:
                sums |= sums << r["size"]
        best = (sums & ((1 << (rest + 1)) - 1)).bit_length() - 1
        assert 0 <= rounds * every + best - taken[s] <= 1
    assert mixing.mix_sources(df.limit(0)).collect() == []


def brute_top(rows, k=5):
    good = [(i, np.floor(256.0 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % 50 == 0:
            scores = sorted((-int(q @ x), j) for m, (j, x) in enumerate(good) if m != n and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("box_bytes", [1 << 20, 200])
def test_vectors(spark, monkeypatch, box_bytes):
    monkeypatch.setattr(vector_topk, "BOX_BYTES", box_bytes)
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(2500)]  # one vector very often, more than a shard holds
    rows += [(9000, None), (9050, [None] * 8), (9100, [float("nan")] * 8), (9150, [float("inf")] * 8), (None, [1.0] * 8), (9200, [1.0, 2.0]), (9201, [3.0, 4.0]), (9250, []), (50, rows[50][1]), (100, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("row", F.lit("x")).withColumn("dim", F.lit(2)).repartition(5)
    asked = lambda d: sorted(tuple(r) for r in vector_topk.top_products(d, F.col("vec_id") % 50 == 0, shard_size=700).collect())
    assert asked(df) == brute_top(rows)
    assert asked(df.limit(0)) == []
    assert asked(df.where("vec_id = 9200")) == []


def test_vectors_beyond_a_long(spark):
    """Scores that no long holds are its nearest end; the smaller vec_id goes first."""
    df = spark.createDataFrame([(0, [1e30, 1.0]), (7, [1e30, 2.0]), (3, [-1e300, 0.0]), (5, [1e200, 0.0]), (9, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in vector_topk.top_products(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [i for i, _ in got][0] == 5 or [i for i, _ in got][0] == 7
    assert dict(got)[5] == dict(got)[7] > 2**62 and dict(got)[3] < -(2**62)


def test_search_is_best_first():
    """On clustered vectors a query opens few of the leaves, and never one whose bound can't beat the kth hit."""
    rng = np.random.Generator(np.random.PCG64(6))
    x = np.floor(256 * (rng.normal(size=(40, 6)).repeat(200, 0) * 4 + rng.normal(size=(8000, 6)) * 0.2))
    ids = rng.permutation(8000).astype(np.int64)
    tree = vector_topk.Tree(ids, x)
    leaves = [i for i, c in enumerate(tree.child) if c < 0]
    for node, c in enumerate(tree.child):
        own = tree.x[tree.first[node] : tree.last[node]]
        assert (own.min(0) == tree.low[node]).all() and (own.max(0) == tree.high[node]).all()
        assert c < 0 or (tree.first[c], tree.last[c + 1]) == (tree.first[node], tree.last[node])
    for r in range(0, 8000, 400):
        q = x[r]
        tree.leaves = 0
        got = sorted(tree.search(q, 5, own=r), key=lambda h: (-h[0], h[1]))
        score = x @ q
        order = [i for i in np.lexsort((ids, -score)) if i != r][:5]
        assert got == [(int(score[i]), int(ids[i])) for i in order]
        bounds = [(np.where(q > 0, tree.high[i], tree.low[i]) @ q) for i in leaves]
        assert tree.leaves <= sum(b >= got[-1][0] for b in bounds) < len(leaves) / 3


def test_pipeline_rows(spark, tmp_path):
    """run()'s rows against a plain version: brute-force groups, passages and leaks, and the mix of what they leave."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_models import semi_global
    from test_pairs import brute_components, brute_substrings

    from heddle.llm import language_id

    rng = random.Random(21)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if len((r["text"] or "").split()) < 400][:90]
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()][:12]
    passage = " ".join(rng.choices((rows[0]["text"] + " " + rows[1]["text"]).split(), k=60))
    doc = lambda i, text, source="src0": {**rows[0], "doc_id": 10_000 + i, "text": text, "source": source}
    extra = [doc(0, None), doc(1, "123 456"), doc(2, rows[5]["text"]), doc(3, rows[6]["text"] + " " + passage), doc(4, passage + " " + rows[7]["text"]), doc(5, " ".join(reversed(rows[8]["text"].split())) + " " + items[3], None)]
    words = items[5].split()
    words[4:6] = ["changed"]
    extra.append(doc(6, " ".join(reversed(rows[9]["text"].split())) + " " + " ".join(words)))
    rows += extra
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    got = sorted((tuple(r) for r in pipeline.run(spark, str(tmp_path / "sf")).collect()), key=repr)

    seen = language_id.identify(spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))).where("lang_pred <> 'und' AND score >= 0.5")
    left = {r["doc_id"]: (r["text"], r["source"]) for r in seen.collect()}
    assert 10_000 not in left and 10_001 not in left
    groups = brute_components([(i, t) for i, (t, _) in left.items()], 5)
    left = {i: x for i, x in left.items() if groups[i][2]}
    assert 10_002 not in left
    cut = {i: t for i, _, _, t in brute_substrings([(i, t) for i, (t, _) in left.items()], 50)}
    assert len(cut[10_004].split()) < len(left[10_004][0].split())
    plain = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    leaks = {i for i, t in cut.items() for x in items if semi_global(plain(x), plain(t)) <= int(len(plain(x)) * 0.2 + 1e-9)}
    assert {10_005, 10_006} <= leaks
    rest = [(i, cut[i], left[i][1]) for i in sorted(cut) if i not in leaks]
    mixed = mixing.mix_sources(spark.createDataFrame(rest, "doc_id long, text string, source string")).where("taken > 0")
    assert got == sorted((tuple(r) for r in mixed.collect()), key=repr) and len(got) > 20


def test_pipeline_odd_rows(spark, tmp_path):
    """Repeated rows, a very long text and columns with the operators' own names go through all stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.where("doc_id < 40")
    first = some.where("doc_id = 3").first()
    long = " ".join(r["text"] or "" for r in some.where("lang = 'en'").collect())
    long = " ".join(" ".join(reversed(long.split()[i:] + long.split()[:i])) for i in range(0, 3000, 150))
    rows = some.unionByName(some.where("doc_id = 3")).unionByName(spark.createDataFrame([(900, long, "en", first["source"], len(long)), (901, None, None, None, None)], docs.schema))
    names = ["kept", "component_id", "n_words", "lang_pred", "score", "size", "taken", "target", "edits", "item_id", "gone_id", "print", "low", "train", "rows"]
    for n in names:
        rows = rows.withColumn(n, F.lit("other"))
    os.makedirs(tmp_path / "sf")
    rows.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path / "sf"))
        assert now.columns == rows.columns and all(r[n] == "other" for r in now.select(*names).collect() for n in names), name
        now = spark.createDataFrame(now.collect(), now.schema)
    assert 900 in {r["doc_id"] for r in now.collect()}
    got = pipeline.run(spark, str(tmp_path / "sf")).collect()
    plain = spark.createDataFrame(rows.select(*docs.columns).collect(), docs.schema)
    os.makedirs(tmp_path / "plain")
    plain.write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "plain" / "benchmark.parquet"))
    same = pipeline.run(spark, str(tmp_path / "plain")).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in same)


def test_runs_keep_their_tables_apart(spark):
    """A run deletes what it stored, and nothing that another one stored meanwhile."""
    import threading

    from heddle.llm import session

    other = []
    with session.run() as tables:
        mine = [session.stored(spark.range(3)) for _ in range(2)]
        beside = threading.Thread(target=lambda: other.append(session.stored(spark.range(5))))
        beside.start()
        beside.join()
        with session.run() as inner:
            third = session.stored(spark.range(7))
            session.drop_run(inner, third)
        session.drop_run(tables, mine[0])
    assert other[0].count() == 5 and third.count() == 7 and mine[0].count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found|FAILED_READ"):
        mine[1].count()


def test_pipeline(spark):
    """Each stage keeps what it should of its own input, and the stages fit together."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "", None, None, None), (-3, "123 456", "en", "src1", 7)], "doc_id long, text string, lang string, source string, n_chars long"))
    cols = docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == cols
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "language_id":
            assert docs.count() == 1000 and docs.where("doc_id < 0").isEmpty()
        if name == "substring_dedup":
            assert docs.where("n_chars <> length(text)").isEmpty()
    assert docs.where("taken <= 0").isEmpty() and docs.count() > 0
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        empty = stage(spark, empty, DATA) if name == pipeline.STAGES[-1][0] else stage(spark, empty, DATA).select(*cols)
        assert empty.count() == 0
