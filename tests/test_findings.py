"""Queries against their SQL on rows that the smallest tables lack."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from heddle.plans.catalog import ORACLE_SQL, QUERIES


def asked(spark, tmp_path, name, rows, schema, table):
    """A query's rows over a table of these rows, in their order in one file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    return sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())


def told(tmp_path, name, table):
    """Its SQL's rows."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    return sorted(con.execute(ORACLE_SQL[name]).fetchall())


def test_labels_like_their_urls(spark, tmp_path):
    """linked_turns: a label that is the beginning of its URL (`a.` of a.example) is written out, as in the SQL."""
    rows = [(1, 0, "user", "Shtien onsh eren edenly a. Heshly"), (1, 1, "user", "xxxa.exampl a"), (2, 0, "user", "   " * 12), (3, 0, "user", None), (3, 1, "user", "a")]
    got = asked(spark, tmp_path, "linked_turns", rows, "conv_id long, turn long, role string, text string", "conversations")
    assert got == told(tmp_path, "linked_turns", "conversations")


def test_onsets_at_one_instant(spark, tmp_path):
    """onsets: of events at one instant the one with the smallest event_id ends the quiet, in whatever order they come."""
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [(9, at(0), 1), (4, at(0), 1), (7, at(0.5), 1), (3, at(10), 1), (1, at(2000), 2), (0, at(2000), 2), (2, at(4000), 2)]
    got = asked(spark, tmp_path, "onsets", [(i, t, u, "x", 1.0, None) for i, t, u in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string", "events")
    assert got == [(1, 1, 4), (2, 2, 0)]


@pytest.mark.parametrize("name", ["page_plain_text", "comment_texts"])
def test_entities_and_blanks_as_in_the_sql(spark, tmp_path, name):
    """page_plain_text, comment_texts: entities, blanks and letters' cases that the SQL reads, and no others; no row without HTML."""
    texts = [
        "token = &quot</title> x", "&quot;a&quot; &amp;quot &ampquot; &copy &copy; &middot &middot; &lt &lt;b&gt; &#39;&#x27;&nbsp;&apos;&eacute;", "\u3000x\u2003\x85", "\xa0 x \x0b", "x \x85", "\x01", "", "<ſtyle>x</ſtyle>y<styleé>z</style>", None,
        '<a\x0bhref="https://a.b/">t</a>', '<a href=" https://a.b/ ">t</a>', '<a href="HTTPS://A.b/&quot;x&quot">\u3000HTTPS://A.b/\u3000</a>', '<a éhref="https://a.b/?&lt;i&gt;">a.b/…\x85</a>', '<a href="https://a.b/?\'&amp;lt;">\xa0a.b...\n</a>',
    ]
    rows = [(20 * i + k, "https://a.b/", t) for i, t in enumerate(texts) for k in range(20)]
    got = asked(spark, tmp_path, name, rows, "page_id long, url string, html string", "pages")
    assert got == told(tmp_path, name, "pages")
    assert len(got) == 20 * (len(texts) - 1)


def test_sentences_are_split_once(spark):
    """sentence_coverage: a text's sentences and its letters are worked out once a row, not once for each use."""
    plan = QUERIES["sentence_coverage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])") == 1
    assert plan.count("[^a-z0-9]") == 2


def test_every_sentence_is_asked_for(spark, tmp_path):
    """sentence_coverage: all sentences count, not ten of them; shares are rounded as doubles."""
    line = lambda i: f"Sentence {i} of this text has rather more than eight words."
    rows, wanted = [], {}
    # n sentences, the first `again` of them once more at the end
    for doc, (n, again) in enumerate([(12, 0), (25, 0), (40, 0), (40, 7), (200, 0), (3, 0), (10, 4)]):
        said = [line(1000 + i) for i in range(n)] + [line(1000 + i) for i in range(again)]
        text = " ".join(said)
        have = "".join(c for c in text[: 2 * len(text) // 3].lower() if c.isalnum())
        found = sum("".join(c for c in s.lower() if c.isalnum()) in have for s in said)
        rows.append((doc, text, "en", "x", len(text)))
        wanted[doc] = math.floor(found / len(said) * 100 + 0.5) / 100
    rows += [(90, None, "en", "x", 0), (91, "", "en", "x", 0), (92, "\n".join(line(i) if i % 3 else "short one." for i in range(60)), "en", "x", 0)]
    # 23 of 40 and 29 of 200: ties in decimals alone
    for doc, found, n, share in ((93, 23, 40, 0.57), (94, 29, 200, 0.14)):
        rest = " ".join(line(2000 + i) for i in range(n - found))
        rows.append((doc, " ".join([line(1000)] * found) + " x." * len(rest) + " " + rest, "en", "x", 0))
        wanted[doc] = share
    got = asked(spark, tmp_path, "sentence_coverage", rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    assert got == told(tmp_path, "sentence_coverage", "documents")
    assert {d: c for d, c in got if d in wanted} == wanted


def test_blanks_of_sentences(spark, tmp_path):
    """sentence_coverage: words and the ends of sentences are told by the blanks that the SQL knows."""
    texts = ["a b c d e f g\x0bh", "\u3000 b c d e f g \xa0.", "\x0b b c d e f g h", "a b c d e f g h.\x0bi j k l m n o p", "\u2003a b c d e f g h\u3000", "a\xa0b c d e f g h"]
    rows = [(i, t, "en", "x", 0) for i, t in enumerate(texts)]
    got = asked(spark, tmp_path, "sentence_coverage", rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    assert got == told(tmp_path, "sentence_coverage", "documents")


def test_phrases_of_long_texts(monkeypatch):
    """sentence_coverage: hashed windows find what each phrase looked for alone does; the time of one long text stays near its length."""
    from heddle.functions import phrases

    rng = random.Random(8)
    cases = [("", ["a"]), ("abc", ["abc", "abcd", "", "c", "c"]), ("é" * 40 + "x", ["é" * 9, "é" * 9 + "x", "é" * 41])]
    for letters, n in (("ab", 900), ("abcdefgh", 3000), ("a", 300)):
        t = "".join(rng.choice(letters) for _ in range(n))
        said = [t[i : i + rng.randrange(1, 90)] for i in (rng.randrange(n) for _ in range(200))]
        cases.append((t, said + [p[:-1] + "x" for p in said] + [p[1:] + t[:9] for p in said] + said[:20] + [t, t + "a", t[-8:], t[:8]]))
    monkeypatch.setattr(phrases, "ALONE", -1)
    for most in (1 << 20, 64, 7, 1):
        monkeypatch.setattr(phrases, "WINDOWS", most)
        for t, said in cases:
            assert phrases.count_held(t, said) == sum(p in t for p in said)


def test_short_items_behind_others_of_their_key(spark):
    """op10: an item that may not be edited is found behind a passage of the same key; a walk of four steps needn't read the last word."""
    from heddle.llm import decontamination
    from heddle.llm.kernels import Words, text_bytes

    def key(text):
        w = Words(*text_bytes(pa.array([text])), lower=True, letters_only=True)
        return decontamination.item_keys(w.hash, 0)[0][0]

    items, docs, clashes = [], [], 0
    for i in range(40):
        item, other = f"a{i} b{i} c{i} d{i}", f"a{i} b{i} x{i} y{i}"
        clashes += key(item) == key(other)
        items.append((i, item))
        docs += [(2 * i, f"{other} so {other}. And {item}!"), (2 * i + 1, f"{other} so {other}")]
    # an item of eight words, whose window is of seven; no edits at a low rate
    items += [(100, "one two three four five six seven eight")]
    docs += [(100, "One two three four five six seven nine; one two three four five six seven eight.")]
    assert clashes
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.1).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(2 * i, i) for i in range(40)] + [(100, 100)]


def test_markdown_in_small_batches(spark, monkeypatch):
    """page_markdown: a Python worker gets some megabytes of HTML and holds a few rows of it as strings, whatever the table's size."""
    from heddle.functions import markup

    df = QUERIES["page_markdown"](spark, "/root/testdata/sf0.001")
    assert int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    held = []

    def said(x):
        held.append(x)
        return x and x.upper()

    monkeypatch.setattr(markup, "ROWS", 2)
    assert markup._texts(said, pa.array(["a", None, "", "b", "c"])).to_pylist() == ["A", None, "", "B", "C"]
    assert markup._texts(said, pa.array([], pa.string())).to_pylist() == []
    assert held == ["a", None, "", "b", "c"]


def test_one_machine_over_ranges(spark, monkeypatch):
    """lru_outcomes: one machine's events are folded range by range, not in one task, with the rows of a single pass."""
    from heddle.streaming import folds

    rng = random.Random(5)
    rows = [(i, rng.randrange(900), rng.choice([rng.randrange(60), 7]), rng.randrange(90), i % 11 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, us long, user_id long, size long, refresh boolean")
    monkeypatch.setattr(folds, "RANGE", 60)
    for make, args in ((lambda: folds.LruBytes(3000, ttl=200), ["user_id", "size", "us", "refresh"]), (lambda: folds.Budget(20000), ["size"])):
        machine, wanted = make(), {}
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            of = dict(zip(df.columns, r, strict=True))
            wanted[r[0]] = machine.step(*(of[a] for a in args))
        got = folds.fold(df, None, ["us", "id"], make, args)
        assert {r[0]: tuple(r)[len(df.columns) :] for r in got.collect()} == wanted
        assert got.columns[: len(df.columns)] == df.columns
        assert sum(1 for n in got.rdd.glom().map(len).collect() if n) > 5
    assert folds.fold(df.limit(0), None, ["us", "id"], lambda: folds.Budget(9), ["size"]).collect() == []


def test_distinct_hashes(spark):
    """op2: distinct_any() numbers hashes as distinct() does, those included that differ in their low bits alone."""
    from heddle.llm import blocks

    rng = np.random.default_rng(3)
    for key in (rng.integers(0, 1 << 63, 3000, dtype=np.uint64)[rng.integers(0, 900, 3000)], rng.integers(0, 40, 500, dtype=np.uint64) | np.uint64(1 << 63), np.empty(0, np.uint64), np.array([7], np.uint64)):
        (a, _, b), (x, first, y) = blocks.distinct(key), blocks.distinct_any(key)
        assert (a == x).all() and (b == y).all() and (key[first] == x).all()


def test_unseen_ngrams_are_not_asked_for():
    """op2: an n-gram whose last words no training text has is in none; asking for it filled messages."""
    from heddle.llm import backoff_lm, blocks

    table = pa.table({"doc_id": [1, 2, 3], "text": ["a b c d", "a b e f", "a b e a b"], "train": [True, True, False]})
    block = backoff_lm._Block(pa.Table.from_batches([blocks._block(table, True, False, 0)]), 4)
    for k in (1, 2, 3):
        if k > 1:
            block.open(k)
        there = block.number[k] >= 0
        block.total[k] = np.bincount(block.number[k][there], block.weight[there], len(block.keys[k])).astype(np.int64)
    # behind `a b` and behind the start and `a`: `a b c`, `a b e`, `start a b`, and not `a b end`
    assert len(block.keys[3]) == 3
    assert (block.total[3] > 0).all()
