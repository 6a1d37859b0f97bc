"""Functions and machines by themselves."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.functions import classify, markup, text, urls
from heddle.streaming import folds


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_windows_reassemble(spark):
    """Windows followed by their offsets give the text back, whatever its characters."""
    body = "é👍🏽 " * 900
    df = spark.createDataFrame([(body,)], "t string")
    at, out = 0, ""
    while True:
        w = df.select(text.window_of(F.col("t"), 400, F.lit(at)).alias("w")).first()["w"]
        assert len(w["text"]) <= 400
        end = w["next"] - at
        out += w["text"][:end]
        if w["next"] >= w["total"]:
            break
        at = w["next"]
    assert out == body


def test_window_edges(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    got = [r["w"] for r in df.select(text.window_of(F.col("t"), 10, F.lit(5)).alias("w")).collect()]
    assert got[0]["text"].startswith("[") and got[0]["next"] == 3
    assert got[2]["text"] is None
    tight = df.select(text.window_of(F.col("t"), 2, F.lit(0)).alias("w")).first()["w"]
    assert tight["text"].startswith("ab") and tight["next"] == 2  # no room for the marker: overshoots


def test_bad_urls_do_not_raise(spark):
    rows = [(x,) for x in ("", "http://", "::", "http://[::1]/", "http://a b/", None, "HTTP://A.com:99999999/")]
    df = spark.createDataFrame(rows, "u string")
    u = F.col("u")
    assert len(df.select(urls.merge_key(u), urls.cache_url(u), urls.guard_reason(u), urls.route(u), urls.github_kind(u), urls.listing_limit(u)).collect()) == len(rows)


def test_merge_key(spark):
    cases = {"HTTPS://www.Example.com/a/#x": "example.com/a", "http://example.com:8080/a?q=1": "example.com:8080/a?q=1", "nonsense": "nonsense"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert [r[0] for r in df.select(urls.merge_key(F.col("u"))).collect()] == list(cases.values())


def test_scan_limit_is_bytes(spark):
    far = "é" * 40000 + "verify you are human"
    df = spark.createDataFrame([(far,), ("x" * 100 + "VERIFY YOU ARE HUMAN",)], "t string")
    assert [r[0] for r in df.select(classify.wall_marker(F.col("t"))).collect()] == [None, "verify you are human"]
    # a character that the limit cuts is left out, whatever its length
    cut = ["x" * (classify.SCAN_BYTES - n) + c * 3 for c in ("é", "語", "👍") for n in range(1, 5)]
    assert column_of(spark, classify.head_bytes, cut) == [t.encode()[: classify.SCAN_BYTES].decode("utf-8", "ignore") for t in cut]


def test_markdown():
    md = markup.to_markdown("<h2>T</h2><p>a <b>b</b> <a href='http://x/y'>l</a></p><ul><li>1<li>2</ul><ol><li>p</ol><pre>x  y</pre><blockquote>q</blockquote><table><tr><td>1<td>2</tr></table><script>no</script>&amp;")
    for part in ("## T", "**b**", "[l](http://x/y)", "- 1", "1. p", "```\nx  y\n```", "> q", "| 1 | 2 |", "&"):
        assert part in md
    assert "no" not in md
    assert markup.to_markdown(None) is None and markup.to_markdown("") == ""


def test_markdown_whole():
    html = '<h2>T</h2><p>a <b>b</b> <a href="http://x/y">l</a></p><ul><li>1</li><li>2</li></ul><ol><li>p</li><li>q</li></ol><pre>x  y</pre><blockquote>q</blockquote><table><tr><td>1</td><td>2</td></tr></table>&amp;<br>z'
    assert markup.to_markdown(html) == "## T\n\na **b** [l](http://x/y)\n\n- 1\n- 2\n\n1. p\n2. q\n\n```\nx  y\n```\n\n> q\n\n| 1 | 2 |\n\n&\nz"


def test_tidy_keeps_fences():
    src = "![b](u)\n\n```\n![b](u)\n[x](y)\n```\n[x](y.md)"
    assert markup.tidy_markdown(src, "http://h") == "```\n![b](u)\n[x](y)\n```\n[x](http://h/y.md)"


def test_articles(spark):
    import json

    from heddle.functions.articles import article_markdown

    link = lambda k, u: {"key": k, "value": {"type": "LINK", "data": {"url": u}}}
    entities = [link("1", "http://a"), {"key": "2", "value": {"type": "MEDIA", "data": {"mediaItems": [{"mediaId": "m"}, {"mediaId": "none"}]}}}, {"key": "3", "value": {"type": "TWEET", "data": {"tweetId": "77"}}}, {"key": "4", "value": {"type": "MARKDOWN", "data": {"markdown": " **m** "}}}, link("5", "x y")]
    span = lambda o, n, k: {"offset": o, "length": n, "key": k}
    blocks = [
        {"type": "header-one", "text": " T "}, {"type": "header-five", "text": "F"}, {"type": "unordered-list-item", "text": "a"}, {"type": "ordered-list-item", "text": "b"}, {"type": "unstyled", "text": "  "}, {"type": "unordered-list-item", "text": "c"},
        {"type": "unstyled", "text": "👍 here", "entityRanges": [span(3, 4, 1), span(4, 2, 1), span(3, 99, 1), span(0, 0, 1), span(0, 1, 9)]}, {"type": "atomic", "text": " ", "entityRanges": [span(0, 1, 2)]}, {"type": "atomic", "text": " ", "entityRanges": [span(0, 1, 3)]}, {"type": "atomic", "entityRanges": [span(0, 1, 4)]}, {"type": "atomic", "text": "x", "entityRanges": []},
        {"type": "blockquote", "text": "q\nr"}, {"type": "code-block", "text": " x\n"}, {"type": "unstyled", "text": "x y z", "entityRanges": [span(0, 3, 5)]},
    ]
    whole = {"blocks": blocks, "entityMap": entities, "mediaEntities": [{"media_id": "m", "media_info": {"__typename": "ApiVideo", "alt_text": "a  b"}}]}
    want = "## T\n\n#### F\n\n- a\n1. b\n- c\n\n👍 [here](http://a)\n\n[video: a b] [image]\n\n[embedded post: https://x.com/i/status/77]\n\n**m**\n\n> q\n> r\n\n```\n x\n\n```\n\nx y z"
    halves = {"blocks": [{"type": "unstyled", "text": "👍👍!", "entityRanges": [span(1, 2, 1)]}], "entityMap": entities}
    assert column_of(spark, article_markdown, [json.dumps(halves)]) == ["\ufffd[\ufffd\ufffd](http://a)\ufffd!"]
    assert column_of(spark, article_markdown, [json.dumps(whole), "{}", "nonsense", None, "[]", '{"blocks": [{"type": "unstyled", "text": "t"}]}']) == [want, "", None, None, None, "t"]


@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 20))
@settings(deadline=None, max_examples=60)
def test_quota_never_exceeded(gaps, limit, period):
    """In no period are there more admissions than allowed, and bookings stay in order."""
    machine, at, sent = folds.RollingQuota(limit, period), 0, []
    for g in gaps:
        at += g
        sent.append(machine.step(at)[0])
    assert sent == sorted(sent)
    for i in range(len(sent) - limit):
        assert sent[i + limit] - sent[i] >= period


def test_cache_edges():
    open_, closed = folds.TtlCache(10), folds.TtlCache(10, closed=True)
    for m in (open_, closed):
        assert m.step(0)[0] == "miss" and m.step(9)[0] == "hit"
    assert open_.step(10)[0] == "miss" and closed.step(10)[0] == "hit"
    assert open_.step(11, True)[0] == "bypass" and open_.step(20)[0] == "hit"


def test_quota_cancel_and_hold():
    m = folds.RollingQuota(1, 100)
    assert m.step(0) == (0, "sent") and m.step(1) == (100, "sent")
    m.step(2, "cancel", 100)
    assert m.step(3) == (100, "sent")
    m.step(4, "hold", 1000)
    m.step(5, "hold", 1)
    assert m.step(6) == (1004, "sent")
    assert folds.RollingQuota(1, 100, 50).step(0) == (0, "sent")
    assert not m.idle(1100, 1004, 50) and m.idle(1105, 1004, 50)


def test_lru_and_flights():
    m = folds.LruBytes(600, overhead=100)
    assert [m.step(k, 150)[0] for k in "abab"] == ["miss", "miss", "hit", "hit"]
    assert m.step("c", 150)[2] == 1 and m.step("b", 150)[0] == "hit" and m.step("a", 150)[0] == "miss"
    m = folds.LruBytes(600, overhead=100, ttl=10)
    assert m.step("a", 150, 0) == ("miss", 251, 0) and m.step("a", 99, 5, True) == ("refresh", 200, 0)
    assert m.step("a", 1, 14)[0] == "hit" and m.step("a", 150, 15) == ("miss", 251, 0)
    assert m.step("a", 600, 16, True) == ("too_large", 251, 0) and m.step("a", 0, 17)[0] == "hit"
    h = folds.Holds(100)
    assert h.step(0, True, 0, True, True) == (True, 0) and h.step(1, True, 0, True, False) == (True, 101)
    assert h.step(5, True, 10) == (False, 105) and h.step(6, True, 500) == (False, 506) and h.step(7) == (False, 506) and h.step(506) == (True, 0)
    f = folds.SingleFlight()
    assert f.step(0, 10, 1, True)[0] == "leader" and f.step(5, 15, 2)[0] == "leader" and f.step(6, 9, 3) == ("follower", 2)


def test_fold_matches_machines(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 5), i, rng.randint(0, 1000)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, t long")
    got = {r["i"]: r["admitted"] for r in folds.fold(df, "k", ["t", "i"], lambda: folds.RollingQuota(2, 50), ["t"]).collect()}
    want, machines = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[i] = machines.setdefault(k, folds.RollingQuota(2, 50)).step(t)[0]
    assert got == want


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(k, i, 10 * i) for i in range(40) for k in (1, 2)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "k long, i long, t long, n long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    make = lambda: folds.RollingQuota(2, 50)
    out = folds.fold_stream(stream, "k", "t", make, ["t"])
    run = out.writeStream.format("memory").queryName("admitted").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    got = {r["n"]: r["admitted"] for r in spark.table("admitted").collect()}
    want = {r["n"]: r["admitted"] for r in folds.fold(df, "k", ["t", "n"], make, ["t"]).collect()}
    assert got == want


def test_idle_state_goes(spark, tmp_path):
    """A key whose state has been idle starts anew in a later micro-batch; without a limit it goes on."""
    import time

    got = {}
    for idle in (2000, None):
        home = tmp_path / f"idle_{idle}"
        spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "k long, t long, n long").write.parquet(str(home / "in"))
        stream = spark.readStream.schema("k long, t long, n long").parquet(str(home / "in"))
        for step in (0, 1):
            out = folds.fold_stream(stream, "k", "t", lambda: folds.RollingQuota(2, 100), ["t"], idle)
            keep = lambda df, _: df.isEmpty() or df.write.mode("append").parquet(str(home / "out"))  # noqa: B023, E731
            # a stream with timers makes batches for ever
            run = out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(home / "cp")).trigger(processingTime="1 second").start()
            for _ in range(90):
                time.sleep(1)
                if (home / "out").exists() and spark.read.schema("k long, t long, n long, admitted long").parquet(str(home / "out")).count() == 2 + step:
                    break
            run.stop()
            if step == 0:
                time.sleep(4)
                spark.createDataFrame([(1, 2, 2)], "k long, t long, n long").write.mode("append").parquet(str(home / "in"))
        got[idle] = {r["n"]: r["admitted"] for r in spark.read.schema("k long, t long, n long, admitted long").parquet(str(home / "out")).collect()}
    assert got == {2000: {0: 0, 1: 1, 2: 2}, None: {0: 0, 1: 1, 2: 100}}


def test_streamed_counters(spark, tmp_path):
    from heddle.streaming import metrics

    spark.createDataFrame([("a", 0.1), ("a", 3.0), ("b\"x", 0.7)], "l string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("l string, v double").parquet(str(tmp_path / "in"))
    for name, df in (("totals", metrics.counter(stream, ["l"])), ("buckets", metrics.distribution(stream, ["l"], F.col("v"), [0.5, 1.0]))):
        df.writeStream.format("memory").queryName(name).outputMode("update" if name == "totals" else "complete").trigger(availableNow=True).start().awaitTermination(240)
    assert {tuple(r) for r in spark.table("totals").collect()} == {("a", 2), ('b"x', 1)}
    assert {(r["l"], r["le"], r["n"]) for r in spark.table("buckets").collect()} == {("a", 0.5, 1), ("a", 1.0, 1), ("a", None, 2), ('b"x', 0.5, 0), ('b"x', 1.0, 1), ('b"x', None, 1)}
    assert {r["line"] for r in metrics.exposition(spark.table("totals"), "n", ["l"]).collect()} == {'n{l="a"} 2', 'n{l="b\\"x"} 1'}


def test_chains_of_any_depth(spark):
    """A chain of 500 is whole; a cycle ends."""
    from heddle.operators import threads
    from heddle.sources.tables import checkpoints

    checkpoints(spark)
    rows = [(1, i, i - 1 if i else None) for i in range(500)] + [(2, 0, 1), (2, 1, 0), (2, 5, 99)]
    got = {(r["thread"], r["id"]): r["chain"] for r in threads.ancestors(spark.createDataFrame(rows, "thread long, id long, parent long")).collect()}
    assert got[1, 499] == ">".join(map(str, range(500))) and got[1, 0] == "0" and got[2, 5] == "5" and len(got) == 503


def test_every_engine_counts(spark):
    """Engines beyond a thousand are counted, each from the search on that names it."""
    import datetime as dt

    from heddle.plans import rank_queries

    rows = [(i, 1 + i % 3, f"e{i:04d}", 1.0 if i % 2 else 30.0, dt.datetime(2026, 1, 1)) for i in range(3000)]
    path = rank_queries.table
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp")
    rank_queries.table = lambda s, d, name: df
    try:
        out = {r["engine"].split("/")[0]: r["n_silent"] for r in rank_queries.silent_engines(spark, "").collect()}
    finally:
        rank_queries.table = path
    # three searches in the order of their users; only odd events name an engine
    assert out == {f"e{i:04d}": 2 - i % 3 for i in range(1, 3000, 2) if i % 3 < 2}


def column_of(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_challenges(spark):
    """A solver's script as a <script src>, or the whole title; no other mention."""
    yes = [
        '<script src="/cdn-cgi/challenge-platform/h/g/orchestrate/chl_page/v1?ray=1"></script>', "<SCRIPT defer SRC=https://x.y/cdn-cgi/challenge-platform/a/orchestrate/b>", "<title>Just a moment...</title>", "<title>Einen Moment…</title>", "<title lang=fr>\n Un instant… </title>",
        "<title>Attention Required! | Cloudflare</title>", "<title>Please Wait... | Cloudflare</title>", "<title>um momento</title>",
    ]
    no = [
        '<script src="/cdn-cgi/challenge-platform/scripts/jsd/main.js"></script>', '<div class="cf-turnstile"></div>', "<script>var a='/cdn-cgi/challenge-platform/x/orchestrate/'</script>", "<p>src=/cdn-cgi/challenge-platform/x/orchestrate/</p>", "<title>Just a moment of silence</title>", "<title>Please wait...</title>",
        "x" * 65_536 + "<title>Just a moment...</title>", "", None,
    ]
    assert column_of(spark, classify.challenge_page, yes) == [True] * len(yes)
    assert [bool(x) for x in column_of(spark, classify.challenge_page, no)] == [False] * len(no)


def test_silent_failures(spark):
    words = "words that say something about a subject " * 8
    cases = {
        "# Page not found\n" + words: "not_found", words + "\n# Page not found": None, "short\n" * 11 + "Page not found\n" + words: "not_found", "short\n" * 12 + "Page not found\n" + words: None,
        "---\n" * 40 + "> **Page not found**\n" + words: "not_found", "The page you were looking for is no more, and this line goes on beyond sixty.\n" + words: None, "### Select your country\n" + words: "bot_block", "## Select your region\n" + words: None, "#choose a country\n" + words: None,
        "[Choose a country](/x)\n" + words: None, "x\n" * 10 + "# Choose a country\n" + words: None, "# Choose a country\n" + words * 6: None, "Loading…\n" * 10 + "a\n" * 23: "thin_content", "Loading\n" * 10 + "a\n" * 24: None, "Loading\n" * 9: None, "Powered and protected by\nAkamai": "bot_block", "": None,
    }
    assert column_of(spark, classify.silent_failure, cases) == list(cases.values())
    # the vendor may be named in the cleaned HTML alone
    df = spark.createDataFrame([("Powered and protected by", "<img alt=akamai>")], "t string, h string")
    assert df.select(classify.silent_failure(F.col("t"), classify.scanned(F.col("t"), F.col("h")))).first()[0] == "bot_block"


def canonical(query):
    """The query as the standard library reads and writes it."""
    import re
    from urllib.parse import quote_plus, unquote_to_bytes

    pieces = [p for p in query.split("&") if p]
    if any(";" in p or re.search("%(?![0-9A-Fa-f]{2})", p) for p in pieces):
        return query
    pairs = [tuple(unquote_to_bytes(x.replace("+", " ")) for x in (p.split("=", 1) + [""])[:2]) for p in pieces]
    return "&".join(f"{quote_plus(k, safe='~')}={quote_plus(v, safe='~')}" for k, v in sorted(pairs, key=lambda p: p[0]))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab%7eE2f+=&;~-_.!*' é👍\x7f\xff/", max_size=24), min_size=1, max_size=40))
def test_canonical_queries(spark, queries):
    queries = [*queries, "%FF%C3=%ff&%c3%28", "b=%7E&a=%2f", "a", "=", "&&", "a=b=c&a=a", "%zz=1", "a%", "+=+"]
    assert column_of(spark, urls.canonical_query, queries) == [canonical(q) for q in queries]


def test_cache_urls(spark):
    cases = {
        "HTTP://Example.COM:80/a?b=1&a=2#x": "http://example.com/a?a=2&b=1", "https://u:p@Example.com:8443/": "https://u:p@example.com:8443/", "https://a.b/%7Ex/%2f": "https://a.b/%7Ex/%2f", "https://a.b/ü x%41": "https://a.b/%C3%BC%20xA", "https://a.b/%zz": None, "https://a.b:x/": None, "https://a b/": None,
        "https://[::1]:443/x": "https://[::1]/x", "https://[::1]:8080/x": "https://[::1]:8080/x", "https://a.b/?": "https://a.b/?", "https://a.b/?&&": "https://a.b/", "mailto:x@y": None, "": None, "https://a.b/\x01": None, "https://a.b?x;y=1&a": "https://a.b?x;y=1&a",
    }
    assert column_of(spark, urls.cache_url, cases) == list(cases.values())
    assert column_of(spark, lambda u: urls.cache_key(u, F.lit("{}")), ["", "nonsense"]) == [None, None]


def test_listings(spark):
    at = "https://www.reddit.com/r/x"
    limits = {"": 25, "?limit=0": 25, "?limit=-4": 25, "?limit=5000000": 100, "?limit=7": 7, "?limit=%2B7": 7, "?limit=+7": 25, "?limit=7.5": 25, "?limit=99999999999999999999": 25, "?limit=3&limit=9": 3, "?%6cimit=8": 8, "?a;limit=9&limit=6": 6, "?limit=%zz&limit=6": 6, "?LIMIT=6": 25, "?limit=%FF": 25, "?limit=%C3&limit=4": 25}
    assert column_of(spark, urls.listing_limit, [at + q for q in limits]) == list(limits.values())
    cases = {
        at: ("x", "hot", "", 25), at + "/TOP/?t=Week": ("x", "top", "week", 25), at + "/new?t=week": ("x", "new", "", 25), at + ".json?limit=3": ("x", "hot", "", 3), at + "/controversial?t=decade": ("x", "controversial", "", 25), at + "/best": None, at + "/comments/1": None, "https://reddit.com/user/x": None, "https://x.com/r/x": None,
    }
    got = column_of(spark, urls.listing, cases)
    assert [tuple(g) if g else None for g in got] == list(cases.values())
    assert column_of(spark, urls.is_share, [at + "/s/Ab_1", at + "/s/Ab_1/", at + "/s/a/b", "https://old.reddit.com/R/y/S/9"]) == [True, True, False, True]


def test_question_hosts(spark):
    yes = ["https://www.stackoverflow.com/questions/1/x", "http://meta.unix.stackexchange.com/q/5", "https://www.unix.meta.stackexchange.com/a/5/6", "https://meta.stackexchange.com/questions/3", "https://www.meta.askubuntu.com/q/1"]
    no = ["ftp://stackoverflow.com/questions/1", "https://chat.stackexchange.com/questions/1", "https://www.api.stackexchange.com/q/1", "https://stackoverflow.com/users/1", "https://a.b.stackexchange.com/q/1", "https://wwwstackoverflow.com/q/1"]
    assert column_of(spark, urls.route, yes + no) == ["stackexchange"] * len(yes) + ["browser"] * len(no)


def test_links_and_facets(spark):
    cases = [
        ("Home", "https://a.b/c", "[Home](https://a.b/c)"), ("a.b/lon…", "https://a.b/long", "https://a.b/long"), ("https://a.b/lon...", "https://a.b/long", "https://a.b/long"), ("www.a.b", "https://www.a.b/c", "https://www.a.b/c"), ("a.b", "HTTP://www.a.b/c", "HTTP://www.a.b/c"), ("Continue…", "https://a.b", "[Continue…](https://a.b)"),
        (" ", "https://a.b", "https://a.b"), ("…", "https://a.b", "https://a.b"), (" x ", "", " x "), (" x ", None, " x "), ("A.b", "https://a.b", "[A.b](https://a.b)"),
    ]
    df = spark.createDataFrame(cases, "l string, h string, w string")
    assert all(r[0] == r[1] for r in df.select(text.link(F.col("l"), F.col("h")), "w").collect())

    def plainly(body, facets):
        raw, at, out = body.encode(), 0, []
        start = lambda i: i == len(raw) or raw[i] & 0xC0 != 0x80
        for a, z, u in sorted((f for f in facets if f[2] and 0 <= f[0] < f[1] <= len(raw) and start(f[0]) and start(f[1])), key=lambda f: f[0]):
            if a >= at:
                out += [raw[at:a].decode(), f"[{raw[a:z].decode().strip()}]({u})" if raw[a:z].strip() else u]
                at = z
        return "".join(out) + raw[at:].decode()

    rng = random.Random(6)
    rows = []
    for i in range(200):
        body = "".join(rng.choice("aé👍 語b") for _ in range(rng.randint(0, 12)))
        rows.append((i, body, [(rng.randint(-1, 20), rng.randint(-1, 30), rng.choice(["u:1", "u:2", "", None])) for _ in range(rng.randint(0, 6))]))
    rows.append((1000, "é link!", [(3, 7, "http://a"), (5, 8, "http://b")]))
    df = spark.createDataFrame(rows, "i long, t string, f array<struct<start:int,end:int,uri:string>>")
    got = {r["i"]: r["x"] for r in df.select("i", text.expand_links(F.col("t"), F.col("f")).alias("x")).collect()}
    for i, body, facets in rows:
        assert got[i] == plainly(body, facets)
    none = spark.createDataFrame([("x", None), (None, [(0, 1, "u")])], "t string, f array<struct<start:int,end:int,uri:string>>")
    assert [r[0] for r in none.select(text.expand_links(F.col("t"), F.col("f"))).collect()] == ["x", None]


def test_percentiles(spark):
    """Exact whatever a group's size, ties and spread are; nulls don't count."""
    import numpy as np

    from heddle.operators import logs

    rng = np.random.default_rng(4)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 700, "ties": rng.integers(0, 9, 3000).astype(float), "wide": rng.normal(0, 1, 5000) ** 5, "spike": np.concatenate([[7.0] * 4000, rng.normal(0, 1, 90)])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r["g"]: r for r in logs.linear_percentiles(df, ["g"], "v", qs).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        for name, q in qs.items():
            assert abs(got[g][name] - np.quantile(x, q)) < 2e-6
    for q in (0.0, 0.3, 0.9, 1.0):
        for rule, at in (("near", lambda n, q: round(q * (n - 1))), ("floor", lambda n, q: min(n - 1, int(n * q)))):
            found = {r["g"]: r["percentile"] for r in logs.indexed_percentile(df, ["g"], "v", q, rule).collect()}
            assert found == {g: sorted(x)[at(len(x), q)] for g, x in groups.items()}


def test_cancelled_by_call():
    """A call's booking goes with the call; one that is unknown or gone cancels nothing; the state survives a dump."""
    m = folds.RollingQuota(1, 100)
    assert m.step(0, "call", None, 1) == (0, "sent") and m.step(1, "call", None, 2) == (100, "sent")
    assert m.step(2, "cancel", 9, 3) == (None, "unknown")
    again = folds.RollingQuota(1, 100)
    again.load(m.dump())
    assert again.step(2, "cancel", 2, 3) == (None, "cancelled") and again.step(3, "cancel", 2, 4) == (None, "unknown")
    assert again.step(4, "call", None, 5) == (100, "sent") and again.step(500, "call", None, 6) == (500, "sent")
    assert again.step(501, "cancel", 5, 7) == (None, "unknown")
