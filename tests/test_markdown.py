"""Entities, texts of HTML, fences, headings, excerpts, TOON: against the standard library and plain versions."""

import html
import json
import random
import re

from pyspark.sql import functions as F

from heddle.functions import markdown


def column_of(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_entities(spark):
    texts = [
        "&amp;&lt;&gt;&quot;&#39;&apos;&nbsp;", "&ampx &amp &am &copy2 &notit; &notin; &not &nope; &", "&#65;&#x41;&#X1F600;&#128512;&#0;&#xD800;&#x110000;&#99999999999;", "&#150;&#x80;&#129;", "&amp;lt;", "&fjlig;&NotEqualTilde;&CounterClockwiseContourIntegral;", "plain", "", None, "&#;&#x;&;", "&AMP&LT", "a&frac12b&sup2;",
        "&" * 5, "&para;&paragraph;&centerdot;&cent;&centx;", "&#9;&#10;&#x27",
    ]
    rng = random.Random(4)
    names = sorted(html.entities.html5)
    texts += ["".join("&" + rng.choice(names) + rng.choice(["", " ", "z", ";"]) for _ in range(8)) for _ in range(60)]
    # the library leaves control numbers out, browsers keep them
    want = [t if t is None else html.unescape(t).replace("\x81", "\x81") for t in texts]
    assert column_of(spark, markdown.unescape, texts) == want
    assert column_of(spark, lambda c: markdown.unescape(markdown.escape(c)), texts) == texts


def test_comment_texts(spark):
    cases = {
        'see <a href="https:&#x2F;&#x2F;a.b&#x2F;c?x=1&amp;y=2" rel="nofollow">https:&#x2F;&#x2F;a.b&#x2F;c...</a> end': "see https://a.b/c?x=1&y=2 end", '<a href="https://a.b">the <i>site</i></a>': "[the site](https://a.b)", '<a href="https://a.b/">https://a.b</a>': "https://a.b/", '<a href="">x</a>': "x",
        "one<p>two<p>three</p>": "one\n\ntwo\n\nthree", "<pre><code>if a &lt; b:\n  c</code></pre>": "```\nif a < b:\n  c\n```", "a\n\n\n\nb &amp;amp;": "a\n\nb &amp;", "<i>x</i> < y > z": "x  z", "": "", '<a href="http://x/?a=%3Cb%3E&lt;i&gt;">t</a>': "[t](http://x/?a=%3Cb%3E<i>)",
    }
    assert column_of(spark, markdown.comment_text, cases) == list(cases.values())


def test_forum_texts(spark):
    cases = {
        '<p>hi <a class="mention" href="/u/x">@x</a></p><p>see <a href="https://www.a.b/long/path">a.b/long…</a></p>': "hi @x\n\nsee https://www.a.b/long/path", '<a data-href="no" href=" HTTPS://a.b ">Read &amp; go</a>': "[Read & go](HTTPS://a.b)", "<script>x</script><style a>y</style >t<br>u<BR/>v": "t\nu\nv",
        "<ul><li>a</li><li>b</li></ul>": "a\n\nb", "&amp;lt;b&gt;": "&lt;b>", '<a href="https://a.b/?x=1&amp;y">a <b>b</b></a>': "[a b](https://a.b/?x=1&y)",
    }
    assert column_of(spark, markdown.forum_text, cases) == list(cases.values())


def plain_pieces(md):
    """(is a fenced block, text) of the stretches of a text, line by line."""
    out, fence = [], ""
    for line in re.findall(r"[^\n]*\n|[^\n]+$", md):
        m = re.match(r" {0,3}(```+|~~~+)", line)
        if not fence and m:
            fence = m[1]
            out.append([True, line])
            continue
        if fence:
            out[-1][1] += line
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().lstrip(m[1][0]).strip():
                fence = ""
                out.append([False, ""])
            continue
        if not out or out[-1][0]:
            out.append([False, ""])
        out[-1][1] += line
    return out


def test_headings(spark):
    rng = random.Random(7)
    lines = ["# a", "## b", "###### six", "####### seven", "#no", "text # x", "```", "````", "~~~", "``` py", "   ```", "    ```", "~~~~ ", "", "# c `` d", "```x"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for _ in range(150)] + ["", "# only"]
    for by in (1, 3, 5):
        want = ["".join(t if f else re.sub(r"(?m)^(#{1,6})(?=\s)", lambda m: "#" * min(6, len(m[1]) + by), t) for f, t in plain_pieces(x)) for x in texts]  # noqa: B023
        assert column_of(spark, lambda c: markdown.demote_headings(c, by), texts) == want  # noqa: B023


def plain_excerpt(md, most):
    raw = md.replace("\r\n", "\n").strip().encode()
    if len(raw) <= most:
        return raw.decode(), False
    at = most
    while raw[at] & 0xC0 == 0x80:
        at -= 1
    head = raw[:at]
    if head.rfind(b"\n") > most // 2:
        head = head[: head.rfind(b"\n")]
    text, open_ = head.decode().strip(), ""
    for line in text.split("\n"):
        m = re.match(r" {0,3}(```+|~~~+)", line)
        if m:
            open_ = m[1] if not open_ else "" if m[1][0] == open_[0] else open_
    return text + ("\n" + open_ if open_ else ""), True


def test_excerpts(spark):
    rng = random.Random(3)
    texts = ["short", "", "é👍" * 40, "x" * 60, "x" * 59 + "\n" + "y" * 9, "\r\n".join(["line"] * 30)] + ["\n".join(rng.choice(["```py", "```", "~~~~", "é words here", "👍", "x" * 30]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    got = column_of(spark, lambda c: markdown.excerpt(c, 60), texts)
    assert [(g["text"], g["cut"]) for g in got] == [plain_excerpt(t, 60) for t in texts]


def test_fences_and_languages(spark):
    texts = ["a", "``` x\n", "a `````` b\n\n", "", "`"]
    want = []
    for t in texts:
        mark = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", t)), default=0))
        want.append(f"{mark}go\n{t.rstrip(chr(10))}\n{mark}")
    assert column_of(spark, lambda c: markdown.fenced(c, F.lit("go")), texts) == want
    names = {"a/b.PY": "python", "Dockerfile": "dockerfile", "x/dockerfile.dev": "dockerfile", "app.dockerfile": "dockerfile", "go.mod": "go", "LICENSE": "", "a.b/c": "", "x.zig": "zig", ".bashrc": "bashrc", "Makefile": "makefile"}
    assert column_of(spark, markdown.code_language, names) == list(names.values())


def test_toon_tables(spark):
    values = ["plain", "a,b", "", " x", "x ", "true", "null", "12", "1e5", "-1", "- a", "a:b", 'q"q', "back\\slash", "two\nlines", "é👍", "[x]", "a|b", "1.2.3", "tab\t", None, "\u00a0x"]
    bare = [v is not None and bool(v) and v == v.strip() and not re.search(r'[:"\\\[\]{}\n\r\t|,]', v) and v not in ("true", "false", "null") and not re.match(r"-", v) and not re.fullmatch(r"\d+(\.\d+)?([eE][+-]?\d+)?", v) for v in values]
    assert column_of(spark, markdown.toon_text, values) == [v if b else "null" if v is None else json.dumps(v, ensure_ascii=False) for v, b in zip(values, bare, strict=True)]
    rows = spark.sql("SELECT array(named_struct('x', 1, 'y', 'a,b'), named_struct('x', 2, 'y', null)) AS r UNION ALL SELECT array()")
    fields = {"x": lambda r: r["x"].cast("string"), "y": lambda r: markdown.toon_text(r["y"])}
    assert [r[0] for r in rows.select(markdown.toon_table("rows", fields, F.col("r"))).collect()] == ['rows[2]{x,y}:\n  1,"a,b"\n  2,null', "rows: []"]


def test_readmes(spark):
    """Links of all kinds, badge rows, layout tags; nothing within fences."""
    cases = {
        "[a](b.md) [c](/d/../e.md?x#y) ![i](../up.PNG) [j](<sp ace.md>)": "[a](https://github.com/o/r/blob/v1/docs/b.md) [c](https://github.com/o/r/blob/v1/e.md?x#y) ![i](https://raw.githubusercontent.com/o/r/v1/up.PNG) [j](https://github.com/o/r/blob/v1/docs/sp ace.md)",
        "[a](#x) [b](//h/p) [c](mailto:x@y) [d](https://h)": "[a](#x) [b](//h/p) [c](mailto:x@y) [d](https://h)",
        "[x]: y.md\n[^1]: z.md\ntext [x]: y.md": "[x]: https://github.com/o/r/blob/v1/docs/y.md\n[^1]: z.md\ntext [x]: y.md",
        "![a](https://h/a.png)\n[![a](b.svg)](c)\n![x](https://img.shields.io/x) ![y](z)\ntext ![b](c.gif)": "![a](https://h/a.png)\n\ntext ![b](https://raw.githubusercontent.com/o/r/v1/docs/c.gif)".replace("\n\n", "\n"),
        "see [![build](https://x/badge.svg)](https://ci) here": "see  here",
        '<h2 align="center">A <b>b</b></h2>x<br>y<p>z</p><kbd>k</kbd><a href="q.md"> the\n link </a><a href="r"></a><!-- c\nd --><img src="x">': "## A b\nx\ny\nz\nk[the link](https://github.com/o/r/blob/v1/docs/q.md)",
        "```\n[a](b)  \n<b>\n```\n[a](../../../b)": "```\n[a](b)  \n<b>\n```\n[a](https://github.com/o/r/blob/v1/b)",
        "a\r\n\r\n\r\n\r\nb  \t\n": "a\n\nb", "": "",
    }
    got = column_of(spark, lambda c: markdown.clean_markdown(c, F.lit("o/r"), F.lit("v1"), F.lit("docs")), cases)
    assert got == list(cases.values())
