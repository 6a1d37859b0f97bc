"""HTML and Markdown in expressions: entities, links, texts of comments and forum posts, fences, headings, excerpts, and TOON tables.

A text is cut at what a pattern finds, and put together again from the pieces between and what each find becomes. So everything is
linear in the text and nothing is read twice.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import link_of

#: Entities that texts nearly always have, looked up before the whole list.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;")
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
#: Letters of the longest name that counts without a semicolon.
_LONGEST_BARE = max(len(n) for n in html5 if not n.endswith(";"))
#: What the C1 control numbers stand for: the characters of Windows-1252.
_C1 = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}


def _map(pairs: dict) -> Column:
    """A map literal, written as one text so that plans stay small."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())), F.lit("\x1e"), F.lit("\x1f"))


#: Names that count without a semicolon.
_BARE = "\x1e".join(n for n in html5 if not n.endswith(";"))


def replaced(text: Column, pattern: str, then: Callable[[Column], Column], between: Callable[[Column], Column] = lambda p: p) -> Column:
    """The text with then(found) for everything that the pattern finds, and between(piece) for what lies between."""
    found = lambda t: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), then)
    return let(text, lambda t: F.array_join(F.zip_with(F.split(t, pattern, -1), found(t), lambda p, x: F.concat(between(p), F.coalesce(x, F.lit("")))), ""))


def _character(code: Column) -> Column:
    """The character of a number: U+FFFD where there is none."""
    bad = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(bad, "�").when(code.between(0x80, 0x9F), F.try_element_at(_map(_C1), code.cast("string"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _entity(t: Column) -> Column:
    number = F.when(F.rlike(t, F.lit("^&#[xX]")), F.conv(F.regexp_extract(t, "^&#[xX]0*([0-9a-fA-F]{1,8})", 1), 16, 10)).otherwise(F.regexp_extract(t, "^&#0*([0-9]{1,10})", 1))
    long = F.length(F.regexp_extract(t, "^&#[xX]?0*([0-9a-fA-F]*)", 1)) > 8
    name = F.substr(t, F.lit(2))
    names = _map(html5)

    def cut(n: Column) -> Column:
        # the longest beginning that is a name by itself, and the rest as it is
        known = F.filter(F.transform(F.sequence(F.least(F.length(n) - 1, F.lit(_LONGEST_BARE)), F.lit(2), F.lit(-1)), lambda k: F.substr(n, F.lit(1), k)), lambda b: F.array_contains(F.split(F.lit(_BARE), "\x1e"), b))
        first = F.get(known, F.lit(0))
        return F.when(F.length(n) < 3, t).otherwise(F.coalesce(F.concat(F.try_element_at(names, first), F.substr(n, F.length(first) + 1)), t))

    common = F.try_element_at(_map({n: html5[n] for n in _COMMON}), name)
    named = F.coalesce(common, F.try_element_at(names, name), let(name, cut))
    return F.when(F.startswith(t, F.lit("&#")), F.when(long, "�").otherwise(_character(F.coalesce(F.nullif(number, F.lit("")), F.lit("0")).cast("long")))).otherwise(named)


def unescape(text: Column) -> Column:
    """Entities as their characters, each once: names with a semicolon, the old ones without, and numbers."""
    return replaced(text, _ENTITY, _entity)


def escape(text: Column) -> Column:
    """What unescape() turns back."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


class Reader(NamedTuple):
    """How a text's entities are read, signs held back from a second reading, and blanks at its ends cut."""

    read: Callable[[Column], Column]
    hold: Callable[[Column], Column]
    ends: Callable[[Column], Column]
    #: Of an anchor's target.
    target: Callable[[Column], Column]


#: All entities and all of Unicode's white space, as the service has them.
WHOLE = Reader(unescape, escape, trimmed, trimmed)

_LISTED = {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">"}


def _listed(text: Column) -> Column:
    # ampersands wait as a control character until the others are read
    text = F.replace(F.replace(text, F.lit("&amp;"), F.lit("\x01")), F.lit("&amp"), F.lit("\x01"))
    for name, sign in _LISTED.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return F.replace(text, F.lit("\x01"), F.lit("&"))


def _listed_back(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


#: The entities of the driver's pages alone, as the queries' SQL reads them: others stay, and without a semicolon all but &amp. Targets keep their blanks.
LISTED = Reader(_listed, _listed_back, lambda t: F.regexp_replace(t, r"^[ \t\n\f\r\xA0]+|[ \t\n\f\r\xA0]+\z", ""), lambda t: t)

#: White space in HTML's tags; Java's \s has the vertical tab too.
_S = r"[ \t\n\f\r]"
#: Anchors with their targets in double quotes, as comments and as forum posts have them (fixed values).
COMMENT_ANCHOR = rf'(?isu)<a{_S}[^>]*?(?<!\w)href{_S}*={_S}*"([^"]*)"[^>]*>(.*?)</a{_S}*>'
FORUM_ANCHOR = rf'(?isu)<a{_S}(?:[^>]*?{_S})?href{_S}*={_S}*"([^"]*)"[^>]*>(.*?)</a{_S}*>'


def comment_text(html: Column, by: Reader = WHOLE) -> Column:
    """a comment's HTML as text: anchors as their targets or as Markdown links, code in fences, paragraphs apart."""

    def anchor(a: Column) -> Column:
        inner = F.regexp_extract(a, COMMENT_ANCHOR, 2)

        def told(href: Column) -> Column:
            said = by.ends(by.read(F.regexp_replace(inner, "<[^>]+>", "")))
            bare = let(said, lambda s: (s == "") | F.startswith(href, s) | F.endswith(s, F.lit("...")) | F.endswith(s, F.lit("…")))
            return F.when(href == "", inner).when(bare, by.hold(href)).otherwise(F.concat(F.lit("["), inner, F.lit("]("), by.hold(href), F.lit(")")))

        return let(by.read(F.regexp_extract(a, COMMENT_ANCHOR, 1)), told)

    t = replaced(html, COMMENT_ANCHOR, anchor)
    for tag in ("<pre><code>", "</code></pre>", "<pre>", "</pre>"):
        t = F.replace(t, F.lit(tag), F.lit("\n```\n"))
    t = F.replace(F.replace(t, F.lit("<p>"), F.lit("\n\n")), F.lit("</p>"), F.lit(""))
    return by.ends(F.regexp_replace(by.read(F.regexp_replace(t, "<[^>]+>", "")), r"\n{3,}", "\n\n"))


def forum_text(html: Column, by: Reader = WHOLE) -> Column:
    """a forum post's HTML as text: scripts out, absolute links kept, ends of blocks as line breaks."""

    def anchor(a: Column) -> Column:
        inner = F.regexp_extract(a, FORUM_ANCHOR, 2)
        label = by.ends(by.read(F.regexp_replace(inner, "(?s)<[^>]*>", "")))
        told = lambda href: F.when(F.rlike(href, F.lit("^(?iu:https?://)")), by.hold(let(label, lambda t: link_of(t, href)))).otherwise(inner)
        return let(by.target(by.read(F.regexp_extract(a, FORUM_ANCHOR, 1))), told)

    t = F.regexp_replace(html, rf"(?isu)<(script|style)(?!\w)[^>]*>.*?</(script|style){_S}*>", "")
    t = F.regexp_replace(replaced(t, FORUM_ANCHOR, anchor), rf"(?i)<br{_S}*/?>", "\n")
    t = F.regexp_replace(t, rf"(?iu)</(p|div|li|ul|ol|h[1-6]|blockquote|pre|tr|table){_S}*>", "\n\n")
    return by.ends(F.regexp_replace(by.read(F.regexp_replace(t, "(?s)<[^>]*>", "")), r"\n{3,}", "\n\n"))


#: A fenced block, to its closing line or the end.
_FENCED = r"(?ms)^ {0,3}(?:(`{3,})[^\n]*(?:\n(?:.*?^ {0,3}\1`*[ \t\r]*(?:\n|\z)|.*\z)|\z)|(~{3,})[^\n]*(?:\n(?:.*?^ {0,3}\2~*[ \t\r]*(?:\n|\z)|.*\z)|\z))"


def outside_fences(text: Column, then: Callable[[Column], Column]) -> Column:
    """then() of every stretch that isn't a fenced block; blocks stay as they are."""
    return replaced(text, _FENCED, lambda f: f, then)


def demote_headings(text: Column, by: int) -> Column:
    """Headings outside fences down by some levels, six at most (F8)."""

    def down(piece: Column) -> Column:
        # from the deepest level, so that none is moved twice
        for level in range(6, 0, -1):
            piece = F.regexp_replace(piece, rf"(?m)^#{{{level}}}(?=\s)", "#" * min(level + by, 6))
        return piece

    return outside_fences(text, down)


def excerpt(text: Column, most: int) -> Column:
    """Struct (text, cut): the first `most` bytes, ended at a line if one ends in their second half, an open fence closed (F8)."""
    whole = trimmed(F.replace(text, F.lit("\r\n"), F.lit("\n")))

    def shortened(md: Column) -> Column:
        raw = F.encode(md, "UTF-8")
        begins = lambda at: F.hex(F.substring(raw, at + 1, 1)).rlike("^[0-7C-F]")
        end = F.when(begins(most), F.lit(most))
        for back in (1, 2, 3):
            end = end.when(begins(most - back), F.lit(most - back))
        head = F.substr(raw, F.lit(1), end).cast("string")
        last = lambda h: F.octet_length(h) - F.octet_length(F.substring_index(h, "\n", -1)) - 1
        at_line = let(head, lambda h: F.when(last(h) > most // 2, F.substr(F.encode(h, "UTF-8"), F.lit(1), last(h)).cast("string")).otherwise(h))

        def closed(h: Column) -> Column:
            def step(open_: Column, line: Column) -> Column:
                mark = F.regexp_extract(line, "^ {0,3}(```+|~~~+)", 1)
                return let(mark, lambda m: F.when(m == "", open_).when(open_ == "", m).when(F.substring(m, 1, 1) == F.substring(open_, 1, 1), F.lit("")).otherwise(open_))

            still = F.aggregate(F.split(h, "\n"), F.lit(""), step)
            return let(still, lambda o: F.when(o == "", h).otherwise(F.concat(h, F.lit("\n"), o)))

        return let(trimmed(at_line), closed)

    def told(md: Column) -> Column:
        cut = F.octet_length(md) > most
        return F.struct(F.when(cut, shortened(md)).otherwise(md).alias("text"), cut.alias("cut"))

    return let(whole, told)


def fenced(text: Column, language: Column) -> Column:
    """The text in a fence that is longer than any run of backticks in it (F8)."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return let(mark, lambda m: F.concat(m, language, F.lit("\n"), F.regexp_replace(text, r"\n+$", ""), F.lit("\n"), m))


#: Languages of code by the file's extension, where that isn't their usual name, and by the whole name (fixed values).
LANGUAGES = {
    "py": "python", "rb": "ruby", "rs": "rust", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "sh": "bash", "bash": "bash", "zsh": "bash", "yml": "yaml", "tf": "hcl", "tfvars": "hcl", "h": "c", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "md": "markdown",
    "ps1": "powershell", "pl": "perl", "ex": "elixir", "exs": "elixir", "hs": "haskell", "jl": "julia", "m": "objectivec", "fs": "fsharp", "ml": "ocaml", "vue": "vue", "svelte": "svelte",
}
LANGUAGES_BY_NAME = {
    "dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile", "jenkinsfile": "groovy", "vagrantfile": "ruby", "gemfile": "ruby", "rakefile": "ruby", "justfile": "just", "go.mod": "go", "go.sum": "text",
}


def extension(name: Column) -> Column:
    """What is behind the last dot of a path's last part, in lower case; '' without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def code_language(name: Column) -> Column:
    """The language of a file by its name; its extension where none is known (F8)."""
    base = F.lower(F.substring_index(name, "/", -1))
    docker = F.startswith(base, F.lit("dockerfile.")) | F.endswith(base, F.lit(".dockerfile"))
    return F.coalesce(F.try_element_at(_map(LANGUAGES_BY_NAME), base), F.when(docker, "dockerfile"), F.try_element_at(_map(LANGUAGES), extension(base)), extension(base))


def toon_text(value: Column, comma: bool = True) -> Column:
    """A text as a value of a TOON row (comma: where commas part values): as it is where that can't be misread, else in quotes."""
    odd = r'(?U)^\s|\s$|[:"\\\[\]{}\n\r\t' + ("|,]" if comma else "]")
    plain = (value != "") & ~F.rlike(value, F.lit(odd)) & ~value.isin("true", "false", "null") & ~F.rlike(value, F.lit(r"^-|^\d+(\.\d+)?([eE][+-]?\d+)?$"))
    quoted = F.to_json(F.struct(value.alias("x")))
    return F.when(value.isNull(), "null").when(plain, value).otherwise(F.substr(quoted, F.lit(6), F.length(quoted) - 6))


def toon_table(name: str, fields: dict[str, Callable[[Column], Column]], rows: Column) -> Column:
    """`name[n]{fields}:` and a line for each row of an array; `name: []` for none (F20). fields: how each is read from a row, as text."""
    line = lambda r: F.concat(F.lit("  "), F.concat_ws(",", *[F.coalesce(read(r), F.lit("null")) for read in fields.values()]))
    head = F.concat(F.lit(f"{name}["), F.size(rows).cast("string"), F.lit("]{" + ",".join(fields) + "}:\n"))
    return F.when(F.size(rows) == 0, F.lit(f"{name}: []")).otherwise(F.concat(head, F.array_join(F.transform(rows, line), "\n")))


#: Where a repository's files and its images are read (fixed values).
FILES_AT, IMAGES_AT = "https://github.com", "https://raw.githubusercontent.com"
_IMAGE = r"(?i)\.(png|jpe?g|gif|svg|webp|avif|bmp|ico)$"
_HTML_ANCHOR = r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
_HTML_HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>"
_LINKED_BADGE = r"(?i)\[!\[[^\]]*\]\([^)]*(?:badge|shield|badgen)[^)]*\)\]\([^)]*\)"
_IMAGES_ALONE = r"^\s*((\[\s*)?!\[[^\]]*\]\([^)]*\)(\s*\]\([^)]*\))?\s*)+$"
_INLINE_LINK = r"\]\(\s*(<[^>]*>|[^()\s]+)"
_REFERENCE = r"(?m)^( {0,3}\[[^\]^][^\]]*\]:\s*)(<[^>]*>|\S+)"
_ATTRIBUTE = r'(?i)\b(href|src)\s*=\s*"([^"]*)"'


def resolved(target: Column, repo: Column, ref: Column, folder: Column) -> Column:
    """A link of a repository's file as an absolute URL; absolute ones and those within the page stay."""
    bare = F.regexp_replace(F.regexp_replace(target, "^<", ""), ">$", "")

    def absolute(d: Column) -> Column:
        cut = F.regexp_extract(d, r"^[^?#]*", 0)
        parts = F.split(F.when(F.startswith(cut, F.lit("/")), cut).otherwise(F.concat_ws("/", folder, cut)), "/")
        none = F.array().cast("array<string>")
        clean = F.aggregate(parts, none, lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
        where = F.array_join(clean, "/")
        site = F.when(F.rlike(where, F.lit(_IMAGE)), F.concat(F.lit(f"{IMAGES_AT}/"), repo, F.lit("/"))).otherwise(F.concat(F.lit(f"{FILES_AT}/"), repo, F.lit("/blob/")))
        there = F.concat(site, ref, F.lit("/"), where, F.substr(d, F.length(cut) + 1))
        return F.when((d == "") | F.rlike(d, F.lit(r"^(#|//|[A-Za-z][A-Za-z0-9+.-]*:)")), target).otherwise(there)

    return let(bare, absolute)


def clean_markdown(text: Column, repo: Column, ref: Column, folder: Column) -> Column:
    """A repository's Markdown without comments, images of HTML and badge rows, layout tags reduced to their text, links absolute. Fenced blocks stay as they are."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    at = lambda c: resolved(c, repo, ref, folder)

    def anchor(a: Column) -> Column:
        return let(flat(F.regexp_extract(a, _HTML_ANCHOR, 2)), lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("["), t, F.lit("]("), F.regexp_extract(a, _HTML_ANCHOR, 1), F.lit(")"))))

    def heading(h: Column) -> Column:
        marks = F.repeat(F.lit("#"), F.regexp_extract(h, _HTML_HEADING, 1).cast("int"))
        return let(flat(F.regexp_extract(h, _HTML_HEADING, 2)), lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("\n"), marks, F.lit(" "), t, F.lit("\n"))))

    def row_of_badges(line: Column) -> Column:
        low = F.lower(line)
        return F.rlike(line, F.lit(_IMAGES_ALONE)) & (F.contains(line, F.lit("[![")) | F.contains(low, F.lit("shields.io")) | F.contains(low, F.lit("badge")))

    def clean(piece: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(piece, r"(?s)<!--.*?-->", ""), r"(?is)<img\b[^>]*>", "")
        t = replaced(replaced(t, _HTML_ANCHOR, anchor), _HTML_HEADING, heading)
        t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"(?i)</?(p|div|center|picture|details|summary)\b[^>]*>", "\n")
        t = F.regexp_replace(F.regexp_replace(t, r"(?i)</?(span|source|sup|sub|b|strong|em|i|kbd|font)\b[^>]*>", ""), _LINKED_BADGE, "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: ~row_of_badges(x))
        t = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"[ \t]+$", "")), "\n")
        t = replaced(t, _INLINE_LINK, lambda m: F.concat(F.regexp_extract(m, r"^\]\(\s*", 0), at(F.regexp_extract(m, _INLINE_LINK, 1))))
        t = replaced(t, _REFERENCE, lambda m: F.concat(F.regexp_extract(m, _REFERENCE, 1), at(F.regexp_extract(m, _REFERENCE, 2))))
        return replaced(t, _ATTRIBUTE, lambda m: F.concat(F.regexp_extract(m, _ATTRIBUTE, 1), F.lit('="'), at(F.regexp_extract(m, _ATTRIBUTE, 2)), F.lit('"')))

    whole = outside_fences(F.replace(text, F.lit("\r\n"), F.lit("\n")), clean)
    return trimmed(F.regexp_replace(whole, r"\n{3,}", "\n\n"))
