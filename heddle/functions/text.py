"""Text columns: windows, clean-up, prose length and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .phrases import share_held

#: Who says that a text is cut; part of the marker's width.
LABEL = "heddle"


def cut_marker(next_char: Column, total: Column) -> Column:
    return F.format_string(f"\n\n[{LABEL}: content truncated at %d of %d characters. Call fetch_url again with start_char=%d to continue.]", next_char, total, next_char)


def window_of(text: Column, most: int, start: Column) -> Column:
    """Struct (text, total, next): characters from `start`, cut to `most` with the marker inside (F1).

    most <= 0: no cut. Where the marker doesn't fit, the window overshoots; a start past the
    end gives a message.
    """
    total = F.length(text)
    at = F.greatest(start, F.lit(0)).cast("int")
    rest = total - at
    keep = F.lit(most) - F.length(cut_marker(at + most, total))
    keep = F.when(keep < 1, F.lit(most)).otherwise(keep)
    beyond = (at > 0) & (at >= total)
    cut = (F.lit(most) > 0) & (rest > most)
    said = F.format_string(f"[{LABEL}: no content at offset %d — total %d characters]", at, total)
    out = F.when(beyond, said).when(cut, F.concat(F.substr(text, at + 1, keep), cut_marker(at + keep, total))).otherwise(F.substr(text, at + 1))
    return F.struct(out.alias("text"), total.alias("total"), F.when(~beyond & cut, at + keep).otherwise(total).alias("next"))


def clean_body(text: Column) -> Column:
    """Blanks to one, line breaks to one or two, trimmed."""
    t = F.regexp_replace(text, r"[ \t\f\r]+", " ")
    t = F.regexp_replace(t, r" *\n(?: *\n)+ *", "\n\n")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def prose(text: Column) -> Column:
    """Without link targets, bare URLs, marks and zero-width characters, blanks to one."""
    t = F.regexp_replace(text, r"\]\([^)]*\)", "]")
    t = F.regexp_replace(t, r"https?://\S+", "")
    t = F.regexp_replace(t, "[#*_\\[\\]|`>​-‏⁠﻿-]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def prose_chars(text: Column) -> Column:
    return F.length(prose(text))


def strip_tags(html: Column) -> Column:
    """Scripts, styles, comments and tags out, blanks to one (F15 and the plain-GET reader); entities stay."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|svg|head)\b.*?</(script|style|noscript|template|svg|head)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))


def first_lines(text: Column, n: int) -> Column:
    """The first n lines that aren't blank."""
    return F.array_join(F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, n), "\n")


def flat_verdict(text: Column, most: int) -> Column:
    """Control characters and blanks to single blanks, cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), r"\s+", " ")), 1, most)


def human_bytes(n: Column) -> Column:
    """812 B, 4.2 KB, 1.3 MB, halves to even."""
    one = lambda x: F.format_string("%.1f", F.bround(x, 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / 1048576), F.lit(" MB")))


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def link(label: Column, href: Column, shorten: bool = True) -> Column:
    """[label](href), or the bare URL where the label is no more than its beginning, shortened or not.

    The URL's scheme and a www. may be missing from the label. Without a URL the label stays as it is. shorten=False: only a blank
    label gives the bare URL.
    """
    said = F.regexp_replace(label, r"^\s+|\s+$", "")
    return F.when(F.coalesce(href, F.lit("")) == "", label).otherwise(let(said, lambda t: link_of(t, href, shorten)))


def link_of(said: Column, href: Column, shorten: bool = True) -> Column:
    """link() of a trimmed label and a URL that is there."""
    whole = F.concat(F.lit("["), said, F.lit("]("), href, F.lit(")"))
    if not shorten:
        return F.when(said == "", href).otherwise(whole)
    shown = F.regexp_replace(F.regexp_replace(said, r"\.\.\.\z", ""), r"…\z", "")
    bare = F.regexp_replace(href, r"^(?i:https?://)", "")
    same = (shown == "") | F.startswith(href, shown) | F.startswith(bare, shown) | F.startswith(F.regexp_replace(bare, r"^www\.", ""), shown)
    return F.when(same, href).otherwise(whole)


def expand_links(text: Column, facets: Column, shorten: bool = True) -> Column:
    """Links put in at byte ranges of the UTF-8 text (F13), written as link() does. facets: array of struct (start, end, uri).

    Of facets in the order of their starts, one that overlaps a link before it is left out, as are those without URL, empty, out of
    bounds, or with an end inside a character. The text between is copied as it is.
    """

    def spliced(raw: Column) -> Column:
        size = F.octet_length(raw)
        first_byte = lambda at: F.hex(F.substr(raw, at + 1, F.lit(1))).rlike("^[0-7C-F]")
        good = F.filter(facets, lambda f: (F.coalesce(f["uri"], F.lit("")) != "") & (f["start"] >= 0) & (f["end"] <= size) & (f["start"] < f["end"]))
        good = F.filter(good, lambda f: first_byte(f["start"]) & ((f["end"] == size) | first_byte(f["end"])))
        ordered = F.array_sort(F.transform(good, lambda f, i: F.struct(f["start"].cast("int").alias("start"), i.alias("i"), f["end"].cast("int").alias("end"), f["uri"].alias("uri"))))
        part = lambda a, z: F.substr(raw, a + 1, z - a).cast("string")

        def put(acc: Column, f: Column) -> Column:
            piece = F.concat(part(acc["at"], f["start"]), link(part(f["start"], f["end"]), f["uri"], shorten))
            return F.when(f["start"] < acc["at"], acc).otherwise(F.struct(f["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(ordered, none, put, lambda acc: F.concat(F.array_join(acc["out"], ""), part(acc["at"], size)))

    return F.when(F.coalesce(F.size(facets), F.lit(0)) > 0, let(F.encode(text, "UTF-8"), spliced)).otherwise(text)


def clock(seconds: Column) -> Column:
    """h:mm:ss or m:ss, half seconds up."""
    s = F.floor(seconds + 0.5).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def longer(first: Column, second: Column) -> Column:
    """The longer text, the first if equal."""
    return F.when(F.length(second) > F.length(first), second).otherwise(first)


def post_text(text: Column, reply: Column) -> Column:
    """A post's text: trimmed, lines without blanks at their ends, and of a reply the leading @names out, unless it is nothing else."""
    ends = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(ends(text), r"^(?:@[A-Za-z0-9_]{1,15}\s+)+", "")
    only = F.rlike(bare, F.lit(r"^\s*(?:@[A-Za-z0-9_]{1,15}\s*)*$"))
    return F.regexp_replace(ends(F.when(reply & ~only, bare).otherwise(text)), r"(?m)[ \t]+$", "")


def demote_headings(text: Column, by: int) -> Column:
    """Headings down by some levels, six at most (F8); for text without fences."""
    marks = F.array(*[F.lit("#" * i) for i in range(1, 7)])
    lines = F.split(text, "\n")

    def down(line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1))
        return F.when(level > 0, F.concat(F.get(marks, F.least(level + by, F.lit(6)) - 1), F.substr(line, level + 1))).otherwise(line)

    return F.array_join(F.transform(lines, down), "\n")


def excerpt(text: Column, most: int) -> Column:
    """Cut to `most` characters with an ellipsis (F8)."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def _without_targets(text: Column) -> Column:
    return F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")


#: White space as the queries' SQL has it; Java's \s has the vertical tab too.
_S = r"[ \t\n\f\r]"
#: Unicode's blanks, which a sentence loses at its ends.
_BLANKS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def plain(text: Column) -> Column:
    """Lower-case words alone: links without their targets, no marks, one blank for white space (F16)."""
    return F.lower(F.regexp_replace(F.regexp_replace(_without_targets(text), r"[*_`#>|]", ""), rf"{_S}+", " "))


def letters(text: Column) -> Column:
    """Letters and digits alone, of the plain text (F16); its marks and blanks go with all the rest."""
    return F.regexp_replace(F.lower(_without_targets(text)), r"[^a-z0-9]", "")


def sentences(text: Column) -> Column:
    """All sentences of eight words and more of the plain lines (F16)."""
    lines = F.array_join(F.transform(F.split(text, r"\r\n|\n|\r"), plain), "\n")
    parts = F.transform(F.split(lines, rf"(?<=[.!?]){_S}+|\n+"), lambda s: F.trim(s, F.lit(_BLANKS)))
    return F.filter(parts, lambda s: (F.size(F.split(s, rf"{_S}+")) >= 8) & ~F.contains(s, F.lit("://")))


def coverage(reference: Column, text: Column) -> Column:
    """Share of the reference's sentences found in the text; null without any (F16)."""
    asked = F.filter(F.transform(sentences(reference), letters), lambda s: s != "")
    return share_held(letters(text), asked)


def parse_date(text: Column, now: Column) -> Column:
    """RFC 3339 to the minute from absolute layouts or `<n> <unit> ago` (month 30, year 365 days), else '' (U12)."""
    t = F.trim(text)
    days = F.create_map(*[F.lit(x) for kv in (("minute", 60), ("hour", 3600), ("day", 86400), ("week", 604800), ("month", 2592000), ("year", 31536000)) for x in kv])
    n = F.try_to_number(F.nullif(F.regexp_extract(t, r"(?i)^(\d{1,6}) (?:minute|hour|day|week|month|year)s? ago$", 1), F.lit("")), F.lit("999999")).cast("long")
    unit = F.lower(F.regexp_extract(t, r"(?i)^\d{1,6} (minute|hour|day|week|month|year)s? ago$", 1))
    ago = F.timestamp_seconds(F.unix_timestamp(now) - n * F.try_element_at(days, unit))
    whole = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX")], ago)
    return F.coalesce(F.date_format(F.date_trunc("minute", whole), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def epoch_text(seconds: Column) -> Column:
    """RFC 3339 from seconds; '' for none."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def until_midnight(now: Column) -> Column:
    """Seconds to the next UTC midnight."""
    return F.lit(86400) - F.unix_timestamp(now) % 86400


def redact(text: Column) -> Column:
    """URLs, addresses with their ports and looked-up names as [upstream]."""
    t = F.regexp_replace(text, r"https?://[^\s\"'`]+", "[upstream]")
    t = F.regexp_replace(t, r"\blookup [^\s:]+", "lookup [upstream]")
    return F.regexp_replace(t, r"(\d{1,3}(?:\.\d{1,3}){3}|\[[0-9a-fA-F:.]+\])(:\d+)?", "[upstream]")


def scrub(text: Column) -> Column:
    """Absolute URLs as their scheme and host alone."""
    return F.regexp_replace(F.regexp_replace(text, r"(https?)://(?:[^\s\"'<>/?#@]*@)?([^\s\"'<>/?#@]+)[^\s\"'<>]*", "$1://$2"), r"https?://(?=[/?#\s\"'<>]|$)[^\s\"'<>]+", "<url>")


def explained(kind: Column, status: Column, detail: Column) -> Column:
    """A failure for the caller: its kind, the upstream's status, and what happened with the upstream's addresses taken out."""
    label = F.concat(kind, F.when(F.coalesce(status, F.lit(0)) != 0, F.concat(F.lit(" (HTTP "), status.cast("string"), F.lit(")"))).otherwise(""))
    said = F.coalesce(detail, F.lit(""))
    return F.when(said == "", label).when(label == "error", redact(said)).otherwise(F.concat(label, F.lit(": "), redact(said)))
