"""Social posts with all that hangs on them, as Markdown (F12): parents, attachments, quotes, polls, cards, articles, self-threads and replies.

A post is a struct: id, handle, name, created, text, likes, reposts, replies, views, media (array of kind, alt, seconds), poll (choices: array of
label, votes, percent; total; status), card (title, url), note, unavailable; whatever there isn't is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import clock

MEDIA = "array<struct<kind: string, alt: string, seconds: double>>"
POLL = "struct<choices: array<struct<label: string, votes: bigint, percent: double>>, total: bigint, status: string>"
CARD = "struct<title: string, url: string>"
#: A post's columns; quoting is what a quoted post quotes itself.
POST = f"id string, handle string, name string, created string, text string, likes bigint, reposts bigint, replies bigint, views bigint, media {MEDIA}, poll {POLL}, card {CARD}, note string, unavailable string, quoting struct<handle: string, id: string>"


def post(**columns: Column) -> Column:
    """A post from some of its columns; the others are null."""
    kinds = _fields(POST)
    return F.struct(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def _fields(schema: str) -> dict[str, str]:
    from pyspark.sql.types import StructType

    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema).fields}


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def author(p: Column) -> Column:
    """@handle, with the name where it says more."""
    return F.when(_given(p["name"]) & (p["name"] != p["handle"]), F.concat(F.lit("@"), p["handle"], F.lit(" ("), p["name"], F.lit(")"))).otherwise(F.concat(F.lit("@"), p["handle"]))


def post_url(handle: Column, id_: Column) -> Column:
    return F.concat(F.lit("https://x.com/"), handle, F.lit("/status/"), id_)


def header(p: Column, counts: bool) -> Column:
    """Who, when, where, and how much it was noticed."""
    parts = [author(p), F.nullif(p["created"], F.lit("")), post_url(p["handle"], p["id"])]
    if counts:
        parts.append(_plural(F.coalesce(p["likes"], F.lit(0)), "like", "likes"))
        parts += [F.when(p[n] > 0, _plural(p[n], one, many)) for n, one, many in (("reposts", "repost", "reposts"), ("replies", "reply", "replies"), ("views", "view", "views"))]
    return F.concat_ws(" · ", *parts)


def media_line(media: Column) -> Column:
    """[image: alt] [video, 1:23] [gif], or ''."""

    def mark(m: Column) -> Column:
        length = F.when((m["kind"] != "image") & (m["seconds"] > 0), F.concat(F.lit(", "), clock(m["seconds"]))).otherwise("")
        return let(_one_line(m["alt"]), lambda alt: F.concat(F.lit("["), m["kind"], length, F.when(alt != "", F.concat(F.lit(": "), alt)).otherwise(""), F.lit("]")))

    return F.coalesce(F.array_join(F.transform(media, mark), " "), F.lit(""))


def poll_block(poll: Column) -> Column:
    info = F.concat_ws(", ", F.when(poll["total"] > 0, _plural(poll["total"], "vote", "votes")), F.nullif(poll["status"], F.lit("")))
    choice = lambda c: F.concat(F.lit("- "), c["label"], F.lit(": "), F.format_string("%.1f", F.bround(c["percent"], 1)), F.lit("% ("), _plural(c["votes"], "vote", "votes"), F.lit(")"))
    return F.concat_ws("\n", F.concat(F.lit("**Poll**"), F.when(info != "", F.concat(F.lit(" ("), info, F.lit(")"))).otherwise(""), F.lit(":")), F.transform(poll["choices"], choice))


def card_line(card: Column) -> Column:
    return F.when(_given(card["title"]), F.concat(F.lit("["), card["title"], F.lit("]("), card["url"], F.lit(")"))).otherwise(card["url"])


def block_quote(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(~F.rlike(x, F.lit(r"\S")), ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def indented(text: Column, by: Column) -> Column:
    """All lines but the first moved in; empty ones stay empty."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.when((i == 0) | (x == ""), x).otherwise(F.concat(by, x))), "\n")


def _attached(p: Column, card: str) -> list[Column]:
    return [F.nullif(p["text"], F.lit("")), F.nullif(media_line(p["media"]), F.lit("")), F.when(p["poll"].isNotNull(), poll_block(p["poll"])), F.when(p["card"].isNotNull(), F.concat(F.lit(card), card_line(p["card"])))]


def quote_block(p: Column) -> Column:
    """A quoted or a parent post."""
    text, media, poll, card = _attached(p, "Link: ")
    quoting = F.when(p["quoting"].isNotNull(), F.concat(F.lit("(quoting "), post_url(p["quoting"]["handle"], p["quoting"]["id"]), F.lit(")")))
    gone = F.concat(F.lit("> ["), p["unavailable"], F.lit("]"))
    return F.when(_given(p["unavailable"]), gone).otherwise(block_quote(F.concat_ws("\n\n", header(p, False), text, media, poll, card, quoting)))


def post_body(p: Column, quote: Column, quote_gone: Column) -> Column:
    """The text and all that is attached to it."""
    text, media, poll, card = _attached(p, "**Link:** ")
    quoted = F.when(quote.isNotNull(), F.concat(F.lit("Quoting:\n\n"), quote_block(quote))).when(_given(quote_gone), F.concat(F.lit("> [quoted post unavailable: "), quote_gone, F.lit("]")))
    note = F.when(_given(p["note"]), F.concat(F.lit("**Community note:** "), p["note"]))
    return F.concat_ws("\n\n", text, media, quoted, poll, note, card)


def thread_item(p: Column, quote: Column) -> Column:
    text, media, _, card = _attached(p, "Link: ")
    whole = F.concat_ws("\n\n", text, media, F.when(quote.isNotNull(), quote_block(quote)), card)
    return F.when(_given(p["unavailable"]), F.concat(F.lit("["), p["unavailable"], F.lit("]"))).otherwise(F.coalesce(F.nullif(whole, F.lit("")), F.lit("(no text)")))


def reply_line(p: Column, by_author: Column, quote: Column) -> Column:
    """@handle [author] (3 likes): text [media] (quoting …), on lines without blank ones."""
    text = F.array_join(F.filter(F.split(F.coalesce(p["text"], F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"\S"))), "\n")
    said = _one_line(quote["text"])
    short = F.when(F.length(said) > 200, F.concat(F.substring(said, 1, 200), F.lit("…"))).otherwise(said)
    media = media_line(p["media"])
    return F.concat(
        F.lit("@"), p["handle"], F.when(by_author, " [author]").otherwise(""), F.lit(" ("), _plural(F.coalesce(p["likes"], F.lit(0)), "like", "likes"), F.lit("): "), text, F.when(media != "", F.concat(F.lit(" "), media)).otherwise(""),
        F.when(quote.isNotNull(), F.concat(F.lit(" (quoting "), author(quote), F.lit(": "), short, F.lit(")"))).otherwise(""),
    )


def render_posts(posts: DataFrame, parents: DataFrame, threads: DataFrame, replies: DataFrame) -> DataFrame:
    """id, markdown. posts: id, post, quote (a post), quote_gone, article (struct of title, markdown), cut_by (the source of a text that is cut; null: whole).

    parents, threads, replies: id (of the post), pos, post; threads and replies besides quote, replies by_author too. A thread names the
    post itself in its place. A reply that is in the thread is left out by the caller (J9).
    """
    p = F.col("post")

    def gathered(rows: DataFrame, line: Column, name: str, between: str) -> DataFrame:
        each = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
        return rows.groupBy("id").agg(F.array_join(each, between).alias(name), F.count("*").alias(f"n_{name}"))

    above = gathered(parents, F.concat(F.lit("\n"), quote_block(p), F.lit("\n")), "above", "")
    from pyspark.sql import Window

    own = posts.select("id", F.col("post.id").alias("own"))
    placed = threads.join(own, "id").withColumn("place", F.concat(F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("string"), F.lit(". ")))
    item = F.when(p["id"] == F.col("own"), F.lit("(the linked post, above)")).otherwise(indented(thread_item(p, F.col("quote")), F.repeat(F.lit(" "), F.length("place"))))
    chain = gathered(placed, F.concat(F.lit("\n"), "place", item, F.lit("\n")), "chain", "")
    under = gathered(replies, F.concat(F.lit("- "), indented(reply_line(p, F.col("by_author"), F.col("quote")), F.lit("  ")), F.lit("\n")), "under", "")
    rows = posts
    for part in (above, chain, under):
        rows = rows.join(part, "id", "left")
    c = F.col
    some = lambda condition, *parts: F.when(condition, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    body = post_body(p, c("quote"), c("quote_gone"))
    whole = F.concat(
        header(p, True), F.lit("\n"), some(_given(c("cut_by")), "\n**Text truncated:** only the first ~275 characters of this post were available (", c("cut_by"), " fallback).\n"),
        some(c("n_above") > 0, "\n**In reply to:**\n", c("above")), let(body, lambda b: some(b != "", "\n", b, "\n")), some(c("article").isNotNull(), "\n## Article: ", c("article.title"), "\n\n", c("article.markdown"), "\n"),
        some(c("n_chain") > 0, "\n## Thread by @", p["handle"], " (", c("n_chain").cast("string"), " posts)\n", c("chain")),
        some(c("n_under") > 0, "\n## Replies (", c("n_under").cast("string"), " of ", F.greatest(F.coalesce(p["replies"], F.lit(0)), c("n_under")).cast("string"), ")\n\n", c("under")),
    )
    return rows.select("id", F.concat(F.regexp_replace(whole, r"(?U)^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))
