"""Articles made of blocks, as Markdown (F14). A block's ranges count UTF-16 units, so texts are cut in that encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .markdown import trimmed

#: An article's JSON: blocks with ranges that name entities by key, the entities, and the media that some of them name.
ARTICLE = """blocks array<struct<type: string, text: string, entityRanges: array<struct<offset: int, length: int, key: int>>>>,
entityMap array<struct<key: string, value: struct<type: string, data: struct<url: string, tweetId: string, markdown: string, mediaItems: array<struct<mediaId: string>>>>>>,
mediaEntities array<struct<media_id: string, media_info: struct<__typename: string, alt_text: string>>>"""


def _named(entities: Column, key: Column) -> Column:
    """The value of the last entity with a key; null without one."""
    return F.try_element_at(F.filter(entities, lambda e: e["key"] == key.cast("string")), F.lit(-1))["value"]


def _linked(block: Column, entities: Column) -> Column:
    """The block's text with its links; of ranges that overlap the first counts, and ranges out of bounds are left out."""
    ranges = F.coalesce(block["entityRanges"], F.array().cast("array<struct<offset: int, length: int, key: int>>"))
    with_url = F.transform(ranges, lambda r, i: F.struct(r["offset"].alias("start"), i.alias("i"), (r["offset"] + r["length"]).alias("end"), let(_named(entities, r["key"]), lambda e: F.when(e["type"] == "LINK", e["data"]["url"])).alias("url")))

    def spliced(raw: Column) -> Column:
        units = F.octet_length(raw) / 2
        good = F.array_sort(F.filter(with_url, lambda r: (F.coalesce(r["url"], F.lit("")) != "") & (r["start"] >= 0) & (r["end"] > r["start"]) & (r["end"] <= units)))

        def part(a: Column, z: Column) -> Column:
            # half of a character at either end is none
            def whole(h: Column) -> Column:
                h = F.regexp_replace(F.regexp_replace(h, "^D[C-F]..", "FFFD"), "^((?:....)*)D[89AB]..$", "$1FFFD")
                return F.decode(F.unhex(h), "UTF-16BE")

            return whole(F.hex(F.substr(raw, a * 2 + 1, (z - a) * 2)))

        def put(acc: Column, r: Column) -> Column:
            said = let(part(r["start"], r["end"]), lambda t: F.when(trimmed(t) == r["url"], r["url"]).otherwise(F.concat(F.lit("["), t, F.lit("]("), r["url"], F.lit(")"))))
            return F.when(r["start"] < acc["at"], acc).otherwise(F.struct(r["end"].alias("at"), F.concat(acc["out"], F.array(F.concat(part(acc["at"], r["start"]), said))).alias("out")))

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(good, none, put, lambda acc: F.concat(F.array_join(acc["out"], ""), part(acc["at"], units.cast("int"))))

    text = F.coalesce(block["text"], F.lit(""))
    return F.when(F.size(ranges) == 0, text).otherwise(let(F.encode(text, "UTF-16BE"), spliced))


def _embedded(block: Column, entities: Column, media: Column) -> Column:
    """What a block without text stands for: media, a post, Markdown; '' for anything else."""

    def mark(item: Column) -> Column:
        found = F.try_element_at(F.filter(media, lambda m: m["media_id"] == item["mediaId"]), F.lit(-1))["media_info"]
        kind = F.when(found["__typename"] == "ApiVideo", "video").when(found["__typename"] == "ApiGif", "gif").otherwise("image")
        return let(F.trim(F.regexp_replace(F.coalesce(found["alt_text"], F.lit("")), r"(?U)\s+", " ")), lambda alt: F.concat(F.lit("["), kind, F.when(alt != "", F.concat(F.lit(": "), alt)).otherwise(""), F.lit("]")))

    def said(e: Column) -> Column:
        d = e["data"]
        post = F.when(F.coalesce(d["tweetId"], F.lit("")) == "", "").otherwise(F.concat(F.lit("[embedded post: https://x.com/i/status/"), d["tweetId"], F.lit("]")))
        return F.when(e["type"] == "MEDIA", F.coalesce(F.array_join(F.transform(d["mediaItems"], mark), " "), F.lit(""))).when(e["type"] == "TWEET", post).when(e["type"] == "MARKDOWN", trimmed(F.coalesce(d["markdown"], F.lit("")))).otherwise("")

    return F.coalesce(let(_named(entities, F.get(block["entityRanges"], F.lit(0))["key"]), said), F.lit(""))


def _block(block: Column, entities: Column, media: Column) -> Column:
    """Struct (line, item) of a block; an empty line for none."""
    kind = block["type"]

    def rendered(text: Column) -> Column:
        line = (
            F.when(text == "", "")
            .when(kind == "header-one", F.concat(F.lit("## "), text)).when(kind == "header-two", F.concat(F.lit("### "), text))
            .when(kind.isin("header-three", "header-four", "header-five", "header-six"), F.concat(F.lit("#### "), text))
            .when(kind == "unordered-list-item", F.concat(F.lit("- "), text)).when(kind == "ordered-list-item", F.concat(F.lit("1. "), text))
            .when(kind == "blockquote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
            .when(kind == "code-block", F.concat(F.lit("```\n"), F.coalesce(block["text"], F.lit("")), F.lit("\n```"))).otherwise(text)
        )
        return F.struct(line.alias("line"), kind.isin("unordered-list-item", "ordered-list-item").alias("item"))

    return F.when(kind == "atomic", F.struct(_embedded(block, entities, media).alias("line"), F.lit(False).alias("item"))).otherwise(let(trimmed(_linked(block, entities)), rendered))


def article_markdown(json: Column) -> Column:
    """An article's JSON as Markdown: blocks apart by a blank line, items of a list by a line break; null for text that is no JSON object."""

    def joined(lines: Column) -> Column:
        apart = lambda x, i: F.when(i == 0, "").when(x["item"] & F.get(lines, i - 1)["item"], "\n").otherwise("\n\n")
        return F.array_join(F.transform(lines, lambda x, i: F.concat(apart(x, i), x["line"])), "")

    whole = F.from_json(json, ARTICLE)
    blocks = lambda a: F.transform(F.coalesce(a["blocks"], F.array().cast(_BLOCKS)), lambda b: _block(b, a["entityMap"], a["mediaEntities"]))
    told = let(whole, lambda a: let(F.filter(blocks(a), lambda x: x["line"] != ""), joined))
    return F.when(F.coalesce(F.rlike(json, F.lit(r"^\s*\{")) & F.try_parse_json(json).isNotNull(), F.lit(False)), told)


_BLOCKS = "array<struct<type: string, text: string, entityRanges: array<struct<offset: int, length: int, key: int>>>>"
