"""Exact dedup by two passes over Bloom-filtered hashes, in DataFrame expressions alone.

Texts are equal if they are identical once A-Z are lower-cased. Each text is read once for its SHA-256; what follows
works on the digests.

Pass one: a digest's 64-bit hash picks a word of 64 bits and four bits in it (a blocked Bloom filter), both packed into
one number. Numbers are counted, with map-side combine: the ones that occur twice or more may belong to repeated
digests, and only these set their bits. The filter is sent to every task in pages; its size is bounded.

Pass two: every row tests its bits. Rows that fail are the only ones of their text: they go straight to the output and
are never shuffled. The others are grouped by their whole digest, which settles what is equal. The groups come back
to their rows by a join in which very large groups are broadcast, so that a text which a third of all rows share is
spread over as many tasks as its rows were.

A filter that is too small for the repeated texts lets more rows take part in pass two and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import join_by_size
from .session import memory_of_core, stored

#: Bits of the filter for a row, least and most words of 8 bytes (MOST_WORDS: 128 MB), and the filter's largest part of a core's memory.
ROW_BITS, LEAST_WORDS, MOST_WORDS, FILTER_PART = 16, 1 << 10, 1 << 24, 16
#: Bits that a hash sets in its word; each takes 6 bits of the hash. Words of a page.
KEY_BITS, PAGE = 4, 1 << 10
#: What the result has beside the columns of the documents.
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased, null as empty; lower() says the same of texts without other than ASCII characters, and is faster."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def filter_words(rows: int, core_bytes: int) -> int:
    """Words of the filter, a power of two: by rows, and at most what a core's memory allows."""
    most = max(LEAST_WORDS, min(MOST_WORDS, core_bytes // FILTER_PART // 8))
    wanted = min(most, max(LEAST_WORDS, rows * ROW_BITS // 64))
    return 1 << (wanted.bit_length() - 1)


def _slot(digest: Column, words: int) -> Column:
    """The word of a digest and its bits in the word, in one number."""
    return F.xxhash64(digest).bitwiseAND(F.lit((words << 6 * KEY_BITS) - 1))


def _mask(slot: Column) -> Column:
    mask = None
    for i in range(KEY_BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(slot, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def repeated_filter(digests: DataFrame, words: int) -> DataFrame:
    """(page, bits): the words, by pages, of a Bloom filter of all digests that may occur twice or more; empty pages are left out."""
    twice = digests.groupBy(_slot(F.col("digest"), words).alias("slot")).count().where("count > 1")
    word = F.shiftrightunsigned("slot", 6 * KEY_BITS)
    full = twice.groupBy(word.alias("word")).agg(F.bit_or(_mask(F.col("slot"))).alias("mask"))
    page, at = F.floor(F.col("word") / PAGE).cast("int"), (F.col("word") % PAGE).cast("int")
    # a page is an array of its words in order, the ones without bits as 0
    pages = full.groupBy(page.alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "mask"))).alias("m"))
    zero = F.lit(0).cast("long")
    return pages.select("page", F.transform(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("bits"))


def _tested(rows: DataFrame, pages: DataFrame, words: int) -> DataFrame:
    """The rows and whether their digest may occur twice (__twice)."""
    slot = _slot(F.col("__digest"), words)
    word = F.shiftrightunsigned(slot, 6 * KEY_BITS)
    paged = rows.withColumn("__page", F.floor(word / PAGE).cast("int")).join(F.broadcast(pages.select(F.col("page").alias("__page"), F.col("bits").alias("__bits"))), "__page", "left")
    hit = F.get("__bits", (word % PAGE).cast("int")).bitwiseAND(_mask(slot)) == _mask(slot)
    return paged.withColumn("__twice", F.coalesce(hit, F.lit(False))).drop("__page", "__bits")


def exact_dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of docs (doc_id, text); the kept rows have each text once.

    Equal texts are a group: group_size is the number of its rows and keep_id its largest doc_id, whose row is kept.
    Null texts are empty ones, and all empty texts are equal. A null doc_id is smaller than any other. Of rows that share
    both their text and the group's largest doc_id, one is kept (whichever is read first). No rows give no rows. Columns
    of docs that have the names of added ones, and those whose names begin with two underscores, are not in the result.
    With texts=False the result lacks the text, and docs are read once instead of two or three times.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ADDED and not c.startswith("__")]
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    rest = [c for c in own if texts and c == "doc_id" or not texts and c != "text"]
    read = stored(docs.select(*rest, digest.alias("__digest")))
    words = filter_words(read.count(), memory_of_core(spark))
    pages = stored(repeated_filter(read.select(F.col("__digest").alias("digest")), words))
    # who is equal: rows of a doc_id first, so that no large group is in one task
    some = _tested(read.select("doc_id", "__digest"), pages, words).where("__twice").groupBy("__digest", "doc_id").agg(F.count("*").alias("n"))
    best = some.groupBy("__digest").agg(F.sum("n").alias("rows"), F.max(F.struct("doc_id", "n")).alias("best"))
    groups = stored(best.where("rows > 1").select("__digest", "rows", F.col("rows").alias("__size"), F.col("best.doc_id").alias("__keep"), F.col("best.n").alias("__ties")))
    sums = groups.agg(F.sum("rows").alias("rows"), F.max("__ties").alias("ties")).first()
    rows = read if not texts else docs.select(*own, digest.alias("__digest"))
    tested = _tested(rows, pages, words)
    alone = tested.where("NOT __twice").select(*rows.columns, F.lit(1).cast("long").alias("__size"), F.col("doc_id").alias("__keep"), F.lit(True).alias("kept"))
    met = join_by_size(tested.where("__twice").select(*rows.columns), groups, ["__digest"], sums["rows"] or 0, "left")
    met = met.withColumn("kept", F.col("__size").isNull() | F.col("doc_id").eqNullSafe(F.col("__keep")))
    if (sums["ties"] or 0) > 1:
        met = _one_of_ties(met)
    met = met.select(*rows.columns, F.coalesce("__size", F.lit(1)).cast("long").alias("__size"), F.when(F.col("__size").isNull(), F.col("doc_id")).otherwise(F.col("__keep")).alias("__keep"), "kept")
    shown = [c for c in own if texts or c != "text"]
    return alone.unionByName(met).select(*shown, F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def _one_of_ties(met: DataFrame) -> DataFrame:
    """Of the rows of a group that share its largest doc_id, the first stays kept; they are written once, so their numbers hold."""
    tied = F.col("kept") & (F.coalesce("__ties", F.lit(1)) > 1)
    ties = stored(met.where(tied).withColumn("__mark", F.monotonically_increasing_id()))
    first = ties.groupBy("__digest").agg(F.min("__mark").alias("__first"), F.count("*").alias("rows"))
    chosen = join_by_size(ties, first, ["__digest"], ties.count()).withColumn("kept", F.col("__mark") == F.col("__first"))
    return met.where(~tied).unionByName(chosen.select(*met.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 12 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, texts=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
