"""URL rules behind a blocked Bloom filter, in DataFrame expressions alone.

A rule is a canonical URL prefix: a host and a path, written together, such as
`example.com/en/`. It fits the URLs of its host and of all subdomains whose path
starts with its path. Every URL is turned into its candidate keys, one for each
host suffix and each path length that some rule has. The keys are first looked
up in a blocked Bloom filter (a table of 64-bit words; a key sets and tests
its bits within one word). It has RULE_BITS bits for each rule, up to MOST_WORDS
words, so it may be sent to every task. Possible hits go on to a hash join with
the exact rules, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import join_by_size

#: Bits of the filter for a rule, its least and most words of 8 bytes, and the bits that a key sets in its word.
RULE_BITS, LEAST_WORDS, MOST_WORDS, KEY_BITS = 16, 1 << 6, 1 << 21, 4
#: Rules that a broadcast may hold; beyond it the same join is shuffled.
MOST_BROADCAST = 200_000

RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_words(rules: int) -> int:
    """Words of the filter for so many rules, a power of two."""
    return max(LEAST_WORDS, min(MOST_WORDS, 1 << (rules * RULE_BITS // 64).bit_length()))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key in its word."""
    h = F.xxhash64(key, F.lit(1))
    mask = None
    for i in range(KEY_BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def bloom_words(rules: DataFrame, words: int) -> DataFrame:
    """One row: the filter's words as an array of longs."""
    masks = rules.groupBy(_word(F.col("rule"), words).cast("long").alias("id")).agg(F.bit_or(_mask(F.col("rule"))).alias("m"))
    every = rules.sparkSession.range(words).join(masks, "id", "left").select(F.struct("id", F.coalesce("m", F.lit(0).cast("long")).alias("m")).alias("w"))
    return every.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["m"]).alias("words"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages (url).

    rules: host, path, verdict. Of the rules that fit, the longest (host and path
    together) decides, of equally long ones the smaller; a rule listed twice has the smaller
    verdict. rule is null and verdict the default where none fits. Null URLs and URLs without
    :// have empty host and path, which no rule fits. Rules with a null or empty host are
    ignored; a null path is empty. Repeated rows stay. Columns of pages named host, path,
    rule or verdict are replaced.
    """
    spark = pages.sparkSession
    listed = rules.where("host <> ''").select(_ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    listed = listed.select(F.concat("host", "path").alias("rule"), F.length("path").alias("cut"), "verdict").groupBy("rule", "cut").agg(F.min("verdict").alias("verdict"))
    # distinct path lengths: at most as many as the longest URL has characters
    cuts = sorted(r["cut"] for r in listed.select("cut").distinct().collect())
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*own, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not cuts:
        return judged.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    urls = judged.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("rows"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda c: F.struct(F.concat(s, F.expr("path").substr(F.lit(1), c)).alias("rule"), c.alias("cut")))))
    rules_there = listed.count()
    size = filter_words(rules_there)
    words = bloom_words(listed, size).scalar()
    tried = urls.select("host", "path", "rows", F.explode(keys).alias("k")).select("host", "path", "rows", "k.rule", "k.cut")
    mask = _mask(F.col("rule"))
    hits = tried.where(F.get(words, _word(F.col("rule"), size)).bitwiseAND(mask) == mask)
    fits = hits.join(F.broadcast(listed) if rules_there <= MOST_BROADCAST else listed, ["rule", "cut"])
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("short"), "rule", "verdict")).alias("best"), F.first("rows").alias("rows"))
    # URLs without a host fit no rule and would all meet under one key
    blank = judged.where("host = ''").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    # a URL with very many rows is not brought together
    out = join_by_size(judged.where("host <> ''"), best, ["host", "path"], pages.count(), "left")
    return out.select(*own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).unionByName(blank)


def fixed_rules(spark: SparkSession) -> DataFrame:
    """The rules of the query."""
    rows = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5 over all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, fixed_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST, r.host || r.path) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""
