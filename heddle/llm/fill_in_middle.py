"""Fill-in-the-middle: texts cut in three parts and put together in another order, by marks put after every unit.

A mark is one character. The text's own marks are escaped first, so that afterwards a mark stands for nothing but the
end of a unit. regexp_replace puts one after each unit, their number is the text's length, and substring_index takes the
parts that lie before, between and after the two cuts; marks are removed and escapes undone within the parts. A unit is
a code point here; any pattern of units that covers the text would do.

All of it is DataFrame expressions on a row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mark, and what starts an escape: ESCAPE a is ESCAPE itself, ESCAPE b is the mark.
MARK, ESCAPE = "\x1f", "\x1e"
#: A unit of an escaped text: an escape or one other code point.
UNIT = f"{ESCAPE}[ab]|[^{ESCAPE}]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are changed; of a hundred that are changed so many have their suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: What the result has beside the columns of the documents.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}a")), F.lit(MARK), F.lit(f"{ESCAPE}b"))


def unescaped(part: Column) -> Column:
    """A part as it was in the text: without marks, escapes undone."""
    part = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(part, F.lit(f"{ESCAPE}b"), F.lit(MARK)), F.lit(f"{ESCAPE}a"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a mark after every unit."""
    return F.regexp_replace(escaped(text), UNIT, f"$0{MARK}")


def _first(units: Column, k: Column) -> Column:
    """The first k units of a marked text, without the last mark."""
    return F.call_function("substring_index", units, F.lit(MARK), k)


def _hash(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to every row of docs (doc_id, text).

    n is the text's code points. The cuts and the form follow from the SHA-256 of the seed and doc_id alone, so reruns
    agree. form: plain (output is the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part
    behind its marker; restored() gives back the text. Empty texts and those that hold a marker are plain. Null texts
    count as empty, a null doc_id as no digits. Rows that share a doc_id are cut by the same hash, each at its own length; any
    text may hold marks and escapes. No rows give no rows. Columns with the names of added ones, and
    those that begin with two underscores, are not in the result. A row needs some ten times its text's bytes of memory.
    """
    own = [c for c in docs.columns if c not in ADDED and not c.startswith("__")]
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(*own, text.alias("__text"), marked(text).alias("__units"), digest.alias("__digest"))
    count = F.length("__units") - F.length(F.replace("__units", F.lit(MARK), F.lit("")))
    rows = rows.withColumn("n", count.cast("long"))
    a, b = (_hash(F.col("__digest"), i) % (F.col("n") + 1) for i in (0, 1))
    rows = rows.withColumns({"__from": F.least(a, b).cast("int"), "__to": F.greatest(a, b).cast("int")})
    holds = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("__text", F.lit(marker))
    plain = (F.col("n") == 0) | holds | (_hash(F.col("__digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_hash(F.col("__digest"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    units, start, end = F.col("__units"), F.col("__from"), F.col("__to")
    before = unescaped(_first(units, start))
    # the last units of those before the second cut, and what is behind it up to the last mark
    between = unescaped(F.call_function("substring_index", _first(units, end), F.lit(MARK), start - end))
    after = unescaped(F.call_function("substring_index", units, F.lit(MARK), end - F.col("n").cast("int") - 1))
    psm = F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), between)
    spm = F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), between)
    output = F.when(F.col("form") == "plain", F.col("__text")).when(F.col("form") == "psm", psm).otherwise(spm)
    changed = F.col("form") != "plain"
    return rows.select(
        *own, "n", "form",
        F.when(changed, start.cast("long")).alias("prefix_chars"),
        F.when(changed, (end - start).cast("long")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form: no part holds a marker, so the first of each kind is the real one."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.replace(F.substring_index(head, SUFFIX, 1), F.lit(PREFIX), F.lit("")), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.replace(F.substring_index(head, PREFIX, 1), F.lit(SUFFIX), F.lit("")))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 13 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(d, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS h4 FROM t),
f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, substr(text, 1, lo) AS pre, substr(text, lo + 1, hi - lo) AS mid, substr(text, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
