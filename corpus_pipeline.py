"""From raw documents to a mixed training set, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept; run() writes each stage's rows as Parquet in the shared folder and reads
them back for the next one, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.decontamination import decontaminate
from heddle.llm.language_id import identify
from heddle.llm.mixing import mix_sources
from heddle.llm.near_dup import MOST_BROADCAST, near_duplicates
from heddle.llm.session import drop, drop_run, run as noted, stored
from heddle.llm.substring_dedup import substring_dedup

#: Share of a text's probability that its language must have.
LEAST_SCORE = 0.5


def _beside(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with the columns that have an operator's names under others, and what selects all of them as they were."""
    other = {c: f"__own_{c}" if c in added else c for c in docs.columns}
    return docs.select(*[F.col(c).alias(n) for c, n in other.items()]), [F.col(n).alias(c) for c, n in other.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is told apart; null and letterless texts go.

    Rows are judged one by one, repeated ones alike; no rows give no rows.
    """
    rows, own = _beside(docs, ("lang_pred", "score"))
    return identify(rows).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*own)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group (five-word shingles, similarity of 0.8).

    Null and blank texts are near nothing and stay, as do rows without doc_id. Rows that share a doc_id are one document and stay or go
    together. No rows give no rows.
    """
    gone = stored(near_duplicates(docs).where("NOT kept").select("doc_id"))
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 words and more that a document with a smaller doc_id has; every document stays, if with an empty text.

    A null text stays null. Of rows that share a doc_id none is smaller, so they take nothing from one another. What is left of a changed
    text is joined by single blanks, and n_chars is counted anew. No rows give no rows.
    """
    rows, own = _beside(docs, ("n_words", "n_removed"))
    out = substring_dedup(rows, window=50, start=13)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, edits up to a fifth of its words included.

    Null and wordless texts hold none and stay; repeated rows go or stay together. An empty benchmark drops nothing, and no rows give no rows.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many of their words it takes: doc_id, source, size, source_size, target, taken."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("language_id", language),
    ("near_dup", near_dups),
    ("substring_dedup", substrings),
    ("decontamination", benchmarks),
    ("mixing", mixture),
]

#: The stages are models, hashes and dynamic programmes; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = docs
        with noted() as tables:
            docs = stored(stage(spark, before, sf_dir))
            # the stage is written: its own tables and its input are done with
            drop_run(tables, docs)
        drop(before)
    return docs
