"""Mixing sources to target weights by fitting each source's budget exactly where that can be done.

Documents are counted by source and exact length. Targets come from the
sources' sizes and weights (water-filling under a cap of `most` times a source's
size). A source is taken whole as often as its target allows; what remains is
a subset-sum over the counted lengths: for each length the same share of its
documents is taken, rounded down, and a bounded-knapsack dynamic programme over
the lengths left closes the gap. Then each length's number of documents is
chosen by a seeded hash of their ids.

Only counts are ever gathered: one row for a source and length. A length with very
many documents is ranked in slices of its hash range, of which only one can be
cut, so no task ranks a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import stored

_WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a slice, of those ranked together.
SLICE = 500


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their lengths sum to `budget`, or as near below it as can be.

    lengths: distinct, above 0; counts: how many there are of each. The first
    pass takes the same share of every length. What that leaves is brought under the
    largest length by whole documents, longest first, and a table of reachable sums over the
    documents left (each length with multiplicity, in powers of two) gives the rest. The table
    has one entry for a sum, the step that reached it first; sums go to three of the largest lengths.
    """
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    size, most = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    total = int((size * most).sum())
    if budget >= total:
        take = most.copy()
    else:
        take = np.array([int(m) * budget // total for m in most.tolist()], np.int64)
        gap = budget - int((size * take).sum())
        reach = int(size[0]) if len(size) else 0
        for i in range(len(size)):
            # leave up to two of the largest lengths open for the exact fit
            n = min(int(most[i] - take[i]), max(0, gap - 2 * reach) // int(size[i]))
            take[i] += n
            gap -= n * int(size[i])
        spare = most - take
        steps, sums = [], 1
        full = (1 << (gap + 1)) - 1
        reached = np.full(gap + 1, -1, np.int32)
        for i in range(len(size)):
            n = min(int(spare[i]), gap // int(size[i]))
            part = 1
            while n > 0:
                part = min(part, n)
                new = (sums << part * int(size[i])) & full & ~sums
                if new:
                    reached[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(gap // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(steps)
                    steps.append((i, part))
                    sums |= new
                n -= part
                part *= 2
            if sums >> gap & 1:
                break
        at = sums.bit_length() - 1
        while at:
            # what is left was reached by an earlier step
            i, part = steps[reached[at]]
            take[i] += part
            at -= part * int(size[i])
    back = np.empty_like(take)
    back[order] = take
    return back.tolist()


def _plan(table: pa.Table) -> pa.Table:
    """For one source: the rows of its lengths with rounds (whole copies) and extra (documents with one copy more)."""
    size = table["size"].to_pylist()
    count = table["count"].to_pylist()
    target = float(table["target"][0].as_py())
    whole = sum(s * c for s, c in zip(size, count, strict=True))
    goal = round(target)
    rounds = min(goal // whole, table["most"][0].as_py()) if whole else 0
    rest = goal - rounds * whole if rounds < table["most"][0].as_py() else 0
    used = [i for i, s in enumerate(size) if s > 0]
    extra = [0] * len(size)
    for i, n in zip(used, knapsack([size[i] for i in used], [count[i] for i in used], rest) if used and rest else [], strict=False):
        extra[i] = n
    return table.select(["key", "size", "count", "source_size", "target"]).append_column("rounds", pa.array([rounds] * len(size), pa.int64())).append_column("extra", pa.array(extra, pa.int64()))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """key, source_size, target for sources (key, source, source_size), one row each.

    Sources by code point, null last, get the weights in turn. The level at which the uncapped
    sources share what the capped ones leave is where sources, ordered by cap against weight, stop being capped.
    """
    w = Window.partitionBy("all").orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    rows = sizes.withColumn("all", F.lit(True)).withColumn("weight", F.get(cycle, (F.row_number().over(w) - 1) % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.partitionBy("all").orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("all").orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("all")
    total = F.sum(F.col("source_size").cast("double")).over(every) * share
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(by), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("open", F.col("level") < F.col("ratio"))
    # the first open source, the others before it being capped, has the level of all open ones
    rows = rows.withColumn("water", F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(every)["level"])
    return rows.select("key", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17) -> DataFrame:
    """The mix's plan, one row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    size: the text's words (null: 0). Sources share `share` of all words by the weights, which sources by code point
    (null last) get in turn; no target exceeds `most` times its source's words, and the excess is
    reshared. taken: words that the mix takes of the row, its repeats counted.

    Rows of size 0 are taken as nothing. Repeated rows are documents of their own. An empty table gives none.
    Other columns are ignored. Runs with one seed agree.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("key")
    words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size")
    # the text too, so that rows without doc_id are spread
    luck = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).bitwiseAND(F.lit((1 << 62) - 1)).alias("luck")
    sized = stored(docs.select("doc_id", "source", key, words, luck))
    counts = stored(sized.groupBy("key", "size").agg(F.count("*").alias("count"), F.first("source").alias("source")))
    goals = stored(targets(counts.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("count")).alias("source_size")), weights, share, most))
    plan = stored(
        counts.select("key", "size", "count")
        .join(goals.select("key", "source_size", "target", F.lit(most).cast("long").alias("most")), "key")
        .groupBy("key")
        .applyInArrow(_plan, "key string, size long, count long, source_size long, target double, rounds long, extra long")
    )

    # Of each length, the first `extra` documents by their seeded hash, found by slices of the hash range.
    slices = F.ceil(F.col("count") / SLICE).cast("long")
    at = F.least(slices - 1, F.floor(F.col("luck") / (F.lit(float(1 << 62)) / slices))).alias("slice")
    drawn = sized.join(plan, ["key", "size"]).select("doc_id", "source", "key", "size", "luck", "source_size", "target", "rounds", "extra", at)
    held = drawn.where("extra > 0").groupBy("key", "size", "slice", "extra").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    open_slices = stored(held.withColumn("left", F.col("extra") - before).where("left > 0").select("key", "size", "slice", "held", "left"))
    rows = drawn.join(open_slices, ["key", "size", "slice"], "left").withColumn("cut", F.coalesce(F.col("left") < F.col("held"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("luck", "doc_id"))
    sure = rows.where("NOT cut").withColumn("more", F.col("left").isNotNull())
    ranked = rows.where("cut").withColumn("more", place <= F.col("left"))
    taken = (F.col("size") * (F.col("rounds") + F.col("more").cast("long"))).alias("taken")
    return sure.unionByName(ranked).select("doc_id", "source", "size", "source_size", "target", taken)


def query(spark, sf_dir: str) -> DataFrame:
    """Op 6 over all documents: all words, weights 1, 2, 3, at most 3 times a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
