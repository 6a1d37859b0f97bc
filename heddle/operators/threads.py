"""Threads: roots and depths, breadth-first caps, and totals. Rows: thread, id, parent (null for the post), pos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_depth(rows: DataFrame, rounds: int = 40) -> DataFrame:
    """Adds root and depth (G4): a row whose parent isn't there is its own root at depth 0.

    Pointer doubling: each round every row points twice as far up, so 2**rounds levels are
    covered; it ends when no pointer moves. Rows in a cycle end with the depth they have then.
    """
    ids = rows.select("thread", F.col("id").alias("parent"), F.col("id").alias("up")).distinct()
    known = rows.select("thread", "id", "parent").join(ids, ["thread", "parent"], "left")
    now = known.select("thread", "id", F.coalesce("up", "id").alias("root"), F.col("up").isNotNull().cast("int").alias("depth"))
    for _ in range(rounds):
        far = now.select("thread", F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = now.join(far, ["thread", "root"]).select("thread", "id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth")).checkpoint()
        moved = step.join(now.select("thread", "id", F.col("root").alias("was")), ["thread", "id"]).where("was <> root").limit(1).count()
        now = step
        if not moved:
            break
    return rows.join(now, ["thread", "id"])


def cap_thread(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of each thread nearest to the top, in their order."""
    w = Window.partitionBy("thread").orderBy("depth", "pos")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def cap_subtrees(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of each root's subtree nearest to the root, which counts."""
    w = Window.partitionBy("thread", "root").orderBy("depth", "pos")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def cap_roots(rows: DataFrame, n: int, orphans: str = "count") -> DataFrame:
    """The first n roots of each thread with all below them.

    orphans: rows whose parent is unknown `count` against n as roots, or are `keep`t beside it.
    """
    orphan = (F.col("id") == F.col("root")) & F.col("parent").isNotNull()
    tops = rows.where("id = root").withColumn("orphan", orphan)
    if orphans == "keep":
        w = Window.partitionBy("thread", "orphan").orderBy("pos")
        tops = tops.withColumn("nth", F.when(F.col("orphan"), F.lit(0)).otherwise(F.row_number().over(w)))
    else:
        tops = tops.withColumn("nth", F.row_number().over(Window.partitionBy("thread").orderBy("pos")))
    return rows.join(tops.where(F.col("nth") <= n).select("thread", "root"), ["thread", "root"], "left_semi")


def thread_totals(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """total, returned, truncated of each thread."""
    total = rows.groupBy("thread").agg(F.count("*").alias("total"))
    held = kept.groupBy("thread").agg(F.count("*").alias("returned"))
    return total.join(held, "thread", "left").select("thread", "total", F.coalesce("returned", F.lit(0)).alias("returned"), (F.coalesce("returned", F.lit(0)) < F.col("total")).alias("truncated"))


def ancestors(rows: DataFrame) -> DataFrame:
    """Each row's chain of parents, oldest first, joined by >."""
    return ancestor_arrays(rows).select("thread", "id", F.array_join(F.transform("chain", lambda i: i.cast("string")), ">").alias("chain"))


def ancestor_arrays(rows: DataFrame) -> DataFrame:
    """thread, id, chain: each row's parents, oldest first, and itself.

    Pointer doubling: each round a row's chain takes in the chain of the row it ends at, so a chain of any
    length takes as many rounds as its length has binary digits. A row that leads into a cycle never ends; its chain is
    cut after as many rounds as the largest thread's rows have digits.
    """
    ids = rows.select("thread", F.col("id").alias("parent"), F.col("id").alias("up")).distinct()
    now = rows.select("thread", "id", "parent").join(ids, ["thread", "parent"], "left").select("thread", "id", "up", F.array("id").alias("chain"))
    most = rows.groupBy("thread").count().agg(F.max("count").alias("n")).first()["n"] or 0
    for _ in range(most.bit_length()):
        far = now.select("thread", F.col("id").alias("up"), F.col("up").alias("next"), F.col("chain").alias("above"))
        now = now.join(far, ["thread", "up"], "left").select("thread", "id", F.col("next").alias("up"), F.when(F.col("above").isNull(), F.col("chain")).otherwise(F.concat("above", "chain")).alias("chain")).checkpoint()
        if now.where("up IS NOT NULL").isEmpty():
            break
    return now.select("thread", "id", "chain")


def self_threads(rows: DataFrame) -> DataFrame:
    """How each post lies in its author's own threads (W10). rows: thread, id, parent, pos, author.

    top, above: the oldest of the posts over it, each by the author and answered by the next, and how many they are. head, place: the chain of
    first replies that it stands in, named by its first post, and its place there from 0; a post's next one is the first reply (by pos) to it by its
    author. So the thread that a post shows is the posts above it, itself, and the later places of its chain. Authors are told apart without case.

    Both are lists linked by one parent each, ranked by pointer doubling: rows stay as many as posts, however long a chain is.
    """
    own = rows.select("thread", "id", "parent", "pos", F.lower("author").alias("author"))
    above = own.select("thread", F.col("id").alias("parent"), F.col("author").alias("answered"))
    same = own.join(above, ["thread", "parent"]).where("author = answered").select("thread", "parent", "id", "pos")
    first = same.groupBy("thread", "parent").agg(F.min_by("id", F.struct("pos", "id")).alias("id"))

    def ranked(links: DataFrame, root: str, depth: str) -> DataFrame:
        linked = own.select("thread", "id").join(links.select("thread", "id", "parent"), ["thread", "id"], "left")
        return with_depth(linked).select("thread", "id", F.col("root").alias(root), F.col("depth").alias(depth))

    return ranked(same, "top", "above").join(ranked(first, "head", "place"), ["thread", "id"])


def self_thread(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """thread, root, id, place: the posts of each asked one's (thread, id) self-thread in order; its own place is 0, those above it have negative ones."""
    ranks = self_threads(rows)
    here = asked.select("thread", F.col("id").alias("root")).join(ranks.withColumnRenamed("id", "root").select("thread", "root", "head", F.col("place").alias("at")), ["thread", "root"])
    below = here.join(ranks.select("thread", "head", "id", "place"), ["thread", "head"]).where("place >= at").select("thread", "root", "id", (F.col("place") - F.col("at")).alias("place"))
    own = rows.select("thread", "id", "parent", F.lower("author").alias("author"))
    up = own.withColumnRenamed("id", "up").select("thread", F.col("up").alias("parent"), F.col("author").alias("answered"))
    links = own.join(up, ["thread", "parent"], "left").select("thread", "id", F.when(F.col("author") == F.col("answered"), F.col("parent")).alias("parent"))
    chain = ancestor_arrays(links).join(asked.select("thread", "id"), ["thread", "id"], "left_semi")
    each = chain.select("thread", F.col("id").alias("root"), F.posexplode("chain").alias("k", "up"), F.size("chain").alias("n"))
    return below.unionByName(each.where("k < n - 1").select("thread", "root", F.col("up").alias("id"), (F.col("k") - F.col("n") + 1).alias("place")))
