"""Three wire schemas of posts as one, and pull requests put together from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import demote_headings, excerpt

#: The three sources' names for a post's parts (F22): target, then fx, syndication and vx fields.
POST_FIELDS = (("id", "id", "id_str", "tweetID"), ("handle", "screen_name", "screen_name", "user_screen_name"), ("name", "author_name", "name", "user_name"), ("text", "text", "full_text", "text"), ("likes", "likes", "favorite_count", "likes"))


def one_post(rows: DataFrame, source: str) -> DataFrame:
    """A source's rows in the common columns, with its name; the texts' HTML entities for <, > and & are read."""
    at = {"fx": 1, "syndication": 2, "vx": 3}[source]
    out = rows.select(*[F.col(f[at]).alias(f[0]) for f in POST_FIELDS]).withColumn("source", F.lit(source))
    t = F.replace(F.replace(F.replace("text", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return out.withColumn("text", t).withColumn("likes", F.coalesce(F.col("likes").cast("long"), F.lit(0).cast("long"))).withColumn("id", F.col("id").cast("string"))


def unify_posts(fx: DataFrame, syndication: DataFrame, vx: DataFrame) -> DataFrame:
    """three wire schemas as one table; the first source that has a post counts, in this order."""
    every = one_post(fx, "fx").unionByName(one_post(syndication, "syndication")).unionByName(one_post(vx, "vx"))
    order = F.when(F.col("source") == "fx", 0).when(F.col("source") == "syndication", 1).otherwise(2)
    best = F.min_by(F.struct("handle", "name", "text", "likes", "source"), order)
    return every.groupBy("id").agg(best.alias("p")).select("id", "p.*")


def indented(text: Column, by: int) -> Column:
    """All lines but the first moved in."""
    return F.replace(text, F.lit("\n"), F.lit("\n" + " " * by))


def render_pulls(pulls: DataFrame, files: DataFrame, commits: DataFrame, reviews: DataFrame, comments: DataFrame, diff_bytes: int = 30000) -> DataFrame:
    """Id, markdown of pull requests with the lists of four tables (id, pos, and what each has).

    pulls: id, title, state, body; files: name, patch (patches stay within diff_bytes, those that don't fit are named only); commits: sha, message; reviews: author, state; comments: author, text.
    """
    from ..streaming.folds import Budget, fold

    sized = fold(files.withColumn("bytes", F.coalesce(F.octet_length("patch"), F.lit(0)).cast("long")), "id", ["pos"], lambda: Budget(diff_bytes), ["bytes"])
    patch = F.when(F.col("kept") & F.col("patch").isNotNull(), F.concat(F.lit("\n```diff\n"), "patch", F.lit("\n```")))

    def listed(rows: DataFrame, title: str, line: Column, name: str) -> DataFrame:
        each = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
        return rows.groupBy("id").agg(F.concat(F.lit(f"## {title} ("), F.count("*").cast("string"), F.lit(")\n\n"), F.array_join(each, "\n")).alias(name))

    parts = (
        listed(sized, "Files", F.concat(F.lit("- "), "name", F.coalesce(patch, F.lit(""))), "files"),
        listed(commits, "Commits", F.concat(F.lit("- "), F.substring("sha", 1, 7), F.lit(" "), F.substring_index("message", "\n", 1)), "commits"),
        listed(reviews, "Reviews", F.concat(F.lit("- @"), "author", F.lit(": "), F.lower("state")), "reviews"),
        listed(comments, "Comments", F.concat(F.lit("- @"), "author", F.lit(": "), indented(excerpt(F.col("text"), 1500), 2)), "comments"),
    )
    out = pulls
    for p in parts:
        out = out.join(p, "id", "left")
    head = F.concat(F.lit("# "), "title", F.lit(" (#"), F.col("id").cast("string"), F.lit(", "), "state", F.lit(")"))
    return out.select("id", F.concat_ws("\n\n", head, F.nullif(excerpt(demote_headings(F.col("body"), 2), 3000), F.lit("")), "files", "commits", "reviews", "comments").alias("markdown"))
