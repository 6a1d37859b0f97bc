"""Replacing many tokens of texts by a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the table that a broadcast may hold; beyond it the join is shuffled.
MOST_BROADCAST = 200_000


def replace_tokens(rows: DataFrame, key: str, text: str, tokens: DataFrame, pattern: str) -> DataFrame:
    """Rows whose texts have every token that the table names replaced, in one pass over each text.

    pattern: what a token looks like (without groups). tokens: token, replacement (null: the token goes, as a medium's link does). A token that isn't in the table stays. What is put
    in is not looked at again, so the order of the table doesn't matter. Of several rows of a token the least replacement counts.
    key: a column that tells the rows apart.

    Texts are split at their tokens; only the distinct tokens of a text are joined with the table, and come back to it as a map.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    once = tokens.groupBy("token").agg(F.min("replacement").alias("replacement"))
    asked = rows.select(key, F.explode(F.array_distinct(found)).alias("token"))
    if once.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        once = F.broadcast(once)
    said = asked.join(once, "token").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("replacement", F.lit("")).alias("r")))).alias("__said"))
    pieces = F.split(text, pattern, -1)
    put = F.transform(F.col("__found"), lambda t: F.coalesce(F.try_element_at("__said", t), t))
    whole = F.array_join(F.zip_with("__pieces", put, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    out = rows.join(said, key, "left").withColumn("__found", found).withColumn("__pieces", pieces)
    return out.withColumn(text, F.when(F.col("__said").isNotNull(), whole).otherwise(F.col(text))).drop("__said", "__found", "__pieces")
