"""Chat formatting into budgeted windows with loss masks, in DataFrame expressions alone.

Prefix sums of the turns' tokens (words, and TURN_TOKENS for the marks) choose
spans of whole turns: a new window begins where the running sum enters another
cell of half the free budget, and around a turn that is larger than such a
cell. So a window's own turns stay within the free budget, unless it is one
turn larger than that. Every later window repeats the system turn and the last
turns of the window before it, as far as the history budget goes. Targets are
the assistant's turns; a repeated one is masked.

Template: <s>, then for each turn <|role|>text<|end|>, then </s>. Inside roles
and texts the characters that control strings begin with are written as \\b
(backslash), \\l (<), \\k ([) and \\p (|), so no control string of this or of
other templates is left in them, and reading back restores them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tokens of a window, tokens of repeated history, and tokens that a turn's marks cost.
BUDGET, HISTORY, TURN_TOKENS = 512, 64, 3
_WORD = r"[^\x20\x09-\x0D]+"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"), ("|", "\\p"))


def escape(c: Column) -> Column:
    for plain, written in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, n_repeated, n_tokens, loss.

    turns: conv_id, turn, role, text. The first n_repeated turns of text are
    copies from before (the system turn, then history). loss is an array of
    (start, length) in characters from 1, around the assistant texts that count.

    Null roles and texts are empty. Rows of a conversation are taken by turn, ties
    by role and text; repeated rows are turns of their own; a null conv_id is one
    conversation; null turns come first. A system turn is a first turn with the role
    system. An empty table gives no window. Other columns are ignored.
    """
    free = max(budget - history, 2)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(_WORD)) + TURN_TOKENS)
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("pos", F.row_number().over(conv)).withColumn("through", F.sum("tokens").over(conv.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    # the system turn is in every window, so it takes its tokens from each
    rows = rows.withColumn("kept", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole))
    rows = rows.withColumn("half", F.greatest(F.lit(1), F.floor((F.lit(free) - F.col("kept")) / 2)))
    rows = rows.withColumn("cell", F.floor((F.col("through") - F.col("tokens")) / F.col("half"))).withColumn("large", (F.col("tokens") > F.col("half")) & ~F.col("system"))
    new = F.coalesce((F.col("cell") != F.lag("cell").over(conv)) | F.col("large") | F.lag("large").over(conv), F.lit(False)) & ~F.coalesce(F.lag("system").over(conv), F.lit(False))
    rows = rows.withColumn("window", F.sum(new.cast("int")).over(conv.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last", F.max("window").over(whole)).withColumn("end", F.max("through").over(Window.partitionBy("conv_id", "window")))
    again = (F.col("end") - F.col("through") + F.col("tokens") <= history) & (F.col("window") < F.col("last")) & ~F.col("system")
    place = lambda window, repeated: F.struct(window.cast("long").alias("window"), F.lit(repeated).alias("repeated"))  # noqa: E731
    none = F.array().cast("array<struct<window:bigint,repeated:boolean>>")
    places = F.concat(
        F.array(place(F.col("window"), False)),
        F.when(again, F.array(place(F.col("window") + 1, True))).otherwise(none),
        F.when(F.col("system") & (F.col("last") > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("last"), F.lit(1))), lambda k: place(k, True))).otherwise(none),
    )
    placed = rows.select("conv_id", "pos", "role", "text", "tokens", F.explode(places).alias("at")).select("conv_id", "pos", "role", "text", "tokens", "at.window", "at.repeated")
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    turn = F.struct(
        "pos", head.alias("head"), escape(F.col("text")).alias("body"), (~F.col("repeated") & (F.col("role") == "assistant")).alias("target"), "repeated", "tokens"
    )
    windows = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + 7  # noqa: E731
    start = F.struct(F.lit(4).alias("next"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    # few turns: a window holds what its budget holds
    marked = F.aggregate(
        "turns",
        start,
        lambda acc, x: F.struct(
            (acc["next"] + size(x)).alias("next"),
            F.when(x["target"], F.array_append(acc["loss"], F.struct((acc["next"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return windows.select(
        "conv_id",
        "window",
        F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit("<|end|>"))), ""), F.lit("</s>")).alias("text"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0), lambda acc, x: acc + x["tokens"]).alias("n_tokens"),
        marked.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, text, turns (role, text; copies left out) and targets (the unmasked texts), from the formatted text."""
    body = F.expr("substring(text, 4, length(text) - 7)")
    written = F.filter(F.split(body, r"<\|end\|>"), lambda x: x != "")
    own = F.slice(written, F.col("n_repeated") + 1, F.greatest(F.size(written) - F.col("n_repeated"), F.lit(0)))
    # |> cannot stand inside a role, whose | are escaped
    role = lambda x: F.substring_index(x, "|>", 1)  # noqa: E731
    turns = F.transform(own, lambda x: F.struct(unescape(F.substr(role(x), F.lit(3))).alias("role"), unescape(F.substr(x, F.length(role(x)) + 3)).alias("text")))
    targets = F.transform("loss", lambda m: unescape(F.substr(F.col("text"), m["start"], m["length"])))
    return windows.select("conv_id", "window", "text", turns.alias("turns"), targets.alias("targets"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3 over all conversations, and one whose texts hold control strings; digests of what is read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = turns.unionByName(more.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema]))
    read = read_back(chat_windows(turns))
    each = F.struct("window", "turns", "targets", F.length("text").alias("chars"))
    conv = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("windows"))
    turns_of = F.flatten(F.transform("windows", lambda w: w["turns"]))
    text = F.array_join(F.transform(turns_of, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.flatten(F.transform("windows", lambda w: w["targets"])), "")
    return conv.select(
        "conv_id",
        F.size(turns_of).cast("long").alias("n_turns"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda acc, w: acc + w["chars"]).alias("formatted_chars"),
    )


#: The digests from the table itself; formatted_chars adds up the places of each turn.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, len(regexp_extract_all(text, '[^ 	-]+')) + 3 AS tokens,
             length(role) + length(regexp_replace(role, '[^\<\[|]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\<\[|]', '', 'g')) + 11 AS chars FROM c),
p AS (SELECT *, row_number() OVER w AS pos, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS through FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, pos = 1 AND role = 'system' AS system, max(CASE WHEN pos = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS kept FROM p),
h AS (SELECT *, greatest(1, floor((448 - kept) / 2.0)) AS half FROM s),
g AS (SELECT *, floor((through - tokens) / half) AS cell, tokens > half AND NOT system AS large FROM h),
n AS (SELECT *, CASE WHEN coalesce(cell <> lag(cell) OVER w OR large OR lag(large) OVER w, false) AND NOT coalesce(lag(system) OVER w, false) THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
v AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY pos) AS span FROM n),
e AS (SELECT *, max(span) OVER (PARTITION BY conv_id) AS last, max(through) OVER (PARTITION BY conv_id, span) AS stop FROM v),
a AS (SELECT *, 1 + CASE WHEN system THEN last WHEN stop - through + tokens <= 64 AND span < last THEN 1 ELSE 0 END AS places FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
       (sum(chars * places) + 7 * (max(last) + 1))::BIGINT AS formatted_chars
FROM a GROUP BY conv_id
"""
