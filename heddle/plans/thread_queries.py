"""Queries over threads. Conversations are linear, so parents are declared: turn t answers turn (t - 1) // 2, turn 0 is
the top, and turn 5 answers a turn that isn't there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import threads
from ..sources import trees
from ..sources.tables import in_request_order, table
from .page_queries import _host
from .registry import query

_ROWS = "SELECT conv_id AS thread, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn = 5 THEN 99 ELSE (turn - 1) // 2 END AS parent, turn AS pos FROM conversations"
_DEPTH = f"""WITH RECURSIVE r AS ({_ROWS}), d(thread, id, parent, pos, root, depth) AS (
  SELECT thread, id, parent, pos, id, 0 FROM r WHERE parent IS NULL OR (thread, parent) NOT IN (SELECT (thread, id) FROM r)
  UNION ALL SELECT r.thread, r.id, r.parent, r.pos, d.root, d.depth + 1 FROM r JOIN d ON r.thread = d.thread AND r.parent = d.id)"""


def _rows(spark, sf_dir) -> DataFrame:
    t = F.col("turn")
    parent = F.when(t == 0, F.lit(None)).when(t == 5, 99).otherwise(F.floor((t - 1) / 2)).cast("long")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), t.alias("id"), parent.alias("parent"), t.alias("pos"))


def _deep(spark, sf_dir) -> DataFrame:
    from ..sources.tables import checkpoints

    checkpoints(spark)
    return threads.with_depth(_rows(spark, sf_dir))


_COLS = ["thread", "id", "root", "depth"]


@query("thread_depths", f"{_DEPTH} SELECT thread, id, root, depth FROM d")
def thread_depths(spark, sf_dir):
    """Root and depth of each turn."""
    return _deep(spark, sf_dir).select(*_COLS)


@query("capped_threads", f"{_DEPTH} SELECT thread, id, root, depth FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY depth, pos) AS k FROM d) WHERE k <= 4")
def capped_threads(spark, sf_dir):
    """The four turns nearest to the top."""
    return threads.cap_thread(_deep(spark, sf_dir), 4).select(*_COLS)


@query("capped_subtrees", f"{_DEPTH} SELECT thread, id, root, depth FROM (SELECT *, row_number() OVER (PARTITION BY thread, root ORDER BY depth, pos) AS k FROM d) WHERE k <= 2")
def capped_subtrees(spark, sf_dir):
    """Two turns of each root."""
    return threads.cap_subtrees(_deep(spark, sf_dir), 2).select(*_COLS)


@query("capped_roots", f"{_DEPTH}, t AS (SELECT thread, id, row_number() OVER (PARTITION BY thread ORDER BY pos) AS k FROM d WHERE id = root) SELECT d.thread, d.id, d.root, d.depth FROM d JOIN t ON d.thread = t.thread AND d.root = t.id WHERE k <= 1")
def capped_roots(spark, sf_dir):
    """The first root with all below it, orphans counting as roots."""
    return threads.cap_roots(_deep(spark, sf_dir), 1).select(*_COLS)


@query("kept_orphans", f"{_DEPTH}, t AS (SELECT thread, id, parent, row_number() OVER (PARTITION BY thread, parent IS NOT NULL ORDER BY pos) AS k FROM d WHERE id = root) SELECT d.thread, d.id, d.root, d.depth FROM d JOIN t ON d.thread = t.thread AND d.root = t.id WHERE k <= 1 OR t.parent IS NOT NULL")
def kept_orphans(spark, sf_dir):
    """The first root with all below it, orphans kept beside it."""
    return threads.cap_roots(_deep(spark, sf_dir), 1, orphans="keep").select(*_COLS)


@query("thread_totals", "SELECT conv_id AS thread, count(*) AS total, least(count(*), 4) AS returned, count(*) > 4 AS truncated FROM conversations GROUP BY 1")
def thread_totals(spark, sf_dir):
    """Totals of threads capped at four turns."""
    rows = _deep(spark, sf_dir)
    return threads.thread_totals(rows, threads.cap_thread(rows, 4))


@query("ancestor_chains", f"""WITH RECURSIVE r AS ({_ROWS}), u(thread, leaf, id, parent, hops) AS (SELECT thread, id, id, parent, 0 FROM r UNION ALL SELECT r.thread, u.leaf, r.id, r.parent, hops + 1 FROM u JOIN r ON r.thread = u.thread AND r.id = u.parent)
SELECT thread, leaf AS id, string_agg(id::VARCHAR, '>' ORDER BY hops DESC) AS chain FROM u GROUP BY 1, 2""")
def ancestor_chains(spark, sf_dir):
    """Each turn's parents, oldest first."""
    return threads.ancestors(_rows(spark, sf_dir))


@query("first_replies", "SELECT conv_id AS thread, arg_min(turn, turn) FILTER (role = 'user' AND turn > 0) AS reply FROM conversations GROUP BY 1")
def first_replies(spark, sf_dir):
    """The first later turn by the same author (the user)."""
    own = (F.col("role") == "user") & (F.col("turn") > 0)
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread")).agg(F.min_by(F.when(own, F.col("turn")), F.when(own, F.col("turn"))).alias("reply"))


_OWN = "SELECT conv_id AS thread, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn = 5 THEN 99 ELSE (turn - 1) // 2 END AS parent, role AS author FROM conversations"
_SAME = f"r AS ({_OWN}), l AS (SELECT r.thread, r.id, r.parent FROM r JOIN r p ON p.thread = r.thread AND p.id = r.parent AND p.author = r.author), n AS (SELECT thread, parent, min(id) AS id FROM l GROUP BY 1, 2)"


def _authored(spark, sf_dir) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("id"), F.col("role").alias("author"))
    return _rows(spark, sf_dir).join(roles, ["thread", "id"])


@query("self_threads", f"""WITH RECURSIVE {_SAME}, u AS (SELECT thread, id, id AS top, 0 AS above FROM r WHERE (thread, id) NOT IN (SELECT (thread, id) FROM l) UNION ALL SELECT l.thread, l.id, u.top, u.above + 1 FROM l JOIN u ON u.thread = l.thread AND u.id = l.parent),
d AS (SELECT thread, id, id AS head, 0 AS place FROM r WHERE (thread, id) NOT IN (SELECT (thread, id) FROM n) UNION ALL SELECT n.thread, n.id, d.head, d.place + 1 FROM n JOIN d ON d.thread = n.thread AND d.id = n.parent)
SELECT thread, id, top, above, head, place FROM u JOIN d USING (thread, id)""")
def self_threads(spark, sf_dir):
    """Each turn's place among its author's own: the unbroken parents above it, and its chain of first replies."""
    from ..sources.tables import checkpoints

    checkpoints(spark)
    return threads.self_threads(_authored(spark, sf_dir))


@query("self_thread_posts", f"""WITH RECURSIVE {_SAME}, h AS (SELECT thread, id FROM r WHERE id % 2 = 0),
d(thread, root, id, place) AS (SELECT thread, id, id, 0 FROM h UNION ALL SELECT n.thread, d.root, n.id, d.place + 1 FROM n JOIN d ON d.thread = n.thread AND d.id = n.parent),
u(thread, root, id, place) AS (SELECT thread, id, id, 0 FROM h UNION ALL SELECT l.thread, u.root, l.parent, u.place - 1 FROM l JOIN u ON u.thread = l.thread AND u.id = l.id)
SELECT * FROM d UNION SELECT * FROM u""")
def self_thread_posts(spark, sf_dir):
    """The whole self-thread of each of the user's turns (declared: those with even numbers are asked for), in order."""
    from ..sources.tables import checkpoints

    checkpoints(spark)
    rows = _authored(spark, sf_dir)
    return threads.self_thread(rows, rows.where("id % 2 = 0").select("thread", "id"))


@query("merged_expansions", "SELECT conv_id AS thread, turn AS id FROM conversations WHERE turn < 3 UNION ALL SELECT conv_id, turn FROM conversations c WHERE turn >= 1 AND NOT EXISTS (SELECT 1 FROM conversations k WHERE k.conv_id = c.conv_id AND k.turn = c.turn AND k.turn < 3)")
def merged_expansions(spark, sf_dir):
    """Turns of an expansion (from turn 1 on) joined to those there (up to turn 2), ids once."""
    rows = _rows(spark, sf_dir).select("thread", "id")
    have, more = rows.where("id < 3"), rows.where("id >= 1")
    return have.unionByName(more.join(have, ["thread", "id"], "left_anti"))


@query("open_gaps", "SELECT conv_id AS thread, list_filter(list(turn ORDER BY turn), lambda c: c NOT IN (1, 3)) AS children FROM conversations GROUP BY 1")
def open_gaps(spark, sf_dir):
    """A gap's children without those that were asked for (1 and 3), repeats kept."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread")).agg(F.sort_array(F.collect_list("turn")).alias("children"))
    asked = F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))
    return rows.select("thread", F.filter("children", lambda c: ~F.array_contains(asked, c)).alias("children"))


@query("id_batches", "SELECT conv_id // 40 AS batch, count(*) AS n, min(conv_id) AS first FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1")
def id_batches(spark, sf_dir):
    """Ids in batches of forty."""
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().groupBy(F.floor(F.col("conv_id") / 40).alias("batch")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


@query("stream_order", "SELECT conv_id AS thread, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS pos FROM conversations WHERE role = 'user'")
def stream_order(spark, sf_dir):
    """Posts put in a stream's order (declared: turns backwards, those loaded are the user's), places without gaps."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("id"), "role")
    stream = turns.groupBy("thread").agg(F.sort_array(F.collect_list("id"), asc=False).alias("stream")).select("thread", F.posexplode("stream").alias("at", "id"))
    return stream.join(turns.where("role = 'user'"), ["thread", "id"]).withColumn("pos", F.row_number().over(Window.partitionBy("thread").orderBy("at")) - 1).select("thread", "id", "pos")


@query("accepted_first", "SELECT conv_id AS thread, turn AS id, turn = 3 AS accepted, row_number() OVER (PARTITION BY conv_id ORDER BY turn <> 3, turn) AS place FROM conversations")
def accepted_first(spark, sf_dir):
    """The accepted answer (declared: turn 3) first, the others in order."""
    from pyspark.sql import Window

    t = F.col("turn")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.when(t == 3, 0).otherwise(1), "turn"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), t.alias("id"), (t == 3).alias("accepted"), place.alias("place"))


@query("listed_entries", f"SELECT page_id, row_number() OVER (PARTITION BY {_host('url')} ORDER BY page_id % 3 <> 0, lower(url), page_id) AS place FROM pages")
def listed_entries(spark, sf_dir):
    """O2: directories (declared: every third page) first, then names without case, for each host."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "pages").withColumn("list", urls.hostname(F.col("url")))
    order = Window.partitionBy("list").orderBy(F.when(F.col("page_id") % 3 == 0, 0).otherwise(1), F.lower("url"), "page_id")
    return rows.select("page_id", F.row_number().over(order).alias("place"))


@query("request_batches", "SELECT page_id // 30 AS batch_id, row_number() OVER (PARTITION BY page_id // 30 ORDER BY page_id) - 1 AS pos, url FROM pages")
def request_batches(spark, sf_dir):
    """Batches of thirty URLs, each with its place."""
    b = F.floor(F.col("page_id") / 30)
    batches = table(spark, sf_dir, "pages").groupBy(b.alias("batch_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]).alias("urls"))
    return in_request_order(batches)


@query("error_documents", """SELECT url, CASE WHEN page_id % 7 = 0 THEN 'error: timeout' ELSE 'text' END AS page_content, CASE WHEN page_id % 7 = 0 THEN 'timeout' ELSE 'ok' END AS kind FROM pages""")
def error_documents(spark, sf_dir):
    """Failures as documents."""
    from ..sources.tables import error_documents as as_documents

    rows = table(spark, sf_dir, "pages").select("url", F.lit("text").alias("text"), F.when(F.col("page_id") % 7 == 0, "timeout").alias("kind"))
    return as_documents(rows).select("url", "page_content", F.col("metadata")["kind"].alias("kind"))


def _gone(t):
    """Turns whose text is declared to be gone."""
    return t % 7 == 3


def _documents(spark, sf_dir, shape: str) -> DataFrame:
    """Conversations as a site's thread documents, nested to any depth: turn 0 is the post, the parents are the declared ones."""
    from ..sources.tables import checkpoints

    checkpoints(spark)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = _rows(spark, sf_dir).join(turns, ["thread", "id"]).where("id > 0")
    text = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)

    def node(r, inner):
        gone, own = _gone(r["id"]), r["id"].cast("string")
        body = text(r["text"])
        if shape == "nested":
            said = F.when(gone, F.lit('"author":null,"text":null')).otherwise(F.concat(F.lit('"author":"'), r["role"], F.lit('","text":'), body))
            return F.concat(F.lit('{"id":'), own, F.lit(","), said, F.lit(',"children":['), inner, F.lit("]}"))
        if shape == "posts":
            said = F.when(gone, F.lit('"notFound":true')).otherwise(F.concat(F.lit('"post":{"uri":"'), own, F.lit('","author":{"handle":"'), r["role"], F.lit('"},"record":{"text":'), body, F.lit("}}")))
            return F.concat(F.lit("{"), said, F.lit(',"replies":['), inner, F.lit("]}"))
        up = F.when(r["parent"] > 0, F.concat(F.lit("t1_"), r["parent"].cast("string"))).otherwise(F.concat(F.lit("t3_p"), r["thread"].cast("string")))
        said = F.when(gone, F.lit('"author":"[deleted]","body":"[removed]"')).otherwise(F.concat(F.lit('"author":"'), r["role"], F.lit('","body":'), body))
        # turn 2 has a link to go on behind it, and a child that is no object
        inner = F.when(r["id"] == 2, F.concat_ws(",", F.nullif(inner, F.lit("")), F.lit('{"kind":"more","data":{"count":0,"parent_id":"t1_2","children":[]}},"bad"'))).otherwise(inner)
        replies = F.when(inner == "", '""').otherwise(F.concat(F.lit('{"kind":"Listing","data":{"children":['), inner, F.lit("]}}")))
        return F.concat(F.lit('{"kind":"t1","data":{"id":"'), own, F.lit('","parent_id":"'), up, F.lit('",'), said, F.lit(',"replies":'), replies, F.lit("}}"))

    nested = trees.nest(rows, node)
    heads = turns.where("id = 0").select("thread")
    docs = heads.join(nested, "thread", "left").fillna("", ["json"])
    t = F.col("thread").cast("string")
    whole = {
        "nested": F.concat(F.lit('{"id":0,"children":['), "json", F.lit("]}")),
        "posts": F.concat(F.lit('{"thread":{"post":{"uri":"0"},"replies":['), "json", F.lit("]}}")),
        "listing": F.concat(F.lit('[{"kind":"Listing","data":{"children":[{"kind":"t3","data":{"id":"p'), t, F.lit('"}}]}},{"kind":"Listing","data":{"children":['),
            F.concat_ws(",", F.nullif("json", F.lit("")), F.concat(F.lit('{"kind":"more","data":{"count":'), (F.col("thread") % 3 + 1).cast("string"), F.lit(',"parent_id":"t3_p'), t, F.lit('","children":["x","y"]}}'))), F.lit("]}}]")),
    }
    return docs.select("thread", whole[shape].alias("json"))


_TREE = """WITH RECURSIVE r AS (SELECT conv_id AS thread, turn AS id, turn % 7 = 3 AS gone, CASE WHEN turn = 5 OR turn <= 2 THEN 0 ELSE (turn - 1) // 2 END AS up, role, coalesce(text, '') AS text FROM conversations WHERE turn > 0),
d AS (SELECT thread, id, gone, role, text, 0 AS parent, 0 AS depth, [id] AS path, CASE WHEN gone THEN 0 ELSE id END AS live FROM r WHERE up = 0
  UNION ALL SELECT r.thread, r.id, r.gone, r.role, r.text, {up}, d.depth + 1, list_append(d.path, r.id), CASE WHEN r.gone THEN d.live ELSE r.id END FROM r JOIN d ON r.thread = d.thread AND r.up = d.id)"""
_FLAT = "SELECT thread, 'comment' AS kind, id::VARCHAR AS id, {parent} AS parent, role AS author, sha256(text) AS text_sha256, depth, row_number() OVER (PARTITION BY thread ORDER BY path) - 1 AS pos FROM d WHERE NOT gone"


def _digests(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'comment'").select("thread", "kind", "id", "parent", "author", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "depth", "pos")


@query("nested_comments", _TREE.format(up="d.id") + _FLAT.format(parent="parent::VARCHAR"))
def nested_comments(spark, sf_dir):
    """G1: conversations nested into documents of any depth and taken apart again; every seventh turn from the third is declared deleted and stays its children's parent."""
    return _digests(trees.flatten(_documents(spark, sf_dir, "nested"), "nested"))


@query("listed_comments", _TREE.format(up="d.id") + _FLAT.format(parent="CASE WHEN parent = 0 AND id <> 5 THEN 'p' || thread WHEN id = 5 THEN '99' ELSE parent::VARCHAR END"))
def listed_comments(spark, sf_dir):
    """The same as listings, replies '' or a listing; comments carry their parents' names, the removed ones go."""
    return _digests(trees.flatten(_documents(spark, sf_dir, "listing"), "listing"))


@query("reply_trees", _TREE.format(up="d.live") + _FLAT.format(parent="parent::VARCHAR"))
def reply_trees(spark, sf_dir):
    """The same as posts with replies; a placeholder's children answer the post above it."""
    return _digests(trees.flatten(_documents(spark, sf_dir, "posts"), "posts"))


@query("listing_gaps", """SELECT conv_id AS thread, 'more' AS text, 'p' || conv_id AS parent, conv_id % 3 + 1 AS hidden, 'x,y' AS children, conv_id % 3 + 1 AS missing FROM conversations WHERE turn = 0
  UNION ALL SELECT conv_id, 'continue', '2', 0, NULL, NULL FROM conversations WHERE turn = 2""")
def listing_gaps(spark, sf_dir):
    """The gaps of the listings, and the replies that a thread hides."""
    rows = trees.flatten(_documents(spark, sf_dir, "listing"), "listing").where("kind = 'gap'")
    missing = trees.hidden_replies(rows)
    ids = F.when(F.col("children").isNotNull(), F.array_join("children", ","))
    return rows.join(missing, "thread", "left").select("thread", "text", "parent", "hidden", ids.alias("children"), F.when(F.col("text") == "more", F.col("missing")).alias("missing"))


@query("flattened_trees", f"""SELECT 'nested' AS shape, * FROM ({_TREE.format(up="d.id")} SELECT thread, count(*) AS n, max(depth) AS deepest FROM d WHERE NOT gone GROUP BY 1)
  UNION ALL SELECT 'listing', * FROM ({_TREE.format(up="d.id")} SELECT thread, count(*) AS n, max(depth) AS deepest FROM d WHERE NOT gone GROUP BY 1)
  UNION ALL SELECT 'posts', * FROM ({_TREE.format(up="d.live")} SELECT thread, count(*) AS n, max(depth) AS deepest FROM d WHERE NOT gone GROUP BY 1)""")
def flattened_trees(spark, sf_dir):
    """Comments and depth of each thread, from all three shapes."""
    out = None
    for shape in trees.SHAPES:
        rows = trees.flatten(_documents(spark, sf_dir, shape), shape).where("kind = 'comment'")
        rows = rows.groupBy("thread").agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).select(F.lit(shape).alias("shape"), "thread", "n", "deepest")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("preorder_caps", "SELECT conv_id AS thread, turn AS id FROM conversations WHERE turn < 5")
def preorder_caps(spark, sf_dir):
    """A prefix of the pre-order, five turns."""
    return _rows(spark, sf_dir).where("pos < 5").select("thread", "id")


@query("expanded_gaps", "SELECT conv_id AS thread, turn AS id FROM conversations WHERE turn <= 4")
def expanded_gaps(spark, sf_dir):
    """Threads known to turn 1 and grown in three rounds, each answer opening the next turn."""
    from ..sources.tables import checkpoints

    checkpoints(spark)
    rows = _rows(spark, sf_dir).select("thread", "id", "pos")
    more = rows.select("thread", "id", "pos", (F.col("id") + 1).alias("child")).join(rows.select("thread", F.col("id").alias("child")), ["thread", "child"], "left_semi")
    last = rows.join(more.select("thread", "id"), ["thread", "id"], "left_anti").withColumn("child", F.lit(None).cast("long"))
    more = more.select("thread", "id", "pos", "child").unionByName(last)
    return trees.expand_gaps(rows.where("id <= 1"), rows.where("id = 2"), more).select("thread", "id")
