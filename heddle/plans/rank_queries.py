"""Queries over rankings: two declared rankings of the pages for each of a hundred queries (query_id = page_id % 100)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking
from ..sources.tables import table
from .page_queries import _host, _key
from .registry import query, values

_A = "SELECT page_id % 100 AS query_id, row_number() OVER (PARTITION BY page_id % 100 ORDER BY page_id) AS rank, url FROM pages"
_B = "SELECT page_id % 100 AS query_id, row_number() OVER (PARTITION BY page_id % 100 ORDER BY length(html) DESC, page_id) AS rank, replace(url, 'http://', 'https://www.') AS url FROM pages"


def _rankings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages").withColumn("query_id", F.col("page_id") % 100)
    w = Window.partitionBy("query_id")
    a = pages.select("query_id", F.row_number().over(w.orderBy("page_id")).alias("rank"), "url")
    b = pages.withColumn("size", F.length("html")).select("query_id", F.row_number().over(w.orderBy(F.desc("size"), "page_id")).alias("rank"), F.replace("url", F.lit("http://"), F.lit("https://www.")).alias("url"))
    return a, b


_MERGED = f"""WITH u AS (SELECT *, 0 AS source FROM ({_A}) UNION ALL SELECT *, 1 AS source FROM ({_B})),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, {_key('url')} ORDER BY rank * 2 + source) AS nth FROM u),
m AS (SELECT query_id, url, source, row_number() OVER (PARTITION BY query_id ORDER BY rank * 2 + source) AS rank FROM k WHERE nth = 1)"""


@query("merged_rankings", f"{_MERGED} SELECT * FROM m WHERE rank <= 10")
def merged_rankings(spark, sf_dir):
    """Primary and backup in turn, each page once, ten at most."""
    return ranking.interleave(*_rankings(spark, sf_dir), limit=10).select("query_id", "rank", "url", "source")


@query("failover_outcomes", f"""{_MERGED}, n AS (SELECT query_id, count(*) AS n FROM ({_A}) GROUP BY 1), d AS (SELECT query_id, CASE WHEN query_id % 10 = 0 THEN 'replace' WHEN n < 3 THEN 'merge' ELSE 'keep' END AS action FROM n),
o AS (SELECT query_id, url, rank, 'keep' AS action FROM ({_A}) UNION ALL SELECT query_id, url, rank, 'replace' FROM ({_B}) UNION ALL SELECT query_id, url, rank, 'merge' FROM m)
SELECT query_id, action, count(*) AS n_results, min_by(url, rank) AS top FROM o JOIN d USING (query_id, action) GROUP BY 1, 2""")
def failover_outcomes(spark, sf_dir):
    """What a search answers after the decision (failures declared for every tenth query)."""
    from ..functions.classify import failover

    a, b = _rankings(spark, sf_dir)
    n = a.groupBy("query_id").agg(F.count("*").alias("n"))
    action = failover(F.col("n"), F.lit(0), F.col("query_id") % 10 == 0, F.lit(False), F.lit(False), 3)["action"]
    decided = n.select("query_id", action.alias("action"))
    merged = ranking.interleave(a, b).select("query_id", "url", "rank")
    offers = a.withColumn("action", F.lit("keep")).unionByName(b.withColumn("action", F.lit("replace"))).unionByName(merged.withColumn("action", F.lit("merge")))
    return offers.join(decided, ["query_id", "action"]).groupBy("query_id", "action").agg(F.count("*").alias("n_results"), F.min_by("url", "rank").alias("top"))


_HITS = "SELECT event_id, user_id AS query_id, list_distinct([event_type, (['click', 'view', 'error'])[event_id % 3 + 1]]) AS engines FROM events"


@query("engine_credits", f"SELECT engine, count(*) AS n_rows, sum((n = 1)::INT)::BIGINT AS n_sole FROM (SELECT unnest(engines) AS engine, len(engines) AS n FROM ({_HITS})) GROUP BY 1")
def engine_credits(spark, sf_dir):
    """A1, A5: rows of each credited engine (event types stand for engines), and rows that it alone gave."""
    other = F.get(F.array(F.lit("click"), F.lit("view"), F.lit("error")), (F.col("event_id") % 3).cast("int"))
    return ranking.engine_rows(table(spark, sf_dir, "events").select(F.array_distinct(F.array("event_type", other)).alias("engines")))


@query("single_engine_rows", "SELECT event_type AS engine, count(*) AS n_rows FROM events WHERE trim(event_type) <> '' GROUP BY 1")
def single_engine_rows(spark, sf_dir):
    """A2: rows by the single engine field; blanks are left out."""
    return table(spark, sf_dir, "events").where("trim(event_type) <> ''").groupBy(F.col("event_type").alias("engine")).agg(F.count("*").alias("n_rows"))


_FAILS = "SELECT user_id AS query_id, event_type AS engine, CASE WHEN event_id % 4 = 0 THEN 'CAPTCHA' WHEN event_id % 4 = 1 THEN 'Suspended: too many requests' WHEN event_id % 4 = 2 THEN '' ELSE 'boom' END AS message FROM events WHERE value > 60"


def _failures(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 4
    message = F.when(k == 0, "CAPTCHA").when(k == 1, "Suspended: too many requests").when(k == 2, "").otherwise("boom")
    return table(spark, sf_dir, "events").where("value > 60").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("engine"), message.alias("message"))


@query("failed_engines", f"SELECT engine, CASE message WHEN 'CAPTCHA' THEN 'captcha' WHEN '' THEN 'unknown' WHEN 'boom' THEN 'error' ELSE 'too_many_requests' END AS class, count(*) AS n FROM ({_FAILS}) GROUP BY 1, 2")
def failed_engines(spark, sf_dir):
    """A3: failures by engine and class (values over 60 stand for failures)."""
    return ranking.failed_engines(_failures(spark, sf_dir))


_ASKED = "user_id * 1000 + epoch_us(ts) // 86400000000 % 1000"
_NAMED = "event_type || '/' || (epoch_us(ts) // 86400000000 // 6)"


@query("silent_engines", f"""WITH e AS (SELECT {_ASKED} AS query_id, {_NAMED} AS engine, epoch_us(ts) AS us, event_id, value FROM events),
s AS (SELECT query_id, min(us) AS began FROM e GROUP BY 1), r AS (SELECT DISTINCT query_id, engine FROM e WHERE value < 2), n AS (SELECT query_id, engine FROM r UNION SELECT query_id, engine FROM e WHERE value > 60),
f AS (SELECT engine, min([began, query_id]) AS known FROM n JOIN s USING (query_id) GROUP BY 1)
SELECT engine, count(*) AS n_silent FROM s, f WHERE [began, s.query_id] >= known AND s.query_id IN (SELECT query_id FROM r) AND NOT EXISTS (SELECT 1 FROM n WHERE n.query_id = s.query_id AND n.engine = f.engine) GROUP BY 1""")
def silent_engines(spark, sf_dir):
    """Engines known by then that gave nothing and didn't fail (declared: a user's day is a search, a kind of event in six days an engine, values under 2 are rows, over 60 failures)."""
    day = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"
    events = table(spark, sf_dir, "events").withColumn("us", F.expr(day)).withColumn("day", F.expr("us div 86400000000"))
    events = events.select((F.col("user_id") * 1000 + F.col("day") % 1000).alias("query_id"), F.concat("event_type", F.lit("/"), F.expr("day div 6").cast("string")).alias("engine"), "us", "value")
    searches = events.groupBy("query_id").agg(F.min("us").alias("at"))
    return ranking.silent_engines(searches, events.where("value < 2"), events.where("value > 60"), 3_600_000_000)


_CRIT = [("view", 0), ("click", 1), ("nothere", 2)]


@query("degradations", f"""WITH q AS (SELECT DISTINCT user_id AS query_id FROM events), r AS (SELECT DISTINCT user_id AS query_id, event_type AS engine FROM events WHERE value < 8), f AS (SELECT query_id, engine, max(message) AS message FROM ({_FAILS}) GROUP BY 1, 2),
g AS (SELECT q.query_id, pos, CASE WHEN f.engine IS NOT NULL THEN c.engine || ': ' || CASE f.message WHEN 'CAPTCHA' THEN 'captcha' WHEN '' THEN 'unknown' WHEN 'boom' THEN 'error' ELSE 'too_many_requests' END WHEN r.engine IS NULL THEN c.engine || ': no results' END AS reason
  FROM q CROSS JOIN (SELECT * FROM {values(_CRIT, 'engine, pos')}) c LEFT JOIN r ON r.query_id = q.query_id AND r.engine = c.engine LEFT JOIN f ON f.query_id = q.query_id AND f.engine = c.engine)
SELECT query_id, coalesce(arg_min(reason, pos) FILTER (reason IS NOT NULL), '') AS reason FROM g GROUP BY 1""")
def degradations(spark, sf_dir):
    """The first critical engine missing from each search."""
    events = table(spark, sf_dir, "events")
    rows = events.where("value < 8").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("engine"))
    return ranking.degradation([e for e, _ in _CRIT], rows, _failures(spark, sf_dir), events.select(F.col("user_id").alias("query_id")).distinct())


@query("host_lists", f"""WITH h AS (SELECT {_host('url')} AS host, page_id, url, row_number() OVER (PARTITION BY {_host('url')} ORDER BY page_id) AS rank, count(*) OVER (PARTITION BY {_host('url')}) AS n FROM pages)
SELECT host, rank, CASE WHEN rank <= 3 THEN url ELSE '… ' || (n - 3) || ' more' END AS url FROM h WHERE rank <= 4""")
def host_lists(spark, sf_dir):
    """Three URLs of each host and how many more there are."""
    from ..functions import urls

    pages = table(spark, sf_dir, "pages").select(urls.hostname(F.col("url")).alias("host"), "page_id", "url")
    return ranking.with_rest(pages, "host", ["page_id"], "url", 3)


@query("ranked_items", """SELECT doc_id, coalesce(item_id, 1 + (SELECT count(*) FROM benchmark)) AS rank, row_number() OVER (PARTITION BY source ORDER BY coalesce(item_id, 1 + (SELECT count(*) FROM benchmark)), doc_id) AS pos FROM documents LEFT JOIN benchmark ON doc_id = item_id * 3""")
def ranked_items(spark, sf_dir):
    """Rows put in an outside ranking's order, those without a rank last, in their own order, in each source."""
    ranks = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("doc_id"), "item_id")
    last = ranks.count() + 1
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(ranks, "doc_id", "left").select("doc_id", F.coalesce("item_id", F.lit(last)).alias("rank"), "source")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("source").orderBy("rank", "doc_id"))).drop("source")
