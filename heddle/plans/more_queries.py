"""Queries over options, predicates and assembled documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import options
from ..operators import documents
from ..sources.tables import table
from .registry import query, spread, spread_sql

_OPTS = [(1, "top", "day", None, None), (2, "bogus", "", 0, False), (3, "qa", "decade", 900, True), (4, "new", "year", 20, None)]


@query("request_options", f"""SELECT event_id, sort IN ({', '.join(f"'{s}'" for s in options.THREAD_SORTS)}) AS sort_ok, span IN ('', 'day', 'week', 'month', 'year') AS range_ok, least(coalesce(n, 50), 500) AS n, coalesce(deep, true) AS deep FROM {spread_sql('(SELECT event_id FROM events)', 'event_id', _OPTS, 'no, sort, span, n, deep')}""")
def request_options(spark, sf_dir):
    """requests' options (declared by event_id) over the defaults."""
    c = F.col
    rows = spread(table(spark, sf_dir, "events").select("event_id"), "event_id", _OPTS, "no int, sort string, span string, n int, deep boolean")
    return rows.select("event_id", options.valid_sort(c("sort")).alias("sort_ok"), options.valid_range(c("span")).alias("range_ok"), options.option(c("n"), 50, 500).alias("n"), options.option(c("deep"), True).alias("deep"))


@query("cacheable_documents", "SELECT lang, count(CASE WHEN coalesce(text, '') <> '' AND doc_id % 5 NOT IN (1, 2, 3) THEN 1 END) AS n_cacheable, count(*) AS n FROM documents GROUP BY lang")
def cacheable_documents(spark, sf_dir):
    """Documents that may be cached (partial, fallback and error marks declared by doc_id)."""
    k = F.col("doc_id") % 5
    mark = F.when(k == 1, F.create_map(F.lit("partial"), F.lit("true"))).when(k == 2, F.create_map(F.lit("fallback_from"), F.lit("reddit"))).when(k == 3, F.create_map(F.lit("error"), F.lit("true"))).otherwise(F.create_map(F.lit("content_type"), F.lit("markdown")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(options.cacheable(F.col("text"), mark)).alias("n_cacheable"), F.count("*").alias("n"))


_REFUSE = [(1, True, False, "captcha", True), (2, False, True, "error", False), (3, False, False, "captcha", True), (4, False, False, "captcha", False), (5, False, False, "timeout", True)]


@query("fallback_refusals", f"""SELECT event_id, CASE WHEN final THEN 'final' WHEN explicit THEN 'format' WHEN kind IN ('http_429', 'http_403', 'captcha', 'bot_block', 'quota_exhausted') AND same THEN 'same_host_block' ELSE '' END AS refused,
  NOT final AND kind IN ('http_403', 'http_429', 'captcha', 'bot_block', 'upstream_error') AS next_method FROM {spread_sql('(SELECT event_id FROM events)', 'event_id', _REFUSE, 'no, final, explicit, kind, same')}""")
def fallback_refusals(spark, sf_dir):
    """Whether a browser or another method may follow a failure (declared by event_id)."""
    c = F.col
    rows = spread(table(spark, sf_dir, "events").select("event_id"), "event_id", _REFUSE, "no int, final boolean, explicit boolean, kind string, same boolean")
    return rows.select("event_id", options.fallback_refused(c("final"), c("explicit"), c("kind"), c("same")).alias("refused"), options.next_method(c("kind"), c("final")).alias("next_method"))


@query("binary_files", "SELECT doc_id, doc_id % 3 <> 0 AS is_binary FROM documents")
def binary_files(spark, sf_dir):
    """Texts as bytes, some with a zero byte or a broken character put in front (declared by doc_id)."""
    k = F.col("doc_id") % 3
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    body = F.when(k == 1, F.concat(F.lit(b"a\x00"), raw)).when(k == 2, F.concat(F.lit(b"\xff\xfe"), raw)).otherwise(raw)
    return table(spark, sf_dir, "documents").select("doc_id", options.is_binary(body).alias("is_binary"))


_PAGES = [(1, "Verify you are human", 200), (2, "r/x is a private community", 200), (3, "There’s nothing here", 200), (4, "x", 410), (5, "x", 403), (6, "x", 429), (7, "x", 502), (8, "x", 200), (9, "This community was banned", 404)]


@query("missing_pages", f"""SELECT page_id, CASE WHEN contains(lower(body), 'verify you are human') THEN 'captcha' WHEN regexp_matches(lower(body), 'private community|quarantined|has been banned|was banned') THEN 'http_403'
  WHEN status IN (404, 410) OR regexp_matches(replace(lower(body), '’', ''''), 'page not found|community not found|there''s nothing here|nobody on reddit goes by that name|this community doesn''t exist') THEN 'not_found'
  WHEN status = 403 THEN 'http_403' WHEN status = 429 THEN 'http_429' WHEN status >= 500 THEN 'upstream_error' ELSE 'layout' END AS kind FROM (SELECT page_id, said || html AS body, status FROM {spread_sql('pages', 'page_id', _PAGES, 'no, said, status')})""")
def missing_pages(spark, sf_dir):
    """Rendered pages that hold no post (what stands before each page's HTML, and its status, declared by page_id)."""
    rows = spread(table(spark, sf_dir, "pages"), "page_id", _PAGES, "no int, said string, status int").withColumn("body", F.concat("said", "html"))
    return rows.select("page_id", options.missing_page(F.col("body"), F.col("status")).alias("kind"))


_FAILS = [(1, None, False, False, False), (2, "captcha", True, True, True), (3, None, True, True, False), (4, None, False, True, True), (5, None, False, True, False)]


@query("failure_reasons", f"SELECT event_id, CASE WHEN NOT failed THEN 'ok' ELSE coalesce(kind, CASE WHEN cancelled THEN 'canceled' END, CASE WHEN late THEN 'timeout' END, 'error') END AS reason FROM {spread_sql('(SELECT event_id FROM events)', 'event_id', _FAILS, 'no, kind, cancelled, failed, late')}")
def failure_reasons(spark, sf_dir):
    """What a call (declared by event_id) ended with."""
    c = F.col
    rows = spread(table(spark, sf_dir, "events").select("event_id"), "event_id", _FAILS, "no int, kind string, cancelled boolean, failed boolean, late boolean")
    return rows.select("event_id", options.reason_of(c("kind"), c("cancelled"), c("late"), c("failed")).alias("reason"))


@query("route_labels", "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1")
def route_labels(spark, sf_dir):
    """Bounded labels."""
    return table(spark, sf_dir, "events").groupBy(options.route_label(F.col("event_type"), ("view", "click")).alias("label")).agg(F.count("*").alias("n"))


#: Labels of clients and what their names hold.
_CLIENTS = (("opencode", ("opencode",)), ("openwebui", ("open-webui", "openwebui", "open webui")), ("cursor", ("cursor",)))
_CALLERS = [("OpenCode/1.2", None, None), (None, "open webui", "cursor"), ("", "", "Mozilla/5.0 Cursor/3"), (None, None, None), ("curl", "python", "wget"), ("unknown", None, "Open-WebUI bot opencode"), ("my cursor for opencode", "", "")]


def _label_sql(c: str) -> str:
    return f"CASE WHEN contains(lower({c}), 'opencode') THEN 'opencode' WHEN regexp_matches(lower({c}), 'open[- ]?webui') THEN 'openwebui' WHEN contains(lower({c}), 'cursor') THEN 'cursor' END"


@query("client_labels", f"SELECT coalesce({_label_sql('asked')}, {_label_sql('session')}, {_label_sql('agent')}, 'other') AS client, event_type, count(*) AS n FROM {spread_sql('(SELECT event_id, event_type FROM events)', 'event_id', _CALLERS, 'asked, session, agent')} GROUP BY ALL")
def client_labels(spark, sf_dir):
    """Bounded labels of callers by what the request, its session or its user agent says (declared by event_id)."""
    rows = spread(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", _CALLERS, "asked string, session string, agent string")
    return rows.groupBy(options.client_label([F.col("asked"), F.col("session"), F.col("agent")], _CLIENTS).alias("client"), "event_type").agg(F.count("*").alias("n"))


@query("reply_exclusion", "SELECT conv_id, turn FROM conversations WHERE NOT (conv_id, turn) IN (SELECT (conv_id, turn) FROM conversations WHERE role = 'assistant')")
def reply_exclusion(spark, sf_dir):
    """Replies that are not in the thread already (declared: the assistant's turns are)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return turns.select("conv_id", "turn").join(turns.where("role = 'assistant'"), ["conv_id", "turn"], "left_anti")


@query("before_and_after", "SELECT url, count(prev) AS n_pairs, count(CASE WHEN size > prev THEN 1 END) AS n_grown FROM (SELECT url, length(html) AS size, lag(length(html)) OVER (PARTITION BY url ORDER BY page_id) AS prev FROM pages) GROUP BY 1")
def before_and_after(spark, sf_dir):
    """Each run's result beside the one before it, by URL (declared: a later row of a URL is a later run)."""
    pages = table(spark, sf_dir, "pages").select("url", "page_id", F.length("html").alias("size"))
    both = pages.withColumn("prev", F.lag("size").over(Window.partitionBy("url").orderBy("page_id")))
    return both.groupBy("url").agg(F.count("prev").alias("n_pairs"), F.count_if(F.col("size") > F.col("prev")).alias("n_grown"))


@query("lenient_json", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def lenient_json(spark, sf_dir):
    """Fields of JSON text; what doesn't parse is null, unknown fields are left out."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


_NL = "chr(10)"
_PLURAL = "{0} || ' {1}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END"
_QUOTED = "array_to_string(list_transform(string_split({0}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '\\S') THEN '> ' || x ELSE '>' END), chr(10))"
_POLL_SQL = "'**Poll** (' || {0} || ' vote' || CASE WHEN {0} = 1 THEN '' ELSE 's' END || ', final results):' || chr(10) || '- Yes: 33.3% (1 vote)' || chr(10) || '- No: 66.7% (2 votes)'"


@query("rendered_posts", f"""WITH t AS (SELECT conv_id AS id, turn, role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT id, string_agg(chr(10) || {_QUOTED.format("'@' || role || ' · https://x.com/' || role || '/status/' || id || '-' || turn || CASE WHEN text <> '' THEN chr(10) || chr(10) || text ELSE '' END || CASE WHEN turn % 2 = 1 THEN chr(10) || chr(10) || '(quoting https://x.com/q/status/9)' ELSE '' END")} || chr(10), '' ORDER BY turn) AS above FROM t WHERE turn IN (1, 2) AND id % 3 = 0 GROUP BY id),
c AS (SELECT id, count(*) AS n, string_agg(chr(10) || turn + 1 || '. ' || CASE WHEN turn = 0 THEN '(the linked post, above)' WHEN turn = 2 THEN '[gone]' WHEN turn % 4 = 3 THEN '(no text)' ELSE array_to_string(list_transform(string_split(text || chr(10) || chr(10) || 'Link: https://c', chr(10)), lambda x, i: CASE WHEN i = 1 OR x = '' THEN x ELSE repeat(' ', length((turn + 1)::VARCHAR) + 2) || x END), chr(10)) END || chr(10), '' ORDER BY turn) AS chain FROM t WHERE id % 3 = 1 GROUP BY id),
u AS (SELECT id, count(*) AS n, string_agg('- ' || array_to_string(list_transform(string_split('@' || role || CASE WHEN role = 'user' THEN ' [author]' ELSE '' END || ' (' || {_PLURAL.format('(turn % 4)', 'like')} || '): ' || array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')), chr(10)) || CASE WHEN turn % 3 = 0 THEN ' [gif]' ELSE '' END
  || CASE WHEN turn % 5 = 0 THEN ' (quoting @q (Q): ' || (SELECT CASE WHEN length(o) > 200 THEN left(o, 200) || '…' ELSE o END FROM (SELECT trim(regexp_replace(text, '[\\s\\x{{85}}\\x{{A0}}]+', ' ', 'g')) AS o)) || ')' ELSE '' END, chr(10)), lambda x, i: CASE WHEN i = 1 OR x = '' THEN x ELSE '  ' || x END), chr(10)) || chr(10), '' ORDER BY turn) AS under FROM t WHERE turn > 2 AND id % 3 <> 1 GROUP BY id),
q AS (SELECT id, max_by(text, turn) AS text FROM t WHERE role = 'assistant' GROUP BY id),
b AS (SELECT t.id, t.text, concat_ws(chr(10) || chr(10), nullif(t.text, ''), '[video, ' || (t.id % 90 + 1) // 60 || ':' || lpad(((t.id % 90 + 1) % 60)::VARCHAR, 2, '0') || ': a clip] [image]',
  CASE WHEN t.id % 5 = 4 THEN '> [quoted post unavailable: deleted]' WHEN q.id IS NOT NULL THEN 'Quoting:' || chr(10) || chr(10) || {_QUOTED.format("'@bot · 2026-01-01 · https://x.com/bot/status/q' || t.id || chr(10) || chr(10) || q.text || CASE WHEN t.id % 4 = 1 THEN chr(10) || chr(10) || " + _POLL_SQL.format('(t.id)') + " ELSE '' END")} END,
  CASE WHEN t.id % 4 = 0 THEN {_POLL_SQL.format('(t.id + 1)')} END, CASE WHEN t.id % 7 = 0 THEN '**Community note:** note ' || t.id END, CASE t.id % 4 WHEN 1 THEN '**Link:** https://c' WHEN 2 THEN '**Link:** [C](https://c)' END) AS body FROM t LEFT JOIN q USING (id) WHERE turn = 0)
SELECT id, regexp_replace('@user (A User) · 2026-01-01 · https://x.com/user/status/' || id || '-0 · ' || {_PLURAL.format('(id % 3)', 'like')} || CASE WHEN id % 2 > 0 THEN ' · 1 repost' ELSE '' END || ' · 2 replies' || CASE WHEN id % 9 > 0 THEN ' · ' || {_PLURAL.format('(id % 9)', 'view')} ELSE '' END || chr(10)
  || CASE WHEN id % 6 = 0 THEN chr(10) || '**Text truncated:** only the first ~275 characters of this post were available (syndication fallback).' || chr(10) ELSE '' END || CASE WHEN above IS NOT NULL THEN chr(10) || '**In reply to:**' || chr(10) || above ELSE '' END || CASE WHEN body <> '' THEN chr(10) || body || chr(10) ELSE '' END
  || CASE WHEN id % 8 = 0 THEN chr(10) || '## Article: A' || chr(10) || chr(10) || 'text' || chr(10) ELSE '' END || CASE WHEN c.n > 0 THEN chr(10) || '## Thread by @user (' || c.n || ' posts)' || chr(10) || chain ELSE '' END || CASE WHEN u.n > 0 THEN chr(10) || '## Replies (' || u.n || ' of ' || greatest(2, u.n) || ')' || chr(10) || chr(10) || under ELSE '' END,
  '^[\\s\\x{{85}}\\x{{A0}}]+|[\\s\\x{{85}}\\x{{A0}}]+$', '', 'g') || chr(10) AS markdown FROM b LEFT JOIN a USING (id) LEFT JOIN c USING (id) LEFT JOIN u USING (id)""")
def rendered_posts(spark, sf_dir):
    """Conversations as posts with all attachments (declared by conv_id and turn): parents, quotes, polls, cards, notes, articles, self-threads and replies."""
    from ..operators.posts import post, render_posts

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"))
    n, t = F.col("id"), F.col("pos")
    own = F.concat(n.cast("string"), F.lit("-"), t.cast("string"))
    clip = F.struct(F.lit("video").alias("kind"), F.lit("a  clip").alias("alt"), (n % 90 + 0.5).alias("seconds"))
    image = F.struct(F.lit("image").alias("kind"), F.lit(" ").alias("alt"), F.lit(9.0).alias("seconds"))
    choices = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(v).cast("long").alias("votes"), F.lit(v * 100 / 3).alias("percent")) for x, v in (("Yes", 1), ("No", 2))])
    poll = lambda total: F.struct(choices.alias("choices"), total.alias("total"), F.lit("final results").alias("status"))
    card = F.when(n % 4 == 1, F.struct(F.lit("").alias("title"), F.lit("https://c").alias("url"))).when(n % 4 == 2, F.struct(F.lit("C").alias("title"), F.lit("https://c").alias("url")))
    said = turns.where("role = 'assistant'").groupBy("id").agg(F.max_by("text", "pos").alias("quoted"))
    quote = post(id=F.concat(F.lit("q"), n.cast("string")), handle=F.lit("bot"), created=F.lit("2026-01-01"), text=F.col("quoted"), poll=F.when(n % 4 == 1, poll(n)))
    main = post(id=own, handle=F.lit("user"), name=F.lit("A User"), created=F.lit("2026-01-01"), text=F.col("text"), likes=n % 3, reposts=n % 2, replies=F.lit(2), views=n % 9, media=F.array(clip, image), poll=F.when(n % 4 == 0, poll(n + 1)), card=card, note=F.when(n % 7 == 0, F.concat(F.lit("note "), n.cast("string"))))
    posts = turns.where("pos = 0").join(said, "id", "left").select(
        "id", main.alias("post"), F.when((n % 5 != 4) & F.col("quoted").isNotNull(), quote).alias("quote"), F.when(n % 5 == 4, "deleted").alias("quote_gone"), F.when(n % 8 == 0, F.struct(F.lit("A").alias("title"), F.lit("text").alias("markdown"))).alias("article"), F.when(n % 6 == 0, "syndication").alias("cut_by")
    )
    quoting = F.when(t % 2 == 1, F.struct(F.lit("q").alias("handle"), F.lit("9").alias("id")))
    parents = turns.where((n % 3 == 0) & t.isin(1, 2)).select("id", "pos", post(id=own, handle=F.col("role"), text=F.col("text"), quoting=quoting).alias("post"))
    link = F.struct(F.lit("").alias("title"), F.lit("https://c").alias("url"))
    item = post(id=own, handle=F.lit("user"), text=F.when(t % 4 != 3, F.col("text")), card=F.when(t % 4 != 3, link), unavailable=F.when(t == 2, "gone"))
    threads = turns.where(n % 3 == 1).select("id", "pos", item.alias("post"), post().alias("quote")).withColumn("quote", F.when(F.lit(False), F.col("quote")))
    gif = F.when(t % 3 == 0, F.array(F.struct(F.lit("gif").alias("kind"), F.lit("").alias("alt"), F.lit(0.0).alias("seconds"))))
    replies = turns.where((t > 2) & (n % 3 != 1)).select("id", "pos", post(id=own, handle=F.col("role"), text=F.col("text"), likes=t % 4, media=gif).alias("post"), (F.col("role") == "user").alias("by_author"), F.when(t % 5 == 0, post(handle=F.lit("q"), name=F.lit("Q"), text=F.col("text"))).alias("quote"))
    return render_posts(posts, parents, threads, replies)


_SHORT = "CASE WHEN length({0}) > {1} THEN rtrim(left({0}, {1})) || '…' ELSE {0} END"
_WHY = r"array_to_string(list_transform(string_split('# Why' || chr(10) || text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^#{1,6} ') THEN repeat('#', least(6, length(regexp_extract(x, '^(#{1,6}) ', 1)) + 2)) || substr(x, length(regexp_extract(x, '^(#{1,6}) ', 1)) + 1) ELSE x END), chr(10))"


@query("rendered_pulls", f"""WITH RECURSIVE t AS (SELECT conv_id AS id, turn AS pos, role, text, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
b(id, k, used, kept) AS (SELECT DISTINCT id, 0::BIGINT, 0::BIGINT, true FROM t UNION ALL SELECT t.id, t.k, CASE WHEN used + size <= 1500 THEN used + size ELSE used END, used + size <= 1500 FROM b JOIN t ON t.id = b.id AND t.k = b.k + 1),
l AS (SELECT id, count(*) AS n, string_agg('- f' || pos || CASE WHEN kept THEN {_NL} || '```diff' || {_NL} || text || {_NL} || '```' ELSE '' END, {_NL} ORDER BY pos) AS files, string_agg('- ' || left(sha1(text), 7) || ' ' || string_split(text, {_NL})[1], {_NL} ORDER BY pos) AS commits,
  string_agg('- @' || role || ': approved', {_NL} ORDER BY pos) AS reviews, string_agg('- @' || role || ': ' || replace({_SHORT.format('text', 1500)}, {_NL}, {_NL} || '  '), {_NL} ORDER BY pos) AS comments FROM t JOIN b USING (id, k) GROUP BY id)
SELECT id, concat_ws({_NL} || {_NL}, '# A change (#' || id || ', open)', {_SHORT.format('why', 3000)}, '## Files (' || n || ')' || {_NL} || {_NL} || files, '## Commits (' || n || ')' || {_NL} || {_NL} || commits, '## Reviews (' || n || ')' || {_NL} || {_NL} || reviews, '## Comments (' || n || ')' || {_NL} || {_NL} || comments) AS markdown
FROM (SELECT id, {_WHY} AS why FROM t WHERE pos = 0) JOIN l USING (id)""")
def rendered_pulls(spark, sf_dir):
    """Conversations as pull requests (declared: turns are files, commits, reviews and comments)."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "role", "text")
    pulls = turns.where("pos = 0").select("id", F.lit("A change").alias("title"), F.lit("open").alias("state"), F.concat(F.lit("# Why\n"), "text").alias("body"))
    files = turns.select("id", "pos", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("name"), F.col("text").alias("patch"))
    commits = turns.select("id", "pos", F.sha1(F.encode("text", "UTF-8")).alias("sha"), F.col("text").alias("message"))
    return documents.render_pulls(pulls, files, commits, turns.select("id", "pos", F.col("role").alias("author"), F.lit("APPROVED").alias("state")), turns.select("id", "pos", F.col("role").alias("author"), "text"), diff_bytes=1500)


_WIRE = "conv_id::VARCHAR AS id, role AS handle, upper(role) AS name, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text"


@query("unified_posts", f"""WITH u AS (SELECT {_WIRE}, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 7 END AS likes, 'fx' AS source, 0 AS o FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0
  UNION ALL SELECT {_WIRE}, conv_id % 11, 'syndication', 1 FROM conversations WHERE turn = 1 UNION ALL SELECT {_WIRE}, turn, 'vx', 2 FROM conversations WHERE turn = 2)
SELECT id, arg_min(handle, o) AS handle, arg_min(name, o) AS name, replace(replace(replace(arg_min(text, o), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text, arg_min(coalesce(likes, 0), o)::BIGINT AS likes, arg_min(source, o) AS source FROM u GROUP BY id""")
def unified_posts(spark, sf_dir):
    """three wire schemas as one (declared: turn 0 comes from the first source but for every third conversation, turns 1 and 2 from the others)."""
    turns = table(spark, sf_dir, "conversations")
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def source(rows, at, likes):
        said = {"id": F.col("conv_id").cast("string"), "handle": F.col("role"), "name": F.upper("role"), "text": escaped, "likes": likes}
        return rows.select(*[said[f[0]].alias(f[at]) for f in documents.POST_FIELDS])

    c = F.col("conv_id")
    fx = source(turns.where((F.col("turn") == 0) & (c % 3 != 0)), 1, F.when(c % 5 != 0, c % 7))
    return documents.unify_posts(fx, source(turns.where("turn = 1"), 2, c % 11), source(turns.where("turn = 2"), 3, F.col("turn")))


@query("article_pages", """WITH b AS (SELECT conv_id, turn, turn % 6 AS k, CASE WHEN length(text) >= 3 AND turn % 6 <> 5 THEN '[' || left(text, 3) || '](https://example.com/)' || substr(text, 4) ELSE text END AS t, text FROM conversations),
l AS (SELECT conv_id, turn, k IN (1, 2) AS item, CASE WHEN k = 5 THEN '[video: a clip] [image]' WHEN trim(t) = '' THEN '' WHEN k = 0 THEN '## ' || t WHEN k IN (1, 2) THEN '- ' || t WHEN k = 3 THEN '> ' || replace(t, chr(10), chr(10) || '> ') ELSE t END AS line FROM b WHERE text IS NOT NULL),
s AS (SELECT *, lag(item) OVER w AS before FROM l WHERE line <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN item AND before THEN chr(10) ELSE chr(10) || chr(10) END || line, '' ORDER BY turn) AS markdown FROM s GROUP BY conv_id""")
def article_pages(spark, sf_dir):
    """conversations as articles (declared by turn: headings, list items, quotes, paragraphs, each beginning with a link, and media)."""
    from ..functions.articles import article_markdown

    t = F.col("turn")
    kinds = F.array(*[F.lit(k) for k in ("header-one", "unordered-list-item", "unordered-list-item", "blockquote", "unstyled", "atomic")])
    span = F.array(F.struct(F.lit(0).alias("offset"), F.lit(3).alias("length"), F.when(t % 6 == 5, 2).otherwise(1).alias("key")))
    block = F.struct("turn", F.get(kinds, (t % 6).cast("int")).alias("type"), "text", span.alias("entityRanges"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    entities = F.expr("""array(named_struct('key', '1', 'value', named_struct('type', 'LINK', 'data', named_struct('url', 'https://example.com/', 'mediaItems', cast(null AS array<struct<mediaId: string>>)))),
      named_struct('key', '2', 'value', named_struct('type', 'MEDIA', 'data', named_struct('url', cast(null AS string), 'mediaItems', array(named_struct('mediaId', 'm1'), named_struct('mediaId', 'm2'))))))""")
    media = F.expr("array(named_struct('media_id', 'm1', 'media_info', named_struct('__typename', 'ApiVideo', 'alt_text', 'a  clip')))")
    return docs.select("conv_id", article_markdown(F.to_json(F.struct("blocks", entities.alias("entityMap"), media.alias("mediaEntities")))).alias("markdown"))


#: What READMEs begin with, by conv_id, and what becomes of it.
_READMES = [
    ("<p align=\"center\"><img src=x></p>\n<h1 align=center>The\n <b>Tool</b></h1>\n", "# The Tool\n\n"), ("[![ci](https://img.shields.io/x)](https://ci)\n![shot](docs/shot.png)\n", "![shot](https://raw.githubusercontent.com/o/r/main/sub/docs/shot.png)\n"),
    ("<!-- a\nb -->See [guide](../GUIDE.md#use) and [top](#top), [abs](https://x/y)\n", "See [guide](https://github.com/o/r/blob/main/GUIDE.md#use) and [top](#top), [abs](https://x/y)\n"),
    ("```sh\n<b>kept</b> [a](b)\n```\n<a href=\"/LICENSE\">The\nlicense</a><br/>x   \n\n\n\n", "```sh\n<b>kept</b> [a](b)\n```\n[The license](https://github.com/o/r/blob/main/LICENSE)\nx\n\n"), ("[ref]: ./a/../b.svg?raw=1\n[^1]: note\n<td src=\"i.gif\">\n", "[ref]: https://raw.githubusercontent.com/o/r/main/sub/b.svg?raw=1\n[^1]: note\n<td src=\"https://raw.githubusercontent.com/o/r/main/sub/i.gif\">\n"),
]


@query("readme_texts", f"""SELECT conv_id, sha256(regexp_replace(said || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[ \\t]+$', '')), chr(10)), '^\\s+|\\s+$', '', 'g')) AS text_sha256
  FROM {spread_sql("(SELECT * FROM conversations WHERE turn = 0)", "conv_id", _READMES, "head, said")}""")
def readme_texts(spark, sf_dir):
    """Turn 0 of each conversation as a README (what stands before it is declared by conv_id, with what becomes of it in the SQL)."""
    from ..functions.markdown import clean_markdown

    rows = spread(table(spark, sf_dir, "conversations").where("turn = 0"), "conv_id", _READMES, "head string, said string")
    text = clean_markdown(F.concat("head", F.coalesce("text", F.lit(""))), F.lit("o/r"), F.lit("main"), F.lit("sub"))
    return rows.select("conv_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))
