"""Queries over documents put together from tables: conversations and pages stand for a code host's and a question site's answers, by declared rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import repository
from ..sources.tables import table
from .page_queries import _host, _p
from .registry import query

_NL = "chr(10)"


def _trim(x: str) -> str:
    return rf"regexp_replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"


def _demote(x: str, by: int) -> str:
    for level in range(6, 0, -1):
        x = rf"regexp_replace({x}, '(?m)^{'#' * level}(\s)', '{'#' * min(6, level + by)}\1', 'g')"
    return x


def _line(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def _count(n: str, one: str, many: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '1 {one}' ELSE {n} || ' {many}' END"


def _bytes(x: str) -> str:
    return f"octet_length(encode({x}))"


def _excerpt(x: str, most: int) -> tuple[str, str]:
    """(text, whether it is cut) of texts without fences."""
    whole = _trim(x)
    end = "CASE " + " ".join(f"WHEN substr(hex(encode({whole})), {2 * (most - b) + 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN {most - b}" for b in range(4)) + " END"
    head = f"decode(unhex(left(hex(encode({whole})), 2 * ({end}))))"
    last = f"string_split({head}, {_NL})[-1]"
    cut = f"CASE WHEN {_bytes(head)} - {_bytes(last)} - 1 > {most // 2} THEN left({head}, length({head}) - length({last}) - 1) ELSE {head} END"
    return f"CASE WHEN {_bytes(whole)} <= {most} THEN {whole} ELSE {_trim(cut)} END", f"{_bytes(whole)} > {most}"


def _digest(rows: DataFrame, text: str = "markdown") -> DataFrame:
    return rows.select("id", F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"), F.length(text).alias("chars"))


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"))


_T = "(SELECT conv_id AS id, turn AS pos, role, coalesce(text, '') AS text FROM conversations)"
_OUT = "SELECT id, sha256(md) AS text_sha256, length(md) AS chars FROM"


@query("rendered_commits", rf"""WITH RECURSIVE t AS (SELECT *, 'f' || pos || '.py' AS name, CASE WHEN pos % 2 = 0 THEN 'added' ELSE 'modified' END AS status, CASE WHEN pos % 5 <> 4 THEN text END AS patch, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM {_T}),
b(id, k, used, kept) AS (SELECT DISTINCT id, 0::BIGINT, 0::BIGINT, true FROM t UNION ALL SELECT t.id, t.k, CASE WHEN used + {_bytes("coalesce(patch, '')")} <= 1500 THEN used + {_bytes("coalesce(patch, '')")} ELSE used END, used + {_bytes("coalesce(patch, '')")} <= 1500 FROM b JOIN t ON t.id = b.id AND t.k = b.k + 1),
f AS (SELECT id, count(*) AS n, sum(pos * 3)::BIGINT AS a, sum(pos)::BIGINT AS d, bool_or(NOT kept) AS cut, string_agg('- ' || name || ' (' || status || ', +' || pos * 3 || ' -' || pos || ')' || {_NL}, '' ORDER BY pos) AS files,
  string_agg(CASE WHEN kept AND coalesce(patch, '') <> '' THEN '--- ' || name || {_NL} || regexp_replace(patch, '\n+$', '') || {_NL} ELSE '' END, '' ORDER BY pos) AS diff FROM t JOIN b USING (id, k) GROUP BY id),
h AS (SELECT *, {_trim('text')} AS msg, substr(sha256(text), 1, 40) AS sha, CASE id % 3 WHEN 0 THEN 'octo' WHEN 1 THEN 'user' END AS login, CASE id % 4 WHEN 0 THEN 'GitHub' WHEN 1 THEN 'user' WHEN 2 THEN 'bot' ELSE '' END AS cm FROM {_T} WHERE pos = 0),
m AS (SELECT *, string_split(msg, {_NL})[1] AS first FROM h)
{_OUT} (SELECT id, '# o/r@' || left(sha, 7) || ': ' || {_line('first')} || {_NL} || {_NL} || '- Author: user' || CASE WHEN login <> 'user' THEN ' (' || login || ')' ELSE '' END || ', 2026-01-02' || {_NL} || CASE WHEN cm = 'bot' THEN '- Committer: bot, 2026-01-03' || {_NL} ELSE '' END || '- SHA: ' || sha || {_NL}
  || '- Changes: +' || a || ' -' || d || ' in ' || {_count('n', 'file', 'files')} || {_NL} || CASE WHEN {_trim('substr(msg, length(first) + 2)')} <> '' THEN {_NL} || '## Message' || {_NL} || {_NL} || {_trim('substr(msg, length(first) + 2)')} || {_NL} ELSE '' END
  || {_NL} || '## Files (' || n || ')' || {_NL} || {_NL} || files || CASE WHEN diff <> '' THEN {_NL} || '## Diff' || {_NL} || {_NL} || '```diff' || {_NL} || regexp_replace(diff, '\n+$', '') || {_NL} || '```' || {_NL} ELSE '' END
  || CASE WHEN cut THEN {_NL} || '[Some file patches omitted (diff budget spent); names and stats are complete.]' || {_NL} ELSE '' END AS md FROM m JOIN f USING (id))""".replace("CASE WHEN login <> 'user' THEN", "CASE WHEN coalesce(login, 'user') <> 'user' THEN"))
def rendered_commits(spark, sf_dir):
    """Conversations as commits (declared: turn 0 is the message, all turns are files)."""
    turns, n = _turns(spark, sf_dir), F.col("id")
    heads = turns.where("pos = 0").select(
        "id", F.lit("o/r").alias("repo"), F.substring(F.sha2(F.encode("text", "UTF-8"), 256), 1, 40).alias("sha"), F.col("text").alias("message"), F.lit("user").alias("author"), F.when(n % 3 == 0, "octo").when(n % 3 == 1, "user").alias("login"),
        F.lit("2026-01-02T03:04:05Z").alias("date"), F.when(n % 4 == 0, "GitHub").when(n % 4 == 1, "user").when(n % 4 == 2, "bot").otherwise("").alias("committer"), F.lit("2026-01-03T03:04:05Z").alias("committed"),
    )
    p = F.col("pos")
    files = turns.select("id", "pos", F.concat(F.lit("f"), p.cast("string"), F.lit(".py")).alias("name"), F.when(p % 2 == 0, "added").otherwise("modified").alias("status"), (p * 3).alias("additions"), p.alias("deletions"), F.when(p % 5 != 4, F.col("text")).alias("patch"))
    return _digest(repository.render_commits(heads, files, 1500))


_KB = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f', round_even({0} / 1024.0, 1)) || ' KB' ELSE printf('%.1f', round_even({0} / 1048576.0, 1)) || ' MB' END"


@query("rendered_trees", rf"""WITH e AS (SELECT {_host('url')} AS id, page_id, {_p('url', 3)} AS name, CASE page_id % 4 WHEN 0 THEN 'dir' WHEN 3 THEN 'symlink' ELSE 'file' END AS type, length(html) * (page_id % 3000) AS size FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY type <> 'dir', lower(name), page_id) AS nth, count(*) OVER (PARTITION BY id) AS n FROM e)
{_OUT} (SELECT id, '# o/r: ' || id || {_NL} || {_NL} || '- Ref: main' || {_NL} || {_NL} || '## Entries (' || max(n) || ')' || {_NL} || {_NL} || string_agg('- ' || CASE WHEN nth = 5 THEN '… ' || (n - 4) || ' more' WHEN type = 'dir' THEN name || '/' WHEN type = 'file' THEN name || ' (' || {_KB.format('size')} || ')' ELSE name || ' (' || type || ')' END || {_NL}, '' ORDER BY nth) AS md FROM k WHERE nth <= 5 GROUP BY id)""")
def rendered_trees(spark, sf_dir):
    """Pages as folders (declared: a host is a folder, its pages' paths are entries, four are shown)."""
    p = F.col("page_id")
    kind = F.when(p % 4 == 0, "dir").when(p % 4 == 3, "symlink").otherwise("file")
    rows = table(spark, sf_dir, "pages").select(urls.hostname(F.col("url")).alias("id"), p.alias("pos"), urls.path(F.col("url")).alias("name"), kind.alias("type"), (F.length("html") * (p % 3000)).alias("size"))
    folders = rows.select("id").distinct().select("id", F.lit("o/r").alias("repo"), F.col("id").alias("path"), F.lit("main").alias("ref"))
    return _digest(repository.render_trees(folders, rows, 4))


_REL = f"(SELECT *, 'v' || pos AS tag, CASE pos % 3 WHEN 0 THEN 'v' || pos WHEN 1 THEN 'Name  ' || pos END AS name, CASE WHEN pos % 4 <> 3 THEN '2026-02-0' || pos % 9 || 'T00:00:00Z' ELSE '' END AS published, CASE WHEN pos % 5 <> 2 THEN role ELSE '' END AS author, pos % 2 = 1 AS prerelease, pos % 5 = 4 AS draft, '# Notes' || chr(13) || chr(10) || text AS body, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS nth FROM (SELECT conv_id, conv_id AS id, turn AS pos, role, coalesce(text, '') AS text FROM conversations))"
_HEADING = f"tag || CASE WHEN {_line('name')} NOT IN ('', tag) THEN ', ' || {_line('name')} ELSE '' END || CASE WHEN published <> '' THEN ' (' || left(published, 10) || ')' ELSE '' END || {_NL}"
_FLAGS = f"CASE WHEN author <> '' OR prerelease OR draft THEN {_NL} || concat_ws(', ', CASE WHEN author <> '' THEN 'by ' || author END, CASE WHEN prerelease THEN 'pre-release' END, CASE WHEN draft THEN 'draft' END) || {_NL} ELSE '' END"
_NOTES, _CUT = _excerpt("body", 200)


def _releases(spark, sf_dir) -> DataFrame:
    p = F.col("pos")
    tag = F.concat(F.lit("v"), p.cast("string"))
    return _turns(spark, sf_dir).select(
        "id", (-p).alias("pos"), tag.alias("tag"), F.when(p % 3 == 0, tag).when(p % 3 == 1, F.concat(F.lit("Name  "), p.cast("string"))).alias("name"), F.when(p % 4 != 3, F.concat(F.lit("2026-02-0"), (p % 9).cast("string"), F.lit("T00:00:00Z"))).otherwise("").alias("published"),
        F.when(p % 5 != 2, F.col("role")).otherwise("").alias("author"), (p % 2 == 1).alias("prerelease"), (p % 5 == 4).alias("draft"), F.concat(F.lit("# Notes\r\n"), "text").alias("body"), F.concat(F.lit("https://h/"), tag).alias("url"),
    )


@query("rendered_release_lists", rf"""WITH l AS (SELECT id, string_agg({_NL} || '## ' || {_HEADING} || {_FLAGS} || {_NL} || {_demote(_NOTES, 2)} || {_NL} || CASE WHEN {_CUT} THEN {_NL} || '[Notes cut; full notes: https://h/' || tag || ']' || {_NL} ELSE '' END, '' ORDER BY nth) AS lines, count(*) AS n FROM {_REL} WHERE nth <= 3 GROUP BY id)
{_OUT} (SELECT id, '# o/r releases' || {_NL} || {_NL} || 'The ' || {_count('n', 'latest release', 'latest releases')} || ', newest first.' || {_NL} || lines AS md FROM l)""")
def rendered_release_lists(spark, sf_dir):
    """Conversations as lists of releases (declared: a turn is one), the three newest, 200 bytes of notes."""
    rows = _releases(spark, sf_dir)
    return _digest(repository.render_release_lists(rows.select("id").distinct().withColumn("repo", F.lit("o/r")), rows, 3, 200))


_BODY = _trim("body")


@query("rendered_releases", rf"""WITH a AS (SELECT id, string_agg('- ' || CASE WHEN nth = 3 THEN '… ' || (n - 2) || ' more' ELSE 'asset' || pos || ' (' || {_KB.format('(pos * 70001)')} || ', ' || {_count('pos', 'download', 'downloads')} || ')' END || {_NL}, '' ORDER BY nth) AS lines, max(n) AS n
  FROM (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY id) AS n FROM {_T} WHERE pos > 0) WHERE nth <= 3 GROUP BY id)
{_OUT} (SELECT r.id, '# o/r: ' || {_HEADING} || {_FLAGS} || CASE WHEN {_BODY} <> '' THEN {_NL} || {_demote(_BODY, 1)} || {_NL} ELSE '' END || CASE WHEN a.n > 0 THEN {_NL} || '## Assets (' || a.n || ')' || {_NL} || {_NL} || a.lines ELSE '' END AS md FROM {_REL} r LEFT JOIN a USING (id) WHERE r.pos = 0)""")
def rendered_releases(spark, sf_dir):
    """turn 0 of each conversation as a release, its later turns as assets, two of which are shown."""
    rows = _releases(spark, sf_dir).where("tag = 'v0'").withColumn("repo", F.lit("o/r"))
    p = F.col("pos")
    assets = _turns(spark, sf_dir).where("pos > 0").select("id", "pos", F.concat(F.lit("asset"), p.cast("string")).alias("asset"), (p * 70001).alias("size"), p.alias("downloads"))
    return _digest(repository.render_releases(rows, assets, 2))


@query("rendered_gists", rf"""WITH f AS (SELECT *, CASE pos % 5 WHEN 0 THEN 'n' || pos || '.md' WHEN 1 THEN 'n' || pos || '.py' WHEN 2 THEN 'LICENSE' || pos WHEN 3 THEN 'Dockerfile.' || pos ELSE 'n' || pos || '.xyz' END AS name FROM {_T}),
l AS (SELECT id, count(*) AS n, min(name) AS first, string_agg({_NL} || '## ' || name || {_NL} || {_NL} || CASE WHEN pos % 5 IN (0, 2) THEN {_trim('text')} || {_NL} ELSE '```' || CASE pos % 5 WHEN 1 THEN 'python' WHEN 3 THEN 'dockerfile' ELSE 'xyz' END || {_NL} || regexp_replace(text, '\n+$', '') || {_NL} || '```' || {_NL} END
  || CASE WHEN pos % 4 = 1 THEN {_NL} || '[File cut by GitHub at ' || {_KB.format(_bytes('text'))} || ' of ' || {_KB.format('(5000 * pos)')} || '; raw file: https://raw/' || pos || ']' || {_NL} ELSE '' END, '' ORDER BY name) AS files FROM f GROUP BY id)
{_OUT} (SELECT id, '# Gist: ' || CASE WHEN id % 3 = 0 THEN first ELSE 'a gist ' || id END || {_NL} || {_NL} || CASE WHEN id % 2 = 0 THEN '- Owner: octo' || {_NL} ELSE '' END || '- Created: 2026-01-01, updated: 2026-01-02' || {_NL} || '- Files: ' || n || {_NL} || files AS md FROM l)""")
def rendered_gists(spark, sf_dir):
    """conversations as gists (declared: a turn is a file of one of five kinds)."""
    p, n = F.col("pos"), F.col("id")
    num = p.cast("string")
    name = F.when(p % 5 == 0, F.concat(F.lit("n"), num, F.lit(".md"))).when(p % 5 == 1, F.concat(F.lit("n"), num, F.lit(".py"))).when(p % 5 == 2, F.concat(F.lit("LICENSE"), num)).when(p % 5 == 3, F.concat(F.lit("Dockerfile."), num)).otherwise(F.concat(F.lit("n"), num, F.lit(".xyz")))
    turns = _turns(spark, sf_dir)
    files = turns.select("id", name.alias("name"), F.col("text").alias("content"), F.lit("Text").alias("language"), (p % 4 == 1).alias("truncated"), (p * 5000).alias("size"), F.concat(F.lit("https://raw/"), num).alias("raw_url"))
    gists = turns.where("pos = 0").select("id", F.when(n % 3 != 0, F.concat(F.lit("a  gist "), n.cast("string"))).alias("description"), F.when(n % 2 == 0, "octo").alias("owner"), F.lit("2026-01-01T00:00:00Z").alias("created"), F.lit("2026-01-02T00:00:00Z").alias("updated"))
    return _digest(repository.render_gists(gists, files))


@query("rendered_files", rf"""WITH d AS (SELECT doc_id AS id, replace(coalesce(text, ''), '`', '') AS text FROM documents),
s AS (SELECT *, octet_length(encode(text)) AS size, decode(unhex(left(hex(encode(text)), 2000)), 'ignore') AS head FROM d),
k AS (SELECT *, CASE WHEN size <= 1000 THEN text WHEN regexp_matches(head, '(?s)^.+\n') THEN regexp_extract(head, '(?s)^(.+)\n', 1) ELSE head END AS kept, CASE WHEN regexp_matches(head, '(?s)^.+\n') THEN octet_length(encode(regexp_extract(head, '(?s)^(.+)\n', 1))) ELSE 1000 END AS cut FROM s)
{_OUT} (SELECT id, '# o/r: ' || CASE id % 3 WHEN 0 THEN 'a/b.py' WHEN 1 THEN 'README.md' ELSE 'x.go' END || {_NL} || {_NL} || '- Ref: main' || {_NL} || '- Size: ' || (size + CASE WHEN id % 7 = 6 THEN 2 ELSE 0 END) || ' bytes' || {_NL} || {_NL}
  || CASE WHEN id % 7 = 6 THEN 'Binary file, not shown.' || {_NL} ELSE CASE id % 3 WHEN 1 THEN {_trim('kept')} WHEN 0 THEN '```python' || {_NL} || regexp_replace(kept, '\n+$', '') || {_NL} || '```' ELSE '```go' || {_NL} || regexp_replace(kept, '\n+$', '') || {_NL} || '```' END
    || CASE WHEN size > 1000 THEN {_NL} || {_NL} || '[File cut at ' || cut || ' of ' || size || ' bytes.]' ELSE '' END END AS md FROM k)""")
def rendered_files(spark, sf_dir):
    """Texts as files of three kinds (declared by doc_id; every seventh is binary), cut at a line within 1000 bytes."""
    n = F.col("doc_id")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(n.alias("id"), F.lit("o/r").alias("repo"), F.when(n % 3 == 0, "a/b.py").when(n % 3 == 1, "README.md").otherwise("x.go").alias("path"), F.lit("main").alias("ref"), text.alias("text"))
    raw = F.encode("text", "UTF-8")
    files = rows.withColumn("body", F.when(F.col("id") % 7 == 6, F.concat(F.lit(b"a\x00"), raw)).otherwise(raw)).drop("text")
    return _digest(repository.render_files(files, 1000))


_TOP = f"(SELECT *, CASE WHEN pos % 3 = 0 THEN pos - 2 END AS under FROM {_T} WHERE pos > 0)"


@query("rendered_discussions", rf"""WITH t AS (SELECT *, '2026-03-0' || pos % 9 AS day FROM {_TOP}), h AS (SELECT id, text, CASE WHEN id % 2 = 0 THEN 2 END AS answer FROM {_T} WHERE pos = 0),
r AS (SELECT id, under AS pos, count(*) AS shown, string_agg({_NL} || '#### Reply by ' || role || ' (' || day || ')' || {_NL} || {_NL} || {_demote(_trim('text'), 5)} || {_NL}, '' ORDER BY pos) AS replies FROM t WHERE under IS NOT NULL GROUP BY id, under),
c AS (SELECT t.*, coalesce(r.replies, '') AS replies, coalesce(r.shown, 0) AS shown, coalesce(t.pos = h.answer, false) AS best FROM t JOIN h USING (id) LEFT JOIN r ON r.id = t.id AND r.pos = t.pos WHERE t.under IS NULL),
l AS (SELECT id, count(*) AS n, string_agg({_NL} || '### ' || role || ' (' || day || ', ' || {_count('pos', 'upvote', 'upvotes')} || ')' || CASE WHEN best THEN ': accepted answer, shown above' || {_NL} ELSE {_NL} || {_NL} || {_demote(_trim('text'), 4)} || {_NL} END || replies, '' ORDER BY pos) AS lines,
  max(CASE WHEN best THEN {_NL} || '## Accepted answer, by ' || role || ' (' || day || ')' || {_NL} || {_NL} || {_demote(_trim('text'), 3)} || {_NL} END) AS accepted, string_agg(CASE WHEN pos % 4 > shown THEN 'a comment by ' || role || ' shows ' || shown || ' of ' || pos % 4 || ' replies' END, '; ' ORDER BY pos) AS fewer FROM c GROUP BY id)
{_OUT} (SELECT h.id, '# ' || {_line('left(text, 30)')} || {_NL} || {_NL} || '- Discussion: o/r#' || h.id || ', category: Ideas' || {_NL} || '- Author: user, 2026-03-01, 1 upvote' || {_NL} || '- Answered: ' || CASE WHEN answer IS NULL THEN 'no' ELSE 'yes' END || {_NL} || '- Comments: ' || coalesce(n, 0) + h.id % 2 || {_NL}
  || CASE WHEN {_trim("'# T' || chr(10) || text")} <> '' THEN {_NL} || {_demote(_trim("'# T' || chr(10) || text"), 2)} || {_NL} ELSE '' END || coalesce(accepted, '') || CASE WHEN n > 0 THEN {_NL} || '## Comments' || {_NL} ELSE '' END || coalesce(lines, '')
  || CASE WHEN h.id % 2 = 1 OR fewer IS NOT NULL THEN {_NL} || '[Truncated: ' || concat_ws('; ', CASE WHEN h.id % 2 = 1 THEN 'showing ' || coalesce(n, 0) || ' of ' || coalesce(n, 0) + 1 || ' comments' END, fewer) || '.]' || {_NL} ELSE '' END AS md FROM h LEFT JOIN l USING (id))""")
def rendered_discussions(spark, sf_dir):
    """Conversations as discussions (declared: every third turn replies to the one two before, turn 2 is the answer of every second)."""
    turns = _turns(spark, sf_dir)
    p, n = F.col("pos"), F.col("id")
    day = F.concat(F.lit("2026-03-0"), (p % 9).cast("string"), F.lit("T00:00:00Z"))
    later = turns.where("pos > 0")
    comments = later.where(p % 3 != 0).select("id", "pos", p.alias("comment"), F.col("role").alias("author"), day.alias("created"), p.alias("upvotes"), F.col("text").alias("body"), (p % 4).alias("n_replies"))
    replies = later.where(p % 3 == 0).select("id", (p - 2).alias("comment"), "pos", F.col("role").alias("author"), day.alias("created"), F.col("text").alias("body"))
    counts = comments.groupBy("id").agg(F.count("*").alias("there"))
    heads = turns.where("pos = 0").join(counts, "id", "left").select(
        "id", F.lit("o/r").alias("repo"), n.alias("number"), F.substring("text", 1, 30).alias("title"), F.lit("Ideas").alias("category"), F.lit("user").alias("author"), F.lit("2026-03-01T00:00:00Z").alias("created"), F.lit(1).alias("upvotes"),
        F.when(n % 2 == 0, F.lit(2).cast("long")).alias("answer"), (F.coalesce("there", F.lit(0)) + n % 2).alias("n_comments"), F.concat(F.lit("# T\n"), "text").alias("body"),
    )
    return _digest(repository.render_discussions(heads, comments, replies))


_BARE = r"""{0} <> '' AND NOT regexp_matches({0}, '^[\s\x{{85}}\x{{A0}}]|[\s\x{{85}}\x{{A0}}]$|[:"\\\[\]{{}}\n\r\t{1}]') AND {0} NOT IN ('true', 'false', 'null') AND NOT regexp_matches({0}, '^-|^[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$')"""


def _toon(x: str, comma: bool = True) -> str:
    return f"CASE WHEN {_BARE.format(x, '|,' if comma else '')} THEN {x} ELSE to_json({x})::VARCHAR END"


@query("rendered_questions", rf"""WITH a AS (SELECT id, pos, text, (pos * 7) % 5 AS score, row_number() OVER (PARTITION BY id ORDER BY (pos * 7) % 5 DESC, pos) AS nth FROM {_T} WHERE pos > 0),
l AS (SELECT id, count(*) AS n, string_agg('  ' || pos || ',' || score || ',' || CASE WHEN pos = 3 THEN 'true' ELSE 'false' END || ',' || CASE WHEN pos % 2 = 0 THEN 'Ann & Bob' ELSE '"Ann, B"' END || ',' || CASE WHEN pos % 3 = 0 THEN '""' ELSE '"2023-11-14T22:13:2' || pos % 3 || 'Z"' END || ',' || {_toon('text')}, {_NL} ORDER BY nth) AS lines FROM a WHERE nth <= 3 GROUP BY id),
q AS (SELECT t.id, left(text, 25) || ' <' || t.id || '>' AS title, text, coalesce(n, 0) AS n, (SELECT count(*) FROM {_T} x WHERE x.id = t.id AND x.pos > 0) AS total, lines FROM {_T} t LEFT JOIN l USING (id) WHERE pos = 0)
{_OUT} (SELECT id, '# ' || {_line('title')} || {_NL} || {_NL} || 'question:' || {_NL} || '  title: ' || {_toon('title', False)} || {_NL} || '  site: stackoverflow.com' || {_NL} || '  score: ' || id % 9 || {_NL} || '  author: O''Neil' || {_NL} || '  asked: "2023-11-14T22:13:20Z"' || {_NL} || '  answers: ' || total || {_NL}
  || CASE WHEN id % 2 = 0 THEN '  accepted_answer: 3' || {_NL} ELSE '' END || '  body: ' || {_toon('text', False)} || {_NL} || CASE WHEN total > n THEN 'note: "answer list truncated: showing the top ' || n || ' of ' || total || ' answers by votes"' || {_NL} ELSE '' END
  || CASE WHEN n = 0 THEN 'answers: []' ELSE 'answers[' || n || ']{{id,score,accepted,author,created,body}}:' || {_NL} || lines END AS md FROM q)""")
def rendered_questions(spark, sf_dir):
    """Conversations as questions with their three best answers (declared: turns after the first are answers)."""
    turns = _turns(spark, sf_dir)
    p, n = F.col("pos"), F.col("id")
    answers = turns.where("pos > 0").select("id", p.alias("answer"), ((p * 7) % 5).alias("score"), (p == 3).alias("accepted"), F.when(p % 2 == 0, "Ann &amp; Bob").otherwise("Ann, B").alias("author"), F.when(p % 3 == 0, 0).otherwise(F.lit(1_700_000_000) + p % 3).alias("created"), F.col("text").alias("body"))
    counts = answers.groupBy("id").agg(F.count("*").alias("n_answers"))
    heads = turns.where("pos = 0").join(counts, "id", "left").select(
        "id", F.concat(F.replace(F.replace(F.substring("text", 1, 25), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(" &lt;"), n.cast("string"), F.lit("&gt;")).alias("title"), F.lit("stackoverflow.com").alias("site"), (n % 9).alias("score"), F.lit("O&#39;Neil").alias("author"),
        F.lit(1_700_000_000).alias("asked"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"), F.when(n % 2 == 0, 3).alias("accepted"), F.col("text").alias("body"),
    )
    return _digest(repository.render_questions(heads, answers, 3), "text")


_RBODY, _RCUT = _excerpt("'# Notes' || chr(10) || text", 150)


@query("rendered_repos", rf"""WITH h AS (SELECT *, left(text, 40) AS about FROM {_T} WHERE pos = 0)
{_OUT} (SELECT id, '# o/r' || id || {_NL} || {_NL} || CASE WHEN {_line('about')} <> '' THEN {_line('about')} || {_NL} || {_NL} ELSE '' END || CASE WHEN id % 3 > 0 THEN '- Topics: ' || CASE id % 3 WHEN 1 THEN 'a' ELSE 'a, b' END || {_NL} ELSE '' END || '- Stars: ' || id * 3 || ', forks: ' || id || ', open issues and PRs: ' || id % 4 || {_NL}
  || CASE WHEN id % 2 = 0 THEN '- Language: Go' || {_NL} ELSE '' END || CASE id % 4 WHEN 0 THEN '- License: MIT' || {_NL} WHEN 1 THEN '- License: Other' || {_NL} ELSE '' END || CASE WHEN id % 5 = 0 THEN '- Homepage: https://h' || {_NL} ELSE '' END || '- Default branch: main' || {_NL} || '- Last push: 2026-01-02' || {_NL} || CASE WHEN id % 7 = 0 THEN '- Fork of: p/q' || {_NL} ELSE '' END || CASE WHEN id % 6 = 0 THEN '- Archived: yes (read-only)' || {_NL} ELSE '' END
  || CASE WHEN id % 3 = 0 THEN {_NL} || '## Latest release: v1, One (2026-01-01)' || {_NL} || {_NL} || {_demote(_RBODY, 3)} || {_NL} || CASE WHEN {_RCUT} THEN {_NL} || '[Release notes cut; full notes: https://r]' || {_NL} ELSE '' END ELSE '' END || CASE WHEN id % 4 < 2 THEN {_NL} || '## README (README.md)' || {_NL} || {_NL} || text || {_NL} ELSE '' END AS md FROM h)""")
def rendered_repos(spark, sf_dir):
    """turn 0 of each conversation as a repository's page (fields declared by conv_id), 150 bytes of release notes."""
    n = F.col("id")
    heads = _turns(spark, sf_dir).where("pos = 0")
    release = F.when(n % 3 == 0, F.struct(F.lit("v1").alias("tag"), F.lit("One").alias("name"), F.lit("2026-01-01T00:00:00Z").alias("published"), F.concat(F.lit("# Notes\n"), "text").alias("body"), F.lit("https://r").alias("url")))
    readme = F.when(n % 4 < 2, F.struct(F.lit("README.md").alias("path"), "text"))
    rows = heads.select(
        "id", F.concat(F.lit("o/r"), n.cast("string")).alias("repo"), F.substring("text", 1, 40).alias("description"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (n % 3).cast("int")).alias("topics"), (n * 3).alias("stars"), n.alias("forks"), (n % 4).alias("issues"), F.when(n % 2 == 0, "Go").alias("language"),
        F.when(n % 4 == 0, "MIT").when(n % 4 == 1, "NOASSERTION").alias("license"), F.when(n % 4 < 2, "Other").alias("license_name"), F.when(n % 5 == 0, "https://h").alias("homepage"), F.lit("main").alias("branch"), F.lit("2026-01-02T00:00:00Z").alias("pushed"), F.when(n % 7 == 0, "p/q").alias("parent"), (n % 6 == 0).alias("archived"), release.alias("release"), readme.alias("readme"),
    )
    return _digest(repository.render_repos(rows, 150))
