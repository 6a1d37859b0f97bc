"""Documents of a code host, put together from tables (F21, S8), and questions with their answers.

Each function takes a table of heads, a row a document, and the tables of its parts, which name the head by `id` and have a place `pos`. Parts are
gathered by document in one shuffle each; nothing is rendered by Python. Texts come as Markdown with both kinds of line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.options import is_binary
from ..functions.text import epoch_text, human_bytes, one_line
from ..streaming.folds import Budget, fold

#: Bytes of a commit's patches, entries of a folder, releases of a list and bytes of their notes, assets of a release, bytes of a file, answers of a question (fixed values).
DIFF_BYTES, ENTRIES, RELEASES, NOTES_BYTES, ASSETS, FILE_BYTES, ANSWERS = 30_000, 500, 10, 3_000, 50, 400_000, 100


def _day(c: Column) -> Column:
    return F.substring(c, 1, 10)


def _count(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _if(condition: Column, *parts: Column | str) -> Column:
    """The parts as one text, or ''."""
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])).otherwise("")


def _lines(rows: DataFrame, name: str, line: Column, by: list[str] | None = None, **more: Column) -> DataFrame:
    """id, the rows' lines in order as one text, and other aggregates."""
    each = F.struct(*(by or ["pos"]), line.alias("line"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["line"]), "").alias(name), *[c.alias(n) for n, c in more.items()])


def _body(c: Column) -> Column:
    return markdown.trimmed(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")))


def render_commits(commits: DataFrame, files: DataFrame, diff_bytes: int = DIFF_BYTES) -> DataFrame:
    """id, markdown. commits: id, repo, sha, message, author, login, date, committer, committed; files: id, pos, name, status, additions, deletions, patch.

    Patches count against a budget in their order: one that doesn't fit is left out, and a later one may still fit.
    """
    sized = fold(files.withColumn("bytes", F.coalesce(F.octet_length("patch"), F.lit(0)).cast("long")), "id", ["pos"], lambda: Budget(diff_bytes), ["bytes"])
    row = F.concat(F.lit("- "), "name", F.lit(" ("), "status", F.lit(", +"), F.col("additions").cast("string"), F.lit(" -"), F.col("deletions").cast("string"), F.lit(")\n"))
    patch = _if(F.col("kept") & _given(F.col("patch")), "--- ", F.col("name"), "\n", F.regexp_replace("patch", r"\n+$", ""), "\n")
    parts = _lines(sized, "files", row, n=F.count("*"), added=F.sum("additions"), deleted=F.sum("deletions"), cut=F.bool_or(~F.col("kept"))).join(_lines(sized, "diff", patch), "id")
    rows = commits.join(parts, "id", "left").fillna({"n": 0, "added": 0, "deleted": 0, "files": "", "diff": "", "cut": False})
    message = _body(F.col("message"))
    subject = one_line(F.substring_index(message, "\n", 1))
    body = markdown.trimmed(F.substr(message, F.length(F.substring_index(message, "\n", 1)) + 2))
    c = F.col
    who = F.concat("author", _if(_given(c("login")) & (c("login") != c("author")), " (", c("login"), ")"))
    other = _given(c("committer")) & (c("committer") != c("author")) & (c("committer") != "GitHub")
    return rows.select("id", F.concat(
        F.lit("# "), "repo", F.lit("@"), F.substring("sha", 1, 7), F.lit(": "), subject, F.lit("\n\n- Author: "), who, F.lit(", "), _day(c("date")), F.lit("\n"), _if(other, "- Committer: ", c("committer"), ", ", _day(c("committed")), "\n"),
        F.lit("- SHA: "), "sha", F.lit("\n- Changes: +"), c("added").cast("string"), F.lit(" -"), c("deleted").cast("string"), F.lit(" in "), _count(c("n"), "file", "files"), F.lit("\n"), _if(body != "", "\n## Message\n\n", body, "\n"),
        F.lit("\n## Files ("), c("n").cast("string"), F.lit(")\n\n"), "files", _if(c("diff") != "", "\n## Diff\n\n", markdown.fenced(c("diff"), F.lit("diff")), "\n"),
        _if(c("cut"), "\n[Some file patches omitted (diff budget spent); names and stats are complete.]\n"),
    ).alias("markdown"))


def render_trees(folders: DataFrame, entries: DataFrame, most: int = ENTRIES) -> DataFrame:
    """id, markdown. folders: id, repo, path, ref; entries: id, pos, name, type (dir, file or what it is), size. Folders first, then by name without case (O2), `most` of them and how many more."""
    order = [F.when(F.col("type") == "dir", 0).otherwise(1), F.lower("name"), F.col("pos")]
    w = Window.partitionBy("id")
    ranked = entries.withColumn("nth", F.row_number().over(w.orderBy(*order))).withColumn("all", F.count("*").over(w)).where(F.col("nth") <= most + 1)
    said = F.when(F.col("type") == "dir", F.concat("name", F.lit("/"))).when(F.col("type") == "file", F.concat("name", F.lit(" ("), human_bytes(F.col("size")), F.lit(")"))).otherwise(F.concat("name", F.lit(" ("), "type", F.lit(")")))
    line = F.concat(F.lit("- "), F.when(F.col("nth") <= most, said).otherwise(F.concat(F.lit("… "), (F.col("all") - most).cast("string"), F.lit(" more"))), F.lit("\n"))
    rows = folders.join(_lines(ranked, "lines", line, ["nth"], n=F.max("all")), "id", "left").fillna({"lines": "", "n": 0})
    where = F.when(_given(F.col("path")), F.col("path")).otherwise("/")
    return rows.select("id", F.concat(F.lit("# "), "repo", F.lit(": "), where, F.lit("\n\n- Ref: "), "ref", F.lit("\n\n## Entries ("), F.col("n").cast("string"), F.lit(")\n\n"), "lines").alias("markdown"))


def _release_heading(hashes: str, label: Column | str) -> Column:
    name = one_line(F.coalesce("name", F.lit("")))
    told = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lit(f"{hashes} "), _if(told != "", told, ": "), "tag", _if((name != "") & (name != F.col("tag")), ", ", name), _if(_given(F.col("published")), " (", _day(F.col("published")), ")"), F.lit("\n"))


def _release_flags() -> Column:
    flags = F.concat_ws(", ", F.when(_given(F.col("author")), F.concat(F.lit("by "), "author")), F.when(F.col("prerelease"), "pre-release"), F.when(F.col("draft"), "draft"))
    return _if(flags != "", "\n", flags, "\n")


def render_release_lists(repos: DataFrame, releases: DataFrame, most: int = RELEASES, notes_bytes: int = NOTES_BYTES) -> DataFrame:
    """id, markdown. repos: id, repo; releases: id, pos (newest first), tag, name, published, author, prerelease, draft, body, url. The newest `most`, their notes cut, headings two levels down."""
    newest = releases.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("nth") <= most)
    newest = newest.withColumn("notes", markdown.excerpt(F.coalesce("body", F.lit("")), notes_bytes))
    notes = _if(F.col("notes.text") != "", "\n", markdown.demote_headings(F.col("notes.text"), 2), "\n", _if(F.col("notes.cut"), "\n[Notes cut; full notes: ", F.col("url"), "]\n"))
    line = F.concat(F.lit("\n"), _release_heading("##", ""), _release_flags(), notes)
    rows = repos.join(_lines(newest, "lines", line, ["nth"], n=F.count("*")), "id", "left").fillna({"lines": "", "n": 0})
    head = F.when(F.col("n") == 0, F.lit("No releases published (tags without a release are not listed).\n")).otherwise(F.concat(F.lit("The "), _count(F.col("n"), "latest release", "latest releases"), F.lit(", newest first.\n")))
    return rows.select("id", F.concat(F.lit("# "), "repo", F.lit(" releases\n\n"), head, "lines").alias("markdown"))


def render_releases(releases: DataFrame, assets: DataFrame, most: int = ASSETS) -> DataFrame:
    """id, markdown. releases: id, repo and what render_release_lists() takes; assets: id, pos, asset, size, downloads. One release with all its notes and `most` assets."""
    w = Window.partitionBy("id")
    ranked = assets.withColumn("nth", F.row_number().over(w.orderBy("pos"))).withColumn("all", F.count("*").over(w)).where(F.col("nth") <= most + 1)
    said = F.concat("asset", F.lit(" ("), human_bytes(F.col("size")), F.lit(", "), _count(F.col("downloads"), "download", "downloads"), F.lit(")"))
    line = F.concat(F.lit("- "), F.when(F.col("nth") <= most, said).otherwise(F.concat(F.lit("… "), (F.col("all") - most).cast("string"), F.lit(" more"))), F.lit("\n"))
    rows = releases.join(_lines(ranked, "lines", line, ["nth"], n=F.max("all")), "id", "left")
    body = _body(F.col("body"))
    listed = _if(F.col("n") > 0, "\n## Assets (", F.col("n").cast("string"), ")\n\n", F.col("lines"))
    return rows.select("id", F.concat(_release_heading("#", F.col("repo")), _release_flags(), _if(body != "", "\n", markdown.demote_headings(body, 1), "\n"), listed).alias("markdown"))


def _is_prose(name: Column) -> Column:
    ext = markdown.extension(name)
    return ext.isin("md", "markdown", "mdown", "mkd", "mdx", "txt") | ((ext == "") & (markdown.code_language(name) == ""))


def render_gists(gists: DataFrame, files: DataFrame) -> DataFrame:
    """id, markdown. gists: id, description, owner, created, updated; files: id, name, content, language, truncated, size, raw_url. Files by name, prose as it is and code in fences."""
    c = F.col
    language = F.when(markdown.code_language(c("name")) == "", F.lower(F.coalesce("language", F.lit("")))).otherwise(markdown.code_language(c("name")))
    content = F.coalesce("content", F.lit(""))
    text = F.when(_is_prose(c("name")), F.concat(_body(c("content")), F.lit("\n"))).otherwise(F.concat(markdown.fenced(content, language), F.lit("\n")))
    cut = _if(F.coalesce("truncated", F.lit(False)), "\n[File cut by GitHub at ", human_bytes(F.octet_length(content)), " of ", human_bytes(c("size")), "; raw file: ", c("raw_url"), "]\n")
    line = F.concat(F.lit("\n## "), "name", F.lit("\n\n"), text, cut)
    rows = gists.join(_lines(files, "files", line, ["name"], n=F.count("*"), first=F.min("name")), "id", "left").fillna({"files": "", "n": 0, "first": ""})
    told = one_line(F.coalesce("description", F.lit("")))
    return rows.select("id", F.concat(F.lit("# Gist: "), F.when(told == "", c("first")).otherwise(told), F.lit("\n\n"), _if(_given(c("owner")), "- Owner: ", c("owner"), "\n"), F.lit("- Created: "), _day(c("created")), F.lit(", updated: "), _day(c("updated")), F.lit("\n- Files: "), c("n").cast("string"), F.lit("\n"), "files").alias("markdown"))


def render_files(files: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """id, markdown. files: id, repo, path, ref, body (binary). Binaries are named only; prose as it is, code in a fence; a long file ends at a line."""
    c = F.col
    # bytes as characters of one byte each, so that the last line's end is found without reading the text
    latin = F.decode(F.substring("body", 1, most), "ISO-8859-1")
    at = F.length("latin") - F.length(F.substring_index("latin", "\n", -1)) - 1
    rows = files.withColumn("size", F.octet_length("body")).withColumn("latin", latin)
    rows = rows.withColumn("kept", F.when(c("size") <= most, c("body")).when(at > 0, F.substr("body", F.lit(1), at)).otherwise(F.substring("body", 1, most))).drop("latin")
    text = F.replace(F.make_valid_utf8(c("kept").cast("string")), F.lit("�"), F.lit(""))
    shown = F.when(_is_prose(c("path")), markdown.trimmed(text)).otherwise(markdown.fenced(text, markdown.code_language(c("path"))))
    note = _if(c("size") > most, "\n\n[File cut at ", F.octet_length("kept").cast("string"), " of ", c("size").cast("string"), " bytes.]")
    body = F.when(is_binary(c("body")), F.lit("Binary file, not shown.\n")).otherwise(F.concat(shown, note))
    return rows.select("id", F.concat(F.lit("# "), "repo", F.lit(": "), "path", F.lit("\n\n- Ref: "), "ref", F.lit("\n- Size: "), c("size").cast("string"), F.lit(" bytes\n\n"), body).alias("markdown"))


def render_discussions(discussions: DataFrame, comments: DataFrame, replies: DataFrame) -> DataFrame:
    """id, markdown. discussions: id, repo, number, title, category, author, created, upvotes, answer (a comment), n_comments, body; comments: id, pos, comment, author, created, upvotes, body, n_replies; replies: id, comment, pos, author, created, body.

    The accepted answer comes first and is only named in its place (J14). What is left out of the lists is said at the end.
    """
    c = F.col
    reply = F.concat(F.lit("\n#### Reply by "), "author", F.lit(" ("), _day(c("created")), F.lit(")\n\n"), markdown.demote_headings(_body(c("body")), 5), F.lit("\n"))
    under = replies.select("id", "comment", "pos", reply.alias("line")).groupBy("id", "comment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("replies"), F.count("*").alias("shown"))
    told = comments.join(discussions.select("id", "answer"), "id").join(under, ["id", "comment"], "left").fillna({"replies": "", "shown": 0})
    accepted = F.coalesce(c("comment") == c("answer"), F.lit(False))
    label = F.concat("author", F.lit(" ("), _day(c("created")), F.lit(", "), _count(c("upvotes"), "upvote", "upvotes"), F.lit(")"))
    line = F.concat(F.lit("\n### "), label, F.when(accepted, F.lit(": accepted answer, shown above\n")).otherwise(F.concat(F.lit("\n\n"), markdown.demote_headings(_body(c("body")), 4), F.lit("\n"))), "replies")
    best = F.max(F.when(accepted, F.concat(F.lit("\n## Accepted answer, by "), "author", F.lit(" ("), _day(c("created")), F.lit(")\n\n"), markdown.demote_headings(_body(c("body")), 3), F.lit("\n"))))
    less = F.when(c("n_replies") > c("shown"), F.concat(F.lit("a comment by "), "author", F.lit(" shows "), c("shown").cast("string"), F.lit(" of "), c("n_replies").cast("string"), F.lit(" replies")))
    fewer = F.array_sort(F.collect_list(F.when(less.isNotNull(), F.struct("pos", less.alias("line")))))
    rows = discussions.join(_lines(told, "lines", line, n=F.count("*"), best=best, fewer=fewer), "id", "left").fillna({"lines": "", "n": 0, "best": ""})
    first = F.when(c("n_comments") > c("n"), F.array(F.concat(F.lit("showing "), c("n").cast("string"), F.lit(" of "), c("n_comments").cast("string"), F.lit(" comments")))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(first, F.coalesce(F.transform("fewer", lambda x: x["line"]), F.array().cast("array<string>")))
    body = _body(c("body"))
    return rows.select("id", F.concat(
        F.lit("# "), one_line(c("title")), F.lit("\n\n- Discussion: "), "repo", F.lit("#"), c("number").cast("string"), F.lit(", category: "), "category", F.lit("\n- Author: "), "author", F.lit(", "), _day(c("created")), F.lit(", "), _count(c("upvotes"), "upvote", "upvotes"),
        F.lit("\n- Answered: "), F.when(c("answer").isNotNull(), "yes").otherwise("no"), F.lit("\n- Comments: "), c("n_comments").cast("string"), F.lit("\n"), _if(body != "", "\n", markdown.demote_headings(body, 2), "\n"), "best",
        _if(c("n") > 0, "\n## Comments\n"), "lines", _if(F.size(notes) > 0, "\n[Truncated: ", F.array_join(notes, "; "), ".]\n"),
    ).alias("markdown"))


def render_repos(repos: DataFrame, notes_bytes: int = 1_500) -> DataFrame:
    """id, markdown. repos: id, repo, description, topics (array), stars, forks, issues, language, license, license_name, homepage, branch, pushed, parent, archived; release (struct of tag, name, published, body, url) and readme (struct of path, text), each null where there is none."""
    c = F.col
    field = lambda label, value: _if(_given(value), f"- {label}: ", value, "\n")
    named = _given(c("license")) & (c("license") != "NOASSERTION")
    release = F.struct(*[c(f"release.{x}").alias(x) for x in ("tag", "name", "published", "body", "url")])
    notes = markdown.excerpt(F.coalesce(release["body"], F.lit("")), notes_bytes)
    rows = repos.withColumn("notes", notes)
    name = one_line(F.coalesce(c("release.name"), F.lit("")))
    heading = F.concat(F.lit("## Latest release: "), c("release.tag"), _if((name != "") & (name != c("release.tag")), ", ", name), _if(_given(c("release.published")), " (", _day(c("release.published")), ")"), F.lit("\n"))
    said = _if(c("notes.text") != "", "\n", markdown.demote_headings(c("notes.text"), 3), "\n", _if(c("notes.cut"), "\n[Release notes cut; full notes: ", c("release.url"), "]\n"))
    told = one_line(F.coalesce("description", F.lit("")))
    return rows.select("id", F.concat(
        F.lit("# "), "repo", F.lit("\n\n"), _if(told != "", told, "\n\n"), field("Topics", F.array_join("topics", ", ")), F.lit("- Stars: "), c("stars").cast("string"), F.lit(", forks: "), c("forks").cast("string"), F.lit(", open issues and PRs: "), c("issues").cast("string"), F.lit("\n"),
        field("Language", c("language")), field("License", F.when(named, c("license")).otherwise(c("license_name"))), field("Homepage", c("homepage")), field("Default branch", c("branch")), field("Last push", _day(c("pushed"))), field("Fork of", c("parent")), _if(F.coalesce("archived", F.lit(False)), "- Archived: yes (read-only)\n"),
        _if(c("release").isNotNull(), "\n", heading, said), _if(c("readme").isNotNull(), "\n## README (", c("readme.path"), ")\n\n", c("readme.text"), "\n"),
    ).alias("markdown"))


def render_questions(questions: DataFrame, answers: DataFrame, most: int = ANSWERS) -> DataFrame:
    """id, text: a question and its answers as TOON under its title (S9). questions: id, title, site, score, author, asked (epoch), n_answers, accepted, body; answers: id, answer, score, accepted, author, created (epoch), body.

    The `most` answers with most votes, in that order (ties by their ids); how many there are is said if some are left out. Titles and names have their entities read.
    """
    ranked = answers.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "answer"))).where(F.col("nth") <= most)
    plain = lambda x: markdown.unescape(F.coalesce(x, F.lit("")))
    each = F.struct("nth", "answer", "score", F.coalesce("accepted", F.lit(False)).alias("accepted"), plain(F.col("author")).alias("author"), epoch_text(F.col("created")).alias("created"), F.coalesce("body", F.lit("")).alias("body"))
    rows = questions.join(ranked.groupBy("id").agg(F.array_sort(F.collect_list(each)).alias("answers")), "id", "left")
    rows = rows.withColumn("answers", F.coalesce("answers", F.array().cast(rows.schema["answers"].dataType))).withColumn("title", plain(F.col("title")))
    c = F.col
    n, total = F.size("answers"), F.greatest(F.col("n_answers"), F.size("answers"))
    text = markdown.toon_text
    alone = lambda v: markdown.toon_text(v, comma=False)
    field = lambda name, value: F.concat(F.lit(f"  {name}: "), value, F.lit("\n"))
    fields = {"id": lambda r: r["answer"].cast("string"), "score": lambda r: r["score"].cast("string"), "accepted": lambda r: r["accepted"].cast("string"), "author": lambda r: text(r["author"]), "created": lambda r: text(r["created"]), "body": lambda r: text(r["body"])}
    note = F.concat(F.lit("answer list truncated: showing the top "), n.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" answers by votes"))
    head = F.concat(field("title", alone(c("title"))), field("site", alone(c("site"))), field("score", c("score").cast("string")), field("author", alone(plain(c("author")))), field("asked", alone(epoch_text(c("asked")))), field("answers", c("n_answers").cast("string")), F.when(F.coalesce("accepted", F.lit(0)) != 0, field("accepted_answer", c("accepted").cast("string"))).otherwise(""), field("body", alone(F.coalesce("body", F.lit("")))))
    return rows.select("id", F.concat(F.lit("# "), one_line(c("title")), F.lit("\n\nquestion:\n"), head, F.when(total > n, F.concat(F.lit("note: "), alone(note), F.lit("\n"))).otherwise(""), markdown.toon_table("answers", fields, c("answers"))).alias("text"))
