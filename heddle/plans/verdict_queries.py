"""Queries over messages, statuses and decisions that no table has: cases declared by the ids of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..sources.tables import table
from .registry import query, spread, spread_sql, table_of, values


def _cases(spark, sf_dir, cases: list[tuple], schema: str):
    return spread(table(spark, sf_dir, "events").select("event_id"), "event_id", cases, schema)


def _cases_sql(cases: list[tuple], names: str) -> str:
    return spread_sql("(SELECT event_id FROM events)", "event_id", cases, names)


_MESSAGES = [
    (1, "Blocked by anti-bot protection: Structural: minimal_text on small page", 200), (2, "Page.goto: Timeout 30000ms exceeded, timed out", 0), (3, "net::ERR_CONNECTION_TIMED_OUT at https://captcha.example.com/", 0),
    (4, "Just a moment... checking", 200), (5, "HTTP 429 from host", 0), (6, "Too Many Requests", 0), (7, "status code: 403", 0), (8, "403 Forbidden", 0), (9, "Cloudflare challenge", 0), (10, "access denied by Akamai", 0),
    (11, "pardon our interruption", 0), (12, "crashed at https://blocked.example.com/x", 0), (13, "crashed", 403), (14, "crashed", 429), (15, "rate-limited", 0), (16, "", 0),
]
_M = r"regexp_replace(message, '(?i)\bhttps?://\S+', ' ', 'g')"


def _has(p: str) -> str:
    return f"regexp_matches({_M}, '(?i){p}')".replace("you're", "you''re")


@query("message_kinds", f"""SELECT event_id, CASE WHEN {_has('structural:|minimal_text|no_content_elements|no <body')} THEN 'thin_content'
  WHEN {_has(r'exceeded the time limit|\btime(?:d)?[ -]?out\b|net::err_timed_out|net::err_connection_timed_out')} THEN 'timeout'
  WHEN {_has("captcha|just a moment|turnstile|verify(?:ing)? (?:you are|you're) (?:a )?human")} THEN 'captcha'
  WHEN {_has(r'\b(?:http|status(?: code)?)\s*:?\s*429\b|\btoo many requests\b|\brate[- ]limit')} THEN 'http_429'
  WHEN {_has(r'\b(?:http|status(?: code)?)\s*:?\s*403\b|\b403 forbidden\b')} THEN 'http_403'
  WHEN {_has(r'anti-?bot|\bblocked\b|cloudflare|akamai|perimeterx|datadome|incapsula|imperva|access denied')} THEN 'bot_block'
  WHEN {_has('pardon our interruption')} THEN 'captcha' WHEN status = 403 THEN 'http_403' WHEN status = 429 THEN 'http_429' ELSE 'upstream_error' END AS kind
  FROM {_cases_sql(_MESSAGES, 'n, message, status')}""")
def message_kinds(spark, sf_dir):
    """A browser service's messages."""
    return _cases(spark, sf_dir, _MESSAGES, "n int, message string, status int").select("event_id", classify.verdict_kind(F.col("message"), F.col("status")).alias("kind"))


_BODIES = [(1, "Blocked by Anti-Bot protection: structural: x"), (2, '{"error":"Internal Server Error","correlation_id":"1"}'), (3, "fine"), (4, "blocked by anti-bot protection")]


@query("block_bodies", f"""SELECT event_id, contains(lower(body), 'blocked by anti-bot protection') AS blocked, regexp_matches(lower(body), 'structural:|minimal_text|no_content_elements|no <body') AS structural,
  contains(lower(body), 'internal server error') AND contains(lower(body), 'correlation_id') AS scrubbed FROM {_cases_sql(_BODIES, 'n, body')}""")
def block_bodies(spark, sf_dir):
    """Error bodies of a browser service."""
    b = F.col("body")
    return _cases(spark, sf_dir, _BODIES, "n int, body string").select("event_id", classify.is_block_response(b).alias("blocked"), classify.is_structural(b).alias("structural"), classify.is_scrubbed(b).alias("scrubbed"))


@query("status_kinds", """SELECT event_id, s AS status, CASE WHEN s = 403 THEN 'http_403' WHEN s = 429 THEN 'http_429' WHEN s = 504 THEN 'timeout' WHEN s >= 500 THEN 'upstream_error' ELSE 'error' END AS upstream_kind,
  CASE WHEN s IN (404, 410) THEN 'not_found' WHEN s >= 500 THEN 'site_error' WHEN s = 403 THEN 'http_403' WHEN s = 429 THEN 'http_429' WHEN s = 400 THEN 'error' ELSE 'bot_block' END AS page_kind,
  CASE WHEN s = 502 THEN 'http_429' WHEN s IN (500, 503) THEN 'upstream_error' ELSE 'error' END AS api_kind FROM (SELECT event_id, 400 + event_id % 200 AS s FROM events)""")
def status_kinds(spark, sf_dir):
    """An HTTP status (declared by event_id) read as an upstream's, a page's, and an API's error id."""
    s = F.col("status")
    rows = table(spark, sf_dir, "events").select("event_id", (F.lit(400) + F.col("event_id") % 200).alias("status"))
    return rows.select("event_id", "status", classify.status_kind(s).alias("upstream_kind"), classify.page_status_kind(s).alias("page_kind"), classify.stack_error(s, F.lit(400)).alias("api_kind"))


@query("failure_codes", f"""SELECT event_type, coalesce(code, 'upstream_error') AS code, coalesce(retryable, false) AS retryable, kind IN ('http_429', 'http_403', 'captcha', 'bot_block', 'quota_exhausted') AS block, count(*) AS n FROM
  (SELECT event_type, (['http_429', 'captcha', 'timeout', 'site_error', 'nonsense'])[event_id % 5 + 1] AS kind FROM events) e LEFT JOIN {values(list(classify.CODES), 'k, code, retryable')} ON k = kind GROUP BY ALL""")
def failure_codes(spark, sf_dir):
    """Failure kinds (declared by event_id) to callers' codes; unknown kinds are upstream errors."""
    kinds = F.array(*[F.lit(k) for k in ("http_429", "captcha", "timeout", "site_error", "nonsense")])
    events = table(spark, sf_dir, "events").select("event_type", F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"))
    codes = F.broadcast(table_of(spark, list(classify.CODES), "kind string, code string, retryable boolean"))  # sixteen rows
    out = events.join(codes, "kind", "left").select("event_type", F.coalesce("code", F.lit("upstream_error")).alias("code"), F.coalesce("retryable", F.lit(False)).alias("retryable"), F.col("kind").isin(*classify.BLOCK_KINDS).alias("block"))
    return out.groupBy("event_type", "code", "retryable", "block").agg(F.count("*").alias("n"))


_ERRORS = [("Suspended: too many requests",), ("CAPTCHA required",), ("Suspended: access denied",), ("timeout",), ("Suspended",), ("boom",), ("",)]


@query("engine_errors", f"""SELECT event_id, message, CASE WHEN message = '' THEN 'unknown' WHEN contains(lower(message), 'captcha') THEN 'captcha' WHEN contains(lower(message), 'too many request') THEN 'too_many_requests'
  WHEN contains(lower(message), 'access denied') THEN 'access_denied' WHEN contains(lower(message), 'timeout') THEN 'timeout' WHEN contains(lower(message), 'suspended') THEN 'suspended' ELSE 'error' END AS class FROM {_cases_sql(_ERRORS, 'message')}""")
def engine_errors(spark, sf_dir):
    """Free-text errors of search engines."""
    return _cases(spark, sf_dir, _ERRORS, "message string").select("event_id", "message", classify.engine_error(F.col("message")).alias("class"))


_ANSWERS = [(i, n, lim, f, r, d) for i, (n, lim, f, r, d) in enumerate([(0, 10, True, False, False), (0, 10, True, True, False), (0, 10, False, False, False), (2, 10, False, False, False), (2, 2, False, False, False), (2, 2, False, False, True), (9, 10, False, False, True), (9, 0, False, False, False), (4, 0, False, False, True)])]


@query("failover_decisions", f"""SELECT event_id, CASE WHEN refused THEN 'keep' WHEN failed OR n = 0 THEN 'replace' WHEN n < CASE WHEN lim > 0 AND lim < 5 THEN lim ELSE 5 END OR degraded THEN 'merge' ELSE 'keep' END AS action,
  CASE WHEN refused THEN '' WHEN failed THEN 'error' WHEN n = 0 THEN 'empty' WHEN n < CASE WHEN lim > 0 AND lim < 5 THEN lim ELSE 5 END THEN 'thin' WHEN degraded THEN 'degraded' ELSE '' END AS trigger FROM {_cases_sql(_ANSWERS, 'no, n, lim, failed, refused, degraded')}""")
def failover_decisions(spark, sf_dir):
    """C11: when a backup is asked, and why."""
    c = F.col
    d = classify.failover(c("n"), c("lim"), c("failed"), c("refused"), c("degraded"), 5)
    return _cases(spark, sf_dir, _ANSWERS, "no int, n int, lim int, failed boolean, refused boolean, degraded boolean").select("event_id", d["action"].alias("action"), d["trigger"].alias("trigger"))


_CHAINS = [(1, 1, "fx", "not_found"), (1, 2, "synd", "not_found"), (2, 1, "fx", "not_found"), (2, 2, "synd", "http_403"), (3, 1, "fx", "captcha"), (3, 2, "synd", "http_429"), (4, 1, "fx", "bot_block"), (4, 2, "vx", "captcha"), (5, 1, "fx", "timeout"), (5, 2, "vx", "error"), (6, 1, "fx", "error"), (6, 2, "synd", "timeout")]


@query("chain_verdicts", f"""SELECT post, CASE WHEN bool_or(kind = 'not_found' AND source = 'fx') AND bool_or(kind = 'not_found' AND source <> 'fx') THEN 'not_found'
  WHEN bool_and(kind IN ('http_429', 'http_403', 'captcha', 'bot_block', 'quota_exhausted')) THEN CASE WHEN bool_or(kind = 'http_429') THEN 'http_429' ELSE arg_min(kind, n) END
  WHEN arg_max(kind, n) IN ('error', 'not_found') THEN 'upstream_error' ELSE arg_max(kind, n) END AS verdict FROM (SELECT event_id // 2 AS post, n, source, kind FROM {_cases_sql(_CHAINS, 'no, n, source, kind')}) GROUP BY post""")
def chain_verdicts(spark, sf_dir):
    """One verdict for the attempts of a chain of sources (two events are a post's)."""
    k, n, fx = F.col("kind"), F.col("n"), F.col("source") == "fx"
    last = F.max_by(k, n)
    verdict = (
        F.when(F.bool_or((k == "not_found") & fx) & F.bool_or((k == "not_found") & ~fx), "not_found")
        .when(F.bool_and(k.isin(*classify.BLOCK_KINDS)), F.when(F.bool_or(k == "http_429"), "http_429").otherwise(F.min_by(k, n)))
        .when(last.isin("error", "not_found"), "upstream_error")
        .otherwise(last)
    )
    rows = _cases(spark, sf_dir, _CHAINS, "no int, n int, source string, kind string").withColumn("post", F.floor(F.col("event_id") / 2))
    return rows.groupBy("post").agg(verdict.alias("verdict"))


_ENVELOPES = [(1, 200, '{"a": 1}', False), (2, 200, "<html>verify you are human</html>", False), (3, 200, "<html></html>", False), (4, 429, "", False), (5, 500, "x", False), (6, 404, "", True), (7, 403, "", False)]


@query("envelope_verdicts", f"""SELECT event_id, CASE WHEN missing THEN 'not_found' WHEN status = 429 THEN 'http_429' WHEN status = 403 THEN 'http_403' WHEN status = 504 THEN 'timeout' WHEN status >= 500 THEN 'upstream_error' WHEN status <> 200 THEN 'error'
  WHEN NOT json_valid(body) THEN CASE WHEN contains(lower(body), 'verify you are human') THEN 'captcha' ELSE 'bot_block' END END AS kind FROM {_cases_sql(_ENVELOPES, 'no, status, body, missing')}""")
def envelope_verdicts(spark, sf_dir):
    """Answers of a JSON endpoint."""
    kind = classify.envelope_verdict(F.col("status"), F.col("body"), F.col("missing"))
    return _cases(spark, sf_dir, _ENVELOPES, "no int, status int, body string, missing boolean").select("event_id", kind.alias("kind"))


_API_ERRORS = [(i, e, st) for i, (e, st) in enumerate([(502, 400), (500, 400), (503, 400), (404, 400), (401, 400), (406, 400), (501, 400), (504, 400), (0, 403), (0, 429), (0, 503), (0, 504), (0, 404), (400, 429)])]


@query("api_errors", f"""SELECT event_id, CASE error_id WHEN 502 THEN 'http_429' WHEN 500 THEN 'upstream_error' WHEN 503 THEN 'upstream_error'
  WHEN 0 THEN CASE WHEN status = 403 THEN 'http_403' WHEN status = 429 THEN 'http_429' WHEN status = 504 THEN 'timeout' WHEN status >= 500 THEN 'upstream_error' ELSE 'error' END ELSE 'error' END AS kind FROM {_cases_sql(_API_ERRORS, 'no, error_id, status')}""")
def api_errors(spark, sf_dir):
    """A question site's error ids, and its statuses where there is none."""
    return _cases(spark, sf_dir, _API_ERRORS, "no int, error_id int, status int").select("event_id", classify.stack_error(F.col("error_id"), F.col("status")).alias("kind"))


_LIMITS = [(i, *r) for i, r in enumerate([
    (True, None, "12", "30"), (True, None, "0", "30"), (True, None, None, None), (True, None, "Wed, 21 Oct 2026 07:28:00 GMT", None), (True, "99.0", "", "7.5"), (False, "0.0", None, "30"), (False, "0", None, None),
    (False, "5", "12", "30"), (False, None, "12", "30"), (False, "-1", "12", None), (False, "0.5", "3", "30"), (False, "soon", "3", "30"),
])]
_NUM = "CASE WHEN regexp_matches(trim({0}), '^[+]?[0-9]+([.][0-9]+)?$') THEN trim({0})::DOUBLE END"


@query("back_offs", f"""SELECT event_id, CASE WHEN NOT too_many AND NOT coalesce(rm < 1, false) THEN 0.0 WHEN ra > 0 THEN ra WHEN rs > 0 THEN rs WHEN too_many THEN 60.0 ELSE 0.0 END::DOUBLE AS hold
  FROM (SELECT *, {_NUM.format('remaining')} AS rm, {_NUM.format('after')} AS ra, {_NUM.format('reset')} AS rs FROM {_cases_sql(_LIMITS, 'no, too_many, remaining, after, reset')})""")
def back_offs(spark, sf_dir):
    """C20: how long to hold; only a 429 or a spent budget asks for it."""
    rows = _cases(spark, sf_dir, _LIMITS, "no int, too_many boolean, remaining string, after string, reset string")
    return rows.select("event_id", classify.back_off(F.col("too_many"), F.col("remaining"), F.col("after"), F.col("reset")).alias("hold"))


_TRIES = [(503, None, None), (503, None, None), (503, None, None), (429, 9000, None), (500, None, True), (404, None, None), (502, 1500, False)]


@query("retry_waits", f"""SELECT event_id, attempt, again, CASE WHEN again THEN greatest(least(4000, (500 * pow(2, attempt - 1))::BIGINT), coalesce(retry_after_ms, 0)) END AS wait_ms
  FROM (SELECT *, (status = 429 OR status >= 500) AND attempt < 3 AND NOT coalesce(vetoed, false) AS again FROM (SELECT *, row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id) AS attempt FROM {_cases_sql(_TRIES, 'status, retry_after_ms, vetoed')}))""")
def retry_waits(spark, sf_dir):
    """Capped exponential waits, without their jitter (four events are the attempts of a call)."""
    from pyspark.sql import Window

    from ..streaming.folds import retry_schedule

    attempt = F.row_number().over(Window.partitionBy(F.floor(F.col("event_id") / 4)).orderBy("event_id"))
    tries = _cases(spark, sf_dir, _TRIES, "status int, retry_after_ms int, vetoed boolean").withColumn("attempt", attempt)
    return retry_schedule(tries).select("event_id", "attempt", "again", "wait_ms")
