"""Ordered first-match classifiers. The order of the branches is the meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .binding import let
from .text import first_lines, plain, prose, prose_chars

#: Phrases of bot walls, in the order they are looked for (fixed values).
WALL_MARKERS = (
    "click the button below to continue shopping",
    "let's confirm you are human",
    "you need to solve a puzzle",
    "cliquez sur le bouton ci-dessous pour continuer vos achats",
    "we're unable to allow access to this page",
    "make sure your browser is updated to the latest version",
    "does not support this browser",
    "something went wrong and this page crashed",
    "you've been blocked by network security",
    "prove you're a human",
    "whoa there, pardner",
    "just a moment...",
    "attention required! | cloudflare",
    "checking if the site connection is secure",
    "verify you are human",
    "verifying you are human",
    "/cdn-cgi/challenge-platform/",
    "pardon our interruption",
    "please verify you are a human",
    "request unsuccessful. incapsula incident id",
    "g-recaptcha",
    "recaptcha/api.js",
    "hcaptcha.com/captcha",
    "our systems have detected unusual traffic",
    "sign in to confirm you're not a bot",
)
#: Bytes of a page that are looked at (fixed value).
SCAN_BYTES = 65536
#: Reasons of a gate for thin content (fixed values).
STRUCTURAL = ("structural:", "minimal_text", "no_content_elements", "no <body")
BLOCK_KINDS = ("http_429", "http_403", "captcha", "bot_block", "quota_exhausted")
#: Failure kind, caller's code, whether a retry may help (fixed values).
CODES = (
    ("http_429", "rate_limited", True), ("http_403", "blocked", False), ("bot_block", "blocked", False), ("captcha", "captcha", False),
    ("timeout", "timeout", True), ("canceled", "timeout", True), ("thin_content", "thin_content", False), ("not_found", "not_found", False),
    ("site_error", "upstream_error", True), ("upstream_error", "upstream_error", True), ("upstream_rejected", "upstream_error", False), ("bad_response", "upstream_error", True),
    ("layout", "upstream_error", False), ("quota_exhausted", "quota_exhausted", True), ("dns_blocked", "dns_blocked", False), ("error", "upstream_error", False),
)


#: Phrases of the error shells that a post page can be (fixed values).
THIN_POST_MARKERS = ("this page doesn’t exist", "this page doesn't exist", "something went wrong. try reloading", "this post is unavailable", "this post was deleted")
#: Where scripts hang their pages, and how pages ask for scripts (fixed values).
MOUNT_POINTS = (
    'id="root"', 'id="app"', 'id="__next"', 'id="__nuxt"', 'id="svelte"', 'id="___gatsby"', "data-reactroot", "ng-app", "ng-view", "ng-version", "<app-root", 'id="q-app"', 'id="elm"',
)
ASKS_FOR_SCRIPTS = ("enable javascript", "requires javascript", "javascript is disabled", "javascript is required", "need to enable javascript")
#: Phrases by which a graded text counts as blocked (fixed values).
GRADE_WALLS = ("just a moment", "verify you are human", "captcha", "access denied", "enable javascript", "attention required", "are you a robot")
#: Paths of a bot check and of a sign-in page that a site redirects to (fixed values).
VERIFICATION_PATH = r"(?i)captcha|_verification\b|/(verify|challenge)(/|$|\.)|/sorry/"
LOGIN_PATH = r"(?i)/(login|signin|sign-in|sign_in|authwall)(/|$|\.|\?)"
#: Messages of a browser service, in the order they are looked for (fixed values).
VERDICT_PATTERNS = (
    ("timeout", r"exceeded the time limit|\btime(?:d)?[ -]?out\b|net::err_timed_out|net::err_connection_timed_out"),
    ("captcha", r"captcha|just a moment|turnstile|verify(?:ing)? (?:you are|you're) (?:a )?human"),
    ("http_429", r"\b(?:http|status(?: code)?)\s*:?\s*429\b|\btoo many requests\b|\brate[- ]limit"),
    ("http_403", r"\b(?:http|status(?: code)?)\s*:?\s*403\b|\b403 forbidden\b"),
    ("bot_block", r"anti-?bot|\bblocked\b|cloudflare|akamai|perimeterx|datadome|incapsula|imperva|access denied"),
)


def head_bytes(text: Column, n: int = SCAN_BYTES) -> Column:
    """The first n bytes as text; a character cut in two is left out."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")), "�+$", ""))


def first_marker(text: Column, markers: tuple[str, ...]) -> Column:
    return let(text, lambda t: F.get(F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(t, m)), F.lit(0)))


def blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"\S"))


def wall_marker(body: Column) -> Column:
    """The first bot-wall phrase in the body's head, curly apostrophes read as straight (C1); null without one."""
    return first_marker(F.translate(F.lower(head_bytes(body)), "’‘", "''"), WALL_MARKERS)


def is_structural(message: Column) -> Column:
    return first_marker(F.lower(message), STRUCTURAL).isNotNull()


def is_block_response(body: Column) -> Column:
    return F.contains(F.lower(body), F.lit("blocked by anti-bot protection"))


def is_scrubbed(body: Column) -> Column:
    """An error body with its reason taken out."""
    low = F.lower(body)
    return F.contains(low, F.lit("internal server error")) & F.contains(low, F.lit("correlation_id"))


def status_kind(status: Column) -> Column:
    """Failure kind of an upstream's HTTP status."""
    return F.when(status == 403, "http_403").when(status == 429, "http_429").when(status == 504, "timeout").when(status >= 500, "upstream_error").otherwise("error")


def page_status_kind(status: Column) -> Column:
    """Failure kind of the page's own status (C7): another table."""
    return (
        F.when(status.isin(404, 410), "not_found")
        .when((status == 504) | (status >= 500), "site_error")
        .when(status == 403, "http_403")
        .when(status == 429, "http_429")
        .when(status == 400, "error")
        .otherwise("bot_block")
    )


def verdict_kind(message: Column, status: Column) -> Column:
    """Failure kind of a browser service's message, URLs left out of account."""
    m = F.regexp_replace(message, r"(?i)\bhttps?://\S+", " ")
    has = lambda p: F.rlike(m, F.lit("(?i)" + p))
    out = F.when(is_structural(m), "thin_content")
    for kind, pattern in VERDICT_PATTERNS:
        out = out.when(has(pattern), kind)
    return out.when(wall_marker(m).isNotNull(), "captcha").when(status == 403, "http_403").when(status == 429, "http_429").otherwise("upstream_error")


#: Headings of a page that isn't there and of a country picker; the script and the whole title of a CDN challenge (fixed values).
_SOFT_404 = r"(?i)\bpage not found\b|\bpage (you|you're|you are) (were |are )?looking for\b|\bthis page (doesn't|does not|no longer) exists?\b|\bthis page is not available\b|\bpage introuvable\b|\bseite nicht gefunden\b"
_PICKER = r"(?im)^#{1,6}\s+(choose|select) (a|your) country\b"
_CHALLENGE_SCRIPT = r"""(?i)<script\b[^>]*\ssrc\s*=\s*["']?[^"'\s>]*/cdn-cgi/challenge-platform/[^"'\s>]*/orchestrate/"""
_CHALLENGE_TITLE = r"(?i)<title[^>]*>\s*(?:just a moment|un instant|einen moment|un momento|um momento|attention required! \| cloudflare|please wait\.\.\. \| cloudflare)\s*(?:\.\.\.|…)?\s*</title>"
#: Opening lines that are looked at, and the characters from which on one is a paragraph (fixed values).
OPENING, PARAGRAPH = 12, 120


def _lines_read(content: Column) -> Column:
    """Struct (missing, marks, loading): whether a short line before the first paragraph says that the page isn't there; lines with something on them, and those that say no more than Loading. One pass."""
    start = F.struct(F.lit(0).alias("seen"), F.lit(False).alias("done"), F.lit(False).alias("missing"), F.lit(0).alias("marks"), F.lit(0).alias("loading"))

    def step(acc: Column, line: Column) -> Column:
        mark = F.regexp_replace(F.trim(line), r"^[.…#* ]+|[.…#* ]+$", "")
        said = F.struct(F.when(acc["done"], F.lit("")).otherwise(prose(line)).alias("p"), F.lower(mark).alias("mark"))

        def read(x: Column) -> Column:
            here, n = x["p"] != "", F.length(x["p"])
            ends = here & ((acc["seen"] >= OPENING) | (n >= PARAGRAPH))
            return F.struct(
                (acc["seen"] + here.cast("int")).alias("seen"), (acc["done"] | ends).alias("done"), (acc["missing"] | (here & ~ends & (n <= 60) & F.rlike(x["p"], F.lit(_SOFT_404)))).alias("missing"),
                (acc["marks"] + (x["mark"] != "").cast("int")).alias("marks"), (acc["loading"] + (x["mark"] == "loading").cast("int")).alias("loading"),
            )

        return let(said, read)

    return F.aggregate(F.split(content, "\n"), start, step)


def silent_failure(content: Column, scan: Column | None = None, prose_length: Column | None = None) -> Column:
    """Kind of a page that was served but isn't the page (C4): CDN interstitial, soft 404, country picker, loading skeleton.

    scan: the content with the cleaned HTML before it, where there is any; prose_length: prose_chars() of the content, if it is there already.
    """
    n = prose_chars(content) if prose_length is None else prose_length
    seen = content if scan is None else scan
    akamai = F.contains(F.lower(content), F.lit("powered and protected by")) & F.contains(F.lower(seen), F.lit("akamai")) & (n < 300)
    picker = (n < 1500) & F.rlike(first_lines(content, 10), F.lit(_PICKER))
    skeleton = lambda x: (x["loading"] >= 10) & (x["loading"] * 10 > x["marks"] * 3)
    return let(_lines_read(content), lambda x: F.when(akamai, "bot_block").when(x["missing"], "not_found").when(picker, "bot_block").when(skeleton(x), "thin_content"))


def served(fit: Column, raw: Column) -> Column:
    """The Markdown that counts: the fitted one, the raw one where that is blank."""
    return F.when(F.coalesce(blank(fit), F.lit(True)), F.coalesce(raw, F.lit(""))).otherwise(fit)


def scanned(content: Column, cleaned: Column) -> Column:
    """What is searched for walls: the cleaned HTML, where it says something else, and the content."""
    return F.when((F.coalesce(cleaned, F.lit("")) == "") | (cleaned == content), content).otherwise(F.concat(cleaned, F.lit("\n"), content))


def challenge_page(html: Column) -> Column:
    """A CDN challenge in the page's head."""
    return let(head_bytes(html), lambda h: F.rlike(h, F.lit(_CHALLENGE_SCRIPT)) | F.rlike(h, F.lit(_CHALLENGE_TITLE)))


def page_verdict(
    html: Column, text: Column, status: Column, silent: Column, prose_length: Column, floor: int = 200, asked: Column | None = None, final: Column | None = None, success: Column | None = None, message: Column | None = None, scan: Column | None = None
) -> Column:
    """One verdict for a fetched page, checks in their fixed order.

    silent and prose_length: silent_failure() and prose_chars() of the text, columns of their own so that each is
    worked out once. scan: scanned() of the text, where there is cleaned HTML. asked and final: the URL asked for and the one the browser ended on; success and
    message: the browser service's own verdict. Where these are not given, their checks are left out.
    """
    no = F.lit(False)
    moved = F.coalesce(final, F.lit("")) != "" if final is not None else no
    there = urls.hostname(final) if final is not None else F.lit("")
    guarded = moved & (there != urls.hostname(asked)) & urls.guard_reason(final).isNotNull() if final is not None else no
    failed = ~F.coalesce(success, F.lit(True)) if success is not None else no
    said = verdict_kind(F.coalesce(message, F.lit("")), status) if message is not None else F.lit("upstream_error")
    elsewhere = moved & urls.redirected_elsewhere(asked, final) if final is not None else no
    verify = F.rlike(urls.path(final), F.lit(VERIFICATION_PATH)) if final is not None else no
    login = F.rlike(urls.path(final), F.lit(LOGIN_PATH)) & ~F.rlike(urls.path(asked), F.lit(LOGIN_PATH)) if final is not None else no
    return (
        F.when(guarded, "refused")
        .when(challenge_page(html), "captcha")
        .when(failed, said)
        .when(wall_marker(text if scan is None else scan).isNotNull(), "captcha")
        .when(F.startswith(there, F.lit("consent.")), "captcha")
        .when(status >= 400, page_status_kind(status))
        .when(silent.isNotNull(), silent)
        .when(blank(text), "thin_content")
        .when(prose_length < floor, "thin_content")
        .when(elsewhere & verify, "captcha")
        .when(elsewhere & login, "bot_block")
        .otherwise("ok")
    )


def engine_error(message: Column) -> Column:
    """Class of a search engine's free-text error."""
    m = F.lower(message)
    return (
        F.when(F.coalesce(message, F.lit("")) == "", "unknown")
        .when(F.contains(m, F.lit("captcha")), "captcha")
        .when(F.contains(m, F.lit("too many request")), "too_many_requests")
        .when(F.contains(m, F.lit("access denied")), "access_denied")
        .when(F.contains(m, F.lit("timeout")), "timeout")
        .when(F.contains(m, F.lit("suspended")), "suspended")
        .otherwise("error")
    )


def failover(results: Column, limit: Column, failed: Column, refused: Column, degraded: Column, least: int) -> Column:
    """Struct (action, trigger): what the backup is asked for, by the primary's answer (C11)."""
    thin = F.when((limit > 0) & (limit < least), limit).otherwise(F.lit(least))
    said = lambda a, t: F.struct(F.lit(a).alias("action"), F.lit(t).alias("trigger"))
    return (
        F.when(refused, said("keep", ""))
        .when(failed, said("replace", "error"))
        .when(results == 0, said("replace", "empty"))
        .when(results < thin, said("merge", "thin"))
        .when(degraded, said("merge", "degraded"))
        .otherwise(said("keep", ""))
    )


def stack_error(error_id: Column, status: Column) -> Column:
    """A question site's API error id; without one the status decides."""
    return F.when(error_id == 502, "http_429").when(error_id.isin(500, 503), "upstream_error").when(error_id == 0, status_kind(status)).otherwise("error")


def envelope_verdict(status: Column, body: Column, missing: Column) -> Column:
    """What a JSON endpoint's answer means; null if it is good."""
    good = F.try_parse_json(body).isNotNull() & F.rlike(body, F.lit(r"^\s*[\[{]"))
    return (
        F.when(missing, "not_found").when(status == 429, "http_429").when(status != 200, status_kind(status))
        .when(~F.coalesce(good, F.lit(False)), F.when(wall_marker(body).isNotNull(), "captcha").otherwise("bot_block"))
    )


def back_off(too_many: Column, remaining: Column, retry_after: Column, reset: Column) -> Column:
    """Seconds to hold (C20): none unless a 429 or a spent budget asks; then what is asked for, else the reset, else a minute for a 429.

    too_many: the answer was a 429. remaining, retry_after, reset: headers as text; only non-negative numbers count.
    """
    number = lambda h: F.when(F.rlike(F.trim(h), F.lit(r"^\+?\d+(\.\d+)?$")), F.trim(h).try_cast("double"))
    limited = too_many | F.coalesce(number(remaining) < 1, F.lit(False))
    return F.when(limited, F.coalesce(F.when(number(retry_after) > 0, number(retry_after)), F.when(number(reset) > 0, number(reset)), F.when(too_many, F.lit(60.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def thin_post(text: Column) -> Column:
    """One of the error shells' phrases, or fewer than 80 characters."""
    return first_marker(F.lower(text), THIN_POST_MARKERS).isNotNull() | (F.length(F.trim(text)) < 80)


def needs_browser(html: Column, text: Column) -> Column:
    """Whether a page's text comes from its scripts."""
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    head = F.lower(F.substring(html, 1, 200000))
    ratio = visible / F.greatest(F.length(html), F.lit(1))
    return (
        F.when(visible >= 1500, False)
        .when(~F.contains(head, F.lit("<script")), False)
        .when(first_marker(head, (*ASKS_FOR_SCRIPTS, *MOUNT_POINTS)).isNotNull(), True)
        .when((ratio < 0.01) & (F.length(html) > 20000), True)
        .when(visible >= 300, False)
        .otherwise((visible < 60) | (ratio < 0.03))
    )


def grade(text: Column, failed: Column, phrases: tuple[str, ...]) -> Column:
    """ok, partial, miss, empty, blocked or error (F17): by the phrases that the text must hold, both made plain."""
    low = plain(text)
    hits = sum((F.contains(low, F.trim(plain(F.lit(p)))).cast("int") for p in phrases), F.lit(0))
    return (
        F.when(failed, "error")
        .when((F.length(text) < 3000) & first_marker(low, GRADE_WALLS).isNotNull(), "blocked")
        .when(F.length(F.trim(text)) < 200, "empty")
        .when(hits == len(phrases), "ok")
        .otherwise(F.when(hits > 0, "partial").otherwise("miss"))
    )
