"""URL columns: identity keys, guards, routing and target parsing. None of them raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import ip_hex, is_reserved
from .binding import let

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host and port, without user information."""
    return F.regexp_replace(_part(url, 2), r"^.*@", "")


def hostname(url: Column) -> Column:
    """Lower case, without port and without a trailing dot (U4); an IPv6 address in its brackets."""
    return F.regexp_replace(F.lower(F.regexp_replace(authority(url), r":\d*$", "")), r"\.$", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def query_string(url: Column) -> Column:
    return F.regexp_replace(_part(url, 4), r"^\?", "")


def merge_key(url: Column) -> Column:
    """What two rankings' copies of a page share (U1): scheme, www., fragment and one trailing slash are dropped."""
    key = F.concat(F.regexp_replace(F.lower(authority(url)), r"^www\.", ""), F.regexp_replace(path(url), "/$", ""))
    key = F.when(query_string(url) != "", F.concat(key, F.lit("?"), query_string(url))).otherwise(key)
    return F.when(authority(url) == "", url).otherwise(key)


#: Bytes that stay as they are in a written parameter, as hex digits: letters, digits, - . _ ~
_PLAIN_BYTE = r"^(2D|2E|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])$"
#: The same in a path, where $ & + , / : ; = @ stay too.
_PATH_BYTE = r"^(2[46BCDEF]|3[0-9ABD]|4[0-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])$"
#: What a path may hold without being written anew, and a host.
_PATH_AS_IS = r"^[A-Za-z0-9._~!$&'()*+,;=:@/\[\]%-]*$"
_HOST_CHARS = r"""^[A-Za-z0-9._~!$&'()*+,;=:\[\]<>"\x{80}-\x{10FFFF}-]*$"""


def decoded_bytes(text: Column) -> Column:
    """The bytes that a percent-encoded text stands for, as hex digits; null where a % has no two digits behind it."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    each = lambda t: F.when(F.length(t) == 3, F.upper(F.substring(t, 2, 2))).otherwise(F.hex(t))
    return let(tokens, lambda ts: F.when(~F.array_contains(ts, "%"), F.array_join(F.transform(ts, each), "")))


def encoded_bytes(digits: Column, plain: str, blank: str) -> Column:
    """Bytes, given as hex digits, as text: those that match `plain` as they are, a blank as `blank`, others behind %."""
    pairs = F.regexp_extract_all(digits, F.lit(".."), F.lit(0))
    one = lambda b: F.when(F.rlike(b, F.lit(plain)), F.unhex(b).cast("string")).when(b == "20", F.lit(blank)).otherwise(F.concat(F.lit("%"), b))
    return F.array_join(F.transform(pairs, one), "")


def _parameter(piece: Column, i: Column) -> Column:
    """Struct (k, i, v): name and value of a parameter as hex digits; null in one where it can't be read."""
    name = F.substring_index(piece, "=", 1)
    value = F.substr(piece, F.length(name) + 2)
    spaced = lambda c: F.replace(c, F.lit("+"), F.lit(" "))
    return F.struct(decoded_bytes(spaced(name)).alias("k"), i.alias("i"), decoded_bytes(spaced(value)).alias("v"), F.contains(piece, F.lit(";")).alias("split"))


def _parameters(query: Column) -> Column:
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), _parameter)


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter, decoded; '' without one. Parameters that can't be read are left out."""
    code = name.encode().hex().upper()
    found = F.filter(_parameters(query_string(url)), lambda p: F.coalesce((p["k"] == code) & ~p["split"], F.lit(False)) & p["v"].isNotNull())
    return F.coalesce(F.make_valid_utf8(F.unhex(F.get(found, F.lit(0))["v"]).cast("string")), F.lit(""))


def canonical_query(query: Column) -> Column:
    """Parameters by name, those of one name in their order, every byte written in the one usual way.

    A query with a ; or an unreadable % stays as it is: what it means isn't known.
    """
    write = lambda d: encoded_bytes(d, _PLAIN_BYTE, "+")

    def sorted_(ps: Column) -> Column:
        odd = F.exists(ps, lambda p: p["split"] | p["k"].isNull() | p["v"].isNull())
        return F.when(odd, query).otherwise(F.array_join(F.transform(F.array_sort(ps), lambda p: F.concat(write(p["k"]), F.lit("="), write(p["v"]))), "&"))

    return let(_parameters(query), sorted_)


def canonical_path(where: Column) -> Column:
    """The path as it is if it could be sent so, else written anew; null if a % of it can't be read."""
    whole = decoded_bytes(where)
    return F.when(F.rlike(where, F.lit(_PATH_AS_IS)), F.when(whole.isNotNull(), where)).otherwise(encoded_bytes(whole, _PATH_BYTE, "%20"))


def cache_url(url: Column) -> Column:
    """Cache identity (U2): scheme and host in lower case, no default port, no fragment, parameters by name and in one spelling.

    Null where there is no host or the URL can't be read: control characters, a port that is no number, characters that no host has, a
    % in the path without its digits.
    """
    port = F.regexp_extract(authority(url), r":([^:\]]*)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    host = F.lower(F.regexp_replace(authority(url), r":[^:\]]*$", ""))
    user = F.regexp_extract(_part(url, 2), r"^(.*@)", 1)
    whole = F.when((port == "") | default, host).otherwise(F.concat(host, F.lit(":"), port))
    asked = _part(url, 4)
    # a lone ? is kept, an empty query of pairs is not
    tail = F.when(asked == "", F.lit("")).when(asked == "?", F.lit("?")).otherwise(let(canonical_query(query_string(url)), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))))
    readable = (host != "") & F.rlike(port, F.lit(r"^\d*$")) & F.rlike(host, F.lit(_HOST_CHARS)) & ~F.rlike(F.trim(url), F.lit(r"[\x00-\x1f\x7f]"))
    return F.when(readable, F.concat(scheme(url), F.lit("://"), user, whole, canonical_path(path(url)), tail))


def cache_key(url: Column, options: Column) -> Column:
    """Versioned digest of the cache URL and the options' JSON (U3); null for a URL without one."""
    return F.concat(F.lit("v1:"), F.sha2(F.encode(F.concat(cache_url(url), F.lit("\n"), options), "UTF-8"), 256))


def host_is(host: Column, domain: str) -> Column:
    """The domain itself or a subdomain."""
    return F.rlike(host, F.lit(r"(?i)(^|\.)" + domain.replace(".", r"\.") + "$"))


#: Forums that run the same software on hosts of their own (fixed values).
FORUM_HOSTS = ("meta.discourse.org", "discuss.python.org", "users.rust-lang.org", "internals.rust-lang.org", "discuss.pytorch.org")
#: Question sites on domains of their own, and hosts of the network that are none (fixed values).
QUESTION_HOSTS = ("stackoverflow.com", "superuser.com", "serverfault.com", "askubuntu.com", "mathoverflow.net")
NOT_QUESTION_NAMES = ("api", "chat", "data", "openid")
#: Hosts of posts and of mirrors of posts, and of their short links (fixed values).
POST_HOSTS = ("x.com", "twitter.com", "fxtwitter.com", "fixupx.com", "vxtwitter.com", "fixvx.com")
SHORT_LINK_HOST = "t.co"
#: Paths that each engine takes on its hosts (fixed values).
SHARE_PATH = r"(?i)^/r/[^/]+/s/[A-Za-z0-9_-]+/?$"
LISTING_PATH = r"(?i)^/r/([^/?#]+)(?:/(hot|new|top|rising|controversial))?$"
PERMALINK_PATH = r"/r/[^/]+/comments/[a-z0-9]+(?:/[^/?#]+)?/?"
FEED_PATHS = ("", "/news", "/front", "/newest", "/ask", "/show")
TOPIC_PATH = r"^/t/(?:([^/]*[^0-9/][^/]*)/([0-9]+)(?:/[0-9]+)?|([0-9]+)(?:/[0-9]+)?)$"
QUESTION_PATH = r"^/(?:questions/([0-9]+)(?:/[^/]*(?:/[0-9]+)?)?|(q|a)/([0-9]+)(?:/[0-9]+)?)/?$"
STATUS_PATH = r"^/(?:[A-Za-z0-9_]{1,50}|i|i/web)/status(?:es)?/([0-9]{1,20})(?:/(?:photo|video)/[0-9]{1,2})?/?$"
SHORT_LINK_PATH = r"^/[A-Za-z0-9]{1,32}/?$"


def _trimmed(url: Column) -> Column:
    """The path without one trailing slash."""
    return F.regexp_replace(path(url), "/$", "")


def is_question_host(host: Column) -> Column:
    """A question site, with www. or without: one on its own domain, its meta site, or a name of the network."""
    host = F.regexp_replace(host, r"^www\.", "")
    name = F.regexp_extract(host, r"^(?:meta\.)?([^.]+)(?:\.meta)?\.stackexchange\.com$", 1)
    # either form of a meta site, not both at once
    twice = F.rlike(host, F.lit(r"^meta\.[^.]+\.meta\."))
    return host.isin(*QUESTION_HOSTS, *(f"meta.{h}" for h in QUESTION_HOSTS)) | ((name != "") & ~name.isin(*NOT_QUESTION_NAMES) & ~twice)


def post_host(host: Column) -> Column:
    """The host of a post's URL without www. and then mobile. in front."""
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^mobile\.", "")


def _claims(url: Column) -> list[tuple[str, Column]]:
    """Engines in their order of registration, with the URLs each one takes."""
    h, p = hostname(url), path(url)
    has = lambda pattern, where=p: F.rlike(where, F.lit(pattern))
    item = (_trimmed(url) == "/item") & F.rlike(query_string(url), F.lit(r"(^|&)id=\d+(&|$)"))
    actor = F.split(F.regexp_replace(p, r"^/+|/+$", ""), "/")
    profile = (F.get(actor, F.lit(0)) == "profile") & (F.coalesce(F.get(actor, F.lit(1)), F.lit("")) != "")
    profile = profile & ((F.size(actor) == 2) | ((F.size(actor) == 4) & (F.get(actor, F.lit(2)) == "post") & (F.get(actor, F.lit(3)) != "")))
    web = scheme(url).isin("http", "https")
    return [
        ("reddit", host_is(h, "reddit.com") & (has(SHARE_PATH) | has(PERMALINK_PATH) | has(LISTING_PATH, F.regexp_replace(_trimmed(url), r"\.json$", "")))),
        ("hackernews", host_is(h, "news.ycombinator.com") & (item | _trimmed(url).isin(*FEED_PATHS))),
        ("github", github_kind(url).isNotNull()),
        ("discourse", h.isin(*FORUM_HOSTS) & has(TOPIC_PATH, _trimmed(url))),
        ("bluesky", host_is(h, "bsky.app") & profile),
        ("stackexchange", web & is_question_host(h) & has(QUESTION_PATH)),
        ("twitter", web & (post_host(h).isin(*POST_HOSTS) & has(STATUS_PATH) | (h == SHORT_LINK_HOST) & has(SHORT_LINK_PATH))),
    ]


def route(url: Column) -> Column:
    """First engine that takes the URL, else the browser."""
    out: Column | None = None
    for engine, claims in _claims(url):
        taken = F.coalesce(claims, F.lit(False))
        out = F.when(taken, engine) if out is None else out.when(taken, engine)
    return out.otherwise("browser")


def valid_site(site: Column) -> Column:
    """A bare hostname."""
    return F.rlike(site, F.lit(r"^[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?)+$"))


def guard_reason(url: Column) -> Column:
    """Why a URL may not be fetched, by its syntax alone (P5); null if it may."""
    host = hostname(url)
    last = F.regexp_extract(host, r"([^.]*)$", 1)
    digits = ip_hex(F.regexp_replace(authority(url), r":\d*$", ""))
    return (
        F.when(~scheme(url).isin("http", "https"), "scheme")
        .when(F.regexp_replace(host, r"^\[\]$", "") == "", "no_host")
        .when(digits.isNotNull(), F.when(is_reserved(digits), "reserved_ip"))
        .when(F.rlike(last, F.lit(r"^([0-9]+|0x[0-9a-f]*)$")), "numeric_host")
        .when((host == "localhost") | F.endswith(host, F.lit(".localhost")), "localhost")
    )


def is_pdf(url: Column) -> Column:
    """A path that ends in .pdf, or an arXiv paper."""
    return F.rlike(F.lower(path(url)), F.lit(r"\.pdf$")) | (host_is(hostname(url), "arxiv.org") & F.startswith(path(url), F.lit("/pdf/")))


def redirected_elsewhere(asked: Column, got: Column) -> Column:
    """Another host (but for www.) or another path (but for a trailing slash); query and fragment don't count."""
    host = lambda u: F.regexp_replace(hostname(u), r"^www\.", "")
    where = lambda u: F.regexp_replace(path(u), "/$", "")
    return (host(asked) != host(got)) | (where(asked) != where(got))


#: Hosts that are read on another one, and hosts that ask for consent (fixed values).
OLD_POST_HOSTS = ("twitter.com", "www.twitter.com", "mobile.twitter.com")
CONSENT_HOSTS = ("youtube.com", "google.com", "news.google.com")


def consent_bypass(url: Column) -> Column:
    """x.com for the old post hosts, and the no-consent parameter for hosts that ask (U8).

    Parameters come out by name, as the added one makes the query be written anew.
    """
    moved = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?)[^/?#]*", "$1x.com")
    asks = F.regexp_replace(F.regexp_replace(hostname(url), r"^www\.", ""), r"^m\.", "").isin(*CONSENT_HOSTS)
    has = F.rlike(query_string(url), F.lit(r"(^|&)ucbcb(=|&|$)"))
    pairs = F.filter(F.split(F.concat_ws("&", F.lit("ucbcb=1"), F.nullif(query_string(url), F.lit(""))), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    query = F.array_join(F.transform(F.array_sort(named), lambda x: x["p"]), "&")
    added = F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("?"), query, F.regexp_extract(url, r"#.*$", 0))
    return F.when(hostname(url).isin(*OLD_POST_HOSTS), moved).when(asks & ~has, added).otherwise(url)


def site_scoped(query: Column, site: Column) -> Column:
    """The query with a site filter in front."""
    return F.when(F.coalesce(site, F.lit("")) == "", query).otherwise(F.concat(F.lit("site:"), site, F.lit(" "), query))


def ref_splits(rest: Column) -> Column:
    """All ways to read `a/b/c` as a ref and a path (U10): (a, b/c), (a/b, c), (a/b/c, '')."""
    parts = F.split(rest, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("ref"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("path")),
    )


#: Owners that are pages of the site itself (fixed values).
RESERVED_OWNERS = (
    "about", "account", "advisories", "apps", "codespaces", "collections", "contact", "copilot", "customer-stories", "dashboard", "enterprise", "enterprises", "events", "explore",
    "features", "github-copilot", "issues", "login", "marketplace", "models", "new", "notifications", "organizations", "orgs", "pricing", "pulls", "readme", "resources", "search",
    "security", "settings", "site", "solutions", "sponsors", "stars", "team", "topics", "trending", "users",
)
#: What names a gist, and what names each kind of page behind owner and repository (fixed values).
GIST_PATH = r"^/(?:[A-Za-z0-9-]+/([0-9a-fA-F]+)|([0-9a-fA-F]{20,}))$"
OWNER_AND_REPOSITORY = r"^/[A-Za-z0-9-]+/[A-Za-z0-9._-]+"
REPOSITORY_PATHS = (
    ("issue", r"/issues/[0-9]+$"), ("pull", r"/pull/[0-9]+$"), ("repo", r"$"), ("blob", r"/blob/[^/]*/.*$"), ("tree", r"/tree/.+$"), ("releases", r"/releases$"),
    ("release", r"/releases/(latest|tag/.+)$"), ("discussion", r"/discussions/[0-9]+$"), ("commit", r"/(?:commit|pull/[0-9]+/commits)/[0-9a-fA-F]{7,40}$"),
)


def github_kind(url: Column) -> Column:
    """What a repository-host URL names (U5); null where it names none."""
    p, h = _trimmed(url), hostname(url)
    owner = F.lower(F.regexp_extract(p, r"^/([^/]*)", 1))
    out = F.when(h == "gist.github.com", F.when(F.rlike(p, F.lit(GIST_PATH)), "gist"))
    out = out.when((h != "github.com") & (h != "www.github.com"), F.lit(None)).when(owner.isin(*RESERVED_OWNERS) | F.rlike(p, F.lit(r"/\.\.?(/|$)")), F.lit(None))
    for name, pattern in REPOSITORY_PATHS:
        out = out.when(F.rlike(p, F.lit(OWNER_AND_REPOSITORY + pattern)), name)
    return out


def thread_id(url: Column) -> Column:
    """The id that a thread's URL carries, by site."""
    p, h = path(url), hostname(url)
    return (
        F.when(host_is(h, "reddit.com"), F.regexp_extract(p, r"/comments/([0-9a-z]+)", 1))
        .when(h == "news.ycombinator.com", F.regexp_extract(query_string(url), r"(?:^|&)id=(\d+)", 1))
        .when(is_question_host(h), F.concat(F.regexp_extract(p, QUESTION_PATH, 1), F.when(F.regexp_extract(p, QUESTION_PATH, 2) == "a", F.lit("a/")).otherwise(F.lit("")), F.regexp_extract(p, QUESTION_PATH, 3)))
        .when(h.isin(*FORUM_HOSTS), F.concat(F.regexp_extract(_trimmed(url), TOPIC_PATH, 2), F.regexp_extract(_trimmed(url), TOPIC_PATH, 3)))
        .when(h == "bsky.app", F.regexp_extract(p, r"^/profile/[^/]+/post/([0-9a-z]+)", 1))
        .when(post_host(h).isin(*POST_HOSTS), F.regexp_extract(p, STATUS_PATH, 1))
        .otherwise("")
    )


#: Windows of time that a listing may name, and the sorts that heed them (fixed values).
LISTING_TIMES = ("hour", "day", "week", "month", "year", "all")
TIMED_SORTS = ("top", "controversial")
#: A listing's posts where none are asked for, and at most (fixed values).
LISTING_LIMIT, MOST_LISTING = 25, 100


def listing_limit(url: Column) -> Column:
    """A listing's limit: 1 to 100, and 25 where the URL asks for none or for no positive number."""
    given = parameter(url, "limit")
    n = F.when(F.rlike(given, F.lit(r"^[+-]?[0-9]+$")), given.try_cast("long"))
    return F.when(n > 0, F.least(n, F.lit(MOST_LISTING))).otherwise(F.lit(LISTING_LIMIT)).cast("int")


def listing(url: Column) -> Column:
    """Struct (sub, sort, t, limit) of a listing's URL; null for others (U6). t is '' unless the sort heeds it."""
    where = F.regexp_replace(_trimmed(url), r"\.json$", "")
    given = F.lower(F.regexp_extract(where, LISTING_PATH, 2))
    sort = F.when(given == "", "hot").otherwise(given)
    t = F.lower(parameter(url, "t"))
    timed = F.when(sort.isin(*TIMED_SORTS) & t.isin(*LISTING_TIMES), t).otherwise("")
    said = F.struct(F.regexp_extract(where, LISTING_PATH, 1).alias("sub"), sort.alias("sort"), timed.alias("t"), listing_limit(url).alias("limit"))
    return F.when(host_is(hostname(url), "reddit.com") & F.rlike(where, F.lit(LISTING_PATH)), said)


def is_share(url: Column) -> Column:
    """A link that a thread is shared by, which has to be resolved first."""
    return host_is(hostname(url), "reddit.com") & F.rlike(path(url), F.lit(SHARE_PATH))


#: Extensions of plain text that needs no browser (fixed values).
RAW_EXTENSIONS = (
    "md", "markdown", "txt", "text", "rst", "adoc", "json", "ndjson", "jsonl", "xml", "yaml", "yml", "toml", "ini", "cfg", "conf", "csv", "tsv", "log", "patch",
    "diff", "proto", "graphql", "sql", "go", "py", "rb", "rs", "c", "h", "cpp", "hpp", "cc", "java", "kt", "swift", "ts", "tsx", "js", "jsx",
    "mjs", "sh", "bash", "zsh", "ps1", "lua", "pl", "ex", "exs", "zig", "tf", "hcl", "dockerfile", "mod", "sum", "lock", "env", "service", "css",
)


def has_raw_extension(url: Column) -> Column:
    """The path's extension is one of plain text."""
    return F.lower(F.regexp_extract(path(url), r"\.([^./]+)$", 1)).isin(*RAW_EXTENSIONS)


def is_raw_type(media: Column) -> Column:
    """C17: a media type that can be read as it is."""
    m = F.lower(F.trim(F.substring_index(media, ";", 1)))
    return F.when(m.isin("text/html", "application/xhtml+xml"), False).otherwise(
        m.isin("application/json", "application/xml", "application/x-ndjson", "application/javascript", "application/yaml", "application/x-yaml", "application/toml")
        | F.startswith(m, F.lit("text/"))
        | F.rlike(m, F.lit(r"\+(json|xml)$"))
    )
