"""Small predicates and option columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sorts of a thread and windows of recency that requests may name (fixed values).
THREAD_SORTS = ("confidence", "top", "new", "controversial", "old", "random", "qa", "live")
TIME_RANGES = ("day", "week", "month", "year")
#: Bytes of a file that are looked at for binary content (fixed value).
SNIFF = 8000


def valid_sort(c: Column) -> Column:
    return c.isin(*THREAD_SORTS)


def valid_range(c: Column) -> Column:
    """A recency window, or none."""
    return (c == "") | c.isin(*TIME_RANGES)


def option(given: Column, default: object, most: int | None = None) -> Column:
    """What the request says, else the deployment's default, under a ceiling. Null is unset; false and 0 are not."""
    out = F.coalesce(given, F.lit(default))
    return F.least(out, F.lit(most)) if most is not None else out


def cacheable(content: Column, metadata: Column) -> Column:
    """Not empty, not partial, not from a fallback, not an error."""
    get = lambda k: F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    return (F.coalesce(content, F.lit("")) != "") & (get("partial") != "true") & (get("fallback_from") == "") & (get("error") != "true")


def fallback_refused(final: Column, explicit: Column, kind: Column, same_host: Column) -> Column:
    """Why a browser may not follow; '' if it may."""
    from .classify import BLOCK_KINDS

    return F.when(final, "final").when(explicit, "format").when(kind.isin(*BLOCK_KINDS) & same_host, "same_host_block").otherwise("")


def is_binary(body: Column) -> Column:
    """A zero byte or invalid UTF-8 in the head; a character that the head cuts is not invalid. body: binary."""
    head = F.substring(body, 1, SNIFF)
    # up to three bytes of a character at the head's end may be cut off
    tail = F.hex(F.substring(head, -3, 3))
    cut = F.length(F.regexp_extract(tail, r"((?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F]))$", 1)) / 2
    whole = F.when(F.length(body) > SNIFF, F.substr(head, F.lit(1), F.lit(SNIFF) - cut.cast("int"))).otherwise(head)
    return F.contains(head, F.lit(b"\x00")) | ~F.is_valid_utf8(whole.cast("string"))


def truncatable(content_type: Column) -> Column:
    """Only Markdown may be cut."""
    return content_type == "markdown"


def reason_of(kind: Column, cancelled: Column, late: Column, failed: Column) -> Column:
    """Ok, the failure's kind, or canceled, timeout, error."""
    return F.when(~failed, "ok").otherwise(F.coalesce(kind, F.when(cancelled, "canceled"), F.when(late, "timeout"), F.lit("error")))


def route_label(path: Column, known: tuple[str, ...]) -> Column:
    """A bounded label."""
    return F.when(path.isin(*known), path).otherwise("other")


def client_label(names: list[Column], known: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The label of the first name that says who calls; `other` if none does. known: labels with what their names hold, in the order they are looked for."""

    def label(name: Column) -> Column:
        low = F.lower(F.coalesce(name, F.lit("")))
        out = F.lit(None).cast("string")
        for said, parts in reversed(known):
            holds = F.lit(False)
            for p in parts:
                holds = holds | F.contains(low, F.lit(p))
            out = F.when(holds, said).otherwise(out)
        return out

    return F.coalesce(*[label(n) for n in names], F.lit("other"))


def next_method(kind: Column, final: Column) -> Column:
    """C14: whether another method may be tried."""
    return ~final & kind.isin("http_403", "http_429", "captcha", "bot_block", "upstream_error")


def missing_page(body: Column, status: Column) -> Column:
    """The kind of a page without a post. Phrases are fixed values."""
    from .classify import first_marker, wall_marker

    low = F.translate(F.lower(body), "’", "'")
    refused = ("is a private community", "private community", "quarantined", "has been banned", "was banned")
    gone = ("page not found", "community not found", "there's nothing here", "nobody on reddit goes by that name", "this community doesn't exist")
    return (
        F.when(wall_marker(body).isNotNull(), "captcha")
        .when(first_marker(low, refused).isNotNull(), "http_403")
        .when(status.isin(404, 410) | first_marker(low, gone).isNotNull(), "not_found")
        .when(status == 403, "http_403")
        .when(status == 429, "http_429")
        .when(status >= 500, "upstream_error")
        .otherwise("layout")
    )
