"""Texts of reports, addresses and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import INTERNAL_KINDS, is_external, part

ELLIPSIS = "…"
# Limits of compact texts.
SHORT_TEXT, LONG_TEXT, SHORT_ID, LIST_ITEMS = 48, 160, 12, 8
# Attributes that hold a record's time, and its title, the first that is there counts.
TIME_ATTRIBUTES = ("timestamp", "occurred-at", "occurred_at", "updated-at", "updated_at", "created-at", "created_at")
TITLE_ATTRIBUTES = ("title", "name", "description", "event-kind")
TERMINAL = ("closed", "done", "completed", "success", "deployed", "resolved", "cancelled", "canceled")


def clean_text(text: Column) -> Column:
    """Line breaks and tabs as visible signs, other control characters as U+FFFD."""
    return F.regexp_replace(F.translate(text, "\n\r\t", "↵␍⇥"), r"\p{Cc}", "�")


def compact_text(text: Column, limit: int = SHORT_TEXT) -> Column:
    """At most ``limit`` characters, the last an ellipsis if some are left out."""
    cleaned = clean_text(text)
    return F.when(F.length(cleaned) > limit, F.concat(F.substring(cleaned, 1, limit - 1), F.lit(ELLIPSIS))).otherwise(cleaned)


def short_id(text: Column) -> Column:
    return compact_text(text, SHORT_ID)


def time_parts(text: Column) -> tuple[Column, Column]:
    """Date and time of a timestamp text; without a T, undated."""
    plain = F.substring_index(text, "@", 1)
    dated = F.instr(plain, "T") > 0
    rest = F.regexp_replace(plain, r"(?s)^[^T]*T", "")
    time = F.substring(F.substring_index(F.substring_index(rest, "Z", 1), "+", 1), 1, 8)
    date = F.when(dated, F.substring_index(plain, "T", 1)).otherwise(F.lit("undated"))
    return date, F.when(dated & (F.octet_length(time) == 8), time).otherwise(F.lit("--:--:--"))


def percent_encode(text: Column) -> Column:
    """Percent-encode all bytes but letters, digits and ``-._~``."""
    out = F.url_encode(text)
    for odd, own in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(odd), F.lit(own))
    return out


def render_url(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders with encoded values; null if one has none."""
    out = F.lit(template)
    for name, text in values.items():
        if f"{{{name}}}" in template:
            out = F.replace(out, F.lit(f"{{{name}}}"), percent_encode(text))
    return out


def address_uri(key: Column) -> Column:
    """The URI of an external entity as reports show it."""
    ns, kind, own = part(key, 1), part(key, 2), clean_text(part(key, 3))
    return (
        F.when((ns == "beads") & (kind == "issue"), F.concat(F.lit("bd://"), own))
        .when(ns == "jj", F.concat(F.lit("jj://"), own))
        .otherwise(F.concat(ns, F.lit("://"), kind, F.lit("/"), own))
    )


def _internal_path(key: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in INTERNAL_KINDS]), F.substring(key, 2, 1).cast("int") + 1)
    return F.concat(kind, F.lit("/"), F.substring_index(key, "\0", -1))


def entity_uri(key: Column) -> Column:
    return F.when(is_external(key), address_uri(key)).otherwise(F.concat(F.lit("prov://"), F.when(~is_external(key), _internal_path(key))))


def detail_uri(key: Column) -> Column:
    ns, kind, own = part(key, 1), part(key, 2), clean_text(part(key, 3))
    return (
        F.when(~is_external(key), F.concat(F.lit("prov://"), F.when(~is_external(key), _internal_path(key))))
        .when((ns == "beads") & (kind == "issue"), F.concat(F.lit("prov://bd/"), own))
        .when(ns == "jj", F.concat(F.lit("prov://jj/"), own))
        .otherwise(F.concat(F.lit("prov://"), ns, F.lit("/"), kind, F.lit("/"), own))
    )


def plain_entity(key: Column) -> Column:
    """``ns/kind/id``, or ``kind/id`` of an internal one."""
    return F.when(is_external(key), F.concat_ws("/", part(key, 1), part(key, 2), part(key, 3))).otherwise(F.when(~is_external(key), _internal_path(key)))


def document_type(id: Column) -> Column:
    """The lower-case prefix before a dash, else ``document``."""
    return F.when(F.instr(id, "-") > 0, F.lower(F.substring_index(id, "-", 1))).otherwise(F.lit("document"))


def why_target(uri: str) -> tuple[str, str, str]:
    """Namespace, kind and id of ``jj://kind/id``."""
    scheme, sep, rest = uri.partition("://")
    kind, slash, id = rest.partition("/")
    if scheme != "jj" or not sep or not kind or not slash or not id or "/" in id:
        raise ValueError(f"invalid URI: {uri!r}")
    return "jj", kind, id
