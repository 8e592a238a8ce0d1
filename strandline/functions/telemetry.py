"""What the metadata of an agent event says, read from its JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import DOMAINS, Domains, digest_id

# Names of metadata members, the first that is a string counts.
SESSION = ("session_id", "session-id", "session_key", "session-key")
SESSION_INSTANCE = ("session_instance_id", "session-instance-id", "session_instance", "session-instance")
HOOK_EVENT = ("hook_event_name", "hook-event-name")
ACTOR = ("actor_id", "actor-id", "actor_key", "actor-key")
TELEMETRY_TRACE = ("telemetry_trace_id", "telemetry-trace-id", "otel_trace_id", "otel-trace-id")
TELEMETRY_SPAN = ("telemetry_span_id", "telemetry-span-id", "otel_span_id", "otel-span-id")
TELEMETRY_PROVIDER = ("telemetry_provider", "telemetry-provider", "otel_provider", "otel-provider")
TRACE = ("trace_id", "trace-id")
SPAN = ("span_id", "span-id")
PROVIDER = ("provider", "provider_name", "provider-name")
#: Members that are searched after the top level, and those that tell the source; parameters of a
#: capture, as each kind of events has its own.
CONTAINERS = ("agent", "session", "context", "telemetry", "lineage", "lineage_context")
SOURCE_CONTAINERS = ("lineage", "lineage_context")


def string_at(variant: Column, *path: str) -> Column:
    """The member if it is a string."""
    at = "$" + "".join(f"['{p}']" for p in path)
    there = F.try_variant_get(variant, at, "variant")
    return F.when(F.schema_of_variant(there) == "STRING", F.try_variant_get(variant, at, "string"))


def metadata_string(variant: Column, keys: tuple[str, ...], containers: tuple[str, ...] = CONTAINERS) -> Column:
    """The first of ``keys`` that is a string at the top level, else in a container."""
    return F.coalesce(*[string_at(variant, k) for k in keys], *[string_at(variant, c, k) for c in containers for k in keys])


def source_of(variant: Column, containers: tuple[str, ...] = SOURCE_CONTAINERS) -> Column:
    """The source that an event explains: a struct ns, kind, id, outcome; null without all of them.

    The first container that is an object counts, and in it ``source``, else ``source_ref``.
    """
    is_object = lambda *path: F.schema_of_variant(F.try_variant_get(variant, "$" + "".join(f"['{p}']" for p in path), "variant")).startswith("OBJECT")
    out = F.lit(None).cast("struct<ns: string, kind: string, id: string, outcome: string>")
    for container in reversed(containers):
        member = {}
        for name in ("namespace", "kind", "id"):
            first = F.try_variant_get(variant, f"$['{container}']['source']", "variant")
            member[name] = F.when(first.isNotNull(), string_at(variant, container, "source", name)).otherwise(string_at(variant, container, "source_ref", name))
        whole = F.struct(member["namespace"].alias("ns"), member["kind"].alias("kind"), member["id"].alias("id"), F.coalesce(string_at(variant, container, "outcome"), string_at(variant, container, "status")).alias("outcome"))
        there = (F.trim(member["namespace"]) != "") & (F.trim(member["kind"]) != "") & (F.trim(member["id"]) != "")
        out = F.when(is_object(container), F.when(there, whole)).otherwise(out)
    return out


def link_id(ns: Column, kind: Column, id: Column, domains: Domains = DOMAINS) -> Column:
    return digest_id(domains.link, ns, kind, id)


def session_end_id(session: Column, domains: Domains = DOMAINS) -> Column:
    return digest_id(domains.session_end, session)


def trace_id(uuid: Column) -> Column:
    """32 hexadecimal digits of a UUID."""
    return F.lower(F.replace(uuid, F.lit("-"), F.lit("")))


def span_id(uuid: Column) -> Column:
    """The last 16 of them."""
    return F.right(trace_id(uuid), F.lit(16))


def json_digest(text: Column) -> tuple[Column, Column]:
    """SHA-256 and byte length of a JSON text in its compact form with sorted keys."""
    compact = F.to_json(F.parse_json(text))
    return F.sha2(compact, 256), F.octet_length(compact)
