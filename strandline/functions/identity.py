"""Deterministic identities. The domains that keep kinds of identities apart are parameters: a log
that has to agree with another engine's is made with that engine's :class:`Domains`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


@dataclass(frozen=True)
class Domains:
    kernel: str = "strandline/id/v1"
    agent: str = "strandline/agent-id/v1"
    agent_seed: str = "strandline/agent-seed/v1"
    actor_seed: str = "strandline/actor-seed/v1"
    link: str = "strandline/link/v1"
    session_end: str = "strandline/session-end/v1"
    plugin: str = "strandline/plugin-seed/v1"


DOMAINS = Domains()


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x.cast("string")


def joined(*parts: Column | str) -> Column:
    """Parts with NUL between them; null if one is null."""
    out = [_text(parts[0])]
    for p in parts[1:]:
        out += [F.lit(NUL), _text(p)]
    return F.concat(*out)


def kernel_id(kind: Column | str, seed: Column, discriminator: Column | str, domains: Domains = DOMAINS) -> Column:
    return F.sha2(joined(domains.kernel, kind, seed, discriminator), 256)


def operation_id(seed: Column) -> Column:
    return kernel_id("operation", seed, "operation")


def event_id(seed: Column, index: Column) -> Column:
    return kernel_id("event", seed, F.concat(F.lit("event:"), index.cast("string")))


def session_id(seed: Column) -> Column:
    return kernel_id("session", seed, "session")


def actor_id(seed: Column) -> Column:
    return kernel_id("actor", seed, "actor")


def object_id(seed: Column, index: Column) -> Column:
    return kernel_id("object", seed, F.concat(F.lit("object:"), index.cast("string")))


def claim_id(seed: Column, event: Column, requirement: Column) -> Column:
    return kernel_id("claim", seed, F.concat(F.lit("claim:"), event.cast("string"), F.lit(":"), requirement.cast("string")))


def replica_id(seed: Column) -> Column:
    return kernel_id("replica", seed, "replica")


def agent_id(kind: Column | str, seed: Column, discriminator: Column | str, domains: Domains = DOMAINS) -> Column:
    """SHA-256 of the domain and of three parts, each after its length in 8 big-endian bytes."""
    parts = [F.encode(F.lit(domains.agent + NUL), "utf-8")]
    for p in (_text(kind), seed, _text(discriminator)):
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.encode(p, "utf-8")]
    return F.sha2(F.concat(*parts), 256)


def counted(text: Column | str) -> Column:
    """A text after its length in bytes and a colon."""
    return F.concat(F.octet_length(_text(text)).cast("string"), F.lit(":"), _text(text))


def digest_id(domain: str, *parts: Column | str) -> Column:
    """SHA-256 of the domain and counted parts, each ended by NUL."""
    return F.sha2(F.concat(F.lit(domain + NUL), *[F.concat(counted(p), F.lit(NUL)) for p in parts]), 256)


def scoped_seed(kind: Column | str, harness: Column | str, installation: Column | str, raw: Column, domains: Domains = DOMAINS) -> Column:
    return joined(domains.agent_seed, *[counted(x) for x in (kind, harness, installation, raw)])


def plugin_seed(namespace: Column | str, plugin: Column | str, seed: Column, domains: Domains = DOMAINS) -> Column:
    return joined(domains.plugin, *[counted(x) for x in (namespace, plugin, seed)])
