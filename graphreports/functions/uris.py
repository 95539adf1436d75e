"""URI checks, short names, enumerations and stable resource identifiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphreports.vocabulary import PREFIXES, RESOURCE_BASE

# Form of a short name, and of a UUID.
SHORT_NAME = r"^([\w-]+):([\w-]+)$"
UUID_FORM = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# A scheme's own port number counts as no port, as a URL parser drops it.
_DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def _lookup(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def is_plain_uri(c: Column) -> Column:
    """True for an absolute URI without user, password, port or query; NULL stays NULL."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    before_fragment = F.regexp_extract(rest, r"^([^#]*)", 1)
    authority = F.regexp_extract(before_fragment, r"^//([^/?]*)", 1)
    host = F.regexp_replace(authority, r":[0-9]*$", "")
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    default_port = F.coalesce(_lookup(_DEFAULT_PORTS)[scheme], F.lit(""))
    web = scheme.isin(*_DEFAULT_PORTS)
    return (
        (scheme != "")
        & ~authority.contains("@")
        & ((port == "") | (port == default_port))
        & ~before_fragment.rlike(r"\?.")
        & (~web | ((host != "") & ~host.rlike(r"[\s<>\"{}|\\^`%]")))
        & ~c.rlike(r"[<>\"\s]")
    )


def to_node(c: Column) -> Column:
    """``<uri>`` for a plain URI, NULL for anything else."""
    return F.when(is_plain_uri(c), F.concat(F.lit("<"), c, F.lit(">")))


def expand_uri(c: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """Full URI of a ``prefix:local`` name; an unknown prefix gives NULL, other text passes."""
    prefix = F.regexp_extract(c, SHORT_NAME, 1)
    local = F.regexp_extract(c, SHORT_NAME, 2)
    return F.when(c.rlike(SHORT_NAME), F.concat(_lookup(prefixes)[prefix], local)).otherwise(c)


def enum_key(c: Column, members: Mapping[str, str], strict: bool = False) -> Column:
    """Key of a URI of an enumeration (key to URI). Unknown: NULL, or an error when ``strict``."""
    found = _lookup({u: k for k, u in members.items()})[c]
    return F.coalesce(found, _unknown("URI", c)) if strict else found


def enum_uri(c: Column, members: Mapping[str, str], strict: bool = False) -> Column:
    """URI of a key of an enumeration. Unknown: NULL, or an error when ``strict``."""
    found = _lookup(members)[F.upper(c)]
    return F.coalesce(found, _unknown("key", c)) if strict else found


def _unknown(what: str, c: Column) -> Column:
    message = F.concat(F.lit(f"unknown enumeration {what}: "), F.coalesce(c, F.lit("NULL")))
    return F.raise_error(message).cast("string")


def is_uuid(c: Column) -> Column:
    """True for lower-case hexadecimal text in 8-4-4-4-12 form."""
    return c.rlike(UUID_FORM)


def stable_id(*keys: Column) -> Column:
    """Identifier in UUID form, the same for the same keys, so that a task run again after a
    lost executor writes the same resource. Each key is written with its length, so that no two
    lists of keys give the same text."""
    texts = [k.cast("string") for k in keys]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.md5(F.concat(*parts))
    return F.concat_ws(
        "-", *[F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def resource_uri(uuid: Column, base: str = RESOURCE_BASE) -> Column:
    return F.concat(F.lit(base), uuid)
