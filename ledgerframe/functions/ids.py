"""Content-addressed identifiers as native columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces of this engine's ids; package ids and graph ids must not be mixed.
PACKAGE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/ledgerframe/package")
GRAPH_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/ledgerframe/graph")


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version-5 UUID of name under namespace; null for null."""
    digits = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(digits, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def graph_id(kind: str, content: Column, namespace: uuid.UUID = GRAPH_NAMESPACE) -> Column:
    return uuid5(namespace, F.concat(F.lit(f"{kind}:"), content))


def md5_slug(text: Column, length: int = 16) -> Column:
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, length)


def sha_id(text: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, length)


def normalize_cik(cik: Column) -> Column:
    """All-digit identifiers without leading zeros, padded to ten; others as they are."""
    bare = F.trim(cik)
    stripped = F.ltrim(bare, F.lit("0"))
    return F.when(bare.rlike("^[0-9]+$"), F.when(F.length(stripped) > 10, stripped).otherwise(F.lpad(stripped, 10, "0"))).otherwise(cik)
