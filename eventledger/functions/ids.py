"""Identifiers: deterministic UUIDs, UUID text, and record keys."""

import re
import uuid

from pyspark.sql import Column, functions as F

from ..schemas import ID_NAMESPACE

_CANONICAL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# What PostgreSQL's uuid input accepts: hyphens after any group of four digits,
# optionally in braces, any case.
_UUID_TEXT = r"^(\{[0-9a-fA-F]{4}(-?[0-9a-fA-F]{4}){7}\}|[0-9a-fA-F]{4}(-?[0-9a-fA-F]{4}){7})$"


def _hyphenated(digits: Column) -> Column:
    return F.regexp_replace(
        digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form, or NULL when the text is not a UUID."""
    digits = F.lower(F.regexp_replace(text, "[-{}]", ""))
    return F.when(text.rlike(_CANONICAL), text).when(text.rlike(_UUID_TEXT), _hyphenated(digits))


def canonical_uuid_text(text: str) -> str | None:
    """``canonical_uuid`` for a single value on the driver."""
    if not re.fullmatch(_UUID_TEXT, text):
        return None
    return str(uuid.UUID(re.sub("[-{}]", "", text)))


def uuid_from_md5(name: Column) -> Column:
    """The 32 hex digits of an md5 cut like a UUID (test tables only)."""
    return _hyphenated(F.md5(name))


def uuid5(name: Column, namespace: str = ID_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def partition_for(key: Column, partitions: int) -> Column:
    """The log partition of a key: equal keys always meet on one partition."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
