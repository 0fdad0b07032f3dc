"""Hashes and deterministic identifiers as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(message: Column, salt: bytes) -> Column:
    """Keyed SHA-256 of a string column, hex encoded.

    The two padded keys are prepared here; the rest runs in the JVM. The padded
    keys are literals of the plan, so plans built with a real salt must not be
    printed or logged.
    """
    if not salt:
        raise ValueError("a non-empty salt is required")
    key = hashlib.sha256(salt).digest() if len(salt) > _BLOCK else salt
    key = key.ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(byte ^ pad for byte in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def row_fingerprint(source: str, key: Column, salt: bytes) -> Column:
    """Salted reference to one row that reveals nothing about it."""
    return F.concat(F.lit("sha256:"), hmac_sha256(F.concat(F.lit(source + ":"), key.cast("string")), salt))


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """Identifier that depends only on its parts."""
    joined = F.concat_ws("|", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def value_form(value: Column, logical_type: str) -> Column:
    """The JSON form of a value.

    Numbers and plain text are their own JSON form, give or take the quotes; a
    JSON writer is used only where something must be escaped. Dates and
    timestamps are written as text, because JSON would round them.
    """
    document = F.to_json(F.struct(value.alias("v")))
    scalar = F.substring(document, F.lit(6), F.length(document) - 6)
    quoted = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    if logical_type in ("integer", "float", "boolean"):
        scalar = value.cast("string")
    elif logical_type in ("date", "datetime"):
        scalar = quoted
    elif logical_type == "string":
        scalar = F.when(value.rlike(r'["\\\x00-\x1F]'), scalar).otherwise(quoted)
    return scalar


def form_hash(form: Column) -> Column:
    return F.substring(F.sha2(form, 256), 1, 16)


def value_hash(value: Column, logical_type: str) -> Column:
    """Sixteen hex digits standing for a value: the hash of its JSON form."""
    return form_hash(value_form(value, logical_type))


def sample_hash(source: str, key: Column) -> Column:
    """Order of rows in a deterministic sample."""
    return F.sha2(F.concat(F.lit(source + "|"), key.cast("string")), 256)
