"""Key payloads, surrogate keys, hashes and typed placeholder values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that stand for NULL in hashed texts.
NULL_KEY, NULL_JUNK = "__NULL_KEY__", "__NULL__"
NULL_HASHDIFF = "__NULL_SENTINEL__"
# Fixed values of the data model: reserved members and open ends of validity.
MISSING, NOT_APPLICABLE, NOT_YET_AVAILABLE, BAD_VALUE = -1, -2, -3, -4
MEMBERS = {MISSING: "Missing", NOT_APPLICABLE: "Not Applicable", NOT_YET_AVAILABLE: "Not Yet Available", BAD_VALUE: "Bad Value"}
STATUS = {MISSING: "MISSING", NOT_APPLICABLE: "NOT_APPLICABLE", NOT_YET_AVAILABLE: "NOT_YET_AVAILABLE", BAD_VALUE: "BAD_VALUE"}
VALID_FROM, VALID_TO = "1900-01-01 00:00:00", "9999-12-31 00:00:00"
SEPARATOR = "\u0000"


def payload(columns: Sequence[str]) -> Column:
    """``name:value`` of every column, NULL as a token, joined by a character no text holds."""
    return F.concat_ws(SEPARATOR, *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY))) for c in columns])


def hash_key(of: Column, strategy: str = "xxhash64") -> Column:
    """A BIGINT key of a text: ``xxhash64`` (the default), or ``portable``, the first 60 bits of its MD5, which any SQL engine computes."""
    if strategy == "xxhash64":
        return F.xxhash64(of)
    if strategy == "portable":
        return F.conv(F.substring(F.md5(of.cast("binary")), 1, 15), 16, 10).cast("bigint")
    raise ValueError(f"unknown key strategy {strategy!r}")


def surrogate_key(natural: Sequence[str], version: str | None = None, strategy: str = "xxhash64") -> Column:
    """Key of a dimension row: of its natural keys and, for versioned dimensions, the column its version starts with."""
    return hash_key(payload([*natural, *([version] if version else [])]), strategy)


def durable_fingerprint(natural: Sequence[str]) -> Column:
    return F.sha2(payload(natural), 256)


def row_fingerprint(natural: Sequence[str], effective: str) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, durable_fingerprint(natural), F.col(effective).cast("string")), 256)


def dual_keys(natural: Sequence[str], effective: str, strategy: str = "xxhash64") -> dict[str, Column]:
    """Durable key (of the natural keys), row key (of one version) and the SHA-256 fingerprints that prove them."""
    row = F.concat_ws(SEPARATOR, durable_fingerprint(natural), F.col(effective).cast("string"))
    return {
        "durable_key": hash_key(payload(natural), strategy),
        "row_key": hash_key(row, strategy),
        "durable_fingerprint": durable_fingerprint(natural),
        "row_fingerprint": F.sha2(row, 256),
    }


def hashdiff(columns: Sequence[str], strategy: str = "xxhash64") -> Column:
    """One hash of the tracked columns in the order of their names; NULL differs from every value."""
    return hash_key(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_HASHDIFF)) for c in sorted(columns)]), strategy)


def junk_key(columns: Sequence[str], strategy: str = "xxhash64") -> Column:
    """Key of a combination of low-cardinality values."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_JUNK)) for c in columns]
    return F.xxhash64(*parts) if strategy == "xxhash64" else hash_key(F.concat_ws(SEPARATOR, *parts), strategy)


def business_key_json(columns: Sequence[str]) -> Column:
    """The key columns as JSON; the whole table is one key where there are none."""
    return F.to_json(F.struct(*columns)) if columns else F.lit('{"__all__":true}')


def business_key_hash(columns: Sequence[str]) -> Column:
    return F.sha2(business_key_json(columns), 256)


def reserved_member(key: Column, *, natural: Sequence[str], not_applicable: Column | None = None, invalid: Column | None = None) -> Column:
    """The resolved key, or the reserved member that says why there is none.

    In this order: not applicable, missing (a natural key is NULL), bad value (blank text, or ``invalid`` says so), not yet available (no match).
    """
    null = blank = F.lit(False)
    for c in natural:
        null |= F.col(c).isNull()
        blank |= F.trim(F.col(c).cast("string")) == ""
    if invalid is not None:
        blank |= F.coalesce(invalid, F.lit(False))
    out = F.when(F.coalesce(not_applicable, F.lit(False)) if not_applicable is not None else F.lit(False), NOT_APPLICABLE)
    return out.when(null, MISSING).when(blank, BAD_VALUE).when(key.isNull(), NOT_YET_AVAILABLE).otherwise(key).cast("bigint")


def _typed(kind: T.DataType, text: str, number: int, flag: bool, date: str) -> Column | None:
    if isinstance(kind, T.StringType):
        return F.lit(text)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return F.lit(number).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(flag)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(date).cast(kind)
    return None


def placeholder(kind: T.DataType) -> Column:
    """What an inferred member holds in a column until its real row arrives; NULL for types without a natural one."""
    found = _typed(kind, "Not Yet Available", NOT_YET_AVAILABLE, False, "1900-01-01")
    return F.lit(None).cast(kind) if found is None else found


def replacement(kind: T.DataType) -> Column:
    """What replaces a NULL attribute of a strict dimension. ValueError for types without a natural value."""
    found = _typed(kind, "Missing", 0, False, "1900-01-01")
    if found is None:
        raise ValueError(f"no replacement for NULLs of type {kind.simpleString()}; give one")
    return found
