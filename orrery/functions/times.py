"""Instants in text: one moment, many notations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 9999-12-31 00:00:00 UTC in microseconds: end of a version that is still open.
OPEN_END_US = 253402214400000000
#: 9999-12-31 23:59:59 UTC in microseconds: closed end of a span that is still open.
OPEN_SPAN_US = 253402300799000000

_EPOCH = r"^[0-9]{9,11}(\.[0-9]+)?$"
#: The notation that Spark's own cast reads as it stands, and the same without a zone.
_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$"
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 (UTC) meant by a text, as BIGINT; NULL if it means no moment.

    Understands ISO dates and times with ``-``, ``/`` or ``.`` between the parts of the date, ``T``
    or blanks before the time, fractions, the compact ``20240131T093000``, zones (``Z``, ``UTC``,
    ``+02:00``; none = UTC), bare dates (their midnight) and seconds since 1970. Everything else,
    impossible dates (``2025-02-30``), blanks and NULL give NULL. The session's time zone plays no part.
    All of it stays in JVM expressions. The usual ISO notation goes to Spark's cast at once; only other texts are rewritten, in steps that each read the one before once.
    """
    moment = lambda t: F.unix_micros(t.try_cast("timestamp"))
    return F.when(text.rlike(_PLAIN), moment(F.concat(text, F.lit("Z")))).when(text.rlike(_ZONED), moment(text)).otherwise(_rewritten(text))


def _rewritten(text: Column) -> Column:
    s = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    t = F.regexp_replace(s, r"^([0-9]{4})[-/.]?([0-9]{2})[-/.]?([0-9]{2})(?:[T ]|$)", "$1-$2-$3T")
    t = F.regexp_replace(t, r"T([0-9]{2})([0-9]{2})([0-9]{2})", "T$1:$2:$3")
    t = F.regexp_replace(F.regexp_replace(t, " ", ""), "T$", "T00:00:00")
    t = F.regexp_replace(t, r"^(.{19}(?:\.[0-9]*)?)(?:Z|UTC)?$", "$1Z")
    moment = F.unix_micros(F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:"), t).try_cast("timestamp"))
    seconds = (s.try_cast("decimal(20,6)") * 1000000).cast("bigint")
    return F.when(s.rlike(_EPOCH), seconds).otherwise(moment)


def stamp_us(stamp: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column read as UTC; exact, whatever the session's zone.

    A TIMESTAMP column should be cast to TIMESTAMP_NTZ in a UTC session first.
    """
    day = F.unix_date(stamp.cast("date")).cast("bigint")
    seconds = (F.hour(stamp) * 3600 + F.minute(stamp) * 60).cast("bigint")
    fraction = (F.extract(F.lit("SECOND"), stamp) * 1000000).cast("bigint")
    return (day * 86400 + seconds) * 1000000 + fraction


def ntz_of_us(us: Column) -> Column:
    """The TIMESTAMP_NTZ (UTC) of microseconds since 1970, whatever the session's zone."""
    seconds = (us.cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
