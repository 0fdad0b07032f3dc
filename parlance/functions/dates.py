"""Timestamp parsing and time buckets as column expressions.

Everything works on TIMESTAMP_NTZ wall-clock time in the requested zone, so the
session time zone never changes a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text as tx

GRAINS = ("none", "day", "week", "month", "quarter", "year")

_COMMON = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?)?$"
_ANY = (
    r"^(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:[ T](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?(?:([+-])(\d{2}):?(\d{2})?)?)?$"
)


def parse_iso(text: Column, zone: str = "UTC") -> Column:
    """ISO text to wall-clock time in ``zone``; anything else becomes null.

    Text without an offset is already in the zone. A bare year or month is not
    a timestamp, although a plain cast would accept it.
    """
    raw = F.regexp_replace(tx.strip(text), F.lit("Z"), F.lit("+00:00"))

    def part(position: int) -> Column:
        return F.regexp_extract(raw, _ANY, position)

    def number(position: int) -> Column:
        return F.coalesce(part(position).try_cast("int"), F.lit(0))

    seconds = F.concat(part(6), F.lit("."), part(7), F.lit("0")).try_cast("decimal(16,6)")
    local = F.try_make_timestamp_ntz(
        part(1).try_cast("int"), number(2), number(3), number(4), number(5),
        F.coalesce(seconds, F.lit(0).cast("decimal(16,6)")),
    )
    shift = number(9) * 60 + number(10)
    shift = F.when(part(8) == "-", -shift).otherwise(shift)
    in_utc = local - F.make_dt_interval(F.lit(0), F.lit(0), shift)
    aware = in_utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), in_utc)
    general = F.when(part(8) == "", local).otherwise(aware)
    return F.when(raw.rlike(_COMMON), raw.try_cast("timestamp_ntz")).when(raw.rlike(_ANY), general)


def wall_clock(column: Column, data_type: T.DataType, zone: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` for a text, date or timestamp column."""
    if isinstance(data_type, T.StringType):
        return parse_iso(column, zone)
    if isinstance(data_type, T.TimestampType):
        return F.convert_timezone(None, F.lit(zone), column)
    if isinstance(data_type, (T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def bucket(moment: Column, grain: str) -> Column:
    """Label of the day, week, month, quarter or year a wall-clock time falls in."""
    day = moment.cast("date")
    text = day.cast("string")
    if grain == "day":
        return text
    if grain == "week":
        return F.concat(F.date_sub(day, F.weekday(day)).cast("string"), F.lit("/P7D"))
    if grain == "month":
        return F.substring(text, 1, 7)
    if grain == "quarter":
        return F.concat(F.substring(text, 1, 4), F.lit("-Q"), F.quarter(day).cast("string"))
    if grain == "year":
        return F.substring(text, 1, 4)
    raise ValueError(f"unknown time grain {grain!r}")
