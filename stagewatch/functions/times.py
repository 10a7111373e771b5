"""Time arithmetic on UTC instants."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3_600_000_000
MAX_SHIFT_HOURS = 1e7
MAX_EPOCH_MILLIS = 8.64e15  # the range of dates in the payload format
# Date forms besides ISO 8601, after weekday, commas and the name of the zone are taken off; one parser for all.
OTHER_DATES = "[yyyy/M/d][M/d/yyyy][d MMM yyyy][MMM d yyyy][ H:m[:s]][ xx]"


def instant(value: datetime | str | Column) -> Column:
    """A literal instant; naive values are read as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f") + "Z").cast("timestamp")


def hours_between(start: Column, end: Column) -> Column:
    """Hours from ``start`` to ``end`` as a double."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_HOUR))


def plus_hours(start: Column, hours: Column) -> Column:
    """``start`` moved by a (fractional) number of hours, to the microsecond.

    Null beyond MAX_SHIFT_HOURS, where the sum would leave the range of timestamps.
    """
    hours = hours.cast("double")
    shift = F.floor(hours * F.lit(float(MICROS_PER_HOUR)) + F.lit(0.5)).cast("bigint")
    return F.when(F.abs(hours) <= MAX_SHIFT_HOURS, F.timestamp_micros(F.unix_micros(start) + shift))


def minus_days(moment: Column, days: int) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) - F.lit(days * 24 * MICROS_PER_HOUR))


def _other_date(text: Column) -> Column:
    """Instant of the written date forms, in UTC unless they give an offset; null for other text."""
    plain = F.regexp_replace(F.trim(text), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+|\s*\([^)]*\)$", "")
    plain = F.regexp_replace(plain, r"\s*(?:GMT|UTC|Z)(?=[+-]|$)", " ")
    plain = F.regexp_replace(plain, r"([A-Za-z]{3})[a-z]*\.?", "$1")
    plain = F.trim(F.regexp_replace(plain, r"[\s,]+", " "))
    return F.when(text.rlike(r"\d/\d|[A-Za-z]{3}.*\d{4}"), F.try_to_timestamp(plain, F.lit(OTHER_DATES)))


def to_utc(text: Column, json_type: Column | None = None, as_of: Column | None = None) -> Column:
    """Instant from the text of a JSON value.

    A JSON number is epoch milliseconds; a string is ISO 8601 (any offset), a written date such as
    ``2024/01/10 08:00``, ``1/10/2024``, ``Wed, 10 Jan 2024 08:00:00 GMT`` or ``January 10, 2024``, or else epoch
    seconds. Anything else gives ``as_of``, or null when that is not given. Millisecond precision.
    """
    is_number = F.lit(False) if json_type is None else json_type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    is_text = F.lit(True) if json_type is None else json_type == "STRING"
    number = text.try_cast("double")
    iso = F.when(text.rlike(r"^\s*[+-]?\d{4}(-|\s*$)"), F.try_to_timestamp(text))

    def epoch(millis: Column) -> Column:
        return F.when(F.abs(millis) <= MAX_EPOCH_MILLIS, F.timestamp_millis(F.floor(millis).cast("bigint")))

    millis, seconds = epoch(number), epoch(number * F.lit(1000.0))
    moment = F.when(is_number, millis).when(is_text, F.coalesce(iso, seconds, _other_date(text)))
    moment = F.date_trunc("MILLISECOND", moment)
    return moment if as_of is None else F.coalesce(moment, as_of)
