"""Display text of durations, dates and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stagewatch.functions.numbers import fixed_text

DASH = "—"
ELLIPSIS = "…"


def fmt_hours(hours: Column) -> Column:
    """Minutes below one hour, hours below one day, else days; a dash when unknown."""
    return (
        F.when(hours.isNull() | F.isnan(hours.cast("double")), F.lit(DASH))
        .when(hours < 1, F.concat(F.floor(hours * 60 + F.lit(0.5)).cast("bigint").cast("string"), F.lit("m")))
        .when(hours < 24, F.concat(fixed_text(hours, 1), F.lit("h")))
        .otherwise(F.concat(fixed_text(hours / 24, 1), F.lit("d")))
    )


def truncate(text: Column, length: int = 65) -> Column:
    """At most ``length`` characters followed by an ellipsis when text was cut."""
    cut = F.concat(F.substring(text, 1, length), F.lit(ELLIPSIS))
    return (
        F.when(text.isNull() | (text == ""), F.lit(DASH))
        .when(F.length(text) > length, cut)
        .otherwise(text)
    )


def initials(name: Column) -> Column:
    """First letters of the first two words, upper case."""
    letters = F.transform(F.split(name, r"\s+"), lambda w: F.substring(w, 1, 1))
    return F.upper(F.array_join(F.slice(letters, 1, 2), ""))


def _british_months(text: Column) -> Column:
    return F.regexp_replace(text, " Sep ", " Sept ")


def fmt_date(moment: Column) -> Column:
    """Day, short month, year, hour and minute."""
    return F.coalesce(_british_months(F.date_format(moment, "dd MMM yyyy, HH:mm")), F.lit(DASH))


def fmt_date_short(moment: Column) -> Column:
    return F.coalesce(_british_months(F.date_format(moment, "dd MMM yyyy")), F.lit(DASH))


def percent(rate: Column) -> Column:
    """A rate in [0, 1] as percent text with one decimal."""
    return F.concat(fixed_text(rate * 100, 1), F.lit("%"))


def words(code: Column) -> Column:
    """An event code as words: underscores become spaces."""
    return F.translate(code, "_", " ")
