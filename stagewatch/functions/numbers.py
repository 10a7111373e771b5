"""Rounding and number text that does not depend on the engine's decimal printing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round to ``digits`` places, halves upwards, in double arithmetic."""
    scale = F.lit(float(10**digits))
    return F.floor(value.cast("double") * scale + F.lit(0.5)).cast("double") / scale


def fixed_text(value: Column, digits: int) -> Column:
    """Text with exactly ``digits`` decimals, e.g. 12.3 at 2 digits is '12.30'."""
    scale = 10**digits
    units = F.floor(F.abs(value.cast("double")) * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(units / F.lit(scale)).cast("bigint").cast("string")
    if digits == 0:
        return F.concat(sign, units.cast("string"))
    part = F.lpad((units % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(sign, whole, F.lit("."), part)


def plain_text(value: Column) -> Column:
    """Shortest text of a decimal: 48.00 is '48', 0.50 is '0.5'."""
    return F.regexp_replace(value.cast("decimal(20,4)").cast("string"), r"\.?0+$", "")


def pad_number(value: Column, width: int) -> Column:
    """Zero-padded text that grows instead of being cut when the number is longer."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
