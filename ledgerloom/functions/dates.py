"""Dates and recency."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DAY_MICROS = 86_400_000_000


def parse_date(text: Column) -> Column:
    """ISO timestamp or yyyy-MM-dd, otherwise NULL."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def filing_date_or(text: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), fallback.cast("timestamp"))


def days_old(date: Column, reference: Column) -> Column:
    """Whole days from date to reference, rounded down (also for future dates)."""
    gap = F.unix_micros(reference.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))
    return F.floor(gap / F.lit(_DAY_MICROS)).cast("int")


def decay_factor(days: Column, rate: float) -> Column:
    return F.exp(F.lit(-rate) * days / F.lit(365))


def period(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
