"""Dates as text: parsing in a fixed order of formats, tolerance, expiry, two-digit years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order in which they are tried.
FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyyMMdd")


def parse_date(text: Column) -> Column:
    """The first format that fits; null for impossible days and anything else."""
    trimmed = F.trim(text)
    return F.coalesce(*(F.try_to_date(trimmed, f) for f in FORMATS))


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def normalise_date(text: Column) -> Column:
    return iso(parse_date(text))


def mrz_date(text: Column, pivot: int = 40) -> Column:
    """``YYMMDD``: years up to the pivot are 20xx."""
    year = F.substring(text, 1, 2)
    century = F.when(F.try_to_number(year, F.lit("99")) <= pivot, "20").otherwise("19")
    return F.when(text.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(century, text), "yyyyMMdd"))


def date_score(a: Column, b: Column, tolerance: int = 1) -> Column:
    """1 for equal dates, falling evenly to 0 beyond the tolerance; both missing is a match."""
    days = F.abs(F.datediff(parse_date(a), parse_date(b)))
    return (
        F.when(a.isNull() & b.isNull(), 1.0)
        .when(days == 0, 1.0)
        .when(days <= tolerance, 1.0 - days / (tolerance + 1))
        .otherwise(0.0)
    )


def date_gap(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), 0).otherwise(F.abs(F.datediff(parse_date(a), parse_date(b))))
