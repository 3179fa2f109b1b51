"""Expiry status, severity and date sequence of documents, relative to a reference date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.dates import iso, parse_date


def check(rows: DataFrame, expiry: str = "expiry", ref: Column | None = None, soon: int = 90, grace: int = 30) -> DataFrame:
    """Add ``days``, ``status``, ``is_expired``, ``in_grace``, ``severity`` and ``message``."""
    ref = F.current_date() if ref is None else ref
    date = parse_date(F.col(expiry))
    days = F.datediff(date, ref)
    status = F.when(date.isNull(), "unknown").when(days < 0, "expired").when(days <= soon, "expiring_soon").otherwise("valid")
    in_grace = F.coalesce((days < 0) & (days >= -grace), F.lit(False))
    severity = F.when(days < 0, F.when(in_grace, "warning").otherwise("critical")).when(date.isNull() | (days <= 30), "warning").when(days <= soon, "info").otherwise("none")
    empty = F.coalesce(F.col(expiry), F.lit("")) == ""
    message = (
        F.when(empty, "Expiry date not provided or could not be extracted")
        .when(date.isNull(), F.concat(F.lit("Could not parse expiry date: "), F.col(expiry)))
        .when(in_grace, F.format_string("Document expired %d day(s) ago, but within %d-day grace period", -days, F.lit(grace)))
        .when(days < 0, F.format_string("Document expired %d day(s) ago", -days))
        .when(days == 0, "Document expires today")
        .when(days <= soon, F.format_string("Document will expire in %d day(s)", days))
        .otherwise(F.format_string("Document is valid for %d more day(s)", days))
    )
    return rows.select("*", F.coalesce(iso(date), F.col(expiry)).alias("expiry_date"), days.alias("days"), status.alias("status"), F.coalesce(days < 0, F.lit(False)).alias("is_expired"), in_grace.alias("in_grace"), severity.alias("severity"), message.alias("message"))


def sequence(rows: DataFrame, issue: str, expiry: str, birth: str, ref: Column) -> DataFrame:
    """Add ``sequence_ok``, ``validity_days``, ``validity_years``, ``warnings`` and ``dates_ok``."""
    i, e, b = (parse_date(F.col(c)) for c in (issue, expiry, birth))
    days = F.datediff(e, i)
    early, wrong = F.coalesce(i <= b, F.lit(False)), F.coalesce(e <= i, F.lit(False))
    years = F.when(days > 0, days / 365.25)
    warnings = F.filter(
        F.array(
            F.when(early, "Issuance date cannot be before or on date of birth"),
            F.when(wrong, "Expiry date must be after issuance date"),
            F.when(years < 1, F.format_string("Unusually short validity period: %d days", days)),
            F.when(years > 20, F.format_string("Unusually long validity period: %.1f years", years)),
        ),
        lambda w: w.isNotNull(),
    )
    expired = F.coalesce(F.datediff(e, ref) < 0, F.lit(False))
    return rows.select("*", (~early & ~wrong).alias("sequence_ok"), F.when(days > 0, days).alias("validity_days"), F.round(years, 1).alias("validity_years"), warnings.alias("warnings"), (~expired & (F.size(warnings) == 0)).alias("dates_ok"))
