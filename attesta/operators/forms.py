"""Form rules: every broken rule of a row, in one pass; valid and invalid rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attesta.functions.text import name_language

LETTERS = "a-zA-Z؀-ۿݐ-ݿࢠ-ࣿـ"
NAME, PLACE = rf"^[{LETTERS}\s\-]+$", rf"^[{LETTERS}\s\-,]+$"


def routed(rows: DataFrame) -> DataFrame:
    """Put ``full_name`` where its script belongs; a mixed one fills both."""
    lang = name_language(F.col("full_name"))
    fill = lambda c, script: F.coalesce(F.nullif(F.col(c), F.lit("")), F.when(lang.isin(script, "mixed"), F.col("full_name")))
    return rows.withColumn("name_arabic", fill("name_arabic", "arabic")).withColumn("name_english", fill("name_english", "english"))


def gender_of_number(rows: DataFrame) -> DataFrame:
    digit = F.substring("id_number", 4, 1)
    derived = F.when(digit == "1", "Male").when(digit == "0", "Female")
    return rows.withColumn("gender", F.coalesce("gender", F.when(F.col("id_type") == "national_id", derived)))


def errors(ref: Column) -> Column:
    """Array of (field, message) for the rules that a row breaks."""
    national, passport = F.col("id_type") == "national_id", F.col("id_type") == "passport"
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    bad = lambda field, broken, message: F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
    date = lambda c: F.try_to_date(F.trim(F.col(c)), "yyyy-M-d")
    rules = [
        bad("id_type", ~(national | passport) | F.col("id_type").isNull(), "unknown document type"),
        bad("id_number", national & blank("id_number"), "required"),
        bad("id_number", national & ~blank("id_number") & ~F.trim("id_number").rlike(r"^\d{11}$"), "must be 11 digits"),
        bad("id_number", national & F.trim("id_number").rlike(r"^\d{11}$") & F.col("gender").isNull(), "4th digit must be 0 or 1"),
        bad("passport_number", passport & blank("passport_number"), "required"),
        bad("passport_number", passport & ~blank("passport_number") & ~F.trim("passport_number").rlike(r"^\d{8}$"), "must be 8 digits"),
        bad("gender", passport & blank("gender"), "required"),
        bad("gender", ~blank("gender") & ~F.col("gender").isin("Male", "Female"), "must be Male or Female"),
        bad("name", blank("name_arabic") & blank("name_english"), "required"),
    ]
    for c, pattern in (("name_arabic", NAME), ("name_english", NAME), ("place_of_birth", PLACE)):
        rules += [bad(c, ~blank(c) & ~F.trim(c).rlike(pattern), "letters only"), bad(c, ~blank(c) & ~F.length(F.trim(c)).between(2, 100), "2 to 100 characters")]
    rules.append(bad("date_of_birth", blank("date_of_birth"), "required"))
    lowest = {"date_of_birth": F.lit("1900-01-01").cast("date"), "issuance_date": F.lit("1990-01-01").cast("date"), "expiry_date": ref}
    highest = {"date_of_birth": ref, "issuance_date": ref, "expiry_date": F.add_months(ref, 600)}
    for c in lowest:
        rules += [bad(c, ~blank(c) & date(c).isNull(), "must be YYYY-MM-DD"), bad(c, ~date(c).between(lowest[c], highest[c]), "out of range")]
    rules += [
        bad("date_of_birth", F.datediff(ref, date("date_of_birth")) / 365.25 > 120, "age over 120 years"),
        bad("expiry_date", date("expiry_date") <= date("issuance_date"), "must be after issuance"),
        bad("date_of_birth", date("date_of_birth") >= date("issuance_date"), "must be before issuance"),
    ]
    return F.filter(F.array(*rules), lambda e: e.isNotNull())


def validate(rows: DataFrame, ref: Column) -> DataFrame:
    """Cleaned rows with ``errors``; valid ones have none. The cross-date rule holds for both forms."""
    return gender_of_number(routed(rows)).withColumn("errors", errors(ref))


def write_split(checked: DataFrame, path: str) -> dict[str, int]:
    """Write checked rows in one pass, valid and invalid ones to folders of their own, and count both on the way.

    Invalid rows keep their errors. The counts, ``rows``, ``invalid`` and ``errors``, come from the writing itself.
    """
    seen = Observation("forms")
    counted = checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("invalid"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"))
    counted.withColumn("outcome", F.when(F.size("errors") == 0, "valid").otherwise("invalid")).write.partitionBy("outcome").parquet(path)
    return seen.get


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
