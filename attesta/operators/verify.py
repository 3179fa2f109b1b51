"""Scores of one verification: typed against printed values, document types, front against back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import dates, text
from attesta.functions.phonetic import arabic_to_latin
from attesta.functions.similarity import ratio

from . import names, reconcile

#: Accepted spellings of each document type.
ALIASES = {"yemen_national_id": "yemen_national_id", "yemen_id": "yemen_national_id", "national_id": "yemen_national_id", "yemen_passport": "yemen_passport", "passport": "yemen_passport"}


def document_type(c: Column) -> Column:
    """The canonical type of a typed one, or null."""
    plain = F.replace(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair)), plain)


def type_decision(expected: Column, detected: Column) -> Column:
    same = document_type(expected) == document_type(detected)
    return F.when(F.coalesce(same, F.lit(False)), "accepted").otherwise("rejected")


def trimmed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.trim(F.col(c)) for c in columns})


def front_back(cards: DataFrame, backs: DataFrame, key: str) -> DataFrame:
    """Add ``front_back_match``: 1 without a back or with the same number, else 0.

    ``cards``: key, number; ``backs``: key, number of the back. A back without a number scores 0.
    """
    b = backs.select(key, F.col("number").alias("_back"), F.lit(True).alias("_has"))
    score = F.when(F.col("_has").isNull(), 1.0).when(F.col("number") == F.col("_back"), 1.0).otherwise(0.0)
    return cards.join(b, key, "left").select(*cards.columns, score.alias("front_back_match"))


@F.pandas_udf(T.DoubleType())
def both_ways(a: pd.Series, b: pd.Series, at_least: pd.Series) -> pd.Series:
    """Mean share of tokens on either side that find a similar token on the other."""
    def share(xs: set[str], ys: set[str], limit: float) -> float:
        return sum(max(ratio(x, y) for y in ys) >= limit for x in xs) / len(xs)

    out = []
    for x, y, limit in zip(a, b, at_least, strict=True):
        xs, ys = set(x.split()), set(y.split())
        out.append((share(xs, ys, limit) + share(ys, xs, limit)) / 2 if xs and ys else 0.0)
    return pd.Series(out, dtype="float64")


def name_scores(rows: DataFrame, typed: str = "typed", arabic: str = "name_arabic", english: str = "name_english") -> DataFrame:
    """Add ``name_score``: nothing typed is 1; equal or same tokens 1; all tokens similar both ways 1;
    0.7 + 0.3 x mean share from 0.6 on; else the fuzzy comparison. The typed script picks the printed name,
    and a missing English one is romanised from the Arabic."""
    is_arabic = text.has_arabic(F.col(typed))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    printed = F.when(is_arabic, F.col(arabic)).otherwise(F.when(blank(english), arabic_to_latin(F.col(arabic))).otherwise(F.col(english)))
    base = rows.withColumn("_p", printed).withColumn("_ar", is_arabic)
    parts = []
    for language, wanted in (("arabic", F.col("_ar")), ("english", ~F.col("_ar"))):
        normal = text.arabic_name if language == "arabic" else text.english_name
        part = names.compare(base.where(wanted), "_p", typed, language, "_s").withColumn("_x", normal(F.col("_p"))).withColumn("_y", normal(F.col(typed)))
        pairs = part.where("_s_tier = 'fuzzy'").select(F.col("_x").alias("_kx"), F.col("_y").alias("_ky")).distinct()
        shares = pairs.withColumn("_share", both_ways("_kx", "_ky", F.lit(0.75 if language == "arabic" else 0.65)))
        parts.append(part.join(shares, (F.col("_x") == F.col("_kx")) & (F.col("_y") == F.col("_ky")), "left"))
    both = parts[0].unionByName(parts[1])
    score = (
        F.when(blank(typed), 1.0).when(blank("_p"), 0.0).when(F.col("_s_tier") != "fuzzy", F.col("_s"))
        .when(F.col("_share") == 1, 1.0).when(F.col("_share") >= 0.6, 0.7 + 0.3 * F.col("_share")).otherwise(F.col("_s"))
    )
    return both.select(*rows.columns, score.alias("name_score"))


def optional(typed: Column, score: Column) -> Column:
    """What was not typed is not held against anyone."""
    return F.when(F.coalesce(typed, F.lit("")) == "", 1.0).otherwise(score)


def id_score(typed: Column, printed: Column) -> Column:
    return optional(typed, reconcile.exact_score(printed, typed))


def date_score(typed: Column, printed: Column, tolerance: int = 1) -> Column:
    return optional(typed, dates.date_score(printed, typed, tolerance))


def gender_score(typed: Column, printed: Column, number: Column, passport: Column) -> Column:
    return optional(typed, reconcile.gender_score(printed, F.initcap(F.trim(typed)), number, passport))


def match_result(typed: Column, printed: Column, match: Column) -> Column:
    return F.when(typed.isNull() | printed.isNull(), "NOT_AVAILABLE").when(match, "MATCH").otherwise("MISMATCH")


def authenticity_status(score: Column) -> Column:
    return F.when(score >= 0.7, "VALID").when(score >= 0.4, "SUSPICIOUS").otherwise("INVALID")


def face_status(score: Column, failed: Column, limit: float = 0.7) -> Column:
    """From a score of 0 to 100."""
    return F.when(failed, "INCONCLUSIVE").when(score >= limit * 100, "MATCH").when(score >= limit * 70, "INCONCLUSIVE").otherwise("NO_MATCH")


def liveness_result(live: Column, failed: Column, enabled: bool = True) -> Column:
    return F.when(F.lit(not enabled) | (live & ~failed), "LIVE").otherwise("NOT_LIVE")
