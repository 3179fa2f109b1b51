"""Romanised names: dictionary, letters, snapping to known spellings; filtered translations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.phonetic import code, spoken
from attesta.functions.text import tokens

from . import gazetteer


def convert(rows: DataFrame, key: str, arabic: str) -> DataFrame:
    """Add ``english``, ``method`` (empty, dictionary, corrected, phonetic) and ``raw_phonetic``.

    Everything is worked out once for each distinct name, row by row over literal maps, and joined to the rows by name.
    """
    spark = rows.sparkSession
    by_code = gazetteer.spellings(spark).groupBy(code(F.col("name")).alias("code")).agg(F.min_by("name", "ord").alias("name"))
    known, snapped = (F.from_json(F.lit(json.dumps(m)), "map<string,string>") for m in (gazetteer.NAMES, {r["code"]: r["name"] for r in by_code.collect()}))
    once = rows.select(F.trim(F.col(arabic)).alias("_t")).distinct()
    once = once.withColumn("_en", F.element_at(known, F.col("_t"))).withColumn("_raw", F.when(F.col("_en").isNull(), spoken(F.col("_t"))))
    snap = lambda w: F.coalesce(F.when(F.length(w) >= 2, F.element_at(snapped, code(w))), w)
    once = once.withColumn("_fixed", F.when(F.col("_raw") != "", F.array_join(F.transform(tokens(F.col("_raw")), snap), " ")))
    empty = F.coalesce(F.col("_t"), F.lit("")) == ""
    method = F.when(empty, "empty").when(F.col("_en").isNotNull(), "dictionary").when(F.col("_fixed") != F.col("_raw"), "corrected").otherwise("phonetic")
    english = F.when(empty, F.col("_t")).otherwise(F.coalesce("_en", "_fixed", "_raw"))
    found = once.select("_t", english.alias("english"), method.alias("method"), F.when(~empty & F.col("_en").isNull(), F.col("_raw")).alias("raw_phonetic"))
    return rows.join(found, F.trim(F.col(arabic)).eqNullSafe(F.col("_t"))).drop("_t")


#: Translations known to be wrong.
BAD_TRANSLATIONS = ("akllal", "akllal,", "aklal", "akla")


def good_translation(source: Column, translated: Column, from_language: Column | None = None, to_language: Column | None = None) -> Column:
    """Not blank; and from Arabic to English: five characters or more, at most two of ``.,;!?``, vowels for a
    fifth of the length, a letter, no copy, not known to be wrong, and of several words if the source is."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    name = (F.coalesce(from_language, F.lit("ar")) == "ar") & (F.coalesce(to_language, F.lit("en")) == "en") if from_language is not None else F.lit(True)
    fits = (
        (F.length(translated) >= 5)
        & (F.regexp_count(translated, F.lit("[.,;!?]")) <= 2)
        & ~F.lower(translated).isin(*BAD_TRANSLATIONS)
        & (F.regexp_count(F.lower(translated), F.lit("[aeiou]")) >= F.length(translated) * 0.2)
        & translated.rlike(r"\p{L}")
        & (bare(translated) != bare(source))
        & ((F.size(tokens(F.regexp_replace(source, r"(?U)\s+", " "))) < 2) | F.contains(translated, F.lit(" ")))
    )
    return F.coalesce((bare(translated) != "") & (~name | fits), F.lit(False))


def translate_rows(rows: DataFrame, dictionary: DataFrame, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """Add ``translated``: Arabic rows by dictionary (source, target), the text itself otherwise."""
    d = dictionary.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    joined = rows.join(d, (F.col(language_col) == "ar") & (F.col(text_col) == F.col("_s")), "left")
    return joined.select(*rows.columns, F.coalesce("_t", F.col(text_col)).alias("translated"))


def without_common_words(words: DataFrame, col: str) -> DataFrame:
    bad = gazetteer.common_words(words.sparkSession)
    return words.join(F.broadcast(bad), F.lower(F.trim(F.col(col))) == F.col("word"), "left_anti")
