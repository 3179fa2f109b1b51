"""Places of birth: tokens classified by a gazetteer, overlap scores, decisions. Row by row, without a shuffle."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import mostly_digits, place_text, place_tokens

from . import gazetteer


def _map(table: DataFrame) -> Column:
    """A rule table of ``token``, ``governorate`` as a literal map; its size is that of the gazetteer."""
    return F.from_json(F.lit(json.dumps({r["token"]: r["governorate"] for r in table.collect()})), "map<string,string>")


def token_kinds(spark: SparkSession, raw: Column, normalised: bool = True) -> Column:
    """An array of (token, kind, canonical, governorate) for the tokens of a text, in order.

    A token that names a governorate counts as one, even where a district bears the same name.
    """
    governorates, districts = _map(gazetteer.governorates(spark, normalised)), _map(gazetteer.districts(spark, normalised))

    def classify(t: Column) -> Column:
        g, d = F.element_at(governorates, t), F.element_at(districts, t)
        kind = F.when(g.isNotNull(), "governorate").when(d.isNotNull(), "district").otherwise("unknown")
        return F.struct(t.alias("token"), kind.alias("kind"), F.coalesce(g, t).alias("canonical"), F.coalesce(g, d).alias("governorate"))

    return F.transform(place_tokens(place_text(raw)), classify)


def classified(places: DataFrame, key: str, raw: str, normalised: bool = True) -> DataFrame:
    """One row for each token: key, ``pos``, ``token``, ``kind``, ``canonical``, ``governorate``."""
    rows = places.select(key, F.posexplode(token_kinds(places.sparkSession, F.col(raw), normalised)).alias("pos", "_t"))
    return rows.select(key, "pos", "_t.token", "_t.kind", "_t.canonical", "_t.governorate")


def place_decision(score: Column, pass_at: float = 0.8) -> Column:
    return F.when(score >= pass_at, "pass").otherwise("manual_review")


def validate(pairs: DataFrame, key: str = "id", extracted: str = "extracted", typed: str = "typed", confidence: str = "confidence", pass_at: float = 0.8, normalised: bool = True) -> DataFrame:
    """Score (0.6 for a shared governorate, 0.4 for a shared district, times confidence) and decision.

    Nothing typed accepts what was extracted; typed text that is mostly digits scores 0. Never rejects.
    Where several names fit, the representative is the smallest. ``key`` need not be unique.
    """
    spark = pairs.sparkSession
    rows = pairs.withColumn("_e", token_kinds(spark, F.col(extracted), normalised)).withColumn("_t", token_kinds(spark, F.col(typed), normalised))
    of = lambda side, kind: F.transform(F.filter(side, lambda t: t["kind"] == kind), lambda t: t["canonical"])
    shared = lambda kind: F.coalesce(F.arrays_overlap(of("_e", kind), of("_t", kind)), F.lit(False))
    overlap = F.when(shared("governorate"), 0.6).otherwise(0.0) + F.when(shared("district"), 0.4).otherwise(0.0)
    no_typed, no_extracted = (F.coalesce(F.col(c), F.lit("")) == "" for c in (typed, extracted))
    garbage = mostly_digits(place_text(F.col(typed)))
    score = F.when(no_typed & ~no_extracted, 1.0).when(no_typed | garbage, 0.0).otherwise(overlap * F.col(confidence))
    pick = lambda kind: F.when(no_typed, F.get(of("_e", kind), F.lit(0))).when(~garbage, F.array_min(of("_t", kind)))
    return rows.select(*pairs.columns, score.alias("score"), place_decision(score, pass_at).alias("decision"), pick("governorate").alias("governorate"), pick("district").alias("district"))
