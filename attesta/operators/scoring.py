"""Point scores of documents, data matches, and faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most points of each part and of each group.
DOCUMENT = {"authenticity": 10.0, "quality": 10.0, "ocr_confidence": 10.0, "front_back_match": 5.0, "most": 35.0}
DATA = {"id_number": 20.0, "name_match": 10.0, "most": 30.0}
FACE = {"face_match": 20.0, "liveness": 15.0, "most": 35.0}


def capped(share: Column, most: float) -> Column:
    return F.least(F.lit(most), share * most)


def _sum(parts: dict[str, Column], most: float) -> list[Column]:
    total = F.lit(0.0)
    for p in parts.values():
        total = total + p
    return [*(F.round(c, 2).alias(n) for n, c in parts.items()), F.round(F.least(F.lit(most), total), 2).alias("total")]


def document_scores(fields: DataFrame, subject: str = "subject", points: dict[str, float] = DOCUMENT) -> DataFrame:
    """From rows (subject, confidence, quality, is_national_id, has_back): mean of positive confidences."""
    per = fields.groupBy(subject).agg(
        F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("_conf"), F.max("quality").alias("_q"),
        (F.bool_or("is_national_id") & F.bool_or("has_back")).alias("_both"),
    )
    parts = {
        "authenticity": capped(F.col("_q"), points["authenticity"]),
        "quality": capped(F.col("_q"), points["quality"]),
        "ocr_confidence": capped(F.coalesce("_conf", F.lit(0.0)), points["ocr_confidence"]),
        "front_back_match": F.when(F.col("_both"), points["front_back_match"]).otherwise(0.0),
    }
    return per.select(subject, *_sum(parts, points["most"]))


def data_match_scores(items: DataFrame, subject: str = "subject", points: dict[str, float] = DATA) -> DataFrame:
    """From rows (subject, field, result)."""
    hit = lambda field, n: F.max(F.when((F.col("field") == field) & (F.col("result") == "MATCH"), n).otherwise(0.0))
    per = items.groupBy(subject).agg(hit("id_number", points["id_number"]).alias("_id"), hit("full_name", points["name_match"]).alias("_name"))
    return per.select(subject, *_sum({"id_number": F.col("_id"), "name_match": F.col("_name")}, points["most"]))


def face_liveness_scores(rows: DataFrame, points: dict[str, float] = FACE) -> DataFrame:
    """Add points from ``face`` and ``confidence`` (0 to 100) and ``is_live``."""
    live = F.when(F.col("is_live"), capped(F.col("confidence") / 100, points["liveness"])).otherwise(0.0)
    return rows.select("*", *_sum({"face_match": capped(F.col("face") / 100, points["face_match"]), "liveness": live}, points["most"]))


def status_of(score: Column, match: float = 0.7, doubt: float = 0.5) -> Column:
    return F.when(score.isNull(), "NOT_AVAILABLE").when(score >= match, "MATCH").when(score >= doubt, "INCONCLUSIVE").otherwise("NO_MATCH")
