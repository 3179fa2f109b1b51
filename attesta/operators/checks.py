"""Rule evaluation over long tables of measurements: (subject, check, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Liveness check, reference maximum, threshold that the scaled value must exceed, core check.
LIVENESS = [("image_size", 800.0, 0.20, True), ("texture", 20.0, 0.08, True), ("color", 1.0, 0.35, True), ("sharpness", 100.0, 0.02, True), ("moire_pattern", 1.0, 0.20, True), ("ml_model", 1.0, 0.60, False)]
#: Profile, check, comparison, limit.
COPY = [
    ("front", "sharpness", ">=", 0.04), ("front", "moire", ">", 0.30), ("front", "screen_grid", "<=", 0.55), ("front", "texture", ">=", 0.08), ("front", "halftone", "<=", 0.35),
    ("back", "sharpness", ">=", 0.04), ("back", "moire", ">", 0.25), ("back", "screen_grid", "<=", 0.65), ("back", "texture", ">=", 0.08), ("back", "halftone", "<=", 0.35),
    ("passport", "sharpness", ">=", 0.09), ("passport", "moire", ">", 0.33), ("passport", "screen_grid", "<=", 0.52), ("passport", "texture", ">=", 0.08), ("passport", "halftone", "<=", 0.28),
]
HIGH_TEXTURE, LEAST_SATURATION = 0.92, 0.06
PASSPORT_SUSPECT = {"moire": (0.33, 0.36), "screen_grid": (0.38, 0.50)}
LEAST_COVERAGE, LEAST_SIDE, FULL_FRAME = 0.5, 320, 0.75


def liveness_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIVENESS, "check string, most double, limit double, core boolean")


def copy_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COPY, "profile string, check string, op string, limit double")


def holds(value: Column, op: Column, limit: Column) -> Column:
    return F.when(op == ">", value > limit).when(op == ">=", value >= limit).when(op == "<", value < limit).otherwise(value <= limit)


def liveness(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """Scaled score and verdict of each liveness check (value over its reference maximum, at most 1)."""
    joined = rows.join(F.broadcast(liveness_rules(rows.sparkSession)), "check")
    score = F.least(F.lit(1.0), F.col("value") / F.col("most"))
    return joined.select(subject, "check", score.alias("score"), "limit", "core", (score > F.col("limit")).alias("passed"))


def verdicts(found: DataFrame, subject: str = "subject", ratio: float | None = None) -> DataFrame:
    """All checks (or a share of at least ``ratio``), the pass ratio, and the failed checks' names."""
    per = found.groupBy(subject).agg(
        F.bool_and("passed").alias("_all"), F.avg(F.col("passed").cast("double")).alias("confidence"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("failed")
    )
    live = F.col("_all") if ratio is None else F.col("confidence") >= ratio
    return per.select(subject, live.alias("ok"), F.least(F.lit(1.0), "confidence").alias("confidence"), (1 - F.col("confidence")).alias("doubt"), "failed")


def not_a_copy(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """Rows (subject, profile, check, value) to one verdict: all limits, saturation, the passport pair."""
    joined = rows.join(F.broadcast(copy_rules(rows.sparkSession)), ["profile", "check"], "left")
    limit_ok = F.when(F.col("limit").isNotNull(), holds(F.col("value"), F.col("op"), F.col("limit")))
    value = lambda c: F.max(F.when(F.col("check") == c, F.col("value")))
    per = joined.groupBy(subject, "profile").agg(
        F.bool_and(limit_ok).alias("_limits"), F.array_sort(F.collect_list(F.when(~limit_ok, F.col("check")))).alias("_failed"),
        *(value(c).alias(f"_{c}") for c in ("texture", "saturation", "moire", "screen_grid")),
    )
    flat = F.coalesce((F.col("_texture") >= HIGH_TEXTURE) & (F.col("_saturation") < LEAST_SATURATION), F.lit(False))
    suspect = (F.col("profile") == "passport") & F.col("_moire").between(*PASSPORT_SUSPECT["moire"]) & F.col("_screen_grid").between(*PASSPORT_SUSPECT["screen_grid"])
    suspect = F.coalesce(suspect, F.lit(False))
    failed = F.when(suspect, F.array(F.lit("screen capture"))).otherwise(F.concat("_failed", F.when(flat, F.array(F.lit("saturation"))).otherwise(F.array().cast("array<string>"))))
    return per.select(subject, "profile", (F.col("_limits") & ~flat & ~suspect).alias("original"), failed.alias("failed"))


def document_sides(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """Wide rows (subject, side, original, sharp, face, glare, coverage, margin_ok, min_side) to a verdict.

    A side counts if it is original, sharp and fully visible; the front also needs a face and no glare.
    """
    covered = F.col("coverage") >= LEAST_COVERAGE
    visible = covered & (F.col("margin_ok") | (F.col("coverage") >= FULL_FRAME))
    front = F.col("side") == "front"
    rules = {
        "resolution": F.col("min_side") >= LEAST_SIDE,
        "original_and_genuine": F.col("original") & F.col("sharp") & visible & covered,
        "fully_visible": visible,
        "no_extra_objects": covered,
        "official_document": ~front | F.col("face"),
        "not_obscured": ~front | (F.col("face") & ~F.col("glare")),
    }
    names = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.concat_ws("_", F.lit(n), "side")) for n, ok in rules.items())), lambda n: n.isNotNull())
    return rows.select(subject, names.alias("_f")).groupBy(subject).agg(F.array_sort(F.flatten(F.collect_list("_f"))).alias("failed")).select(subject, (F.size("failed") == 0).alias("passed"), "failed")


def passports(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """Wide rows (subject, original, sharp, face, glare, coverage, margin_ok, min_side) to a verdict."""
    covered = F.col("coverage") >= LEAST_COVERAGE
    rules = {
        "resolution": F.col("min_side") >= LEAST_SIDE, "official_document": F.col("face"), "not_screenshot_or_copy": F.col("original"), "clear_and_readable": F.col("sharp"),
        "fully_visible": covered & (F.col("margin_ok") | (F.col("coverage") >= FULL_FRAME)), "not_obscured": F.col("face") & ~F.col("glare"), "no_extra_objects": covered, "integrity": F.col("face"),
    }
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())), lambda n: n.isNotNull())
    return rows.select(subject, (F.size(failed) == 0).alias("passed"), failed.alias("failed"))


def face_quality(rows: DataFrame) -> DataFrame:
    """Add ``quality``, ``quality_ok`` and the first failing ``message`` (landmarks, confidence, face_ratio)."""
    quality = 0.4 * F.col("landmarks") / 5 + 0.3 * F.col("confidence") + 0.3 * F.least(F.lit(1.0), F.col("face_ratio") / 0.15)
    message = F.coalesce(
        F.when(F.col("landmarks") < 3, "Face partially hidden"), F.when(F.col("confidence") < 0.5, "Face unclear"), F.when(F.col("face_ratio") < 0.02, "Face too small")
    )
    return rows.select("*", quality.alias("quality"), message.isNull().alias("quality_ok"), message.alias("message"))


def landmark_summary(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """Rows (subject, landmark, visible): both eyes, nose, any mouth corner; fewer than four is occluded."""
    eye, mouth = F.col("landmark").isin("left_eye", "right_eye"), F.col("landmark").isin("mouth_left", "mouth_right")
    return rows.groupBy(subject).agg(
        F.coalesce(F.bool_and(F.when(eye, F.col("visible"))), F.lit(False)).alias("eyes"), F.coalesce(F.bool_or(F.when(F.col("landmark") == "nose", F.col("visible"))), F.lit(False)).alias("nose"),
        F.coalesce(F.bool_or(F.when(mouth, F.col("visible"))), F.lit(False)).alias("mouth"), (F.count_if("visible") < 4).alias("occluded"),
    )


def authenticity_and_quality(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """Mean of the flags of five authenticity checks, and mean of three quality scores (flags if no score)."""
    authentic = F.col("check").isin("official_document", "not_screenshot_or_copy", "integrity", "original_and_genuine", "no_extra_objects")
    quality = F.col("check").isin("clear_and_readable", "fully_visible", "not_obscured")
    flag = F.col("passed").cast("double")
    return rows.groupBy(subject).agg(F.coalesce(F.avg(F.when(authentic, flag)), F.lit(0.0)).alias("authenticity"), F.coalesce(F.avg(F.when(quality, F.coalesce("score", flag))), F.lit(0.0)).alias("quality"))
