"""Check queries over measurements derived from ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import checks as ops

from .registry import over, pick, query, table

NAMES = [c[0] for c in ops.LIVENESS]
_MOST = ", ".join(f"({i}, '{c}', {m}, {t}, {str(k).lower()})" for i, (c, m, t, k) in enumerate(ops.LIVENESS))
_LIVE = f"""WITH r AS (SELECT * FROM (VALUES {_MOST}) t(n, chk, most, lim, core)),
m AS (SELECT user_id AS subject, chk AS check, max(value * most / 100) AS value, max(most) AS most, max(lim) AS lim FROM events JOIN r ON event_id % 6 = n GROUP BY user_id, chk),
s AS (SELECT subject, "check", least(1.0, value / most) AS score, lim AS "limit", least(1.0, value / most) > lim AS passed FROM m)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.element_at(F.array(*(F.lit(c[1]) for c in ops.LIVENESS)), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), pick(NAMES, "event_id").alias("check"), (F.col("value") * most / 100).alias("value"))
    return e.groupBy("subject", "check").agg(F.max("value").alias("value"))


@query(_LIVE + """ SELECT subject, "check", round(score, 6) AS score, passed FROM s""")
def liveness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.liveness(measurements(spark, sf_dir)).select("subject", "check", F.round("score", 6).alias("score"), "passed")


@query(_LIVE + """ SELECT subject, bool_and(passed) AS strict, avg(CAST(passed AS INT)) >= 0.5 AS lenient, round(avg(CAST(passed AS INT)), 6) AS confidence, count(*) FILTER (NOT passed) AS n_failed FROM s GROUP BY subject""")
def liveness_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.liveness(measurements(spark, sf_dir))
    strict, lenient = ops.verdicts(found), ops.verdicts(found, ratio=0.5).select("subject", F.col("ok").alias("lenient"))
    return strict.join(lenient, "subject").select("subject", F.col("ok").alias("strict"), "lenient", F.round("confidence", 6).alias("confidence"), F.size("failed").cast("long").alias("n_failed"))


_W = """SELECT subject, profile, max(texture) AS texture, max(moire) AS moire, max(screen_grid) AS screen_grid, max(sharpness) AS sharpness, max(halftone) AS halftone, max(saturation) AS saturation FROM (SELECT l_orderkey * 10 + l_linenumber AS subject, CASE l_returnflag WHEN 'A' THEN 'front' WHEN 'N' THEN 'back' ELSE 'passport' END AS profile, l_discount * 10 AS texture, l_tax * 10 AS moire, l_quantity / 60.0 AS screen_grid, l_discount * 2 AS sharpness, l_tax * 4 AS halftone, l_tax AS saturation FROM lineitem) GROUP BY subject, profile"""


@query(f"""WITH w AS ({_W}), x AS (SELECT *, CASE profile WHEN 'passport' THEN 0.09 ELSE 0.04 END AS s, CASE profile WHEN 'front' THEN 0.30 WHEN 'back' THEN 0.25 ELSE 0.33 END AS m, CASE profile WHEN 'front' THEN 0.55 WHEN 'back' THEN 0.65 ELSE 0.52 END AS g, CASE profile WHEN 'passport' THEN 0.28 ELSE 0.35 END AS h FROM w)
SELECT subject, profile, sharpness >= s AND moire > m AND screen_grid <= g AND texture >= 0.08 AND halftone <= h AND NOT (texture >= 0.92 AND saturation < 0.06)
 AND NOT (profile = 'passport' AND moire BETWEEN 0.33 AND 0.36 AND screen_grid BETWEEN 0.38 AND 0.50) AS original FROM x""")
def original_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = over(spark, sf_dir, "lineitem", _W).unpivot(["subject", "profile"], ["texture", "moire", "screen_grid", "sharpness", "halftone", "saturation"], "check", "value")
    return ops.not_a_copy(long).select("subject", "profile", "original")


@query("""WITH s AS (SELECT l_orderkey AS subject, l_linenumber AS side, l_discount * 10 >= 0.5 AS covered, l_discount * 10 >= 0.5 AND (l_tax > 0.02 OR l_discount * 10 >= 0.75) AS visible, l_quantity > 5 AS original, l_quantity > 10 AS sharp, l_partkey % 9 > 0 AS face, l_suppkey % 7 = 0 AS glare, l_partkey AS min_side FROM lineitem WHERE l_linenumber <= 2)
SELECT subject, bool_and(min_side >= 320 AND original AND sharp AND visible AND covered AND (side = 2 OR (face AND NOT glare))) AS passed,
sum(CAST(min_side < 320 AS INT) + CAST(NOT (original AND sharp AND visible AND covered) AS INT) + CAST(NOT visible AS INT) + CAST(NOT covered AS INT) + CAST(side = 1 AND NOT face AS INT) + CAST(side = 1 AND NOT (face AND NOT glare) AS INT)) AS n_failed FROM s GROUP BY subject""")
def document_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").selectExpr("l_orderkey AS subject", "if(l_linenumber = 1, 'front', 'back') AS side", "l_quantity > 5 AS original", "l_quantity > 10 AS sharp", "l_partkey % 9 > 0 AS face", "l_suppkey % 7 = 0 AS glare", "l_discount * 10 AS coverage", "l_tax > 0.02 AS margin_ok", "l_partkey AS min_side")
    return ops.document_sides(rows).select("subject", "passed", F.size("failed").cast("long").alias("n_failed"))


@query("""SELECT event_id, round(0.4 * (event_id % 6) / 5 + 0.3 * (value / 100) + 0.3 * least(1.0, (event_id % 40) / 100.0 / 0.15), 6) AS quality,
CASE WHEN event_id % 6 < 3 THEN 'Face partially hidden' WHEN value / 100 < 0.5 THEN 'Face unclear' WHEN (event_id % 40) / 100.0 < 0.02 THEN 'Face too small' END AS message FROM events""")
def face_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 6 AS landmarks", "value / 100 AS confidence", "double(event_id % 40) / 100 AS face_ratio")
    return ops.face_quality(e).select("event_id", F.round("quality", 6).alias("quality"), "message")


@query("""WITH r AS (SELECT user_id AS subject, event_id % 5 AS n, bool_or(value > 50) AS visible FROM events GROUP BY 1, 2)
SELECT subject, coalesce(bool_and(visible) FILTER (n IN (0, 1)), false) AS eyes, coalesce(bool_or(visible) FILTER (n = 2), false) AS nose, coalesce(bool_or(visible) FILTER (n IN (3, 4)), false) AS mouth, count(*) FILTER (visible) < 4 AS occluded FROM r GROUP BY subject""")
def landmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ["left_eye", "right_eye", "nose", "mouth_left", "mouth_right"]
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), pick(marks, "event_id").alias("landmark"), "value")
    return ops.landmark_summary(rows.groupBy("subject", "landmark").agg(F.bool_or(F.col("value") > 50).alias("visible")))


@query("""WITH r AS (SELECT user_id AS subject, event_id % 8 AS n, value > 40 AS passed, CASE WHEN event_id % 3 > 0 THEN value / 100 END AS score FROM events)
SELECT subject, round(coalesce(avg(CAST(passed AS INT)) FILTER (n < 5), 0), 6) AS authenticity, round(coalesce(avg(coalesce(score, CAST(passed AS INT))) FILTER (n >= 5), 0), 6) AS quality FROM r GROUP BY subject""")
def authenticity_and_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["official_document", "not_screenshot_or_copy", "integrity", "original_and_genuine", "no_extra_objects", "clear_and_readable", "fully_visible", "not_obscured"]
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), pick(names, "event_id").alias("check"), (F.col("value") > 40).alias("passed"), F.when(F.col("event_id") % 3 > 0, F.col("value") / 100).alias("score"))
    return ops.authenticity_and_quality(rows).select("subject", F.round("authenticity", 6).alias("authenticity"), F.round("quality", 6).alias("quality"))
