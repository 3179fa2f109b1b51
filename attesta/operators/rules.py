"""Rule tables as DataFrames: field rules, severity weights, policy tree, check thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Order, field, severity, how it is compared, score to pass, score for review.
FIELDS = [
    (0, "id_number", "high", "exact", 1.0, 1.0),
    (1, "passport_number", "high", "exact", 1.0, 1.0),
    (2, "date_of_birth", "high", "exact", 1.0, 1.0),
    (3, "name_english", "high", "name_english", 0.85, 0.60),
    (4, "name_arabic", "high", "name_arabic", 0.85, 0.60),
    (5, "issuance_date", "medium", "date", 1.0, 0.5),
    (6, "expiry_date", "medium", "date", 1.0, 0.5),
    (7, "gender", "medium", "gender", 1.0, 1.0),
    (8, "place_of_birth", "medium", "place", 0.8, 0.4),
    (9, "nationality", "low", "name_arabic", 0.80, 0.50),
    (10, "profession", "low", "name_arabic", 0.75, 0.40),
    (11, "issuance_place", "low", "name_arabic", 0.75, 0.40),
]
#: What a severity weighs in the overall score.
WEIGHTS = [("high", 1.0), ("medium", 0.5), ("low", 0.2)]
#: Component, score it reads, parent, level from the leaves, lowest and highest points, enabled.
POLICY = [
    ("ekyc", None, None, 2, 0.0, 100.0, True),
    ("document_verify", None, "ekyc", 1, 30.0, 35.0, True),
    ("document_authenticity", "doc_authenticity", "document_verify", 0, 10.0, 10.0, True),
    ("document_quality", "doc_quality", "document_verify", 0, 10.0, 10.0, True),
    ("ocr_confidence", "ocr_confidence", "document_verify", 0, 9.0, 10.0, True),
    ("front_back_id_match", "front_back_match", "document_verify", 0, 5.0, 5.0, True),
    ("face_liveness", None, "ekyc", 1, 30.0, 35.0, True),
    ("face_matching", "face_match", "face_liveness", 0, 15.0, 20.0, True),
    ("passive_photo", "liveness", "face_liveness", 0, 10.0, 15.0, True),
    ("data_match", None, "ekyc", 1, 28.0, 30.0, True),
    ("id_number", "id_number_match", "data_match", 0, 15.0, 20.0, True),
    ("name_matching", "name_match", "data_match", 0, 7.0, 10.0, True),
    ("dob", "dob_match", "data_match", 0, 0.0, 0.0, False),
    ("issuance_date", "issuance_date_match", "data_match", 0, 0.0, 0.0, False),
    ("expiry_date", "expiry_date_match", "data_match", 0, 0.0, 0.0, False),
    ("gender", "gender_match", "data_match", 0, 0.0, 0.0, False),
    ("device_risk", None, "ekyc", 1, 0.0, 0.0, False),
    ("compliance", None, "ekyc", 1, 0.0, 0.0, False),
]


def field_rules(spark: SparkSession, fields: list | None = None) -> DataFrame:
    rows = [r for r in FIELDS if fields is None or r[1] in fields]
    return spark.createDataFrame(rows, "ord int, field string, severity string, matching string, pass_at double, review_at double")


def policy_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:4] for r in POLICY], "component string, score_key string, parent string, level int")


def policy_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0], *r[4:]) for r in POLICY], "component string, min double, max double, status boolean")
