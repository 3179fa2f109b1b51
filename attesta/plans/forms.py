"""Form queries over rows derived from ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import forms as ops
from attesta.sources.tables import scratch

from .registry import over, query

REF = "2024-06-01"
_FORM = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'passport' ELSE 'national_id' END AS id_type,
 CASE WHEN c_custkey % 3 > 0 THEN concat('200', cast(c_custkey % 5 as {s}), lpad(cast(c_custkey as {s}), CASE WHEN c_custkey % 11 = 0 THEN 6 ELSE 7 END, '0')) END AS id_number,
 CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 > 0 THEN lpad(cast(c_custkey as {s}), 8, '0') END AS passport_number,
 CASE WHEN c_custkey % 13 > 0 THEN 'Maram Raed' ELSE 'Maram 1' END AS full_name, CAST(NULL AS {s}) AS name_arabic, CAST(NULL AS {s}) AS name_english,
 CASE WHEN c_custkey % 4 > 0 THEN 'Female' END AS gender, CASE WHEN c_custkey % 17 = 0 THEN 'X9' ELSE 'Aden' END AS place_of_birth,
 concat(cast(1895 + c_custkey % 130 as {s}), '-02-03') AS date_of_birth, concat(cast(1985 + c_custkey % 40 as {s}), '-05-06') AS issuance_date, concat(cast(2020 + c_custkey % 60 as {s}), '-05-06') AS expiry_date FROM customer"""
#: What each rule asks, the field it names and what it says.
_RULES = [
    ("id_type = 'national_id' AND length(id_number) <> 11", "id_number", "must be 11 digits"),
    ("id_type = 'national_id' AND length(id_number) = 11 AND gender IS NULL AND substr(id_number, 4, 1) NOT IN ('0', '1')", "id_number", "4th digit must be 0 or 1"),
    ("id_type = 'passport' AND passport_number IS NULL", "passport_number", "required"),
    ("id_type = 'passport' AND gender IS NULL", "gender", "required"),
    ("regexp_matches(full_name, '[0-9]')", "name_english", "letters only"),
    ("place_of_birth = 'X9'", "place_of_birth", "letters only"),
    ("CAST(date_of_birth AS DATE) NOT BETWEEN DATE '1900-01-01' AND DATE '2024-06-01'", "date_of_birth", "out of range"),
    ("CAST(issuance_date AS DATE) NOT BETWEEN DATE '1990-01-01' AND DATE '2024-06-01'", "issuance_date", "out of range"),
    ("CAST(expiry_date AS DATE) NOT BETWEEN DATE '2024-06-01' AND DATE '2074-06-01'", "expiry_date", "out of range"),
    ("(DATE '2024-06-01' - CAST(date_of_birth AS DATE)) / 365.25 > 120", "date_of_birth", "age over 120 years"),
    ("expiry_date <= issuance_date", "expiry_date", "must be after issuance"),
    ("date_of_birth >= issuance_date", "date_of_birth", "must be before issuance"),
]
_CHECKS = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x, _, _ in _RULES)
_SOURCE = f"({_FORM.replace('{s}', 'VARCHAR')})"


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.validate(over(spark, sf_dir, "customer", _FORM), F.lit(REF).cast("date"))


@query(f"SELECT c_custkey, {_CHECKS} AS n_errors, {_CHECKS} = 0 AS valid FROM {_SOURCE}")
def validate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("c_custkey", F.size("errors").alias("n_errors"), (F.size("errors") == 0).alias("valid"))


@query(" UNION ALL ".join(f"SELECT c_custkey, '{field}' AS field, '{message}' AS message FROM {_SOURCE} WHERE {x}" for x, field, message in _RULES))
def form_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every form, as it is told."""
    return _checked(spark, sf_dir).select("c_custkey", F.inline("errors"))


@query(f"SELECT c_custkey, CASE WHEN n = 0 THEN 'valid' ELSE 'invalid' END AS outcome, n AS n_errors, sum(CAST(n > 0 AS INT)) OVER () AS invalid_forms FROM (SELECT c_custkey, {_CHECKS} AS n FROM {_SOURCE})")
def form_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms written in one pass to two folders and read back, with the count that the writing observed."""
    path = scratch(spark, "forms")
    seen = ops.write_split(_checked(spark, sf_dir), path)
    return spark.read.parquet(path).select("c_custkey", "outcome", F.size("errors").alias("n_errors"), F.lit(seen["invalid"]).alias("invalid_forms"))
