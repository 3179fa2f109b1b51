"""Reconciliation over identity-like rows derived from ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import reconcile as ops
from attesta.operators import rules

from . import duck, places
from .registry import over, pick, query

EXACT = ["id_number", "date_of_birth", "issuance_date", "expiry_date", "gender"]
_TYPED = """
SELECT c_custkey AS submission_id, concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), CAST(c_custkey % 2 AS STRING), lpad(CAST(c_custkey AS STRING), 7, '0')) AS id_number,
  CASE WHEN c_custkey % 9 = 0 THEN 'Female' WHEN c_custkey % 2 = 1 THEN 'Male' ELSE 'Female' END AS gender,
  CAST(date_add(DATE '1970-01-01', CAST(c_custkey % 9000 AS INT)) AS STRING) AS date_of_birth, CAST(date_add(DATE '2015-01-01', CAST(c_custkey % 2000 AS INT)) AS STRING) AS issuance_date,
  CASE WHEN c_custkey % 11 > 0 THEN CAST(date_add(DATE '2030-01-01', CAST(c_custkey % 900 AS INT)) AS STRING) END AS expiry_date
FROM customer WHERE c_custkey % 17 > 0"""
_EXTRACTED = """
SELECT c_custkey AS submission_id, concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), CAST(c_custkey % 2 AS STRING), lpad(CAST(c_custkey AS STRING), 7, '0')) AS id_number,
  CASE WHEN c_custkey % 4 > 0 THEN CASE WHEN c_custkey % 2 = 1 THEN 'Male' ELSE 'Female' END END AS gender,
  CAST(date_add(DATE '1970-01-01', CAST(c_custkey % 9000 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS INT)) AS STRING) AS date_of_birth,
  CAST(date_add(DATE '2015-01-01', CAST(c_custkey % 2000 + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS INT)) AS STRING) AS issuance_date,
  CASE WHEN c_custkey % 13 > 0 THEN CAST(date_add(DATE '2030-01-01', CAST(c_custkey % 900 AS INT)) AS STRING) END AS expiry_date
FROM customer WHERE c_custkey % 19 > 0"""


def _duck(sql: str) -> str:
    return sql.replace("date_add(DATE '1970-01-01', CAST(", "(DATE '1970-01-01' + CAST(").replace("date_add(DATE '2015-01-01', CAST(", "(DATE '2015-01-01' + CAST(").replace("date_add(DATE '2030-01-01', CAST(", "(DATE '2030-01-01' + CAST(").replace("AS STRING", "AS VARCHAR")


_RULES = ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', {r[4]}, {r[5]})" for r in rules.FIELDS if r[1] in EXACT)
_FIELDS = f"""
WITH t AS ({_duck(_TYPED)}), e AS ({_duck(_EXTRACTED)}),
r AS (SELECT * FROM (VALUES {_RULES}) x(ord, field, severity, matching, pass_at, review_at)),
b AS (SELECT coalesce(t.submission_id, e.submission_id) AS submission_id, t.id_number AS n, {", ".join(f"e.{f} AS e_{f}, t.{f} AS t_{f}" for f in EXACT)} FROM t FULL JOIN e ON t.submission_id = e.submission_id),
l AS ({" UNION ALL ".join(f"SELECT submission_id, n, '{f}' AS field, e_{f} AS a, t_{f} AS b FROM b" for f in EXACT)}),
k AS (SELECT l.*, ord, severity, matching, pass_at, review_at FROM l JOIN r USING (field) WHERE NOT (b IS NULL AND a IS NOT NULL AND severity <> 'high')),
g AS (SELECT *, CASE substr(n, 4, 1) WHEN '0' THEN 'Female' WHEN '1' THEN 'Male' END AS expected, abs(TRY_CAST(a AS DATE) - TRY_CAST(b AS DATE)) AS gap FROM k),
h AS (SELECT *, matching = 'gender' AND n IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL) AND (coalesce(a <> expected, false) OR coalesce(b <> expected, false)) AS fraud FROM g),
s AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 0.0 WHEN matching = 'date' THEN CASE WHEN gap = 0 THEN 1.0 WHEN gap <= 1 THEN 1.0 - gap / 2.0 ELSE 0.0 END
  WHEN matching = 'gender' THEN CASE WHEN n IS NOT NULL AND NOT fraud THEN 1.0 ELSE 0.0 END ELSE CASE WHEN a = b THEN 1.0 ELSE 0.0 END END AS score FROM h),
f AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN CASE WHEN severity = 'high' THEN 'reject' ELSE 'manual_review' END WHEN fraud THEN 'reject' WHEN score >= pass_at THEN 'pass'
  WHEN severity = 'high' AND score < review_at THEN 'reject' ELSE 'manual_review' END AS decision FROM s)
"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return over(spark, sf_dir, "customer", _TYPED), over(spark, sf_dir, "customer", _EXTRACTED)


def _exact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed, extracted = _records(spark, sf_dir)
    return ops.compare_fields(ops.fields_of(typed, extracted, rules.field_rules(spark, EXACT)), kinds=())


#: Sums of whole units of 1e-12, a severity's mean rounded half up: no order of rows changes them.
_TENTHS = " + ".join(f"CASE WHEN n_{s} > 0 THEN {round(10 * w)} * ((s_{s} + n_{s} // 2) // n_{s}) ELSE 0 END" for s, w in rules.WEIGHTS)
_WEIGHTS = " + ".join(f"CASE WHEN n_{s} > 0 THEN {round(10 * w)} ELSE 0 END" for s, w in rules.WEIGHTS)
_BY_SEVERITY = ", ".join(f"CAST(sum(u) FILTER (severity = '{s}') AS BIGINT) AS s_{s}, count(*) FILTER (severity = '{s}') AS n_{s}" for s, _ in rules.WEIGHTS)
_SCORED = f"(SELECT submission_id, {_TENTHS} AS tenths, {_WEIGHTS} AS weights FROM (SELECT submission_id, {_BY_SEVERITY} FROM (SELECT *, CAST(round(score * 1e12) AS BIGINT) AS u FROM f) GROUP BY submission_id))"


@query(_FIELDS + f"""SELECT submission_id, count(*) AS total_fields, count(*) FILTER (decision = 'pass') AS passed_fields, count(*) FILTER (decision = 'manual_review') AS review_fields, count(*) FILTER (decision = 'reject') AS failed_fields,
max(tenths) / 1e13 AS overall_score, CASE WHEN bool_or(severity = 'high' AND decision = 'reject') THEN 'rejected' WHEN count(*) FILTER (decision = 'manual_review') > 0 THEN 'manual_review' ELSE 'approved' END AS overall_decision
FROM f JOIN {_SCORED} USING (submission_id) GROUP BY submission_id""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.summarise(_exact_fields(spark, sf_dir))
    return found.select("submission_id", "total_fields", "passed_fields", "review_fields", "failed_fields", "overall_score", "overall_decision")


@query(_FIELDS + "SELECT submission_id, field, a AS extracted, b AS typed, score, fraud, decision FROM f")
def reconcile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact_fields(spark, sf_dir).select("submission_id", "field", "extracted", "typed", "score", "fraud", "decision")


_SUMMARY = f"""
SELECT submission_id, total_fields, passed_fields, review_fields, failed_fields, tenths / 1e13 AS overall_score, tenths / weights / 1e12 AS normalised_score, CASE WHEN fatal THEN 'rejected' WHEN review_fields > 0 THEN 'manual_review' ELSE 'approved' END AS overall_decision,
concat_ws('|', CASE WHEN fatal AND bad IS NOT NULL THEN 'High-severity fields failed: ' || bad END, CASE WHEN fatal AND cheat IS NOT NULL THEN '{ops.FRAUD_LABEL}' || cheat END, CASE WHEN NOT fatal AND review_fields > 0 AND r1 IS NOT NULL THEN 'High-severity borderline: ' || r1 END,
  CASE WHEN NOT fatal AND review_fields > 0 AND r2 IS NOT NULL THEN 'Medium-severity mismatches: ' || r2 END, CASE WHEN NOT fatal AND review_fields > 0 AND r3 IS NOT NULL THEN 'Low-severity mismatches: ' || r3 END,
  CASE WHEN NOT fatal AND review_fields = 0 THEN 'All fields meet defined thresholds' END, printf('Weighted matching score: %d.%02d%%', ((tenths + 500000000) // 1000000000) // 100, ((tenths + 500000000) // 1000000000) % 100)) AS recommendations
FROM (SELECT submission_id, count(*) AS total_fields, count(*) FILTER (decision = 'pass') AS passed_fields, count(*) FILTER (decision = 'manual_review') AS review_fields, count(*) FILTER (decision = 'reject') AS failed_fields, bool_or(severity = 'high' AND decision = 'reject') AS fatal,
  string_agg(field, ', ' ORDER BY ord) FILTER (severity = 'high' AND decision = 'reject') AS bad, string_agg(field, ', ' ORDER BY ord) FILTER (severity = 'high' AND decision = 'reject' AND fraud) AS cheat,
  string_agg(field, ', ' ORDER BY ord) FILTER (severity = 'high' AND decision = 'manual_review') AS r1, string_agg(field, ', ' ORDER BY ord) FILTER (severity = 'medium' AND decision = 'manual_review') AS r2, string_agg(field, ', ' ORDER BY ord) FILTER (severity = 'low' AND decision = 'manual_review') AS r3 FROM f GROUP BY submission_id)
JOIN {_SCORED} USING (submission_id)"""


def _advised(found: DataFrame) -> DataFrame:
    """Summaries with their advice as one text."""
    return found.withColumn("recommendations", F.array_join("recommendations", "|"))


@query(_FIELDS + _SUMMARY)
def reconcile_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _advised(ops.summarise(_exact_fields(spark, sf_dir)))


_LATIN = ["Mohammed Ali", "Ali Mohammed", "Muhammad Alsqaf", "Fatima Noor", "Abdulrahman Saleh", "Maram Raed"]
_ARABIC = ["مرام رائد السقاف", "محمد علي", "فاطمة نور", "عبدالله سالم", "أحمد حسن", "سعيد ناصر"]
_PLACES = ["صنعاء - معين", "صنعاء", "عدن", "تعز - القاهرة", "123456", "حضرموت"]


_OF = lambda names, key: "[" + ", ".join(f"'{n}'" for n in names) + f"][CAST(({key}) % {len(names)} AS INT) + 1]"
_WORDS = ["name_english", "name_arabic", "place_of_birth"]
_LISTS = dict(zip(_WORDS, (_LATIN, _ARABIC, _PLACES), strict=True))
_SHIFT = {"name_english": 5, "name_arabic": 6, "place_of_birth": 4}
_PLACE_TOKENS = f"list_distinct(list_filter(list_transform(string_split_regex({duck.arabic_place('raw')}, '[-–—/،,]'), lambda t: trim(t)), lambda t: t <> ''))"
_ALL_RULES = ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', {r[4]}, {r[5]})" for r in rules.FIELDS)
_ALL = _FIELDS.replace("WITH t AS", "WITH RECURSIVE t AS").split("r AS (SELECT", 1)[0] + f"""
r AS (SELECT * FROM (VALUES {_ALL_RULES}) x(ord, field, severity, matching, pass_at, review_at)),
b AS (SELECT coalesce(t.submission_id, e.submission_id) AS submission_id, t.id_number AS n, CASE WHEN e.submission_id IS NULL THEN 1.0 ELSE 1 - (e.submission_id % 4) / 20.0 END AS confidence, {", ".join(f"e.{f} AS e_{f}, t.{f} AS t_{f}" for f in EXACT)},
  {", ".join(f"CASE WHEN e.submission_id IS NOT NULL AND ('{f}' <> 'name_english' OR e.submission_id % 7 > 0) THEN {_OF(_LISTS[f], f'e.submission_id + CAST(e.submission_id % {_SHIFT[f]} = 0 AS INT)')} END AS e_{f}, CASE WHEN t.submission_id IS NOT NULL THEN {_OF(_LISTS[f], 't.submission_id')} END AS t_{f}" for f in _WORDS)} FROM t FULL JOIN e ON t.submission_id = e.submission_id),
c AS (SELECT * REPLACE (CASE WHEN e_name_english IS NULL AND coalesce(t_name_english, '') <> '' AND coalesce(e_name_arabic, '') <> '' THEN {duck.arabic_to_latin('e_name_arabic')} ELSE e_name_english END AS e_name_english) FROM b),
rest AS (SELECT submission_id, n, confidence, field, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM b, r WHERE field NOT IN ({", ".join(f"'{f}'" for f in [*EXACT, *_WORDS, "passport_number"])})),
l AS ({" UNION ALL ".join(f"SELECT submission_id, n, confidence, '{f}' AS field, e_{f} AS a, t_{f} AS b FROM c" for f in [*EXACT, *_WORDS])} UNION ALL SELECT * FROM rest),
k AS (SELECT l.*, ord, severity, matching, pass_at, review_at, {duck.english("coalesce(a, '')")} AS ea, {duck.english("coalesce(b, '')")} AS eb, {duck.arabic("coalesce(a, '')")} AS aa, {duck.arabic("coalesce(b, '')")} AS ab FROM l JOIN r USING (field) WHERE NOT (b IS NULL AND a IS NOT NULL AND severity <> 'high') AND NOT (field = 'name_english' AND b IS NULL)),
pe AS (SELECT ea AS a, eb AS b FROM k WHERE matching = 'name_english'), pa AS (SELECT aa AS a, ab AS b FROM k WHERE matching = 'name_arabic'), {duck.compare('ce', 'pe', 'english')}, {duck.compare('ca', 'pa', 'arabic')},
{places.GAZETTEER_SQL}, pt AS (SELECT raw, CASE WHEN gov.governorate IS NOT NULL THEN 'g' WHEN dis.governorate IS NOT NULL THEN 'd' END AS kind, coalesce(gov.governorate, x.token) AS name FROM (SELECT raw, unnest({_PLACE_TOKENS}) AS token FROM (SELECT a AS raw FROM k WHERE matching = 'place' AND a IS NOT NULL UNION SELECT b FROM k WHERE matching = 'place' AND b IS NOT NULL)) x LEFT JOIN gov ON gov.token = x.token LEFT JOIN dis ON dis.token = x.token),
ps AS (SELECT raw, coalesce(list(name) FILTER (kind = 'g'), []) AS g, coalesce(list(name) FILTER (kind = 'd'), []) AS d FROM pt GROUP BY raw),
g AS (SELECT *, CASE substr(n, 4, 1) WHEN '0' THEN 'Female' WHEN '1' THEN 'Male' END AS expected, abs(TRY_CAST(a AS DATE) - TRY_CAST(b AS DATE)) AS gap FROM k),
h AS (SELECT *, matching = 'gender' AND n IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL) AND (coalesce(a <> expected, false) OR coalesce(b <> expected, false)) AS fraud FROM g),
s AS (SELECT h.*, CASE WHEN h.a IS NULL AND h.b IS NULL THEN 0.0 WHEN matching = 'date' THEN CASE WHEN gap = 0 THEN 1.0 WHEN gap <= 1 THEN 1.0 - gap / 2.0 ELSE 0.0 END
  WHEN matching = 'gender' THEN CASE WHEN n IS NOT NULL AND NOT fraud THEN 1.0 ELSE 0.0 END WHEN matching = 'name_english' THEN ce.score * confidence WHEN matching = 'name_arabic' THEN ca.score * confidence
  WHEN matching = 'place' THEN CASE WHEN h.b IS NULL OR h.a IS NULL OR len(regexp_extract_all(h.b, '[0-9]')) > length(h.b) * 0.5 THEN CASE WHEN h.b IS NULL AND h.a IS NOT NULL THEN 1.0 ELSE 0.0 END ELSE (CASE WHEN list_has_any(p.g, q.g) THEN 0.6 ELSE 0.0 END + CASE WHEN list_has_any(p.d, q.d) THEN 0.4 ELSE 0.0 END) * confidence END
  ELSE CASE WHEN h.a = h.b THEN 1.0 ELSE 0.0 END END AS score
  FROM h LEFT JOIN ce ON ce.a = ea AND ce.b = eb AND matching = 'name_english' LEFT JOIN ca ON ca.a = aa AND ca.b = ab AND matching = 'name_arabic' LEFT JOIN ps p ON p.raw = h.a AND matching = 'place' LEFT JOIN ps q ON q.raw = h.b AND matching = 'place'),
f AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN CASE WHEN severity = 'high' THEN 'reject' ELSE 'manual_review' END WHEN fraud THEN 'reject' WHEN score >= pass_at THEN 'pass'
  WHEN severity = 'high' AND score < review_at THEN 'reject' ELSE 'manual_review' END AS decision FROM s)"""


@query(_ALL + _SUMMARY)
def reconcile_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and places included; every seventh English name was not extracted and is romanised."""
    typed, extracted = _records(spark, sf_dir)
    typed = typed.withColumn("name_english", pick(_LATIN, "submission_id")).withColumn("name_arabic", pick(_ARABIC, "submission_id")).withColumn("place_of_birth", pick(_PLACES, "submission_id"))
    extracted = extracted.withColumn("name_english", F.when(F.col("submission_id") % 7 > 0, pick(_LATIN, "submission_id + int(submission_id % 5 = 0)"))).withColumn("name_arabic", pick(_ARABIC, "submission_id + int(submission_id % 6 = 0)"))
    extracted = extracted.withColumn("place_of_birth", pick(_PLACES, "submission_id + int(submission_id % 4 = 0)")).withColumn("confidence", F.expr("1 - (submission_id % 4) / 20.0").cast("double"))
    return _advised(ops.summarise(ops.compare_fields(ops.fields_of(typed, extracted, rules.field_rules(spark)))))
