"""Policy and score queries over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import policy, rules, scoring

from .registry import query, table

_TREE = ",\n".join(f"('{c}', {f"'{k}'" if k else 'NULL'}, {f"'{p}'" if p else 'NULL'}, {lv}, {lo}, {hi}, {s})" for c, k, p, lv, lo, hi, s in rules.POLICY)
_SCORES = """
keys AS (SELECT * FROM (VALUES (0,'doc_authenticity'),(1,'doc_quality'),(2,'ocr_confidence'),(3,'front_back_match'),(4,'face_match'),(5,'liveness'),(6,'id_number_match'),(7,'name_match')) t(n, score_key)),
scores AS (SELECT user_id AS subject, score_key, least(max(value) / 100, 1.0) AS raw FROM events JOIN keys ON event_id % 8 = n GROUP BY user_id, score_key),
"""
_COMPONENTS = f"""
WITH {_SCORES}
tree AS (SELECT * FROM (VALUES {_TREE}) t(component, score_key, parent, level, lo, hi, status)),
subjects AS (SELECT DISTINCT subject FROM scores),
leaves AS (SELECT subject, component, parent, level, lo, hi, status,
  CASE WHEN NOT status OR hi = 0 THEN 0.0 ELSE lo / hi * 100 END AS threshold, CASE WHEN status THEN coalesce(raw, 0) * 100 ELSE 0.0 END AS score,
  CASE WHEN status THEN coalesce(raw, 0) * 100 / 100 * hi ELSE 0.0 END AS points,
  (NOT status OR coalesce(raw, 0) * 100 >= CASE WHEN hi = 0 THEN 0.0 ELSE lo / hi * 100 END) AS passed
  FROM subjects CROSS JOIN tree LEFT JOIN scores USING (subject, score_key) WHERE level = 0),
cats AS (SELECT s.subject, t.component, t.parent, t.level, t.lo, t.hi, t.status, CASE WHEN NOT t.status OR t.hi = 0 THEN 0.0 ELSE t.lo / t.hi * 100 END AS threshold,
  least(coalesce(sum(l.points), 0), t.hi) AS given FROM subjects s CROSS JOIN tree t LEFT JOIN leaves l ON l.subject = s.subject AND l.parent = t.component WHERE t.level = 1 GROUP BY s.subject, t.component, t.parent, t.level, t.lo, t.hi, t.status),
cat2 AS (SELECT subject, component, parent, level, lo, hi, status, threshold, CASE WHEN status AND hi > 0 THEN given / hi * 100 ELSE 0.0 END AS score,
  CASE WHEN status THEN given ELSE 0.0 END AS points, (NOT status OR given >= lo) AS passed FROM cats),
roots AS (SELECT s.subject, 'ekyc' AS component, CAST(NULL AS VARCHAR) AS parent, 2 AS level, 0.0 AS lo, 100.0 AS hi, true AS status, 0.0 AS threshold, least(sum(points), 100.0) AS score,
  least(sum(points), 100.0) AS points, true AS passed FROM subjects s JOIN cat2 c USING (subject) GROUP BY s.subject),
allc AS (SELECT * FROM leaves UNION ALL BY NAME SELECT * FROM cat2 UNION ALL BY NAME SELECT * FROM roots)
"""


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [r[1] for r in rules.POLICY if r[1] and r[6]]
    key = F.element_at(F.array(*map(F.lit, keys)), (F.col("event_id") % 8 + 1).cast("int"))
    raw = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), key.alias("score_key"), "value")
    return raw.groupBy("subject", "score_key").agg(F.least(F.max("value") / 100, F.lit(1.0)).alias("raw"))


@query(_COMPONENTS + "SELECT subject, component, round(threshold, 6) AS threshold, round(score, 6) AS score, round(points, 6) AS points, passed FROM allc")
def policy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.components(event_scores(spark, sf_dir), rules.policy_defaults(spark))
    return found.select("subject", "component", *(F.round(c, 6).alias(c) for c in ("threshold", "score", "points")), "passed")


@query(_COMPONENTS + """SELECT subject, CASE WHEN max(points) FILTER (component = 'ekyc') > 90 THEN 'APPROVED' WHEN max(points) FILTER (component = 'ekyc') >= 50 THEN 'MANUAL_REVIEW' ELSE 'REJECTED' END AS decision,
round(max(points) FILTER (component = 'ekyc'), 6) AS total_score, 100.0 AS max_possible, count(*) FILTER (NOT passed) AS n_reasons FROM allc GROUP BY subject""")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.components(event_scores(spark, sf_dir), rules.policy_defaults(spark))
    return policy.decide(found).select("subject", "decision", F.round("total_score", 6).alias("total_score"), "max_possible", F.size("reasons").cast("long").alias("n_reasons"))


_TO = lambda x, places: f"round(CAST({x} AS DECIMAL(20, 9)), {places})"
_ONE = {x: _TO(x, 1) for x in ("score", "threshold", "points")}


@query(_COMPONENTS + f""", r AS (SELECT subject, CASE WHEN NOT passed AND level = 0 THEN concat(component, ': score ', {_ONE['score']}, '% < threshold ', {_ONE['threshold']}, '% (got ', {_ONE['points']}, '/', hi, ' pts, need ', lo, ')')
WHEN NOT passed THEN concat(component, ': ', {_ONE['points']}, '/', hi, ' pts (min required: ', lo, ')') END AS reason FROM allc)
SELECT subject, CASE WHEN max(points) FILTER (component = 'ekyc') > 90 THEN 'APPROVED' WHEN max(points) FILTER (component = 'ekyc') >= 50 THEN 'MANUAL_REVIEW' ELSE 'REJECTED' END AS decision, CAST({_TO("max(points) FILTER (component = 'ekyc')", 2)} AS DOUBLE) AS total_score,
CAST({_TO("max(score) FILTER (component = 'face_matching')", 2)} AS DOUBLE) AS face_score, CAST({_TO("max(points) FILTER (component = 'document_verify')", 2)} AS DOUBLE) AS document_points,
bool_or(passed) FILTER (component = 'face_matching') AS face_passed, count(*) AS n_components, any_value(reasons) AS reasons FROM allc LEFT JOIN (SELECT subject, string_agg(reason, '|' ORDER BY reason) AS reasons FROM r GROUP BY subject) USING (subject) GROUP BY subject""")
def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the result documents say, read back from their JSON, reasons included."""
    found = policy.components(event_scores(spark, sf_dir), rules.policy_defaults(spark))
    part = "struct<threshold:double,score:double,score_obtained:double,passed:boolean>"
    read = F.from_json("document", f"decision string, total_score double, components map<string,{part}>, reasons array<string>")
    d = policy.result_document(policy.decide(found), found).select("subject", read.alias("d"))
    of = lambda component, field: F.col("d.components")[component][field]
    return d.select("subject", "d.decision", "d.total_score", of("face_matching", "score").alias("face_score"), of("document_verify", "score_obtained").alias("document_points"), of("face_matching", "passed").alias("face_passed"), F.size("d.components").cast("long").alias("n_components"), F.nullif(F.array_join("d.reasons", "|"), F.lit("")).alias("reasons"))


_WIDE = ", ".join(
    f"CAST(max(lo) FILTER (component = '{c}') AS DOUBLE) AS {c}_min, CAST(max(hi) FILTER (component = '{c}') AS DOUBLE) AS {c}_max, bool_or(status) FILTER (component = '{c}') AS {c}_status, "
    f"round(CAST(max(threshold) FILTER (component = '{c}') AS DOUBLE), 6) AS {c}_threshold, round(CAST(max(score) FILTER (component = '{c}') AS DOUBLE), 6) AS {c}_score"
    for c, *_ in rules.POLICY
)


@query(_COMPONENTS + f"SELECT subject, {_WIDE} FROM allc GROUP BY subject")
def policy_wide_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five columns for each component."""
    wide = policy.wide_log(policy.components(event_scores(spark, sf_dir), rules.policy_defaults(spark))).drop("log_id")
    return wide.withColumns({c: F.round(c, 6) for c in wide.columns if c.endswith(("_threshold", "_score"))})


@query("""SELECT 'ekyc' AS component, 0.0 AS min, CAST(max(c_custkey) AS DOUBLE) AS max, true AS status FROM customer""")
def policy_latest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("double").alias("ekyc_max"), F.lit(None).cast("boolean").alias("ekyc_status"))
    return policy.active_config(wide).where("component = 'ekyc'")


@query("""SELECT n_nationkey AS key_no, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey * 2 AS VARCHAR) ELSE '7' END AS value, n_nationkey % 3 = 0 AS is_override FROM nation""")
def dynamic_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    defaults = nation.select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.lit("7").alias("value"), F.lit("int").alias("kind"))
    given = F.when(F.col("n_nationkey") % 3 == 0, (F.col("n_nationkey") * 2).cast("string")).otherwise("none")
    overrides = nation.where("n_nationkey % 3 < 2").select(F.concat(F.lit("k"), "n_nationkey").alias("key"), given.alias("value"))
    found = policy.dynamic_config(defaults, overrides)
    return found.select(F.substring("key", 2, 9).cast("int").alias("key_no"), "value", "is_override")


@query("""WITH d AS (SELECT o_custkey AS subject, avg(CASE WHEN c > 0 THEN c END) AS conf, max(q) AS q, bool_or(nid) AS nid, bool_or(back) AS back FROM
 (SELECT o_custkey, (o_orderkey % 11) / 10.0 AS c, (o_custkey % 13) / 10.0 AS q, o_custkey % 3 > 0 AS nid, o_custkey % 2 = 0 AS back FROM orders) GROUP BY o_custkey)
SELECT subject, round(least(10.0, q * 10), 2) AS authenticity, round(least(10.0, q * 10), 2) AS quality, round(least(10.0, coalesce(conf, 0) * 10), 2) AS ocr_confidence,
CASE WHEN nid AND back THEN 5.0 ELSE 0.0 END AS front_back_match,
round(least(35.0, least(10.0, q * 10) * 2 + least(10.0, coalesce(conf, 0) * 10) + CASE WHEN nid AND back THEN 5.0 ELSE 0.0 END), 2) AS total FROM d""")
def document_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS subject", "double(o_orderkey % 11) / 10 AS confidence", "double(o_custkey % 13) / 10 AS quality", "o_custkey % 3 > 0 AS is_national_id", "o_custkey % 2 = 0 AS has_back")
    return scoring.document_scores(o)


@query("""WITH s AS (SELECT o_custkey AS subject, max(CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 20.0 ELSE 0 END) AS id_number, max(CASE WHEN o_orderkey % 3 = 1 AND o_orderstatus = 'F' THEN 10.0 ELSE 0 END) AS name_match FROM orders GROUP BY 1)
SELECT subject, id_number, name_match, least(30.0, id_number + name_match) AS total FROM s""")
def data_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS subject", "CASE o_orderkey % 3 WHEN 0 THEN 'id_number' WHEN 1 THEN 'full_name' ELSE 'other' END AS field", "CASE WHEN o_orderstatus = 'F' THEN 'MATCH' ELSE 'MISMATCH' END AS result")
    return scoring.data_match_scores(o)


@query("""SELECT event_id, round(least(20.0, value / 100 * 20), 2) AS face_match, round(CASE WHEN event_id % 4 > 0 THEN least(15.0, (event_id % 101) / 100.0 * 15) ELSE 0 END, 2) AS liveness,
round(least(35.0, least(20.0, value / 100 * 20) + CASE WHEN event_id % 4 > 0 THEN least(15.0, (event_id % 101) / 100.0 * 15) ELSE 0 END), 2) AS total FROM events""")
def face_liveness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "value AS face", "double(event_id % 101) AS confidence", "event_id % 4 > 0 AS is_live")
    return scoring.face_liveness_scores(e).select("event_id", "face_match", "liveness", "total")
