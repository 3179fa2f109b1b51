"""Verification scores over ``customer`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import similarity, text
from attesta.operators import checks, extract
from attesta.operators import verify as ops

from . import duck
from .names import _CITIZENS as CITIZENS_SQL
from .names import _PEOPLE as PEOPLE_SQL
from .names import citizens, people
from .registry import pick, query, table

TYPES = ["Yemen National-ID", "passport", "yemen_id", "visa", " Yemen Passport "]


@query("""SELECT c_custkey, [ 'yemen_national_id', 'yemen_passport', 'yemen_national_id', NULL, 'yemen_passport'][CAST(c_custkey % 5 AS INT) + 1] AS canonical,
CASE WHEN c_custkey % 5 IN (0, 2) AND (c_custkey + 2) % 5 IN (0, 2) OR c_custkey % 5 IN (1, 4) AND (c_custkey + 2) % 5 IN (1, 4) THEN 'accepted' ELSE 'rejected' END AS decision FROM customer""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ops.trimmed(table(spark, sf_dir, "customer").select("c_custkey", pick(TYPES, "c_custkey").alias("a"), pick(TYPES, "c_custkey + 2").alias("b")), ["a"])
    return c.select("c_custkey", ops.document_type(F.col("a")).alias("canonical"), ops.type_decision(F.col("a"), F.col("b")).alias("decision"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1.0 WHEN c_custkey % 5 = 0 THEN 0.0 WHEN c_custkey % 7 = 0 THEN 0.0 ELSE 1.0 END AS front_back_match FROM customer""")
def front_back_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("number"))
    backs = c.where("c_custkey % 3 > 0").withColumn("number", F.expr("case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then 'x' else number end"))
    return ops.front_back(c, backs, "c_custkey").select("c_custkey", "front_back_match")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 > 0 THEN 1.0 ELSE 0.0 END AS id_score, CASE WHEN c_custkey % 4 = 0 THEN 1.0 WHEN c_custkey % 3 = 0 THEN 1.0 WHEN c_custkey % 3 = 1 THEN 0.5 ELSE 0.0 END AS date_score,
CASE WHEN c_custkey % 4 = 0 OR c_custkey % 2 = 1 THEN 1.0 ELSE 0.0 END AS gender_score, CASE WHEN c_custkey % 4 = 0 THEN 'NOT_AVAILABLE' WHEN c_custkey % 5 > 0 THEN 'MATCH' ELSE 'MISMATCH' END AS id_result FROM customer""")
def typed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    typed = lambda v: F.when(k % 4 > 0, v)
    rows = table(spark, sf_dir, "customer").select(
        k, typed(F.lit(" ab1 ")).alias("id"), F.when(k % 5 > 0, "AB1").otherwise("AB2").alias("printed_id"), typed(F.lit("2000-01-05")).alias("date"),
        F.date_format(F.date_add(F.lit("2000-01-05").cast("date"), (k % 3).cast("int")), "yyyy-MM-dd").alias("printed_date"), typed(F.lit("male")).alias("gender"), F.concat(F.lit("200"), k % 2, F.lit("0000000")).alias("number"),
    )
    id_score = ops.id_score(F.col("id"), F.col("printed_id"))
    return rows.select(k, id_score.alias("id_score"), ops.date_score(F.col("date"), F.col("printed_date")).alias("date_score"), ops.gender_score(F.col("gender"), F.lit(None).cast("string"), F.col("number"), F.lit(False)).alias("gender_score"), ops.match_result(F.col("id"), F.col("printed_id"), id_score == 1).alias("id_result"))


_V = f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN name END AS en, arabic AS ar, CASE WHEN c_custkey % 3 > 0 THEN regexp_replace(name, 'mm', 'm', 'g') ELSE arabic END AS typed FROM ({PEOPLE_SQL})"""


def _shares(name: str, hard: str, at_least: float) -> str:
    """``name`` (a, b, share): the mean share of tokens on either side that find a similar token on the other."""
    side = lambda x, y, r: f"SELECT a, b, avg(CAST(best >= {at_least} AS INT)) AS share FROM (SELECT a, b, u, max(ratio) AS best FROM (SELECT a, b, u, unnest(list_distinct({y})) AS v FROM (SELECT a, b, unnest(list_distinct({x})) AS u, {y} FROM {hard})) JOIN (SELECT a AS ra, b AS rb, ratio FROM {name}_r) ON {r} GROUP BY a, b, u) GROUP BY a, b"
    pairs = f"{name}_q AS (SELECT u AS a, v AS b FROM (SELECT DISTINCT u, unnest(tb) AS v FROM (SELECT unnest(ta) AS u, tb FROM {hard})) UNION SELECT v, u FROM (SELECT DISTINCT u, unnest(tb) AS v FROM (SELECT unnest(ta) AS u, tb FROM {hard})))"
    return f"{pairs}, {duck.ratio(f'{name}_r', f'{name}_q')}, {name} AS (SELECT a, b, (l.share + r.share) / 2 AS share FROM ({side('ta', 'tb', 'ra = u AND rb = v')}) l JOIN ({side('tb', 'ta', 'ra = u AND rb = v')}) r USING (a, b))"


@query(f"""WITH RECURSIVE p AS (SELECT c_custkey, typed, is_ar, CASE WHEN is_ar THEN ar WHEN coalesce(en, '') = '' THEN {duck.arabic_to_latin('ar')} ELSE en END AS printed FROM (SELECT *, regexp_matches(typed, '[\\x{{0600}}-\\x{{06FF}}]') AS is_ar FROM ({_V}))),
n AS (SELECT *, CASE WHEN is_ar THEN {duck.arabic('printed')} ELSE {duck.english('printed')} END AS a, CASE WHEN is_ar THEN {duck.arabic('typed')} ELSE {duck.english('typed')} END AS b FROM p),
na AS (SELECT a, b FROM n WHERE is_ar), ne AS (SELECT a, b FROM n WHERE NOT is_ar), {duck.compare('x', 'na', 'arabic')}, {duck.compare('y', 'ne', 'english')}, {_shares('xs', 'x_h', 0.75)}, {_shares('ys', 'y_h', 0.65)},
k AS (SELECT true AS is_ar, x.*, share FROM x LEFT JOIN xs USING (a, b) UNION ALL SELECT false, y.*, share FROM y LEFT JOIN ys USING (a, b))
SELECT c_custkey, round(CASE WHEN typed = '' THEN 1.0 WHEN printed = '' THEN 0.0 WHEN tier <> 'fuzzy' THEN score WHEN share = 1 THEN 1.0 WHEN share >= 0.6 THEN 0.7 + 0.3 * share ELSE score END, 6) AS name_score FROM n JOIN k USING (is_ar, a, b)""")
def verification_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("name")).alias("name_english"), F.col("arabic").alias("name_arabic"), F.when(F.col("c_custkey") % 3 > 0, F.regexp_replace("name", "mm", "m")).otherwise(F.col("arabic")).alias("typed"))
    return ops.name_scores(p).select("c_custkey", F.round("name_score", 6).alias("name_score"))


@query("""SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'VALID' WHEN value / 100 >= 0.4 THEN 'SUSPICIOUS' ELSE 'INVALID' END AS authenticity, CASE WHEN event_id % 9 = 0 THEN 'INCONCLUSIVE' WHEN value >= 70 THEN 'MATCH' WHEN value >= 49 THEN 'INCONCLUSIVE' ELSE 'NO_MATCH' END AS face,
CASE WHEN event_id % 2 = 0 AND event_id % 9 > 0 THEN 'LIVE' ELSE 'NOT_LIVE' END AS liveness, CASE WHEN event_id % 3 = 0 THEN 'Arabic' WHEN event_id % 3 = 1 THEN 'English' ELSE 'fr' END AS label FROM events""")
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_id") % 9 == 0
    code = F.element_at(F.array(F.lit("ar"), F.lit("en"), F.lit("fr")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", ops.authenticity_status(F.col("value") / 100).alias("authenticity"), ops.face_status(F.col("value"), failed).alias("face"), ops.liveness_result(F.col("event_id") % 2 == 0, failed).alias("liveness"), text.language_label(code).alias("label"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS subject, l_partkey, l_partkey >= 320 AND l_partkey % 9 > 0 AND l_quantity > 5 AND l_quantity > 10 AND l_discount * 10 >= 0.5 AND (l_tax > 0.02 OR l_discount * 10 >= 0.75) AND l_suppkey % 7 > 0 AS passed FROM lineitem""")
def passport_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("struct(l_orderkey * 10 + l_linenumber AS a, l_partkey AS b) AS subject", "l_quantity > 5 AS original", "l_quantity > 10 AS sharp", "l_partkey % 9 > 0 AS face", "l_suppkey % 7 = 0 AS glare", "l_discount * 10 AS coverage", "l_tax > 0.02 AS margin_ok", "l_partkey AS min_side")
    return checks.passports(rows).select(F.col("subject.a").alias("subject"), F.col("subject.b").alias("l_partkey"), "passed")


@query("""SELECT l_orderkey AS image, l_returnflag AS label, count(*) AS n, max(l_discount) AS best FROM lineitem GROUP BY ALL""")
def all_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image", "l_returnflag AS label", "l_discount AS confidence", "l_linenumber AS x1", "0 AS y1", "1 AS x2", "1 AS y2")
    found = extract.all_detections(rows, "image")
    return found.select("image", "label", F.size("boxes").cast("long").alias("n"), F.get("boxes", F.lit(0))["confidence"].alias("best"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'DOB' ELSE 'name' END AS label FROM customer WHERE CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE c_custkey % 5 > 0 OR c_custkey % 7 = 0 END""")
def field_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 5 == 0, "DOB").otherwise("name").alias("label"), F.when(k % 2 == 0, "ar").otherwise("en").alias("language"), F.when(k % 2 == 0, F.when(k % 3 == 0, "عدن").otherwise("ع x")).otherwise(F.when(k % 7 == 0, "x 7").otherwise("x")).alias("text"))
    return extract.field_lines(rows).select("c_custkey", "label")


@query(f"""WITH RECURSIVE p AS (SELECT c_custkey, {duck.english('name')} AS a, {duck.english("regexp_replace(name, 'a', 'e')")} AS b FROM ({CITIZENS_SQL})), {duck.ratio('r', 'p')}, {duck.jaro_winkler('j', 'p')}, {duck.compare('x', 'p', 'arabic')}
SELECT c_custkey, round(r.ratio, 6) AS ratio, round(j.jw, 6) AS jaro_winkler, x.tier, round(x.score, 6) AS score FROM p JOIN r USING (a, b) JOIN j USING (a, b) JOIN x USING (a, b)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarities as SQL functions."""
    similarity.register(spark)
    p = citizens(spark, sf_dir).select("c_custkey", text.english_name(F.col("name")).alias("a"), text.english_name(F.regexp_replace(F.col("name"), "^([^a]*)a", "$1e")).alias("b"))
    rows = p.selectExpr("c_custkey", "similarity_ratio(a, b) AS ratio", "jaro_winkler(a, b) AS jw", "name_compare(a, b) AS c")
    return rows.select("c_custkey", F.round("ratio", 6).alias("ratio"), F.round("jw", 6).alias("jaro_winkler"), "c.tier", F.round("c.score", 6).alias("score"))
