"""Places of birth over ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import gazetteer
from attesta.operators import places as ops

from . import duck
from .registry import pick, query, table

PAIRS = [("صنعاء", "صنعاء", 0.6), ("صنعا", "صنعاء", 0.6), ("صنعاء - بني الحارث", "بني الحارث", 0.4), ("صنعاء - معين", "صنعاء - بني الحارث", 0.6), ("صنعاء", "عدن", 0.0), ("صنعاء", "123456", 0.0), ("عدن / كريتر", "عدن، كريتر", 1.0)]
_CASE = " ".join(f"WHEN {i} THEN {s}" for i, (_, _, s) in enumerate(PAIRS))


@query(f"""SELECT c_custkey AS id, round(CASE WHEN c_custkey % 8 = 0 THEN 1.0 ELSE (CASE CAST(c_custkey % 7 AS INT) {_CASE} END) * (1 - (c_custkey % 3) / 10.0) END, 6) AS score,
CASE WHEN c_custkey % 8 = 0 OR (CASE CAST(c_custkey % 7 AS INT) {_CASE} END) * (1 - (c_custkey % 3) / 10.0) >= 0.8 THEN 'pass' ELSE 'manual_review' END AS decision FROM customer""")
def validate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), pick([p[0] for p in PAIRS], "c_custkey").alias("extracted"), F.when(F.col("c_custkey") % 8 > 0, pick([p[1] for p in PAIRS], "c_custkey")).alias("typed"),
        (1 - (F.col("c_custkey") % 3) / 10).alias("confidence"),
    )
    return ops.validate(rows).select("id", F.round("score", 6).alias("score"), "decision")


@query(f"""SELECT kind, canonical, count(*) AS n FROM (SELECT CASE WHEN t IN ('صنعاء', 'صنعا', 'عدن') THEN 'governorate' WHEN t IN ('بني الحارث', 'معين', 'كريتر') THEN 'district' ELSE 'unknown' END AS kind,
CASE WHEN t = 'صنعا' THEN 'صنعاء' ELSE t END AS canonical FROM (SELECT trim(unnest(string_split_regex([{", ".join(f"'{p[0]}'" for p in PAIRS)}][CAST(c_custkey % 7 AS INT) + 1], '[-/،]'))) AS t FROM customer)) GROUP BY ALL""")
def resolve_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick([p[0] for p in PAIRS], "c_custkey").alias("raw"))
    return ops.classified(rows, "c_custkey", "raw").groupBy("kind", "canonical").agg(F.count("*").alias("n"))


_TOKENS = [t for _, _, spellings, districts in gazetteer.GOVERNORATES for t in (*spellings, *districts)]
_SPELLED = duck.values([(i, name, t) for i, (name, _, spellings, _) in enumerate(gazetteer.GOVERNORATES) for t in (name, *spellings)])
_DISTRICTS = duck.values([(i, name, t) for i, (name, _, _, districts) in enumerate(gazetteer.GOVERNORATES) for t in districts])
#: Spellings and districts, normalised, with the first governorate of each.
GAZETTEER_SQL = ", ".join(f"{n} AS (SELECT {duck.arabic_place('token')} AS token, min_by(name, ord) AS governorate FROM {v} AS x(ord, name, token) GROUP BY 1)" for n, v in (("gov", _SPELLED), ("dis", _DISTRICTS)))


@query(f"""WITH {GAZETTEER_SQL}, k AS (SELECT c_custkey, [{", ".join(f"'{t}'" for t in _TOKENS)}][CAST(c_custkey % {len(_TOKENS)} AS INT) + 1] AS raw FROM customer)
SELECT c_custkey, coalesce(gov.governorate, t) AS canonical, coalesce(gov.governorate, dis.governorate) AS governorate, CASE WHEN gov.governorate IS NULL THEN 'district' ELSE 'governorate' END AS kind
FROM (SELECT c_custkey, {duck.arabic_place('raw')} AS t FROM k) LEFT JOIN gov ON gov.token = t LEFT JOIN dis ON dis.token = t""")
def gazetteer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling and district that the gazetteer knows, resolved."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(_TOKENS, "c_custkey").alias("raw"))
    return ops.classified(rows, "c_custkey", "raw").select("c_custkey", "canonical", "governorate", "kind")
