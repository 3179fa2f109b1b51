"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import faces as ops

from .registry import query, table

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(f"""SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, ({_COS} + 1) / 2 AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5""")
def match_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ops.top_k(v.where("id % 100 = 0"), v).withColumn("score", F.round("score", 6))


#: A second picture of a person: the vector with a part of the next one's mixed in.
_PROBE = "list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) + 0.6 * CAST(z[2] AS DOUBLE))"
_PROBES = f"WITH p AS (SELECT a.vec_id + 1000000000 AS id, {_PROBE} AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT p.id, e.vec_id, (list_cosine_similarity(p.v, CAST(e.embedding AS DOUBLE[])) + 1) / 2 AS score FROM p, embeddings e)"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", F.col("vector").cast("array<double>").alias("vector"))
    other = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("second"))
    return v.join(other, "id").select((F.col("id") + 1_000_000_000).alias("id"), F.zip_with("vector", "second", lambda x, y: x + 0.6 * y).alias("vector"))


@query(_PROBES + "SELECT id AS query_id, vec_id, round(score, 6) AS score FROM s WHERE score >= 0.85")
def similar_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every probe against the whole gallery. At so low a limit, buckets that miss next to nothing cost more than all pairs, so it is the exact search."""
    return ops.similar_exact(probes(spark, sf_dir), vectors(spark, sf_dir), 0.85).withColumn("score", F.round("score", 6))


@query(_PROBES + "SELECT count(*) AS pairs, true AS enough FROM s WHERE score >= 0.85")
def gallery_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the exact search, and whether the bucketed one, with its usual chance of 0.95, finds at least nine tenths of them."""
    p, v = probes(spark, sf_dir), vectors(spark, sf_dir)
    exact = ops.similar_exact(p, v).select("query_id", "vec_id")
    found = ops.similar(p, v).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query(f"""SELECT a.vec_id, round(({_COS} + 1) / 2, 6) AS score, CASE WHEN ({_COS} + 1) / 2 >= 0.7 THEN 'MATCH' WHEN ({_COS} + 1) / 2 >= 0.5 THEN 'INCONCLUSIVE' ELSE 'NO_MATCH' END AS status,
round(0.6 * ({_COS} + 1) / 2 + 0.3 * 0.8 + 0.1 * 0.5, 6) AS final, ({_COS} + 1) / 2 <= 0.95 AND a.vec_id % 3 > 0 AS is_live,
CASE WHEN a.vec_id % 7 > 0 AND ({_COS} + 1) / 2 BETWEEN 0.6 AND 0.95 AND a.vec_id % 3 > 0 THEN 'verified' ELSE 'failed' END AS verification,
CASE WHEN a.vec_id % 7 = 0 THEN 'DOCUMENT' WHEN ({_COS} + 1) / 2 > 0.95 OR a.vec_id % 3 = 0 THEN 'LIVENESS' WHEN ({_COS} + 1) / 2 < 0.6 THEN 'FACE_MISMATCH' END AS code,
concat_ws('; ', CASE WHEN a.vec_id % 7 = 0 THEN 'document invalid' END, CASE WHEN ({_COS} + 1) / 2 > 0.95 OR a.vec_id % 3 = 0 THEN 'liveness failed' END, CASE WHEN ({_COS} + 1) / 2 < 0.6 THEN 'faces differ' END) AS message FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def face_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    other = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("second"))
    pairs = ops.pair_scores(v.join(other, "id"), "vector", "second").withColumnRenamed("status", "match_status")
    rows = ops.final_face(pairs.withColumn("live", F.col("id") % 3 > 0).withColumn("liveness", F.lit(0.8)).withColumn("quality", F.lit(0.5)))
    done = ops.verification_status(rows.withColumn("document_ok", F.col("id") % 7 > 0))
    return done.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("match_status").alias("status"), F.round("final", 6).alias("final"), "is_live", F.col("status").alias("verification"), F.col("failure_code").alias("code"), F.col("failure_message").alias("message"))


@query("""WITH b AS (SELECT l_orderkey AS image, l_linenumber AS face, l_quantity * (1 + l_discount * 10) AS area FROM lineitem),
t AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, face) AS nth FROM b) SELECT image, face, round(area, 6) AS area, round(area / 10000, 6) AS ratio FROM t WHERE nth = 1""")
def largest_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image", "l_linenumber AS face", "0.0D AS x1", "0.0D AS y1", "l_quantity AS x2", "1 + l_discount * 10 AS y2", "100 AS width", "100 AS height")
    return ops.largest_faces(rows, "image").select("image", "face", F.round("area", 6).alias("area"), F.round("ratio", 6).alias("ratio"))
