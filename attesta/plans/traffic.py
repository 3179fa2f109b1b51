"""Metric queries over ``events``, and intakes of image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import intake
from attesta.operators import metrics as ops
from attesta.sources.tables import scratch

from .registry import query, table

LE = ", ".join(f"count(*) FILTER (value / 10 <= {b}) AS le_{str(b).replace('.', '_')}" for b in ops.BUCKETS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("endpoint"), (F.col("value") / 10).alias("latency"), (F.col("event_id") % 3).alias("status"), "event_id")


@query(f"SELECT event_type AS endpoint, count(*) AS requests, round(sum(value / 10), 4) AS latency_sum, {LE} FROM events GROUP BY event_type")
def ops_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latency_histogram(requests(spark, sf_dir), ["endpoint"]).withColumn("latency_sum", F.round("latency_sum", 4))


@query("SELECT event_type AS endpoint, event_id % 3 AS status, count(*) AS requests FROM events GROUP BY ALL")
def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.request_counts(requests(spark, sf_dir), ["endpoint", "status"])


@query(f"SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS window_start, event_type AS endpoint, count(*) AS requests, round(sum(value / 10), 4) AS latency_sum, {LE} FROM events GROUP BY 1, 2")
def ops_metrics_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.windowed(requests(spark, sf_dir), "ts", ["endpoint"])
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).withColumn("latency_sum", F.round("latency_sum", 4))


#: An image for every twenty customers; of eight images two show no number, and one a number of another kind.
_IMAGES = """SELECT k, k % 4 > 0 AS ok, CASE WHEN k % 8 = 5 THEN lpad(CAST(k AS VARCHAR), 9, '7') WHEN k % 4 > 0 THEN lpad(CAST(k AS VARCHAR), 11, '1') END AS number, CASE WHEN k % 8 = 5 THEN 'unknown' WHEN k % 4 > 0 THEN 'national_id' END AS kind FROM (SELECT DISTINCT c_custkey // 20 AS k FROM customer)"""


def _taken_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of two intakes of a folder that has grown in between; the second meets the first one's files again."""
    folder, ledger = scratch(spark, "images"), scratch(spark, "intake")
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 20").alias("k"), F.col("c_custkey").alias("line_no"), "c_mktsegment")
    number = F.when(F.col("k") % 8 == 5, F.lpad(F.col("k").cast("string"), 9, "7")).when(F.col("k") % 4 > 0, F.lpad(F.col("k").cast("string"), 11, "1"))
    shown = F.when(F.col("line_no") % 20 == 7, F.coalesce(number, F.lit("torn"))).otherwise(F.col("c_mktsegment"))
    lines = c.select(F.concat(F.lit("image="), "k").alias("image"), "line_no", shown.alias("text"), F.lit(0.9).alias("score"))
    for batch, part in enumerate(("k % 2 = 0", "k % 2 = 1")):
        c.where(part).select("k", "c_mktsegment").repartition("k").withColumnRenamed("k", "image").write.mode("append").partitionBy("image").text(folder)
        intake.take(spark, folder, lines, ledger, batch, F.regexp_extract("path", "(image=[0-9]+)", 1), (".txt",))
    return intake.ledger_of(spark, ledger)


@query(f"SELECT count(*) AS images, count(*) FILTER (ok) AS processed, count(*) FILTER (NOT ok) AS failed FROM ({_IMAGES})")
def batch_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over files that are listed; one that were taken twice would count twice."""
    return intake.summary(_taken_in(spark, sf_dir))


@query(f"SELECT 'image=' || k AS image, k % 2 AS batch, CASE WHEN ok THEN 'processed' ELSE 'failed' END AS status, number AS extracted_id, kind AS id_type, number || '_id.txt' AS new_name, CASE WHEN NOT ok THEN 'No ID found in: image=' || k END AS error FROM ({_IMAGES})")
def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's outcome: its number and new name, or what went wrong."""
    return _taken_in(spark, sf_dir).select("image", "batch", "status", "extracted_id", "id_type", "new_name", "error")


@query("SELECT o_orderkey, CAST(1 + (o_custkey % 2) + CAST(o_orderstatus = 'F' AS INT) AS INTEGER) AS filled FROM orders")
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("a"), F.when(F.col("o_custkey") % 2 == 1, "x").otherwise(" ").alias("b"), F.when(F.col("o_orderstatus") == "F", 1).alias("c"))
    return ops.filled_fields(o, ["a", "b", "c"]).select("o_orderkey", "filled")
