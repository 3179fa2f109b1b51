"""The streaming jobs over the given tables, run until nothing is left and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import metrics
from attesta.sources.tables import scratch
from attesta.streaming import jobs
from attesta.streaming.snapshots import SnapshotTable

from . import records, traffic
from .registry import ORACLES, query, table


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as they come; the pattern stands for a file as well as for a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(f"""SELECT CAST(w AS VARCHAR) AS window_start, event_type AS endpoint, count(*) AS requests, round(sum(value / 10), 4) AS latency_sum, {traffic.LE} FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS w FROM events)
WHERE w + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY w, event_type""")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window that the watermark has passed."""
    out = scratch(spark, "metrics")
    rows = stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"), (F.col("value") / 10).alias("latency"))
    jobs.metrics_stream(rows, out, scratch(spark, "metrics-checkpoint")).awaitTermination()
    rows = traffic.requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = spark.read.schema(metrics.windowed(rows, "ts", ["endpoint"]).schema).parquet(out)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).withColumn("latency_sum", F.round("latency_sum", 4))


@query(ORACLES["registry_upsert"])
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after all updates have come by."""
    state = scratch(spark, "state")
    jobs.create_state(records.state(spark, sf_dir), state, ["document_number"], ["document_id", "image", "transaction_id"])
    updates = records.updates_of(stream(spark, sf_dir, "orders"))
    jobs.upsert_stream(updates, state, scratch(spark, "state-checkpoint"), "at").awaitTermination()
    return SnapshotTable(spark, state).read()


@query("""SELECT 'login' AS event_type, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS metadata, true AS stamped FROM events""")
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "stream-audit")
    jobs.audit_stream(stream(spark, sf_dir, "events").select("event_id", "user_id"), out, scratch(spark, "audit-checkpoint"), "login").awaitTermination()
    return spark.read.parquet(out).select("event_type", "metadata", F.col("occurred_at").isNotNull().alias("stamped"))


@query("""SELECT CAST(a.o_custkey AS VARCHAR) AS transaction_id, a.o_orderkey AS first_id, b.o_orderkey AS second_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND abs(CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE)) <= 20 WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1""")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two calls of a transaction, up to twenty days apart."""
    calls = stream(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("transaction_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    pairs = jobs.paired_calls(calls.where("id % 2 = 0"), calls.where("id % 2 = 1"), within="20 days")
    out = scratch(spark, "pairs")
    pairs.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "pairs-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(pairs.schema).parquet(out)
