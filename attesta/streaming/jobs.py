"""Structured Streaming jobs: metrics, continuous upsert, event append, pairing of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators import metrics
from attesta.operators import registry as ops

from .snapshots import SnapshotTable


def metrics_stream(requests: DataFrame, path: str, checkpoint: str, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Windowed counts and histograms; windows are written once the watermark has passed them."""
    out = metrics.windowed(requests, at, ["endpoint"], width=width, late=late)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def create_state(rows: DataFrame, path: str, keys: list[str], keep_if_null: list[str], buckets: int = 64) -> None:
    """The table that an upsert stream keeps (see :mod:`attesta.streaming.snapshots`)."""
    SnapshotTable(rows.sparkSession, path).create(rows, keys, keep_if_null, buckets)


def upsert_stream(updates: DataFrame, state: str, checkpoint: str, order: str) -> StreamingQuery:
    """Each micro-batch becomes one version of ``state``.

    A batch that was stopped leaves the version before it; one that runs again is known by the table's ledger,
    under the stream's checkpoint, and changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        SnapshotTable(batch.sparkSession, state).upsert(batch, order, writer=checkpoint, batch=number)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_stream(events: DataFrame, path: str, checkpoint: str, event_type: str = "request") -> StreamingQuery:
    rows = ops.audit_rows(events, event_type, F.current_timestamp())
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paired_calls(first: DataFrame, second: DataFrame, at: str = "ts", late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Both calls of a transaction, joined as they arrive; state is dropped behind the watermark."""
    # The identifier that both calls carry, with the time of each.
    a = first.select(F.col("transaction_id").alias("t1"), F.col(at).alias("at1"), F.col("id").alias("first_id")).withWatermark("at1", late)
    b = second.select(F.col("transaction_id").alias("t2"), F.col(at).alias("at2"), F.col("id").alias("second_id")).withWatermark("at2", late)
    close = F.expr(f"t1 = t2 AND at2 BETWEEN at1 - INTERVAL {within} AND at1 + INTERVAL {within}")
    return a.join(b, close).select(F.col("t1").alias("transaction_id"), "first_id", "second_id")
