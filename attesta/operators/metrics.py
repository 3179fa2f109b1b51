"""Request counters and latency histograms, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets, in seconds.
BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def aggregates(latency: Column, buckets: tuple[float, ...] = BUCKETS) -> list[Column]:
    """Count, sum, and cumulative buckets."""
    counts = [F.count_if(latency <= b).alias(f"le_{str(b).replace('.', '_')}") for b in buckets]
    return [F.count("*").alias("requests"), F.sum(latency).alias("latency_sum"), *counts]


def request_counts(requests: DataFrame, keys: list[str]) -> DataFrame:
    return requests.groupBy(*keys).agg(F.count("*").alias("requests"))


def latency_histogram(requests: DataFrame, keys: list[str], latency: str = "latency") -> DataFrame:
    return requests.groupBy(*keys).agg(*aggregates(F.col(latency)))


def windowed(requests: DataFrame, at: str, keys: list[str], latency: str = "latency", width: str = "1 hour", late: str | None = None) -> DataFrame:
    """The same for each tumbling window; ``late`` sets the watermark of a stream."""
    rows = requests.withWatermark(at, late) if late else requests
    grouped = rows.groupBy(F.window(at, width).alias("w"), *keys).agg(*aggregates(F.col(latency)))
    return grouped.select(F.col("w.start").alias("window_start"), *(c for c in grouped.columns if c != "w"))


def filled_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Add the number of fields that are not empty."""
    total = F.lit(0)
    for f in fields:
        total = total + F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "", 1).otherwise(0)
    return rows.withColumn("filled", total)
