"""All registered queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.plans import checks, extraction, faces, forms, names, places, policy, reconciliation, records, streams, texts, traffic, verification  # noqa: F401
from attesta.plans.registry import ORACLES, QUERIES, Query


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["reconcile"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
