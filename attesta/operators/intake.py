"""Batches of image files: listed, joined to what was read from them, with files already seen left out.

The table of outcomes is the ledger as well: a file that it holds, by path, time and length, is not taken again, a
file that was replaced is. An intake appends its outcomes in one commit; a run that stops before it has taken
nothing, and one that is repeated after it finds nothing left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources import tables

from . import extract

OUTCOMES = "path string, modificationTime timestamp, length long, image string, status string, extracted_id string, id_type string, new_name string, error string, batch long"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The files that the ledger does not hold as they are now."""
    return files.join(ledger.select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_anti")


def outcomes(files: DataFrame, lines: DataFrame, suffix: str = "_id") -> DataFrame:
    """One row for each file (with its ``image``): the number found in its lines, the name it gets, or what went wrong.

    ``lines``: image, line_no, text, score. A file that is no image could not be read; one whose lines show no number failed too.
    """
    found = extract.id_numbers(lines, "image").select(F.col("image").alias("_image"), "number", "kind")
    rows = files.join(found, F.col("image") == F.col("_image"), "left")
    ok = F.col("readable") & F.col("number").isNotNull()
    extension = F.lower(F.regexp_extract(file_name(F.col("path")), r"(\.[^.]+)$", 1))
    return rows.select(
        "path", "modificationTime", "length", "image", F.when(ok, "processed").otherwise("failed").alias("status"), F.when(ok, F.col("number")).alias("extracted_id"), F.when(ok, F.col("kind")).alias("id_type"),
        F.when(ok, F.concat("number", F.lit(suffix), extension)).alias("new_name"), F.when(~F.col("readable"), F.concat(F.lit("Could not read: "), "image")).when(~ok, F.concat(F.lit("No ID found in: "), "image")).alias("error"),
    )


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """All outcomes so far; none before the first intake."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(OUTCOMES).parquet(path) if there else spark.createDataFrame([], OUTCOMES)


def take(spark: SparkSession, folder: str, lines: DataFrame, ledger: str, batch: int, image: Column | None = None, suffixes: tuple[str, ...] = tables.IMAGES, check: bool = False) -> None:
    """Take the folder's new files in. ``image`` makes a file's image from its ``path`` (its name, if not given);
    ``check`` looks whether contents begin as images do."""
    files = tables.images(spark, folder, suffixes, check).withColumn("image", image if image is not None else file_name(F.col("path")))
    done = outcomes(pending(files, ledger_of(spark, ledger)), lines)
    tables.append(done.withColumn("batch", F.lit(batch).cast("long")), ledger)


def summary(done: DataFrame) -> DataFrame:
    """How many images, and how many were processed and failed."""
    failed = F.col("status") == "failed"
    return done.agg(F.count("*").alias("images"), F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"))
