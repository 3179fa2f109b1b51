"""Readers and writers: registry tables, image folders, JDBC."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff")
#: How the contents of such files begin, in hexadecimal digits.
SIGNATURES = ("89504E47", "FFD8FF", "424D", "49492A00", "4D4D002A")


def registry(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored table; naming columns keeps large ones out of the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def registry_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table, read in ranges of its numeric key."""
    options = {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGES, check: bool = False) -> DataFrame:
    """Path, time and length of the image files of a folder, and whether they are ``readable``.

    Contents are read only to ``check`` that they begin as images do; else all count as readable. Spark lists no
    empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    begins = F.hex(F.substring("content", 1, 4))
    readable = reduce(lambda a, b: a | b, (begins.startswith(s) for s in SIGNATURES)) if check else F.lit(True)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files.where(kind.isin(*(s[1:] for s in suffixes))).select("path", "modificationTime", "length", readable.alias("readable"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that executors share; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="attesta-")
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: plans that use it many times stay small, and so do retries."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
