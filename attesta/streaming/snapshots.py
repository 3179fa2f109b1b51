"""A table in buckets that changes by whole versions, with a ledger of the batches that are in it.

Files are never replaced. A batch writes its own rows, as a delta of the buckets they belong to, and then one small
manifest names, for every bucket, the folders that hold it now, and for every writer the last batch that is in. The
manifest of version ``n`` is written beside its place and renamed to it: that rename is the only commit. Whatever
stops before it leaves the old version whole and a folder that nothing names; a batch that comes again after it is
known by the ledger and left out. Readers take the newest manifest and keep a consistent version.

A bucket is read as its first folder with the deltas folded in, key by key: of each column the last value, or the last
that is not null for those that keep theirs. A batch that finds ``most_deltas`` in a bucket folds them into a new first
folder, so a batch costs what it brings, and now and then a few buckets, however widely its keys are spread.

Layout: ``versions/<n>.json`` and ``data/<version>-<id>/bucket=<b>/*.parquet``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import registry as ops


class Conflict(RuntimeError):
    """Another writer has made the version."""


@dataclass(frozen=True)
class Manifest:
    """One version: where each bucket is, and each writer's last batch."""

    version: int
    keys: list[str]
    buckets: int
    schema: str
    keep_if_null: list[str] = field(default_factory=list)
    folders: dict[str, list[str]] = field(default_factory=dict)  # of each bucket: the first, then deltas in order
    batches: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    """A keyed table at ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = self.versions()[-1]
        stream = self._fs.open(self._at(f"versions/{version:012d}.json"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, new: Manifest) -> None:
        """The only change that readers see."""
        place, beside = self._at(f"versions/{new.version:012d}.json"), self._at(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(beside)
        try:
            out.write(json.dumps(new.__dict__).encode())
        finally:
            out.close()
        if self._fs.exists(place) or not self._fs.rename(beside, place):
            self._fs.delete(beside, False)
            raise Conflict(f"version {new.version} of {self.path} is there already")

    def _write(self, rows: DataFrame, version: int) -> dict[str, str]:
        """Write rows (with their ``bucket``) to a new folder; the folder of each bucket that has rows."""
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return {n.removeprefix("bucket="): folder for n in self._names(folder) if n.startswith("bucket=")}

    def bucketed(self, rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def create(self, rows: DataFrame, keys: list[str], keep_if_null: list[str] | None = None, buckets: int = 64) -> None:
        """Version 0. Columns of ``keep_if_null`` keep their value where an update has none."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        folders = self._write(self.bucketed(rows, keys, buckets), 0)
        self._commit(Manifest(0, keys, buckets, schema, list(keep_if_null or []), {b: [f] for b, f in folders.items()}))

    def _files(self, m: Manifest, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for b in buckets for folder in m.folders.get(b, [])]
        return self.spark.read.schema(m.schema).parquet(*paths) if paths else self.spark.createDataFrame([], m.schema)

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The rows of a version (the newest one), or of some of its buckets."""
        m = self.manifest(version)
        wanted = list(m.folders) if buckets is None else buckets
        whole, open_ = ([b for b in wanted if (len(m.folders.get(b, [])) > 1) == several] for several in (False, True))
        rows = self._files(m, whole)
        if not open_:
            return rows
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d+)-", 1).cast("long").alias("_at")
        return rows.union(_folded(m, self._files(m, open_).select("*", at)).select(rows.columns))

    def upsert(self, updates: DataFrame, order: str, writer: str = "", batch: int | None = None, most_deltas: int = 8) -> bool:
        """Bring the last update of each key in; false if the writer's batch is in already."""
        now = self.manifest()
        if batch is not None and batch <= now.batches.get(writer, -1):
            return False
        new, fields = now.version + 1, self._files(now, []).schema.fields
        names = [f.name for f in fields]
        if lacking := set(names) - set(updates.columns) - set(now.keep_if_null):
            raise ValueError(f"updates lack {sorted(lacking)}")
        last = ops.newest(updates.select(*{*names, order} & set(updates.columns)), now.keys, order)
        last = last.select(*((F.col(f.name) if f.name in updates.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        keyed = self.bucketed(last, now.keys, now.buckets).persist()
        try:
            touched = [str(r["bucket"]) for r in keyed.select("bucket").distinct().collect()]  # at most as many as buckets
            full = [b for b in touched if len(now.folders.get(b, [])) > most_deltas]
            folders = dict(now.folders)
            if deltas := [int(b) for b in touched if b not in full]:
                written = self._write(keyed.where(F.col("bucket").isin(deltas)), new)
                folders |= {b: [*folders.get(b, []), f] for b, f in written.items()}
            if full:
                both = self.read(now.version, full).withColumn("_at", F.lit(0)).unionByName(keyed.where(F.col("bucket").isin([int(b) for b in full])).drop("bucket").withColumn("_at", F.lit(1)))
                written = self._write(self.bucketed(_folded(now, both).select(names), now.keys, now.buckets), new)
                folders |= {b: [f] for b, f in written.items()}
        finally:
            keyed.unpersist()
        batches = now.batches | ({writer: batch} if batch is not None else {})
        self._commit(Manifest(new, now.keys, now.buckets, now.schema, now.keep_if_null, folders, batches))
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the newest versions, and folders that none of these names: also what a stopped writer left.

        Not while a writer is at work, whose folder nothing names yet.
        """
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"versions/{v:012d}.json"), False)
        named = {f for v in versions[-keep:] for held in self.manifest(v).folders.values() for f in held}
        gone = [n for n in self._names("data") if f"data/{n}" not in named]
        for n in gone:
            self._fs.delete(self._at(f"data/{n}"), True)
        return gone


def _folded(m: Manifest, rows: DataFrame) -> DataFrame:
    """One row for each key: of each column the last value by ``_at``, or the last that is not null if it keeps its own."""
    rest = [c for c in rows.columns if c not in (*m.keys, "_at")]
    last = F.max_by(F.struct(*[c for c in rest if c not in m.keep_if_null] or [F.lit(0).alias("_")]), "_at").alias("_last")
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in rest if c in m.keep_if_null]
    found = rows.groupBy(*m.keys).agg(last, *kept)
    return found.select(*m.keys, *(c if c in m.keep_if_null else F.col(f"_last.{c}").alias(c) for c in rest))
