"""Streaming jobs over small files, driven until nothing is left."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import metrics
from attesta.streaming import jobs
from attesta.streaming.snapshots import Conflict, Manifest, SnapshotTable


def stream(spark, df, path):
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_metrics_stream(spark, tmp_path):
    rows = spark.range(600).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 2).cast("string").alias("endpoint"), (F.col("id") / 100).alias("latency"))
    closing = spark.range(1).select(F.lit("2024-01-03").cast("timestamp").alias("ts"), F.lit("closing").alias("endpoint"), F.lit(1.0).alias("latency"))
    source = stream(spark, rows.unionByName(closing), str(tmp_path / "in"))
    jobs.metrics_stream(source, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r.window_start, r.endpoint): (r.requests, r.le_2_5) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r.window_start, r.endpoint): (r.requests, r.le_2_5) for r in metrics.windowed(rows, "ts", ["endpoint"]).collect()}
    assert got == whole


OLD = [(i, f"n{i}", "img") for i in range(40)]
UPDATES = [(1, "b", None, 1), (1, "c", None, 2), (100, "new", "x", 1)]
MERGED = sorted([r for r in OLD if r[0] != 1] + [(1, "c", "img"), (100, "new", "x")])


def held(spark, state):
    return sorted(tuple(r) for r in SnapshotTable(spark, state).read().select("id", "name", "image").collect())


def upserts(spark, tmp_path):
    jobs.create_state(spark.createDataFrame(OLD, "id int, name string, image string"), str(tmp_path / "state"), ["id"], ["image"], buckets=16)
    return stream(spark, spark.createDataFrame(UPDATES, "id int, name string, image string, at int"), str(tmp_path / "in"))


def test_upsert_stream(spark, tmp_path):
    """Two runs of the stream; buckets without updates keep their files, and a batch that comes again changes nothing."""
    state, source = str(tmp_path / "state"), upserts(spark, tmp_path)
    first = SnapshotTable(spark, state).manifest().folders
    for run in ("c", "again"):  # a new checkpoint sends the same batch once more
        jobs.upsert_stream(source, state, str(tmp_path / run), "at").awaitTermination()
        assert held(spark, state) == MERGED
    now = SnapshotTable(spark, state).manifest()
    assert now.version == 2 and sum(now.folders.get(b) == f for b, f in first.items()) >= len(first) - 2
    assert SnapshotTable(spark, state).read(version=0).count() == 40  # earlier versions can still be read


@pytest.mark.parametrize("stopped_at", ["_write", "_commit"])
def test_a_stopped_batch_loses_nothing(spark, tmp_path, monkeypatch, stopped_at):
    """The batch stops once its buckets are half or wholly written; the table is as before, and the same batch then goes in."""
    state, source = str(tmp_path / "state"), upserts(spark, tmp_path)
    real = getattr(SnapshotTable, stopped_at)

    def stop(self, *args):
        if stopped_at == "_write":
            real(self, args[0].limit(5), *args[1:])
        raise OSError("stopped")

    monkeypatch.setattr(SnapshotTable, stopped_at, stop)
    with pytest.raises(Exception, match="stopped"):
        jobs.upsert_stream(source, state, str(tmp_path / "c"), "at").awaitTermination()
    monkeypatch.undo()
    assert held(spark, state) == OLD
    jobs.upsert_stream(source, state, str(tmp_path / "c"), "at").awaitTermination()
    assert held(spark, state) == MERGED
    table = SnapshotTable(spark, state)
    assert len(table.vacuum(keep=1)) == 1 and held(spark, state) == MERGED


def test_a_batch_that_is_in_is_left_out(spark, tmp_path):
    """A stop between the table's commit and the stream's own: the batch comes again with its number."""
    state, table = str(tmp_path / "state"), SnapshotTable(spark, str(tmp_path / "state"))
    upserts(spark, tmp_path)
    batch = lambda name: spark.createDataFrame([(1, name, None, 1)], "id int, name string, image string, at int")
    assert table.upsert(batch("x"), "at", "stream", 0)
    assert table.upsert(batch("y"), "at", "stream", 1)
    assert not table.upsert(batch("x"), "at", "stream", 0) and table.manifest().version == 2
    assert (1, "y", "img") in held(spark, state)
    assert table.upsert(batch("z"), "at", "other stream", 0)
    assert table.upsert(batch("z").limit(0), "at", "other stream", 1) and table.manifest().version == 4


def test_deltas_fold_as_updates_one_after_another(spark, tmp_path):
    """Many small batches, folded when read or when a bucket has too many, give what one upsert after another gives."""
    draw, columns = random.Random(2), "id int, name string, image string"
    state = SnapshotTable(spark, str(tmp_path / "state"))
    state.create(spark.createDataFrame(OLD, columns), ["id"], ["image"], buckets=4)
    want = {r[0]: list(r[1:]) for r in OLD}
    for batch in range(7):
        rows = [(draw.randrange(60), draw.choice([None, f"b{batch}.{k}"]), draw.choice([None, f"i{batch}"]), k) for k in range(6)]
        assert state.upsert(spark.createDataFrame(rows, f"{columns}, at int"), "at", "w", batch, most_deltas=2)
        for i, name, image, _ in {r[0]: r for r in rows}.values():
            want[i] = [name, image or want.get(i, [None, None])[1]]
        held_now = {r.id: [r.name, r.image] for r in state.read().collect()}
        assert held_now == want and state.read().count() == len(want)
    folders = state.manifest().folders.values()
    assert 1 <= max(map(len, folders)) <= 3 and any(f[0].startswith("data/00000000000") and f[0] > "data/000000000001" for f in folders)
    with pytest.raises(ValueError, match="name"):
        state.upsert(spark.createDataFrame([(1, "x", 1)], "id int, image string, at int"), "at")
    assert state.upsert(spark.createDataFrame([(1, "only", 1)], "id int, name string, at int"), "at")
    want[1][0] = "only"  # columns that keep their value may be left out
    assert {r.id: [r.name, r.image] for r in state.read().collect()} == want


def test_two_writers_of_one_version(spark, tmp_path):
    upserts(spark, tmp_path)
    table = SnapshotTable(spark, str(tmp_path / "state"))
    now = table.manifest()
    table._commit(Manifest(1, now.keys, now.buckets, now.schema, now.keep_if_null, now.folders))
    with pytest.raises(Conflict):
        table._commit(Manifest(1, now.keys, now.buckets, now.schema))
    assert table.manifest().folders == now.folders


def test_audit_and_pairs(spark, tmp_path):
    calls = spark.createDataFrame([("t1", 1), ("t2", 2)], "transaction_id string, id int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    source = stream(spark, calls, str(tmp_path / "in"))
    jobs.audit_stream(source, str(tmp_path / "audit"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    second = stream(spark, calls.where("id = 1").withColumn("id", F.lit(9)), str(tmp_path / "in2"))
    pairs = jobs.paired_calls(source, second)
    q = pairs.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("pairs").collect()] == [("t1", 1, 9)]
