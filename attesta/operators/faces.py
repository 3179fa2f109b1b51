"""Face embeddings: mapped cosine, pair verdicts, exact and hashed search of galleries, box choice."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.tables import materialise

#: Gallery rows of a shard and queries of a block, of the exact search.
SHARD_ROWS, BLOCK_ROWS = 4096, 4096
#: Rows of a side that a task of the exact search meets, rows of either side of a bucket that meet in one task, and rows scored at once.
TASK_ROWS, MEET_ROWS, ROWS_AT_ONCE = 16384, 16384, 512
#: Candidates scored at once, one by one; vectors of a partition of buckets, about.
PAIRS_AT_ONCE, ROWS_A_PART = 16384, 65536
#: How many scored pairs a row counts for that is written to a bucket and read (set, not measured).
PAIRS_A_ROW = 2400


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dot(a, b) / n + 1) / 2))).otherwise(0.0)


def pair_scores(pairs: DataFrame, a: str, b: str, match: float = 0.7, doubt: float = 0.5) -> DataFrame:
    score = cosine(F.col(a), F.col(b))
    rows = pairs.withColumn("score", score)
    return rows.withColumn("status", F.when(F.col("score") >= match, "MATCH").when(F.col("score") >= doubt, "INCONCLUSIVE").otherwise("NO_MATCH"))


def final_face(rows: DataFrame, same_source: float = 0.95) -> DataFrame:
    """Add ``is_live`` (a near-identical pair comes from one source and is not live) and ``final``."""
    live = F.col("live") & (F.col("score") <= same_source)
    return rows.select("*", live.alias("is_live"), (0.6 * F.col("score") + 0.3 * F.col("liveness") + 0.1 * F.col("quality")).alias("final"))


def verification_status(rows: DataFrame, limit: float = 0.6) -> DataFrame:
    """Add ``status``, ``failure_code`` and ``failure_message`` from score, liveness and document flags."""
    reasons = F.filter(F.array(F.when(~F.col("document_ok"), "document invalid"), F.when(~F.col("is_live"), "liveness failed"), F.when(F.col("score") < limit, "faces differ")), lambda r: r.isNotNull())
    codes = F.when(~F.col("document_ok"), "DOCUMENT").when(~F.col("is_live"), "LIVENESS").when(F.col("score") < limit, "FACE_MISMATCH")
    return rows.select("*", F.when(F.size(reasons) == 0, "verified").otherwise("failed").alias("status"), codes.alias("failure_code"), F.array_join(reasons, "; ").alias("failure_message"))


def _unit(values: pa.Array, size: int) -> np.ndarray:
    """The vectors, one a row, of length one; those without a length stay zero."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(size, -1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _mapped(cos: np.ndarray) -> np.ndarray:
    """Cosines moved to 0..1, alike at every place of a matrix."""
    return np.round(np.clip((cos + 1) / 2, 0, 1), 12)


def _spread(rows: DataFrame, each: int) -> DataFrame:
    """``id`` and ``vector`` of the rows with a vector, dealt evenly to partitions of about ``each`` rows."""
    held = rows.where("vector IS NOT NULL").select("id", "vector")
    return held.repartition(max(1, math.ceil(held.count() / each)))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``most``, the last one shorter."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, most - n))
            n += held[-1].num_rows
            b = b.slice(held[-1].num_rows)
            if n == most:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _packed(rows: DataFrame, name: str, each: int) -> DataFrame:
    """Rows gathered to packs of at most ``each``: ``name_ids``, ascending, and ``name_vectors``, the unit vectors' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, each):
            ids = b.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            vectors = _unit(b.column(1), b.num_rows)[order]
            yield pa.RecordBatch.from_arrays([pa.array([ids[order]], pa.list_(pa.int64())), pa.array([vectors.tobytes()], pa.binary())], [f"{name}_ids", f"{name}_vectors"])

    each_task = max(each, TASK_ROWS // each * each)
    held = _spread(rows.select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector")), each_task)
    return materialise(held.mapInArrow(run, f"{name}_ids array<long>, {name}_vectors binary"), name)


#: Rows, columns and scores of the pairs to keep, of queries (ids and unit vectors) and gallery rows.
Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _grid(queries: DataFrame, gallery: DataFrame, find: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Found], shard_rows: int, block_rows: int) -> DataFrame:
    """What ``find`` keeps, (query_id, vec_id, score), of all blocks of queries and all shards of the gallery.

    Both sides are packed and stored once, and their product is read from there: a task reads a part of either side and
    takes their packs pair by pair. No copy is written for a pair, so disk grows with the rows, only time with the pairs.
    """
    q, g = _packed(queries, "block", block_rows), _packed(gallery, "shard", shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, other = (b.column(c)[i].values.to_numpy() for c in ("block_ids", "shard_ids"))
                asked, held = (np.frombuffer(b.column(c)[i].as_buffer(), np.float64).reshape(n, -1) for c, n in (("block_vectors", len(ids)), ("shard_vectors", len(other))))
                for row, column, score in find(ids, asked, other, held):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(other[column]), pa.array(score)], ["query_id", "vec_id", "score"])

    return q.crossJoin(g).mapInArrow(run, "query_id long, vec_id long, score double")


def top_k(queries: DataFrame, gallery: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` best gallery rows for each query, exactly: (query_id, vec_id, score, rank).

    Both have (id, vector). The gallery is packed to shards of at most ``shard_rows``, queries to blocks. Every block
    meets every shard once, in matrix products, and only each shard's ``k`` best go on to the final ranking.
    Ties go to the smaller id. Null vectors take no part; a vector without length scores 0 against all.
    """

    def best(ids: np.ndarray, asked: np.ndarray, other: np.ndarray, held: np.ndarray) -> Found:
        for at in range(0, len(ids), ROWS_AT_ONCE):
            some = asked[at : at + ROWS_AT_ONCE]
            # Zero vectors score 0, not the half that a cosine of 0 is moved to.
            score = np.where(some.any(1)[:, None] & held.any(1)[None, :], _mapped(some @ held.T), 0.0)
            score[ids[at : at + ROWS_AT_ONCE, None] == other[None, :]] = -1.0
            out = np.zeros(score.shape, bool)
            np.put_along_axis(out, np.argsort(-score, axis=1, kind="stable")[:, :k], True, 1)
            row, column = np.nonzero(out & (score >= 0))
            yield row + at, column, score[row, column]

    order = [F.col("score").desc(), F.col("vec_id")]
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return _grid(queries, gallery, best, shard_rows, block_rows).withColumn("rank", nth).where(F.col("rank") <= k)


def _near(asked: np.ndarray, held: np.ndarray, at_least: float) -> Found:
    """All pairs of unit vectors of mapped cosine ``at_least``: a product in single precision, with a margin for its
    error, chooses those that are scored in double."""
    limit = np.float32(2 * at_least - 1 - 1e-6 - 2e-7 * asked.shape[1])
    some, every = asked.any(1), held.any(1)
    a, b = asked.astype(np.float32), np.ascontiguousarray(held.T, np.float32)
    for at in range(0, len(a), ROWS_AT_ONCE):
        hits = np.flatnonzero(a[at : at + ROWS_AT_ONCE] @ b >= limit)
        for i in range(0, len(hits), PAIRS_AT_ONCE):
            row, column = np.divmod(hits[i : i + PAIRS_AT_ONCE], len(held))
            row += at
            score = np.where(some[row] & every[column], _mapped(np.einsum("ij,ij->i", asked[row], held[column])), 0.0)
            kept = score >= at_least
            yield row[kept], column[kept], score[kept]


def similar_exact(probes: DataFrame, gallery: DataFrame, at_least: float = 0.85, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs of a probe and a gallery row of mapped cosine ``at_least``: (query_id, vec_id, score)."""

    def find(ids: np.ndarray, asked: np.ndarray, other: np.ndarray, held: np.ndarray) -> Found:
        for row, column, score in _near(asked, held, at_least):
            apart = ids[row] != other[column]
            yield row[apart], column[apart], score[apart]

    return _grid(probes, gallery, find, shard_rows, block_rows)


def plan_of(rows: int, probes: int, at_least: float, recall: float) -> tuple[int, int]:
    """Signature bits and tables for a gallery of so many rows and so many probes.

    Two vectors at the angle that ``at_least`` stands for agree in a random bit with chance ``p``; a table misses them
    unless they agree in all its bits, and tables are added until all miss with ``1 - recall`` at most. Pairs above the
    limit are missed less often. Of all numbers of bits that with the least work is taken: vectors of both sides go to a
    bucket of each table, and those of a bucket are scored, nearly all of them unrelated and there by chance.
    """
    p = 1 - math.acos(min(1.0, max(-1.0, 2 * at_least - 1))) / math.pi
    plans = []
    for bits in range(1, 41):
        hit = min(1.0, p**bits)
        tables = 1 if hit == 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
        plans.append((tables * ((rows + probes) * PAIRS_A_ROW + rows * probes / 2**bits), bits, tables))
    return min(plans)[1:]


def _codes(vectors: np.ndarray, bits: int, tables: int, seed: int = 17) -> np.ndarray:
    """The bucket of every table (a vector a row): the signs of ``bits`` random projections a table."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits)).sum(2) + (np.arange(tables) << bits)


def bucket_sizes(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """``bucket`` and ``n``, its rows with a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, TASK_ROWS):
            vectors = _unit(b.column(0), b.num_rows)
            code, n = np.unique(_codes(vectors[vectors.any(1)], bits, tables), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["bucket", "n"])

    return rows.select(F.col("vector").cast("array<double>")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_packs(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """Rows with a length, once for each table: packs of ``bucket``, ``ids`` and ``vectors``, their bytes (of singles
    if ``single``), of the rows of a task that share the bucket."""
    single = rows.schema["vector"].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, TASK_ROWS):
            vectors = _unit(b.column(1), b.num_rows)
            some = np.flatnonzero(vectors.any(1))
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for code in _codes(vectors[some], bits, tables).T:
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                packs = np.split(some[order], starts[1:]) if len(some) else []
                ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), b.column(0).take(pa.array(some[order])))
                yield pa.RecordBatch.from_arrays([pa.array(code[order][starts], pa.int64()), ids, pa.array([raw[x].tobytes() for x in packs], pa.binary())], ["bucket", "ids", "vectors"])

    held = rows.select("id", "vector" if single else F.col("vector").cast("array<double>").alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    return held.mapInArrow(run, f"bucket long, ids array<{kind}>, vectors binary").withColumn("single", F.lit(single))


def similar(probes: DataFrame, gallery: DataFrame, at_least: float = 0.85, recall: float = 0.95, meet_rows: int = MEET_ROWS) -> DataFrame:
    """Pairs of a probe and a gallery row of mapped cosine ``at_least``: (query_id, vec_id, score).

    A similarity join by random-projection buckets: only rows that share a bucket of some table meet, and every
    met pair is scored exactly, so all returned pairs are right; a pair at the limit is found with a chance of
    ``recall`` or more (see :func:`plan_of`). Vectors are shuffled to their buckets, one for each table, and scored there in
    matrix products: what is written are rows and results, never the pairs that meet. A bucket of more than about
    ``meet_rows`` of a side, as repeated faces make, is dealt to a grid of tasks. :func:`similar_exact` is the exact way.
    """
    p, g = (materialise(_spread(df, TASK_ROWS), name) for df, name in ((probes, "probes"), (gallery, "gallery")))
    rows, asking = g.count(), p.count()
    bits, tables = plan_of(rows, asking, at_least, recall)
    parts = lambda n: F.ceil(F.col(n) / meet_rows)
    sizes = bucket_sizes(p, bits, tables).withColumnRenamed("n", "_asked").join(bucket_sizes(g, bits, tables).withColumnRenamed("n", "_held"), "bucket")
    large = F.broadcast(sizes.where((F.col("_asked") > meet_rows) | (F.col("_held") > meet_rows)).select("bucket", parts("_asked").alias("_rows"), parts("_held").alias("_columns")))

    def dealt(packs: DataFrame, own: str, other: str) -> DataFrame:
        """Each pack to one line of its bucket's grid, and to all places of that line."""
        line = F.coalesce(F.pmod(F.xxhash64("ids"), F.col(own)), F.lit(0).cast("long"))
        place = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1).cast("long")) - 1))
        return packs.join(large, "bucket", "left").withColumn(f"{own}_at", line).withColumn(f"{other}_at", place)

    asked = dealt(bucket_packs(p, bits, tables), "_rows", "_columns").withColumnRenamed("ids", "_query_ids")
    held = dealt(bucket_packs(g, bits, tables), "_columns", "_rows").withColumnRenamed("ids", "_vec_ids")

    def unpacked(packs: pa.Table, ids: str) -> tuple[pa.Array, np.ndarray]:
        packs = packs.filter(packs.column(ids).is_valid())
        keys = pa.concat_arrays([x.flatten() for x in packs.column(ids).chunks])
        raw = [np.frombuffer(v.as_buffer(), np.float32 if s else np.float64) for v, s in zip(packs.column("vectors"), packs.column("single").to_pylist(), strict=True)]
        x = np.concatenate(raw, dtype=np.float64).reshape(len(keys), -1)
        return keys, x / np.sqrt((x * x).sum(1, keepdims=True))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = pa.Table.from_batches(batches)
        if not 0 < packs.column("_vec_ids").null_count < packs.num_rows:
            return
        (ids, a), (other, b) = (unpacked(packs, c) for c in ("_query_ids", "_vec_ids"))
        for row, column, score in _near(a, b, at_least):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), other.take(pa.array(column)), pa.array(score)], ["query_id", "vec_id", "score"])

    kinds = ", ".join(f"{name} {df.schema['id'].dataType.simpleString()}" for name, df in (("query_id", probes), ("vec_id", gallery)))
    together = asked.unionByName(held, allowMissingColumns=True).select("bucket", "_rows_at", "_columns_at", "_query_ids", "_vec_ids", "vectors", "single")
    key = ("bucket", "_rows_at", "_columns_at")
    met = together.repartition(math.ceil((tables * (rows + asking) + 1) / ROWS_A_PART), *key).groupBy(*key).applyInArrow(meet, f"{kinds}, score double")
    return met.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def largest_faces(boxes: DataFrame, key: str) -> DataFrame:
    """The largest box of each image and its share of the image."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    top = boxes.groupBy(key).agg(F.max_by(F.struct("face", area.alias("area"), "width", "height"), F.struct(area, -F.col("face"))).alias("f"))
    return top.select(key, "f.face", "f.area", (F.col("f.area") / (F.col("f.width") * F.col("f.height"))).alias("ratio"))
