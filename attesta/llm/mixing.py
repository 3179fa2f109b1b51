"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source gets a target in words; what the mix takes is dealt in blocks of ``block`` words. The
blocks are apportioned by highest quotients (weight / 1, weight / 3, weight / 5, ...) three times: to
sources by target, to a source's groups by size, to a group's shards by size. A shard is a hash slice (of id
and text) of one source of about ``shard_words`` words, so a source that holds a third of the corpus has many,
and so has an id, or the lack of one, that very many rows share.
A shard lays its documents end to end in a seeded order and cuts them into blocks; with a quota of
``q`` blocks out of ``n`` each block is taken ``q div n`` times, and ``q mod n`` of them, evenly spread
from a seeded start, once more. How many words a document gives then has a closed form over its two
ends, so no block is ever a row.

Null texts have size 0 and give nothing; a null source is a source of its own, last in the order.
Repeated ids are rows of their own. Ties in the seeded order are broken by id, text and size. An empty
table gives an empty result, and a corpus without words gives targets of 0. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, small_side

WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``weight``, ``target`` to one row for each ``source`` with its ``source_size``.

    ``share`` of all words goes to the sources by weight; what exceeds ``most`` times a source's size is
    dealt again by weight until nobody is above. The end state is a water level: in the order of
    size / weight the first sources stop at their limit, and the rest share what is left by weight.
    """
    last = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.row_number().over(last) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("_limit", most * F.col("source_size"))
    rising = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    full = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(full), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = weighed.withColumn("_level", level).withColumn("_free", F.col("_limit") / F.col("weight") >= F.col("_level"))
    first = F.min(F.when(F.col("_free"), F.struct((F.col("_limit") / F.col("weight")).alias("r"), F.col("_level").alias("l")))).over(everything)
    return leveled.withColumn("target", F.when(F.col("_free"), F.col("weight") * first["l"]).otherwise(F.col("_limit"))).drop("_limit", "_level", "_free")


def apportion(parties: DataFrame, within: list[str], order: list[str], share: str, seats: str) -> DataFrame:
    """Add ``quota``: ``seats`` (one number in each ``within``) dealt by the highest quotients of ``share``.

    A party surely holds the seats that lie below its exact share by more than the parties could
    shift the divisor; only the few about its exact share are ranked.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    exact = F.when(F.sum(share).over(group) > 0, F.col(share) * F.col(seats) / F.sum(share).over(group)).otherwise(0.0)
    slack = F.when(F.sum(share).over(group) > 0, F.col(share) * F.count("*").over(group) / F.sum(share).over(group)).otherwise(0.0) / 2 + 2
    bounded = parties.withColumn("_sure", F.greatest(F.lit(0), F.floor(exact - slack)).cast("long")).withColumn("_open", F.ceil(exact + slack).cast("long"))
    bounded = bounded.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    seat = bounded.where(F.col(share) > 0).select("*", F.explode(F.sequence(F.col("_sure") + 1, F.col("_open"))).alias("_seat"))
    keys = list(dict.fromkeys([*within, *order]))
    ranked = seat.withColumn("_rank", F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy((F.col(share) / (2 * F.col("_seat") - 1)).desc(), *order, "_seat")))
    won = ranked.groupBy(*keys).agg(F.sum((F.col("_rank") <= F.col("_left")).cast("long")).alias("_won"))
    left, right = bounded.alias("a"), won.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    for other in same[1:]:
        same[0] = same[0] & other
    return left.join(right, same[0], "left").select("a.*", (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota")).drop("_sure", "_open", "_left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 16, shard_words: int = 250_000, group_shards: int = 512, seed: int = 7) -> DataFrame:
    """One row for each document: id, ``source``, ``size``, ``source_size``, ``target``, ``shard``, ``text_hash``, ``taken``."""
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash")), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    everything = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(everything) / block).cast("long"))
    sources = materialise(apportion(sources, [], ["source"], "target", "seats").withColumnRenamed("quota", "source_quota"), "sources")

    a, b = sized.alias("a"), sources.select("source", "shards", "source_size", "target", "source_quota").alias("b")
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.id", "a.source", "a.size", "a.text_hash", "source_size", "target", "source_quota", F.pmod(F.xxhash64(F.lit(seed), "a.id", "a.text_hash"), "shards").alias("shard"))
    placed = materialise(placed.withColumn("grp", F.floor(F.col("shard") / group_shards)), "placed")
    shards = materialise(placed.groupBy("source", "grp", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota")), "shards")
    groups = shards.groupBy("source", "grp").agg(F.sum("shard_size").alias("group_size"), F.first("source_quota").alias("source_quota"))
    groups = apportion(groups, ["source"], ["grp"], "group_size", "source_quota").select(F.col("source").alias("gs"), F.col("grp").alias("gg"), F.col("quota").alias("group_quota"))
    owned = shards.join(groups, F.col("source").eqNullSafe(F.col("gs")) & (F.col("grp") == F.col("gg"))).select("source", "grp", "shard", "shard_size", "group_quota")
    quotas = apportion(owned, ["source", "grp"], ["shard"], "shard_size", "group_quota").select(F.col("source").alias("qs"), F.col("shard").alias("qn"), "shard_size", "quota")

    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    laid = laid.join(quotas, F.col("source").eqNullSafe(F.col("qs")) & (F.col("shard") == F.col("qn")))
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)).cast("long")
    laid = laid.withColumn("_n", n).withColumn("_more", F.pmod("quota", "_n")).withColumn("_start", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), "_n"))

    def extra(at: Column) -> Column:
        """Words before ``at`` that lie in blocks which are taken once more."""
        full = F.floor(at / block).cast("long")
        chosen = lambda k: F.floor((k * F.col("_more") + F.col("_start")) / F.col("_n")).cast("long")
        return chosen(full) * block + (chosen(full + 1) - chosen(full)) * (at - full * block)

    taken = F.floor(F.col("quota") / F.col("_n")).cast("long") * F.col("size") + extra(F.col("end")) - extra(F.col("begin"))
    return laid.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "shard", "text_hash", F.least(taken, (most * F.col("size")).cast("long")).alias("taken"))


def copies(got: DataFrame, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """``_id``, ``_key`` (of source and text), ``_times``: whole copies that meet each shard's taken words.

    Every document gets floor(taken / size) copies. What is left over is summed along the shard, long
    documents before short ones and in a seeded order among those of like length; a document that the sum
    lifts above its own seeded share of its size gets one more copy, whose words leave the sum. The sum
    stays within one document of like length, so short documents at the end settle what long ones left.
    Rows that agree in id, source and text are decided as one.
    """
    key = F.xxhash64("source", "text_hash")
    alike = got.where("size > 0").groupBy(F.col(id_col).alias("_id"), "source", "shard", "size", "text_hash").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"))
    drawn = alike.select("source", "shard", "_id", key.alias("_key"), (F.col("n") * F.col("size")).alias("words"), "taken", F.xxhash64(F.lit(seed + 3), "_id", "_key").alias("place"), F.xxhash64(F.lit(seed + 4), "_id", "_key").alias("draw"))

    def run(shard: pa.Table) -> pa.Table:
        size, taken, place, draw = (shard[c].to_numpy() for c in ("words", "taken", "place", "draw"))
        times, left = np.divmod(taken, size)
        need = (draw.view(np.uint64) / 2.0**64 * size).tolist()
        owed, extra = 0, np.zeros(len(size), np.int64)
        for i in np.lexsort((draw, place, -np.frexp(size)[1])).tolist():
            if left[i]:
                owed += int(left[i])
                if owed > need[i]:
                    owed -= int(size[i])
                    extra[i] = 1
        return pa.table({"_id": shard["_id"], "_key": shard["_key"], "_times": pa.array((times + extra).astype(np.int32))})

    kind = got.schema[id_col].dataType.simpleString()
    return drawn.groupBy("source", "shard").applyInArrow(run, f"_id {kind}, _key long, _times int").where("_times > 0")


def repeat_taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in as many whole copies as come to the words that the mix takes of each shard."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    times = small_side(materialise(copies(mix(docs, **options), id_col, options.get("seed", 7)), "times"))
    key = F.xxhash64(F.col(source_col), F.xxhash64(text_col))
    held = docs.withColumn("_own", key).join(times, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")))
    return held.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_times")).alias("_nth")).drop("_nth")
