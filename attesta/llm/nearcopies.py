"""Near copies by the similarity of their word shingles.

Two texts are near copies where the Jaccard similarity of their sets of five-word shingles is at least
``WANTED``; the near copies' connected components are the classes. Words are what white space separates,
ASCII letters lowered; a text of fewer words is one shingle, and texts without words are one class.

Search.  A set's SimHash fingerprint goes through the vantage-point shards of :mod:`.simhash`. All fingerprints
within ``RADIUS`` bits meet there, and the links that the shards' searches follow are candidates; so are sets of equal
fingerprints, each with the smallest. At a similarity of 0.8 most fingerprints differ in more bits than bands of 64
can tell apart. Those sets meet by their ``BANDS * ROWS`` smallest hashes under as many functions, cut into
bands; sets that agree in a band share its bucket. Of two sets of similarity 0.8 all bands miss with a chance of
7e-5, of 0.85 with 1e-6. Whoever meets is compared by the whole sets, so no other text is ever linked.

A large group of copies must not cost a comparison for each pair. A bucket's smallest set is compared with all
others first. Buckets that this leaves in several components make up families: sets that share such a bucket, or
are joined by others that do. In a family all similar pairs are found, whether they share a bucket or not:

Of each set only its difference ``D`` from the family's center matters, the shingles that more than half of the family
have; the center need not be a set of its own. Two sets are near copies just where ``|D1| + |D2| - 2 |D1 & D2|`` is at
most a ninth of both sizes (for 0.8). With ``w = |set| - 9 |D|`` that is ``18 |D1 & D2| >= -(w1 + w2)``. So every set whose
``w`` and the family's largest ``w`` do not sum to less than zero is a near copy of that set: it is compared with that
set alone. The others, the far ones, must share shingles of ``D`` with whatever they are similar to, and at least so many
that both must agree in one of their rarest ones, as many as the bound leaves over (prefix filtering). Only those
pairs are compared. Edits that one copy alone has are its rarest shingles, so copies that were edited in
different places do not meet, though they have most of their text in common.

Equal sets are one node at any number of rows. Nulls count as empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, small_side
from .decontaminate import _mix, gram_hashes, word_hashes
from .simhash import connected, drop_later, majority, row_key, sources_within, stars

WIDTH, BANDS, ROWS, SLICE = 5, 24, 5, 1 << 12
#: Bits in which fingerprints that meet in a shard may differ.
RADIUS = 3
#: Sets of a family that meet its center in one part.
PART = 1024
#: Similarity of near copies, as a fraction of whole numbers.
WANTED = (4, 5)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_DRAW = np.random.default_rng(23)
_FLIP = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_ODD = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _DRAW.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    words = word_hashes(text, _IS_WORD)[0]
    return np.unique(gram_hashes(words, min(WIDTH, max(1, len(words)))))


def buckets(found: np.ndarray) -> np.ndarray:
    """A set's bucket in each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SLICE):
        np.minimum(least, ((found[at : at + SLICE] ^ _FLIP) * _ODD).min(1), out=least)
    return _mix((least.reshape(BANDS, ROWS) * _STEP).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * WANTED[1] >= WANTED[0] * (len(a) + len(b) - both)


def nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``node`` (the set's hash), ``n`` (its size), ``at`` (its buckets) and ``fp`` (its fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            at = [buckets(s).view(np.int64).tolist() if len(s) else [] for s in sets]
            fp = pa.array([majority(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(at, pa.list_(pa.int64())), fp], ["id", "node", "n", "at", "fp"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, node long, n long, at array<long>, fp long")


def shingle_sets(df: DataFrame) -> DataFrame:
    """``node`` and ``held`` (the set's bytes) of the rows of ``node``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["node", "held"])

    small_batches(df.sparkSession)
    return df.select("node", "text").mapInArrow(run, "node long, held binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``u``, ``v``) whose sets are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [near(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    small_batches(pairs.sparkSession)
    a, b = sets.select(F.col("node").alias("u"), F.col("held").alias("a")), sets.select(F.col("node").alias("v"), F.col("held").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def family_shingles(members: DataFrame) -> DataFrame:
    """``family`` and ``shingle``, a row for each of a member's shingles (``held``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for family, held in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = np.frombuffer(held.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), family, np.int64)), pa.array(found)], ["family", "shingle"])

    small_batches(members.sparkSession)
    return members.select("family", "held").mapInArrow(run, "family long, shingle long")


def differences(members: DataFrame) -> DataFrame:
    """``node`` and ``differs``, the shingles that only one of its set (``held``) and its family's ``center`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.setxor1d(np.frombuffer(h.as_py(), np.int64), c.values.to_numpy()) for h, c in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "differs"])

    small_batches(members.sparkSession)
    return members.select("node", "held", "center").mapInArrow(run, "node long, differs array<long>")


def _rooted(met: DataFrame, roots: DataFrame, name: str = "root") -> DataFrame:
    """``met`` with each node's root, as ``name``."""
    held = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return met.join(held, F.col("node") == F.col("_node"), "left").select(*met.columns, F.coalesce("_root", "node").alias(name))


def families(met: DataFrame, roots: DataFrame) -> DataFrame:
    """``node``, ``n``, ``root`` and ``family`` of the sets in buckets whose members are of several components."""
    rooted = materialise(_rooted(met, roots), "rooted")
    torn = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("bucket").alias("_bucket"))
    torn = materialise(rooted.join(torn, F.col("bucket") == F.col("_bucket")).select("first", "node", "n", "root").distinct(), "torn")
    joined = connected(torn.where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct(), "family-roots")
    return materialise(_rooted(torn.select("node", "n", "root").distinct(), joined, "family"), "families")


def with_differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with ``differs``; the center goes to as many parts of a family as its size asks for."""
    held = sets.select(F.col("node").alias("_node"), "held")
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    times = family_shingles(members.join(held, F.col("node") == F.col("_node"))).groupBy("family", "shingle").agg(F.count("*").alias("times"))
    major = times.join(sizes, "family").where("2 * times > size")
    center = sizes.join(major.groupBy("family").agg(F.array_sort(F.collect_list("shingle")).alias("center")), "family", "left")
    parts = F.ceil(F.col("size") / PART).cast("long")
    center = center.select(F.col("family").alias("_family"), F.coalesce("center", F.array().cast("array<long>")).alias("center"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    dealt = members.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("node"), parts)).join(held, F.col("node") == F.col("_node"))
    met = dealt.join(center, (F.col("family") == F.col("_family")) & (F.col("part") == F.col("_part")))
    found = differences(met).withColumnRenamed("node", "_own")
    return members.join(found, F.col("node") == F.col("_own")).drop("_own")


def family_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (``u``, ``v``) that join all near copies within each family, beside those that ``root`` stands for."""
    top, low = WANTED[1] - WANTED[0], WANTED[1] + WANTED[0]
    found = with_differences(members, sets).withColumn("w", top * F.col("n") - low * F.size("differs"))
    found = materialise(found, "differences")
    best = found.groupBy("family").agg(F.max(F.struct("w", "node")).alias("b"))
    found = found.join(best.select(F.col("family").alias("_family"), F.col("b.w").alias("most"), F.col("b.node").alias("hub")), F.col("family") == F.col("_family")).drop("_family")
    far = F.col("w") + F.col("most") < 0
    near_hub = found.where(~far & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    # The largest weight of a far set: what bounds the partners' share.
    least = found.where(far).groupBy("family").agg(F.max("w").alias("far_most")).withColumnRenamed("family", "_family")
    found = found.join(least, F.col("family") == F.col("_family")).drop("_family")
    kept = lambda most: F.size("differs") + 1 - F.ceil(-(F.col("w") + F.col(most)) / (2 * low))
    each = found.select("family", "node", "n", "root", far.alias("far"), kept("most").alias("asks"), kept("far_most").alias("shows"), F.explode("differs").alias("shingle"))
    each = materialise(each, "differing")
    times = each.groupBy("family", "shingle").agg(F.count("*").alias("times")).where("times > 1").select(F.col("family").alias("_family"), F.col("shingle").alias("_shingle"), "times")
    each = each.join(times, (F.col("family") == F.col("_family")) & (F.col("shingle") == F.col("_shingle")), "left").withColumn("times", F.coalesce("times", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("times", "shingle"))
    each = each.withColumn("nth", nth).where((F.col("times") > 1) & (F.col("nth") <= F.greatest(F.when(F.col("far"), F.col("asks")).otherwise(0), F.col("shows"))))
    each = materialise(each.select("family", "shingle", "node", "n", "root", "nth", "far", "asks", "shows"), "rarest")
    x = each.where("far AND nth <= asks").select("family", "shingle", "node", "n", "root")
    y = each.where("nth <= shows").select(F.col("family").alias("family2"), F.col("shingle").alias("shingle2"), F.col("node").alias("node2"), F.col("n").alias("m"), F.col("root").alias("root2"))
    fits = F.least("n", "m") * WANTED[1] >= F.greatest("n", "m") * WANTED[0]
    met = x.join(y, (F.col("family") == F.col("family2")) & (F.col("shingle") == F.col("shingle2")) & (F.col("root") != F.col("root2")) & fits)
    pairs = met.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()
    return verified(near_hub.union(pairs), sets)


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """``first``, ``m`` (its size), ``node``, ``n`` of the sets whose fingerprints meet in the vantage-point shards."""
    held = distinct.where("n > 0").select("node", "n", "fp")
    prints = materialise(held.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.min_by("n", "node").alias("m")), "prints")
    links = stars(prints.select("fp"), RADIUS, within=sources_within)
    u = prints.select(F.col("fp").alias("u"), "first", "m")
    v = prints.select(F.col("fp").alias("v"), F.col("first").alias("node"), F.col("m").alias("n"))
    met = links.join(u, "u").join(v, "v").select("first", "m", "node", "n")
    shared = small_side(prints.where("first < last").select("fp", "first", "m"))
    equal = held.join(shared, "fp").where("node != first").select("first", "m", "node", "n")
    return materialise(met.unionByName(equal), "print-pairs")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``id`` (a struct of :func:`row_key`) and ``component_id``, the class's smallest."""
    keyed = df.select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    marked = materialise(nodes(keyed, "id", "text"), "shingles")
    distinct = materialise(marked.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("fp").alias("fp")), "sets")
    prints = fingerprint_pairs(distinct)
    met = distinct.select("node", "n", F.explode("at").alias("bucket"))
    crowded = met.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select(F.col("bucket").alias("b"), "first")
    met = materialise(met.join(crowded, F.col("bucket") == F.col("b")).select("bucket", "first", "node", "n"), "buckets")

    wanted = small_side(materialise(met.select("node").union(prints.select("first")).union(prints.select("node")).distinct().join(distinct.select("node", "least"), "node").select("node", F.col("least.id").alias("_id"), F.col("least.text_hash").alias("_hash")), "compared"))
    texts = df.select(F.col(id_col).alias("own"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    sets = materialise(shingle_sets(texts.join(wanted, F.col("own").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))), "shingle-sets")

    fits = F.least("n", "m") * WANTED[1] >= F.greatest("n", "m") * WANTED[0]
    size = distinct.select(F.col("node").alias("first"), F.col("n").alias("m"))
    pairs = met.where("node != first").select("first", "node", "n").distinct().join(size, "first").unionByName(prints).where(fits)
    links = materialise(verified(pairs.select(F.least("first", "node").alias("u"), F.greatest("first", "node").alias("v")).distinct(), sets), "stars")

    members = families(met, materialise(connected(links, "star-roots"), "star-rooted"))
    links = links.union(materialise(family_links(members, sets), "links"))
    ends = connected(links, "roots").withColumnRenamed("node", "held")

    classes = distinct.join(ends, F.col("node") == F.col("held"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = classes.join(smallest, "root").select(F.col("node").alias("owned"), "component_id")
    return marked.join(owner, F.col("node") == F.col("owned")).select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near copies: that with the smallest id."""
    return drop_later(docs, near_copies(docs, id_col, text_col), id_col, text_col)
