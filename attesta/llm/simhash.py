"""SimHash near-duplicates, linked through vantage-point shards.

A fingerprint is the majority vote over the XXH64 hashes of a text's word shingles. Fingerprints
within ``radius`` bits are linked, and the links' connected components are the classes.

Search.  The 64 bits are cut into ``radius + 1`` bands. Two fingerprints within ``radius`` bits have
at least one band in which they do not differ at all. For each band there is a vantage-point tree in
the band's own Hamming metric: a node splits by the distance to its vantage point, one child for each
distance. In the band that agrees, the triangle bound |d(x,v) - d(y,v)| <= 0 holds at every node, so
both fingerprints walk to the same leaf; this is the boundary overlap, and it costs ``radius + 1`` rows
for each distinct fingerprint whatever the depth. (One tree over all 64 bits with overlap 2 is exact as
well, but distances gather so tightly about 32 that each level would copy half of the rows again.)
A leaf is a shard. Shards that hold more than ``leaf_rows`` fingerprints, as a large group of near copies makes,
are dealt again in the same way by the bits outside their bands, and again until none is too large: what lies within
``radius`` bits there agrees in one of ``radius + 1`` parts of them, and meets in that part. The second deal takes
two vantage points in each part; from the third on every bit dealt by is one, so that equal distances mean equal bits.
With radius 2 the bits left over are 43, 29, 20, 14 and at last 10, so no shard of the last deal can hold more than
1024 distinct fingerprints, whatever the data. Inside a shard another vantage point sorts the fingerprints, and a search
compares with those whose distance lies within ``radius`` of its own: the triangle bound again.

A shard returns a star for each of its components, never its pairs. The stars of all shards are joined
to components by alternating large-star and small-star steps, written to the shared folder each round.

Nulls and texts without words have fingerprint zero; one or two words count as one shingle. Repeated
rows, ties and equal texts share one fingerprint. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, small_side

SEED = 42
SLICE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    if len(words) < width:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit integer."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        votes += np.unpackbits(hashes[at : at + SLICE].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id`` and ``fp`` (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bands(radius: int, bits: list[int] | None = None) -> list[int]:
    """Bit masks, as signed longs, of ``radius + 1`` bands of the given bits (all 64)."""
    bits = list(range(64)) if bits is None else bits
    edges = [round(i * len(bits) / (radius + 1)) for i in range(radius + 2)]
    return [_signed(sum(1 << b for b in bits[lo:hi])) for lo, hi in zip(edges, edges[1:], strict=False)]


def leaf_of(fp: Column, mask: Column, vantage: list[int]) -> Column:
    """The leaf's number: the distances to the tree's vantage points, in base 65."""
    out = F.lit(0).cast("long")
    for v in vantage:
        out = out * 65 + F.bit_count(fp.bitwiseXOR(F.lit(v)).bitwiseAND(mask))
    return out


def searched(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct ``x`` (uint64): each one's smallest fingerprint within its component, and the one within
    ``radius`` that it was reached from, itself where the search began (both as int64)."""
    far = np.bitwise_count(x ^ x[0]).astype(np.int64)
    order = np.argsort(far, kind="stable")
    xs, far = x[order], far[order]
    signed, root = xs.view(np.int64), np.empty(len(xs), np.int64)
    source = signed.copy()
    left, held = np.arange(len(xs)), xs  # those who wait, and a few who no longer do
    waits, place, gone = np.ones(len(xs), bool), np.arange(len(xs)), 0
    done = np.zeros(len(xs), bool)
    starts = np.searchsorted(far, np.arange(67))
    for first in range(len(xs)):
        if done[first]:
            continue
        done[first], waits[place[first]], members, at = True, False, [first], 0
        gone += 1
        while at < len(members):
            p = members[at]
            at += 1
            if 2 * gone > len(left):  # a large group of copies leaves few to compare with
                left, gone = left[waits], 0
                held, waits = xs[left], np.ones(len(left), bool)
                place[left] = np.arange(len(left))
                starts = np.searchsorted(far[left], np.arange(67))
            lo, hi = starts[max(0, far[p] - radius)], starts[min(65, far[p] + radius) + 1]
            near = np.flatnonzero((np.bitwise_count(held[lo:hi] ^ xs[p]) <= radius) & waits[lo:hi]) + lo
            if len(near):
                waits[near] = False
                done[left[near]] = True
                source[left[near]] = signed[p]
                gone += len(near)
                members.extend(left[near].tolist())
        root[members] = signed[members].min()
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return root[back], source[back]


def components_within(x: np.ndarray, radius: int) -> np.ndarray:
    """Each one's smallest fingerprint within its component."""
    return searched(x, radius)[0]


def sources_within(x: np.ndarray, radius: int) -> np.ndarray:
    """The fingerprint within ``radius`` that each one was reached from: links that span the components."""
    return searched(x, radius)[1]


def deeper(paths: dict[int, int], radius: int) -> list[tuple[int, int, int, int]]:
    """``path``, ``child``, ``mask``, ``used``: the parts that each path's free bits are dealt by, and all bits dealt by since."""
    rows = []
    for path, used in paths.items():
        for j, mask in enumerate(bands(radius, [b for b in range(64) if not used >> b & 1])):
            rows.append((path, (path + 1) * (radius + 1) + j, mask, used | mask))
    return rows


def shards_of(distinct: DataFrame, radius: int, leaf_rows: int, n: int) -> DataFrame:
    """``fp``, ``path``, ``leaf``: the shards that each fingerprint goes to."""
    depth = min(10, max(1, math.ceil(math.log(max(1, n / leaf_rows), 6))))
    draw = random.Random(SEED)
    points = lambda n: [draw.getrandbits(64) - (1 << 63) for _ in range(n)]
    paths = dict(enumerate(bands(radius)))
    homes = F.array(*(F.struct(F.lit(k).cast("long").alias("path"), leaf_of(F.col("fp"), F.lit(mask), points(depth)).alias("leaf")) for k, mask in paths.items()))
    now, settled, again = distinct.select("fp", F.inline(homes)), [], 0
    while True:
        free = 64 - min(used.bit_count() if used >= 0 else (used + (1 << 64)).bit_count() for used in paths.values())
        if free <= radius or again > 1 and 1 << free <= leaf_rows:  # equal bits leave too few others for a large shard
            break
        large = materialise(now.groupBy("path", "leaf").count().where(F.col("count") > leaf_rows).select("path", "leaf"), "large-leaves", (radius + 1) * n)
        if not large.limit(1).count():
            break
        large = small_side(large)
        settled.append(now.join(large, ["path", "leaf"], "left_anti").select("fp", "path", "leaf"))
        parts = deeper(paths, radius)
        children = F.broadcast(distinct.sparkSession.createDataFrame(parts, "path long, child long, mask long, used long"))  # a row for each path, whatever the data
        leaf = F.xxhash64("leaf", leaf_of(F.col("fp"), F.col("mask"), points(2))) if not again else F.col("fp").bitwiseAND(F.col("used"))
        now = now.join(large, ["path", "leaf"], "left_semi").join(children, "path").select("fp", F.col("child").alias("path"), leaf.alias("leaf"))
        paths, again = {child: used for _, child, _, used in parts}, again + 1
    return reduce(DataFrame.unionByName, settled, now)


def stars(distinct: DataFrame, radius: int = 2, leaf_rows: int = 2048, within: Callable[[np.ndarray, int], np.ndarray] = components_within) -> DataFrame:
    """Edges (``u``, ``v``) that connect distinct fingerprints ``fp`` exactly as all links would.

    With :func:`sources_within` each edge is a link itself.
    """

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        x = shard["fp"].to_numpy(np.int64)
        root = within(x.view(np.uint64), radius)
        tied = x != root
        return pd.DataFrame({"u": x[tied], "v": root[tied]})

    shards = shards_of(distinct, radius, leaf_rows, distinct.count())
    return shards.groupBy("path", "leaf").applyInPandas(link, "u long, v long").distinct()


def connected(edges: DataFrame, label: str = "stars", rows: int | None = None) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) for every node of the edges but roots.

    Large-star and small-star steps alternate until nothing changes. Rows of a hub never meet in one
    group: its minimum is a partially aggregated ``min`` and is joined back. ``rows`` bounds the edges.
    """

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    def tally(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label, rows)
    before, state = None, tally(now)
    while state != before and state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        kept = star(large)
        small = kept.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(kept.select("u", F.col("m").alias("v"))).where("u != v").distinct(), label, state[0])
        before, state = state, tally(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of ``df``: its id, ``fp`` and ``component_id`` (the class's smallest id)."""
    marked = materialise(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct", marked.count())
    roots = connected(stars(distinct.select("fp"), radius), rows=(radius + 1) * distinct.count())
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = classes.join(smallest, "root").select(F.col("fp").alias("owned"), "component_id")
    return marked.join(owner, marked["fp"] == owner["owned"]).select(F.col("id").alias(id_col), "fp", "component_id")


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and text. Smaller ids come first, rows without an id last."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))


def drop_later(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each class; ``classes`` holds each row's key as ``id``, and its class's smallest as ``component_id``.

    Texts are not shuffled while the rows to drop are few.
    """
    classes = materialise(classes.select("id", "component_id"), "classes")
    told = lambda df: df.select(F.col("id.id").alias("_id"), F.col("id.text_hash").alias("_hash"))
    same = lambda df, side: df[id_col].eqNullSafe(side["_id"]) & (F.xxhash64(df[text_col]) == side["_hash"])
    gone = small_side(materialise(told(classes.where("id != component_id").select("id").distinct()), "dropped"))
    twice = materialise(told(classes.where("id = component_id").groupBy("id").count().where("count > 1")), "repeated")
    kept = docs.join(gone, same(docs, gone), "left_anti")
    if not twice.limit(1).count():
        return kept
    several = small_side(twice)
    return kept.join(several, same(kept, several), "left_anti").unionByName(kept.join(several, same(kept, several), "left_semi").dropDuplicates([id_col, text_col]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row of each class: that with the smallest id. A row without an id stays where its class has no other."""
    keyed = docs.select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    return drop_later(docs, near_duplicates(keyed, "id", "text", width, radius), id_col, text_col)
