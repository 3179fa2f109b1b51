"""Benchmark decontamination by winnowing.

Every word has a 64-bit hash. Of each sliding window of ``window - gram + 1`` consecutive ``gram``-word
hashes the smallest is kept, so any ``window`` words that a document shares with an item share at least
one kept fingerprint. The fingerprints of both sides are joined and each hit is extended to all
``window``-word spans around it, which are matched by two independent 64-bit hashes.

Most document fingerprints occur in no item. A bit table of fixed size (2 ** ``table_bits`` bits, made
from the items by Spark and sent to the workers) drops nearly all of them before the shuffle; what
passes by chance is dropped by the join. Items shorter than ``window`` words are one window each; for
each such length that occurs (at most ``window - 1``) documents are scanned with grams of that length.

Null and empty texts have no words. Items without words or without an id take no part, rows that repeat
an item's id count as one item, and repeated documents each get a row. Empty tables on either side give
documents without hits, or no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, small_side

_IS_WORD = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _IS_WORD[_lo : _hi + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAW = np.random.default_rng(11)
#: A random 64-bit value for each byte, and odd multipliers, in two independent sets.
_BYTES = _DRAW.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (_DRAW.integers(0, 1 << 62, 2, np.uint64) * np.uint64(4) + np.uint64(3)).tolist()
_STEP = (_DRAW.integers(0, 1 << 62, 2, np.uint64) * np.uint64(4) + np.uint64(3)).tolist()
MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the two bases and of their inverses, grown as texts need them."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 16, 2 * self.n)
            self.up = [self._row(b) for b in _BASE]
            self.down = [self._row(pow(b, -1, 1 << 64)) for b in _BASE]

    def _row(self, base: int) -> np.ndarray:
        row = np.full(self.n + 1, base, np.uint64)
        row[0] = 1
        return np.cumprod(row)


_powers = _Powers()


def word_hashes(text: str | None, is_word: np.ndarray = _IS_WORD) -> list[np.ndarray]:
    """Two arrays: the hashes of the text's words (runs of bytes of ``is_word``), under two independent functions."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    low, out = _LOWER[raw], []
    inside[1:-1] = is_word[low]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return [np.empty(0, np.uint64)] * 2
    _powers.upto(len(raw))
    for k in range(2):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[k][low] * _powers.up[k][: len(raw)], out=total[1:])
        out.append(_mix((total[end] - total[begin]) * _powers.down[k][begin] + (end - begin).astype(np.uint64)))
    return out


def gram_hashes(words: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """Hashes of every ``n`` consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += words[j : j + count] * np.uint64(pow(_STEP[kind], j, 1 << 64))
    return _mix(out + np.uint64(n))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the kept fingerprints: those equal to the smallest of some window of ``width`` grams."""
    count = len(grams) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    least = grams[:count].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + count], out=least)
    kept = np.zeros(len(grams), bool)
    for j in range(width):
        kept[j : j + count] |= grams[j : j + count] == least
    return np.flatnonzero(kept)


def _windows(words: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of every window; a shorter text is one window."""
    n = min(window, len(words[0]))
    return gram_hashes(words[0], n, 0), gram_hashes(words[1], n, 1)


def item_rows(items: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (``fp``, ``n``) and windows (``h1``, ``h2``, ``items``, and ``owners``, a number for that list) of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = word_hashes(text)
                if not len(words[0]):
                    continue
                h1, h2 = _windows(words, window)
                short = len(words[0]) < window
                kept = h1 if short else (g := gram_hashes(words[0], gram))[winnow(g, window - gram + 1)]
                k = len(h1)
                fps = [kept.view(np.int64).tolist()] + [[]] * (k - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * k, pa.string()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(fps, pa.list_(pa.int64())), pa.array([len(words[0]) if short else 0] * k, pa.int32())],
                    ["item_id", "h1", "h2", "fps", "n"],
                )

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), text_col)
    rows = materialise(rows.mapInArrow(run, "item_id string, h1 long, h2 long, fps array<long>, n int"), "items")
    shared = rows.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return rows.select(F.explode("fps").alias("fp"), "n").distinct(), shared.withColumn("owners", F.xxhash64("items"))


def bit_table(fps: DataFrame, bits: int) -> np.ndarray:
    """A table with the bit of each fingerprint set; its size does not depend on the items."""
    slot = F.shiftrightunsigned("fp", 64 - bits)
    words = fps.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(s & 63)))").alias("v"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for w, v in words.toLocalIterator():
        table[w] = v
    return table.view(np.uint64)


def candidates(docs: DataFrame, id_col: str, text_col: str, table: np.ndarray, short: list[int], window: int, gram: int, bits: int) -> DataFrame:
    """One row for each document: key, word count, and the windows about fingerprints in the table."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def listed(grams: np.ndarray, at: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        slot = grams[at] >> np.uint64(64 - bits)
        return at[(bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]

    def of(text: str | None, bitmap: np.ndarray) -> tuple[int, list]:
        words = word_hashes(text)
        n, found = len(words[0]), []
        if n >= window:
            grams = gram_hashes(words[0], gram)
            hits = listed(grams, winnow(grams, window - gram + 1), bitmap)
            if len(hits):
                starts = np.unique((hits[:, None] - np.arange(window - gram + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= n - window)]
                h1, h2 = (np.concatenate([gram_hashes(w[s : s + window], window, k) for s in starts]) for k, w in enumerate(words))
                found += [{"h1": a, "h2": b, "begin": int(s), "size": window} for a, b, s in zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), starts, strict=True)]
        for m in short:
            h1 = gram_hashes(words[0], m)
            at = listed(h1, np.arange(len(h1)), bitmap)
            if len(at):
                h2 = gram_hashes(words[1], m, 1)
                found += [{"h1": a, "h2": b, "begin": int(s), "size": m} for a, b, s in zip(h1[at].view(np.int64).tolist(), h2[at].view(np.int64).tolist(), at, strict=True)]
        return n, found

    spans = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("begin", pa.int32()), ("size", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for b in batches:
            got = [of(t.as_py(), bitmap) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([f for _, f in got], spans)], ["id", "text_hash", "n_words", "spans"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text_hash long, n_words long, spans array<struct<h1:long,h2:long,begin:int,size:int>>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5, table_bits: int = 26) -> DataFrame:
    """One row for each document: id, ``text_hash``, ``n_words``, ``n_hit``, ``items`` (sorted ids)."""
    fps, windows = item_rows(items, item_id_col, item_text_col, window, gram)
    short = sorted(r["n"] for r in fps.where("n > 0").select("n").distinct().collect())
    marked = materialise(candidates(docs, id_col, text_col, bit_table(fps, table_bits), short, window, gram, table_bits), "contamination")
    spans = marked.where(F.size("spans") > 0).select("id", "text_hash", F.explode("spans").alias("s")).select("id", "text_hash", "s.*").distinct()
    windows = materialise(windows, "windows")
    hits = spans.join(windows.select("h1", "h2", "owners"), ["h1", "h2"]).select("id", "text_hash", "begin", (F.col("begin") + F.col("size")).alias("end"), "owners")
    # Words under a union of spans: each span adds what lies beyond the furthest end before it.
    before = F.max("end").over(Window.partitionBy("id", "text_hash").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(before, F.col("begin"))))
    covered = hits.withColumn("fresh", fresh)
    by_doc = covered.groupBy("id", "text_hash").agg(F.sum("fresh").cast("long").alias("n_hit"), F.collect_set("owners").alias("owners"))
    # A passage that many items share is one list of items, met once a document however many windows it has.
    lists = windows.select("owners", "items").dropDuplicates(["owners"])
    met = by_doc.select("id", "text_hash", F.explode("owners").alias("owners")).join(lists, "owners").groupBy("id", "text_hash")
    met = met.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "items")
    by_doc = by_doc.join(met, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("id", "text_hash", "n_hit", "items")
    a, b = marked.alias("a"), by_doc.alias("b")
    joined = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    none = F.array().cast("array<string>")
    return joined.select(F.col("a.id").alias(id_col), F.col("a.text_hash").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share no window with any item."""
    found = contamination(docs, items, id_col, text_col, **options).where("n_hit > 0").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = small_side(materialise(found, "contaminated"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_col]) == bad["_hash"]), "left_anti")
