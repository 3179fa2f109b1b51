"""Runs of repeated word sequences within a text.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical) of at least
``max(shortest, 2 * q)`` words that no neighbouring word extends. Words are what white space separates.

Where to look.  A run repeats at least ``shortest // 2`` words at distance ``q``, so each of its words lies in
a gram of that many words which occurs again inside the run. Whole Arrow batches are cut at once to the
stretches that such grams cover, and again while a stretch holds grams that occur in it only once. No run
is lost or torn by that, and texts without near repeats are never looked at word by word.

How.  A suffix automaton holds a stretch, and a link-cut tree its suffix links. The path from a prefix's state
to the root is all of its suffixes; appending word ``e`` recolours that path with the last occurrence ``e``.
It falls into segments, each of one earlier last occurrence ``f`` and of suffix lengths from above ``low`` to
``high``. Where the distance ``d = e - f`` lies in that range a square of two times ``d`` words ends at ``e``. A
suffix of ``d`` words that occurred later than ``e - d`` would make the square's half periodic itself, so
these squares have smallest periods, and every such square is met. Squares of one period at consecutive ends
are one run. Recolouring costs ``O(log n)`` segments a word, amortised.

One scan, without a shuffle. Nulls, empty texts and texts of fewer than ``shortest`` words have no runs; each
row gets a row, repeated rows and null ids alike. An empty table gives an empty result. Other columns are
ignored. A batch and the automaton of one text's stretch are what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, small_batches
from .decontaminate import gram_hashes

SHORTEST, TEXT_BYTES = 12, 4 << 20
#: Rounds of cutting, at most; what is left is looked at word by word, so it bounds work and changes no result.
ROUNDS = 8
Run = tuple[int, int, int]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of each state, and the state of each prefix."""
    link, length, after, ends = [-1], [0], [{}], []
    last = 0
    for w in words:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        after.append({})
        p = last
        while p >= 0 and w not in after[p]:
            after[p][w] = new
            p = link[p]
        if p >= 0:
            q = after[p][w]
            if length[p] + 1 < length[q]:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                after.append(after[q].copy())
                link[q] = link[new] = twin
                while p >= 0 and after[p].get(w) == q:
                    after[p][w] = twin
                    p = link[p]
            else:
                link[new] = q
        ends.append(new)
        last = new
    return link, length, ends


class SuffixPaths:
    """The suffix links as preferred paths in splay trees, each path of one last occurrence (-1: none yet)."""

    def __init__(self, link: list[int], length: list[int]):
        n = len(link)
        self.up, self.length = list(link), length  # a splay tree's root points to the state above its path
        self.low, self.high = [-1] * n, [-1] * n  # children: nearer to the root of the links, and further
        self.seen = [-1] * n  # valid at the roots of splay trees

    def _lift(self, x: int) -> None:
        """Bring ``x`` to the top of its splay tree."""
        up, low, high = self.up, self.low, self.high
        while True:
            y = up[x]
            if y < 0 or (low[y] != x and high[y] != x):
                return
            z = up[y]
            if z >= 0 and (low[z] == y or high[z] == y):
                first = y if (low[y] == x) == (low[z] == y) else x
                self._turn(first)
            self._turn(x)

    def _turn(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        y = up[x]
        z = up[y]
        if low[y] == x:
            moved = low[y] = high[x]
            high[x] = y
        else:
            moved = high[y] = low[x]
            low[x] = y
        if moved >= 0:
            up[moved] = y
        up[y], up[x] = x, z
        if z >= 0 and low[z] == y:
            low[z] = x
        elif z >= 0 and high[z] == y:
            high[z] = x
        else:
            self.seen[x] = self.seen[y]

    def recolour(self, state: int, end: int) -> list[tuple[int, int, int]]:
        """Give the path from ``state`` to the root the last occurrence ``end``; the segments (earlier one, low, high) it had."""
        up, high, length, seen = self.up, self.high, self.length, self.seen
        found, below, x = [], -1, state
        while True:
            self._lift(x)
            before, rest, above = seen[x], high[x], up[x]
            if rest >= 0:
                seen[rest] = before
            high[x] = below
            if below >= 0:
                up[below] = x
            if before >= 0:
                found.append((before, length[above] if above >= 0 else 0, length[x]))
            if above < 0:
                seen[x] = end
                return found
            below, x = x, above


def runs_of(words: list[int], shortest: int = SHORTEST) -> list[Run]:
    """Start, length and period of every run, by start and then period."""
    link, length, ends = automaton(words)
    paths, open_, out = SuffixPaths(link, length), {}, []

    def close(period: int, first: int, last: int) -> None:
        start = first - 2 * period + 1
        if last - start + 1 >= max(shortest, 2 * period):
            out.append((start, last - start + 1, period))

    for end, state in enumerate(ends):
        for before, low, high in paths.recolour(state, end):
            period = end - before
            if low < period <= high:
                held = open_.get(period)
                if held and held[1] == end - 1:
                    held[1] = end
                else:
                    if held:
                        close(period, *held)
                    open_[period] = [end, end]
    for period, held in open_.items():
        close(period, *held)
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, own: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches that may hold runs, in the words of many texts (``own``: the text of each)."""
    gram = shortest // 2
    nothing = np.empty(0, np.int64)
    grams = gram_hashes(ids.astype(np.uint64), gram)
    at = np.flatnonzero(own[: len(grams)] == own[gram - 1 :]) if len(grams) else nothing
    begin, end, place = nothing, nothing, own[at]
    for _ in range(ROUNDS):
        if not len(at):
            return nothing, nothing
        order = np.lexsort((grams[at], place))
        g, p = grams[at][order], place[order]
        same = (g[1:] == g[:-1]) & (p[1:] == p[:-1])
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        whole, at = again.all(), at[again]
        if whole and len(begin):
            break
        # Grams that overlap, within one text, cover a stretch together; touching stretches must not be torn either.
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) > gram) | (np.diff(own[at]) != 0)
        begin, end = at[fresh], at[np.append(fresh[1:], True)[: len(at)]] + gram
        long = end - begin >= shortest
        nth = np.cumsum(fresh) - 1
        at, place = at[long[nth]], nth[long[nth]]
        begin, end = begin[long], end[long]
    return begin, end


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    covers = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        covers[start + period] += 1
        covers[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(covers[:-1]) == 0).tolist()])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, ``runs`` (structs of start, length and period, by start and
    then period) and ``collapsed`` (the text without what repeats inside runs)."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, TEXT_BYTES):
            texts = b.column(1).fill_null("")
            cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
            offsets = cut.offsets.to_numpy()
            ids = cut.values.dictionary_encode().indices.to_numpy()
            own = np.repeat(np.arange(len(texts)), np.diff(offsets))
            found: dict[int, list[Run]] = {}
            for lo, hi in zip(*(x.tolist() for x in stretches(ids, own, shortest)), strict=True):
                doc = int(own[lo])
                shift = lo - int(offsets[doc])
                found.setdefault(doc, []).extend((s + shift, n, q) for s, n, q in runs_of(ids[lo:hi].tolist(), shortest))
            runs = [found.get(i, []) for i in range(len(texts))]
            short = pa.array([collapsed(t.as_py().encode().split(), r) for t, r in zip(texts, runs, strict=True)], pa.binary())
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
            places = pa.array(np.append(0, np.cumsum([len(r) for r in runs], dtype=np.int32)), pa.int32())
            held = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(places, held), short.cast(pa.string())], [id_col, "runs", "collapsed"])

    small_batches(df.sparkSession)
    id_kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def repeated_tails(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``'s ids and texts, every tenth text (by the id's hash) with a tail that repeats: data to find runs in.

    Texts of null ids, and texts without words, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"), h.alias("_h"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    n = F.size("_w")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    rest = F.size("_w") - F.col("_a")
    rows = rows.withColumn("_p", (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int"))
    unit = lambda size: F.slice("_w", F.col("_a") + 1, size)
    times = F.floor(rest / F.col("_p")).cast("int")
    tail = F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(unit(F.col("_p")), times)), unit((rest % F.col("_p")).cast("int")))
    return rows.select(id_col, F.when(F.col("_a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("_text")).alias(text_col))
