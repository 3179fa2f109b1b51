"""Language identification by interpolated Kneser-Ney character models.

For each language an n-gram model of order ``order`` is estimated over lower-cased letters, every run
of anything else being one boundary symbol. The models are kept together: one sorted array of 64-bit
n-gram hashes for each order, and beside it a matrix with each language's log probability, already
interpolated through all lower orders. A text is scored whole: the entry of its longest known n-gram at
every character, or that of the next shorter one times the context's back-off weight. The language with
the lowest cross-entropy per character wins.

Rejection is calibrated. The training texts' own cross-entropies under their best model give a mean and
a spread that depends on length (variance / characters + floor); a text is rejected when it lies more
than ``reject_sigmas`` spreads above that mean, or has no letter.

Training uses at most ``per_language`` labelled texts of each language, those with the smallest hash of
their id (the documented bound); counting them is a Spark aggregation. Texts that are null or have no
letter get ``und`` with score 0. Rows without a language teach nothing. Repeated rows are rows of their
own; ties go to the language that sorts first. An empty table gives an empty result; without any
labelled row every prediction is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

UNKNOWN = "und"
_EDGE = 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For each code point: its folded letter, or the edge symbol."""
    out = np.full(0x110000 + 1, _EDGE, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_fold: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    """Folded letters with single edges between runs, one edge in front and behind; empty without letters."""
    global _fold
    if _fold is None:
        _fold = _letters()
    s = _fold[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    edge = s == _EDGE
    if edge.all():
        return np.empty(0, np.uint32)
    keep = np.ones(len(s), bool)
    keep[1:] = ~(edge[1:] & edge[:-1])
    s = s[keep]
    ends = np.array([_EDGE], np.uint32)
    return np.concatenate([ends if s[0] != _EDGE else s[:0], s, ends if s[-1] != _EDGE else s[:0]])


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-grams that end at each place from ``n - 1`` on (orders never share a key)."""
    out = np.full(max(0, len(s) - n + 1), n, np.uint64)
    for j in range(n):
        out = (out ^ s[j : len(s) - n + 1 + j]) * _MULT
        out ^= out >> np.uint64(32)
    return out


@dataclass
class Models:
    languages: list[str]
    order: int
    keys: list[np.ndarray]  # by order from 1: sorted hashes
    probs: list[np.ndarray]  # by order: (keys, languages) log probabilities
    backs: list[np.ndarray]  # by order of the context from 1: (keys, languages) log back-off weights
    strange: np.ndarray | None = None  # each language's log probability of a symbol that none has seen
    mean: float = 0.0
    variance: float = 1.0
    floor: float = 0.0

    def losses(self, s: np.ndarray) -> np.ndarray:
        """Each language's cross-entropy per character, over the characters after the first edge."""
        out = np.zeros(len(self.languages))
        for n in range(2, min(self.order, len(s) + 1)):  # the first places have shorter histories
            out += self._score(s[:n], n)[0]
        n = self.order
        for at in range(0, len(s) - n + 1, 1 << 16):  # bounded memory for long texts
            out += self._score(s[at : at + (1 << 16) + n - 1], n).sum(0)
        return -out / max(1, len(s) - 1)

    def _found(self, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in the order's sorted array, and whether each is really there."""
        keys = self.keys[n - 1]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        return at, keys[at] == g

    def _score(self, s: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of the last symbol of every ``n``-gram of a text."""
        at, seen = self._found(grams(s, n), n)
        out = self.probs[n - 1][at]
        unseen = np.flatnonzero(~seen)
        if len(unseen):
            out[unseen] = self._unseen(s[unseen[:, None] + np.arange(n)], n)
        return out

    def _rows(self, w: np.ndarray, n: int) -> np.ndarray:
        """The same for ``n``-grams given as rows."""
        at, seen = self._found(self._hash_rows(w), n)
        out = self.probs[n - 1][at]
        if not seen.all():
            out[~seen] = self._unseen(w[~seen], n)
        return out

    def _unseen(self, w: np.ndarray, n: int) -> np.ndarray:
        """The next shorter n-gram, times the context's back-off weight."""
        if n == 1:
            return np.broadcast_to(self.strange, (len(w), len(self.languages)))
        return self._rows(w[:, 1:], n - 1) + self._back(w[:, :-1], n - 1)

    def _hash_rows(self, w: np.ndarray) -> np.ndarray:
        out = np.full(len(w), w.shape[1], np.uint64)
        for j in range(w.shape[1]):
            out = (out ^ w[:, j]) * _MULT
            out ^= out >> np.uint64(32)
        return out

    def _back(self, w: np.ndarray, n: int) -> np.ndarray:
        at, seen = self._found(self._hash_rows(w), n)
        return np.where(seen[:, None], self.backs[n - 1][at], 0.0)

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, cross-entropy (nats a character), rejected."""
        s = symbols(text or "")
        if not len(s) or not self.languages:
            return UNKNOWN, 0.0, 0.0, True
        loss = self.losses(s)
        best = int(np.argmin(loss))
        n = len(s) - 1
        odds = np.exp(np.clip((loss[best] - loss) * n, -700, 0))
        spread = (self.variance / n + self.floor) ** 0.5
        return self.languages[best], float(1 / odds.sum()), float(loss[best]), bool(loss[best] > self.mean + self.sigmas * spread)

    sigmas: float = 8.0


def estimate(languages: list[str], order: int, counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]], discount: float = 0.75) -> Models:
    """Models from n-gram counts. ``counted[n-1]``: (rows of ``n`` symbols, language number, count).

    Below the top order a count is the number of different symbols seen before the n-gram (Kneser-Ney).
    """
    k = len(languages)
    keys, probs, backs = [], [], []
    model = Models(languages, order, keys, probs, backs)
    for n in range(1, order + 1):
        rows, lang, count = counted[n - 1]
        if n < order:
            longer, longer_lang, _ = counted[n]
            h = model._hash_rows(longer[:, 1:])
            pairs, count = np.unique(np.stack([h, longer_lang.astype(np.uint64)]), axis=1, return_counts=True)
            value = dict(zip(zip(*pairs.tolist(), strict=True), count.tolist(), strict=True))
            own = model._hash_rows(rows)
            count = np.array([value.get((a, b), 0) for a, b in zip(own.tolist(), lang.tolist(), strict=True)], float)
        hashes = model._hash_rows(rows)
        key, where = np.unique(hashes, return_inverse=True)
        table = np.zeros((len(key), k))
        np.add.at(table, (where, lang), count)
        if n == 1:
            total = table.sum(0)
            kinds = (table > 0).sum(0)
            # Interpolated with an even share for every symbol known to any language, and one more.
            prob = np.maximum(table - discount, 0) / np.maximum(total, 1) + discount * kinds / np.maximum(total, 1) / (len(key) + 1)
            prob = np.where(total > 0, prob, 1 / (len(key) + 1))
            model.strange = np.log(np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0) / (len(key) + 1))
        else:
            context = np.empty((len(key), n - 1), np.uint32)
            context[where] = rows[:, :-1]
            shorter = np.empty((len(key), n - 1), np.uint32)
            shorter[where] = rows[:, 1:]
            h = model._hash_rows(context)
            at = np.searchsorted(keys[-1], h)
            at = np.minimum(at, len(keys[-1]) - 1)
            found = keys[-1][at] == h
            total, kinds = np.zeros((len(keys[-1]), k)), np.zeros((len(keys[-1]), k))
            np.add.at(total, at[found], table[found])
            np.add.at(kinds, at[found], (table > 0)[found])
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            backs.append(np.log(back))
            lower = np.exp(model._rows(shorter, n - 1))
            own_total = np.where(found[:, None], total[at], 0)
            prob = np.maximum(table - discount, 0) / np.maximum(own_total, 1) + np.where(own_total > 0, back[at], 1.0) * lower
        keys.append(key)
        probs.append(np.log(prob))
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, per_language: int = 400, reject_sigmas: float = 8.0) -> Models:
    """Fit on rows with a language; see the module for the bound."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(3), "id").bitwiseAND(F.lit((1 << 40) - 1)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Models([], order, [], [], [])
    # A threshold that leaves about 1.5 times the bound of each language, then the bound itself.
    pick = F.lit(False)
    for lang, n in sizes.items():
        pick = pick | ((F.col("lang") == lang) & (F.col("h") <= int(min(1.0, 1.5 * per_language / n) * (1 << 40))))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text")))
    sample = materialise(rows.where(pick).withColumn("nth", nth).where(F.col("nth") <= per_language).select("text", "lang"), "langid-sample")

    languages = sorted(sizes)
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = symbols(text)
                for n in range(1, order + 1):
                    if len(s) >= n:
                        w, c = np.unique(np.lib.stride_tricks.sliding_window_view(s, n), axis=0, return_counts=True)
                        padded = np.zeros((len(w), order), "<u4")
                        padded[:, :n] = w
                        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in padded], pa.binary()), pa.array([n] * len(w), pa.int32()), pa.array([number[lang]] * len(w), pa.int32()), pa.array(c.astype(np.int64))], ["g", "n", "lang", "c"])

    small_batches(spark)
    totals = sample.mapInArrow(count, "g binary, n int, lang int, c long").groupBy("g", "n", "lang").agg(F.sum("c").alias("c")).toPandas()
    counted = []
    for n in range(1, order + 1):
        part = totals[totals["n"] == n]
        if not len(part):  # no text is as long: the orders that exist make the models
            break
        w = np.frombuffer(b"".join(part["g"]), "<u4").reshape(-1, order)[:, :n]
        counted.append((w, part["lang"].to_numpy(np.int64), part["c"].to_numpy(float)))
    if not counted:
        return Models([], order, [], [], [])
    model = estimate(languages, len(counted), counted)
    calibrate(model, sample, reject_sigmas)
    return model


def calibrate(model: Models, sample: DataFrame, sigmas: float) -> None:
    """Mean and spread of the sample's cross-entropies; the sample is bounded, so its losses are too.

    The floor of the spread is that of the texts above the median length, or of the longest where none are above it.
    """
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(m.min(), len(s) - 1) for t in b.column(0) if len(s := symbols(t.as_py())) for m in [sent.value.losses(s)]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.float64()), pa.array([float(n) for _, n in got], pa.float64())], ["loss", "n"])

    got = sample.mapInArrow(run, "loss double, n double").toPandas()
    if len(got):
        loss, n = got["loss"].to_numpy(), got["n"].to_numpy()
        model.mean = float(np.average(loss, weights=n))
        off = (loss - model.mean) ** 2
        model.variance = max(0.5, float(np.median(off * n) * 2.2))
        longer = n > np.median(n)
        longer = longer if longer.any() else n == n.max()
        model.floor = max(0.05**2, float(np.quantile(off[longer], 0.9)))
    model.sigmas = sigmas


def predict(docs: DataFrame, model: Models, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected`` for every row."""
    spark, carry = docs.sparkSession, carry or ["doc_id"]
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.judge(t.as_py()) for t in b.column(0)]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], [*carry, "lang_pred", "score", "cross_entropy", "rejected"])

    small_batches(spark)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(text_col).alias("_text"), *carry).mapInArrow(run, f"{kinds}, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
