"""Cross-entropy difference between two matched n-gram language models.

The target model is counted over the documents that a label marks as wanted, the background model over
all documents. Both are bigram models over one shared vocabulary: every word that occurs in the corpus,
and the end of a text. Both are smoothed alike: a word's own share is its count with ``PRIOR`` added, and
a bigram's share is interpolated with it as if each history had been seen ``STRENGTH`` times more,

    p(w) = (c(w) + PRIOR) / (N + PRIOR * V),  p(w | h) = (c(h, w) + STRENGTH * p(w)) / (c(h) + STRENGTH),

which sums to one over the vocabulary for every history, seen or not. A document's score is its loss per
word (its end counts as one) under the target model minus that under the background model; lower is
closer to the target.

Counts are exact and grow with the corpus: nothing is pruned, and no table of them is sent to the driver
or to all executors. Documents are grouped into blocks of ``block_bytes``. A block sends each of its
different words and bigrams once, with its counts, to one of as many buckets as the corpus's words fill; a
bucket adds up what all blocks sent and answers each block with the sums, in the order it asked. So a word
that stands everywhere costs a row's share for each block, never for each occurrence, and shuffles grow
with the blocks' different bigrams. Words and bigrams are told apart by 63-bit hashes.

Null texts and texts without words score 0 with 0 words. Repeated rows count as often as they stand and
each get a row. Labels without a document, and null labels, mean nothing. Without any wanted document
the target model is even, and every score says how unlike evenness the text is. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, materialise, small_batches
from .decontaminate import _mix, word_hashes

PRIOR, STRENGTH = 0.5, 8.0
BLOCK_BYTES, BUCKET_WORDS = 8 << 20, 1 << 20
_STEP = np.random.default_rng(31).integers(0, 1 << 62, 2, np.uint64) * np.uint64(4) + np.uint64(3)
#: The end of a text as a word of the vocabulary, and its start as a history.
_MARKS = np.array([0x5EED, 0xB0B], np.uint64)


def share(count: np.ndarray, total: float, kinds: float) -> np.ndarray:
    """A word's own probability."""
    return (count + PRIOR) / (total + PRIOR * kinds)


def probability(pair: np.ndarray, history: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A word's probability after a history, from the pair's and the history's counts and the word's share."""
    return (pair + STRENGTH * own) / (history + STRENGTH)


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def unpack(content: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(content), kind)


class Grams:
    """The tokens of a block: ``word`` after ``before`` (places in ``keys`` and beyond), and their bigrams."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, keys: np.ndarray):
        end, start = len(keys), len(keys) + 1
        used = sizes[sizes > 0]
        closes = np.cumsum(used)
        opens = closes - used
        self.word = np.insert(words, closes, end)
        self.before = np.insert(words, opens, start) if len(used) else words
        self.document = np.repeat(np.flatnonzero(sizes), used + 1)
        code, self.pair, self.pair_count = np.unique(self.before * np.int64(len(keys) + 2) + self.word, return_inverse=True, return_counts=True)
        all_keys = np.concatenate([keys, _MARKS])
        one = np.uint64(1)
        pairs = _mix(all_keys[code // (len(keys) + 2)] * _STEP[0] + all_keys[code % (len(keys) + 2)] * _STEP[1]) | one
        self.words = end + 1  # the end counts as a word, the start does not
        self.asked = np.concatenate([_mix(all_keys[: self.words] * _STEP[0]) & ~one, pairs])
        self.order = np.argsort(self.asked, kind="stable")

    def counts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each asked word and pair occurs, in all documents and in the wanted ones."""
        mine = wanted[self.document]
        of = lambda x, n: np.bincount(x, minlength=n)
        every = np.concatenate([of(self.word, self.words), self.pair_count])
        return every, np.concatenate([of(self.word[mine], self.words), of(self.pair[mine], len(self.pair_count))])

    def losses(self, answer: np.ndarray, total: float, kinds: float) -> np.ndarray:
        """Each token's loss in nats, from the corpus's counts of what was asked."""
        word, pair = answer[: self.words], answer[self.words :]
        history = np.append(word, word[-1])  # as many starts as ends
        return -np.log(probability(pair[self.pair], history[self.before], share(word[self.word], total, kinds)))


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The rows of ``id``, ``wanted``, ``text`` as blocks of word numbers."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, block_bytes):
            hashes = [word_hashes(t.as_py())[0] for t in b.column(2)]
            sizes = np.array([len(h) for h in hashes], np.int32)
            keys, words = np.unique(np.concatenate(hashes), return_inverse=True)
            wanted = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            row = [pack(sizes), pack(wanted), pack(words.astype(np.int32)), pack(keys)]
            tokens = sizes + (sizes > 0)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array([x], pa.binary()) for x in row), pa.array([int(tokens.sum())]), pa.array([int(tokens[wanted].sum())])],
                ["ids", "sizes", "wanted", "words", "keys", "n", "n_wanted"],
            )

    small_batches(docs.sparkSession)
    found = docs.select("id", "wanted", "text").mapInArrow(run, f"ids array<{kind}>, sizes binary, wanted binary, words binary, keys binary, n long, n_wanted long")
    return found.withColumn("block", F.monotonically_increasing_id())


def grams_of(sizes: bytes, words: bytes, keys: bytes) -> Grams:
    return Grams(unpack(sizes, np.int32), unpack(words, np.int32).astype(np.int64), unpack(keys, np.uint64))


def questions(made: DataFrame, buckets: int) -> DataFrame:
    """Each block's different words and bigrams with its counts, cut into ``buckets`` ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
        for b in batches:
            for r in b.to_pylist():
                grams = grams_of(r["sizes"], r["words"], r["keys"])
                asked = grams.asked[grams.order]
                every, wanted = (c[grams.order] for c in grams.counts(unpack(r["wanted"], bool)))
                cuts = [0, *np.searchsorted(asked, edges).tolist(), len(asked)]
                full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                for at in range(0, len(full), 64):
                    part = full[at : at + 64]
                    cut = lambda x: pa.array([pack(x[cuts[k] : cuts[k + 1]]) for k in part], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([r["block"]] * len(part), pa.int64()), cut(asked), cut(every), cut(wanted)], ["bucket", "block", "asked", "every", "wanted"])

    small_batches(made.sparkSession)
    return made.select("block", "sizes", "wanted", "words", "keys").mapInArrow(run, "bucket int, block long, asked binary, every binary, wanted binary")


def answers(asked: DataFrame) -> DataFrame:
    """The corpus's counts of what each block asked, and ``kinds``, each bucket's different words, once."""

    def run(t: pa.Table) -> pa.Table:
        keys = [unpack(x.as_py(), np.uint64) for x in t["asked"]]
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = {"bucket": t["bucket"], "block": t["block"]}
        for name in ("every", "wanted"):
            counts = np.concatenate([unpack(x.as_py(), np.int64) for x in t[name]])
            sums = np.bincount(where, counts, len(found)).astype(np.int64)[where]
            out[name] = pa.array([pack(x) for x in np.split(sums, cuts)], pa.binary())
        kinds = int((found & np.uint64(1) == 0).sum())
        out["kinds"] = pa.array([kinds] + [0] * (len(keys) - 1), pa.int64())
        return pa.table(out)

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, block long, every binary, wanted binary, kinds long")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", broadcast_rows: int = 1_000_000, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``id``, ``n_words``, both losses and their difference ``score``; rows that ``labels`` marks with 1 are the target."""
    marked = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_wanted")).distinct()
    if marked.count() <= broadcast_rows:  # beyond that Spark shuffles both sides
        marked = F.broadcast(marked)
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked, F.col("id") == F.col("_wanted"), "left")
    made = materialise(blocks(flagged.select("id", F.col("_wanted").isNotNull().alias("wanted"), "text"), block_bytes), "blocks")
    n, n_wanted = made.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_wanted"), F.lit(0))).first()
    told = materialise(answers(questions(made, max(1, -(-n // bucket_words)))), "answers")
    kinds = told.agg(F.sum("kinds")).first()[0] or 0
    totals = {"wanted": float(n_wanted), "every": float(n)}
    kind = docs.schema[id_col].dataType.simpleString()

    def score(block: pa.Table, answer: pa.Table) -> pa.Table:
        sizes = unpack(block["sizes"][0].as_py(), np.int32)
        grams = grams_of(*(block[c][0].as_py() for c in ("sizes", "words", "keys")))
        answer = answer.sort_by("bucket")
        loss = {}
        for name, total in totals.items():
            counts = np.empty(len(grams.order), np.int64)
            counts[grams.order] = np.concatenate([unpack(x.as_py(), np.int64) for x in answer[name]])
            sums = np.bincount(grams.document, grams.losses(counts, total, kinds), len(sizes))
            loss[name] = sums / (sizes + 1) * (sizes > 0)
        columns = [block["ids"].combine_chunks().flatten(), pa.array(sizes.astype(np.int64)), *map(pa.array, loss.values()), pa.array(loss["wanted"] - loss["every"])]
        return pa.Table.from_arrays(columns, ["id", "n_words", "target_loss", "background_loss", "score"])

    held = made.select("block", "ids", "sizes", "words", "keys").groupBy("block").cogroup(told.select("block", "bucket", "every", "wanted").groupBy("block"))
    scored = held.applyInArrow(score, f"id {kind}, n_words long, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("id", id_col)
