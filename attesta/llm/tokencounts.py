"""Token counts from a cache of digests.

A text's count depends on its normalised content and on the tokenizer alone. So counts are kept in a table of
(tokenizer digest, content digest, count), a folder of Parquet files for each tokenizer version; a run joins its
texts' digests to it, encodes each distinct text that is missing, appends what it counted and joins again.

Normalised content.  Null counts as empty. SentencePiece models write a space as U+2581 before they look at a
text, so there that character is turned into a space: such texts have one count. Nothing else is changed, since
nothing else is sure to keep the count. The tokenizer digest covers the library, its version and the file.

What is missing is looked up by digest, and one row for each digest, that with the smallest id, is sought in
the texts again; texts are scanned twice and never shuffled. Rows that repeat both id and text come to the
encoder together at most and are counted once a batch. Joins are broadcast while the ids are few, by a
checked number of rows, and shuffled beyond it.

An append that is cut off leaves whole Parquet files or none: counts follow from their keys, so keys that two
runs, or a repeated task, have stored twice agree, and reading takes each once. Nulls, empty texts, repeated
rows and null ids each get a row. An empty table gives an empty result and appends nothing. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, materialise, scratch_path, small_batches, small_side

#: How sentencepiece writes a space.
SPACE = "▁"
#: Bytes of text that are encoded together, and of pieces whose counts a worker remembers.
TEXT_BYTES, REMEMBERED = 4 << 20, 32 << 20
#: A count above this is over the limit.
LIMIT = 4096
STORED = "digest binary, n_tokens long"
_counters: dict[str, "PieceCounter | WholeCounter"] = {}


def version_of(path: str) -> str:
    """The digest of a tokenizer: library, library version and file."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """The content that decides a text's count."""
    whole = F.coalesce(text, F.lit(""))
    return F.translate(whole, SPACE, " ") if path.endswith(".model") else whole


class WholeCounter:
    """Counts of a tokenizers file: whole texts, the library's defaults, nothing added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: pa.Array) -> np.ndarray:
        held = texts.to_pylist()
        return np.array([len(e.ids) for at in range(0, len(held), 256) for e in self.tokenizer.encode_batch_fast(held[at : at + 256], add_special_tokens=False)], np.int64)


class PieceCounter:
    """Counts of a SentencePiece model, different pieces of texts once each.

    Where no piece of the vocabulary has a space behind another character, no merge reaches over the place
    before a space, so a text's count is the sum over what stands between its spaces. Texts with spaces at
    an end or in a row are encoded whole, and so are all texts of a model without that property.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.opens = np.array([p.startswith(SPACE) for p in pieces])
        plain = self.model.normalize(" a  b ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}" and self.model.normalize("ﬁÅ\n") == f"{SPACE}ﬁÅ\n"
        self.apart = plain and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known, self.counts = pa.array([], pa.string()), np.empty(0, np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        whole = np.ones(len(texts), bool)
        if self.apart:
            whole = pc.or_(pc.match_substring_regex(texts, "^ |  | \\z"), pc.match_substring(texts, SPACE)).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        out[whole] = [len(found) for found in self.ids(texts.filter(pa.array(whole)).to_pylist())]
        cut = pc.split_pattern(texts.filter(pa.array(~whole & (pc.binary_length(texts).to_numpy() > 0))), " ")
        if len(cut):
            coded = cut.values.dictionary_encode()
            out[~whole & (pc.binary_length(texts).to_numpy() > 0)] = np.add.reduceat(self.learn(coded.dictionary)[coded.indices.to_numpy()], cut.offsets.to_numpy()[:-1])
        return out

    def learn(self, pieces: pa.Array) -> np.ndarray:
        """The counts of different pieces, each with a space before it."""
        if self.known.nbytes + self.counts.nbytes > REMEMBERED:
            self.forget()
        rows = pc.fill_null(pc.index_in(pieces, self.known), -1).to_numpy().astype(np.int64)
        if len(new := np.flatnonzero(rows < 0)):
            rows[new] = len(self.known) + np.arange(len(new))
            fresh = pieces.take(pa.array(new))
            words = fresh.to_pylist()
            ids = [np.array(i, np.int32) for i in self.ids([" ".join(words[at : at + 1024]) for at in range(0, len(words), 1024)])]
            flat = np.concatenate(ids)
            starts = np.flatnonzero(self.opens[flat])
            if len(starts) != len(words):
                raise ValueError("a piece does not begin an id of its own")
            self.known = pa.concat_arrays([self.known, fresh])
            self.counts = np.concatenate([self.counts, np.diff(np.append(starts, len(flat)))])
        return self.counts[rows]


def counter(path: str) -> PieceCounter | WholeCounter:
    if path not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters[path] = (PieceCounter if path.endswith(".model") else WholeCounter)(path)
    return _counters[path]


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """``digest`` and ``n_tokens`` of the rows of ``digest``, ``text``, a digest once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, TEXT_BYTES):
            digests = b.column(0).to_numpy(zero_copy_only=False)
            first = np.sort(np.unique(digests, return_index=True)[1]) if len(digests) else np.empty(0, np.int64)
            once = b.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([once.column(0), pa.array(counter(path).count(once.column(1)))], ["digest", "n_tokens"])

    small_batches(texts.sparkSession)
    return texts.select("digest", "text").mapInArrow(run, STORED)


class CountCache:
    """Stored counts in a shared folder, ``tokenizer=<digest>`` for each tokenizer version."""

    def __init__(self, spark: SparkSession, folder: str, path: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/tokenizer={version_of(path)}"

    def stored(self) -> DataFrame:
        """``digest`` and ``n_tokens``, each digest once."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.folder).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.write.mode("append").parquet(self.folder)


def count(df: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``df``: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``path`` is the tokenizer's file (``.model`` for sentencepiece, else tokenizers), ``cache`` a folder that
    driver and executors share. Without it counts are kept for this call only.
    """
    spark = df.sparkSession
    kept = CountCache(spark, cache or scratch_path(spark, "token-counts"), path)
    content = normalised(F.col(text_col), path)
    keyed = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    keyed = materialise(keyed, "digests")
    wanted = keyed.groupBy("digest").agg(F.min("id").alias("least"))
    missing = materialise(wanted.join(kept.stored().select("digest"), "digest", "left_anti"), "missing")
    sought = small_side(missing.select("least", F.col("digest").alias("_digest")))
    texts = df.select(F.col(id_col).alias("id"), content.alias("text"))
    found = texts.join(sought, F.col("id").eqNullSafe(F.col("least")) & (F.unhex(F.sha2("text", 256)) == F.col("_digest"))).select(F.col("_digest").alias("digest"), "text")
    kept.append(encoded(found, path))
    counts = small_side(kept.stored().join(wanted.select("digest"), "digest", "left_semi").withColumnRenamed("digest", "_digest"))
    got = keyed.join(counts, F.col("digest") == F.col("_digest"))
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
