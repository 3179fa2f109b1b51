"""Token ids in wavelet-matrix files.

Texts are put in ascending id order by a range partitioning, encoded with a public tokenizer and
written as shards of about ``shard_tokens`` ids. A shard is one file that holds a wavelet matrix: one
bit-plane for each bit of the largest id, most significant first, with the ids stably partitioned by
the bit before the next plane. Cumulative counts every ``BLOCK`` bits give rank in constant time, and
select by binary search over them; access, count and occurrence lookup need nothing else.

File layout: ``MAGIC``, header length (4 bytes), JSON header, then the sections named in the header,
each compressed with zstandard: ids, lengths, then for every level the rank directory and the plane.
Spark's text writer writes the files (its line separator is the closing mark), so any file system that
Spark reaches will do, and a lost task is written again.

Null texts count as empty and hold the end id alone. Null ids come first. Repeated ids stay separate
rows, ordered by their texts' hashes, by which an id of very many rows is dealt to tasks as well. An empty table gives no file and an empty result. Other columns are ignored.
A document longer than a shard makes its shard longer; it is never cut.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, scratch_path, small_batches

MAGIC, CLOSE, BLOCK = b"WMX1", "\n=WMX1 END=\n", 512
#: Bytes of text that are cut into pieces together, and of pieces that a worker remembers.
TEXT_BYTES, REMEMBERED = 8 << 20, 32 << 20
#: How the tokenizer file writes a space, and what it takes for white space.
_SPACE, _WHITE = "\u0120", r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_encoders: dict[str, "Encoder"] = {}


class WaveletMatrix:
    """Rank, select, access and occurrence lookup over a sequence of ids."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        now, zeros, planes, ranks = ids, [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (now >> level) & 1 == 1
            packed = np.packbits(bits)
            padded = np.zeros(-(-len(bits) // BLOCK) * BLOCK // 8, np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]))
            planes.append(packed)
            low, high = now.take(np.flatnonzero(~bits)), now.take(np.flatnonzero(bits))  # thrice as fast as masks
            zeros.append(len(low))
            now = np.concatenate([low, high])
        return cls(len(ids), zeros, planes, ranks)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k, (zeros, plane) in enumerate(zip(reversed(self.zeros), reversed(self.planes), strict=True)):
            bits = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~bits)] = now[:zeros]
            above[np.flatnonzero(bits)] = now[zeros:] | kind(1 << k)
            now = above
        return now

    def rank(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        tail = np.unpackbits(self.planes[level][block * BLOCK // 8 : -(-i // 8)])[: i - block * BLOCK]
        return int(self.ranks[level][block]) + int(tail.sum())

    def select(self, level: int, bit: int, j: int) -> int:
        """Place of the ``j``-th (from 0) such bit of a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before[:-1], j, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], count=min(BLOCK, self.n - block * BLOCK))
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[block])])

    def access(self, i: int) -> int:
        out = 0
        for level in range(len(self.planes)):
            bit = self.planes[level][i // 8] >> (7 - i % 8) & 1
            ones = self.rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | int(bit)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        top = len(self.planes) - 1
        for level in range(top + 1):
            a, b = self.rank(level, lo), self.rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (top - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id occurs from ``lo`` to before ``hi``."""
        if token >> len(self.planes):
            return 0
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def occurrence(self, token: int, j: int) -> int:
        """Place of the ``j``-th (from 0) occurrence of the id."""
        at = self._range(token, 0, self.n)[0] + j
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray | list[int], levels: int, **about) -> bytes:
    """A shard's file content, without the closing mark."""
    matrix = WaveletMatrix.build(ids, levels)
    known = [0 if d is None else d for d in doc_ids]
    parts = [np.array(known, "<i8"), np.array(lengths, "<u4"), *(p for pair in zip(matrix.ranks, matrix.planes, strict=True) for p in pair)]
    squeeze = zstandard.ZstdCompressor(level=1)
    bodies = [squeeze.compress(p.tobytes()) for p in parts]
    head = {"n": len(ids), "zeros": matrix.zeros, "null_ids": [i for i, d in enumerate(doc_ids) if d is None], "sizes": [len(b) for b in bodies], **about}
    head_bytes = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head_bytes)), head_bytes, *bodies])


def unpack(content: bytes) -> tuple[dict, list, np.ndarray, WaveletMatrix]:
    """Header, document ids, lengths and matrix of a shard's file."""
    if content[:4] != MAGIC or not content.endswith(CLOSE.encode()):
        raise ValueError("not a whole wavelet-matrix file")
    size = struct.unpack_from("<I", content, 4)[0]
    head, at, parts, loose = json.loads(content[8 : 8 + size]), 8 + size, [], zstandard.ZstdDecompressor()
    for n in head["sizes"]:
        parts.append(loose.decompress(content[at : at + n]))
        at += n
    doc_ids: list = np.frombuffer(parts[0], "<i8").tolist()
    for i in head["null_ids"]:
        doc_ids[i] = None
    matrix = WaveletMatrix(head["n"], head["zeros"], [np.frombuffer(p, np.uint8) for p in parts[3::2]], [np.frombuffer(p, "<u4") for p in parts[2::2]])
    return head, doc_ids, np.frombuffer(parts[1], "<u4"), matrix


class Memory:
    """Ids of the pieces that a worker has met, forgotten as a whole when they take ``REMEMBERED`` bytes."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.opens = np.zeros(tokenizer.get_vocab_size(), bool)  # ids whose bytes begin with a space
        self.opens[[i for t, i in tokenizer.get_vocab().items() if t.startswith(_SPACE)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.ends = np.empty(0, np.uint16), np.zeros(1, np.int64)

    def learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end in ``flat`` of the ids of each (different) piece with a space before it."""
        if self.known.nbytes + self.flat.nbytes + self.ends.nbytes > REMEMBERED:
            self.forget()
        rows = pc.fill_null(pc.index_in(pieces, self.known), -1).to_numpy().astype(np.int64)
        if len(new := np.flatnonzero(rows < 0)):
            rows[new] = len(self.known) + np.arange(len(new))
            self._add(pieces.take(pa.array(new)))
        return self.ends[rows], self.ends[rows + 1]

    def _add(self, pieces: pa.Array) -> None:
        """A space opens an id of its own, so pieces without other white space are encoded side by side."""
        apart = pc.or_(pc.equal(pieces, ""), pc.match_substring_regex(pieces, _WHITE)).to_numpy(zero_copy_only=False)
        plain, single = np.flatnonzero(~apart), np.flatnonzero(apart)
        words = pieces.take(pa.array(plain)).to_pylist()
        ids, _ = self.encode([" " + " ".join(words[at : at + 1024]) for at in range(0, len(words), 1024)])
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(plain):
            raise ValueError("a piece does not begin an id of its own")
        alone, ends = self.encode([f" {w}" for w in pieces.take(pa.array(single)).to_pylist()])
        sizes, begin = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        sizes[plain], sizes[single] = np.diff(np.append(starts, len(ids))), np.diff(ends, prepend=0)
        begin[plain], begin[single] = starts, len(ids) + ends - sizes[single]
        self.flat = np.concatenate([self.flat, gather(np.concatenate([ids, alone]), begin, sizes)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.known = pa.concat_arrays([self.known, pieces])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's end."""
        found = [np.array(e.ids, np.uint16) for at in range(0, len(texts), 256) for e in self.tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint16), *found]), np.cumsum([len(f) for f in found], dtype=np.int64)


def gather(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin and extend as given, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]


class Encoder:
    """A public tokenizer that encodes the different pieces of many texts once each.

    Byte-level BPE splits a text before its pieces meet, and a space that does not lie inside a run of white
    space begins a new piece. So a text is cut at its spaces, and its ids are those of the pieces one after
    another. Texts with a space inside such a run, or with one of the file's added tokens, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(a.single_word or a.lstrip or a.rstrip or a.normalized for a in added):
            raise ValueError("added tokens that are not fixed strings")
        self.added = [a.content for a in added]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.memory = Memory(self.tokenizer)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, two bytes each, and how many each has."""
        if not len(texts):
            return np.empty(0, np.uint16), np.empty(0, np.int64)
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, f"{_WHITE} (?:{_WHITE}|\\z)")
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, a))
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        first = cut.offsets.to_numpy()[:-1]
        coded = cut.values.dictionary_encode()
        at = coded.indices.to_numpy()
        begin, end = (x[at] for x in self.memory.learn(coded.dictionary))
        heads, ends = self.memory.encode(pc.if_else(whole, texts, cut.values.take(pa.array(first))).to_pylist())
        begin[first] = len(self.memory.flat) + np.append(0, ends[:-1])
        end[first] = len(self.memory.flat) + ends
        sizes = end - begin
        return gather(np.concatenate([self.memory.flat, heads]), begin, sizes), np.add.reduceat(sizes, first)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
        if _encoders[path].vocabulary > 1 << 16:
            raise ValueError("ids of more than two bytes")
    return _encoders[path]


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20) -> None:
    """Encode ``df`` and write its shards to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        levels, part, seq = max(1, int(enc.vocabulary - 1).bit_length()), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        total = 0

        def shard() -> pa.RecordBatch:
            doc_ids, lengths, ids = zip(*held, strict=True)
            content = pack(np.concatenate(ids), [d for some in doc_ids for d in some], np.concatenate(lengths), levels, part=part, seq=seq)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for b in gathered(batches, TEXT_BYTES):
            ids, sizes = enc.encode(b.column(1))
            doc_ids, ends = b.column(0).to_pylist(), np.cumsum(sizes)
            ids, lengths = np.insert(ids, ends, end_id), sizes + 1
            ends += np.arange(1, len(ends) + 1)
            at = 0
            while at < len(lengths):
                before = int(ends[at - 1]) if at else 0
                stop = min(len(lengths), int(np.searchsorted(ends, before + shard_tokens - total)) + 1)
                held.append((doc_ids[at:stop], lengths[at:stop], ids[before : ends[stop - 1]]))
                total += int(ends[stop - 1]) - before
                if total >= shard_tokens:
                    yield shard()
                    held, total, seq = [], 0, seq + 1
                at = stop
        if held:
            yield shard()

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    files = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string"))
    files.write.option("lineSep", CLOSE).option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the shards: id, ``start``, ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                head, doc_ids, lengths, matrix = unpack(content.as_py())
                data = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(doc_ids)
                arrays = [pa.array([head["part"]] * k, pa.int64()), pa.array([head["seq"]] * k, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    small_batches(spark)
    content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInArrow(run, "part long, seq long, doc_id long, inner long, n_tokens long, ids_crc32 long")


def with_starts(docs: DataFrame) -> DataFrame:
    """Add the number of ids before each document, over all shards in order."""
    sizes = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("whole"))
    before = F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("part_start"))
    within = F.sum("size").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("seq_start", F.coalesce(within, F.lit(0))).join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_index(df: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20) -> DataFrame:
    """Write the shards, read them back, and return each document's place, length and checksum."""
    from .common import materialise

    spark = df.sparkSession
    path = scratch_path(spark, "wavelet")
    write_shards(df, path, tokenizer, end_id, id_col, text_col, shard_tokens)
    return with_starts(materialise(read_shards(spark, path), "token-index"))
