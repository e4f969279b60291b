"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

Documents are sorted by doc_id over the cluster. Each task encodes its run of documents and packs it into blocks of at most
about ``BLOCK_IDS`` ids (a longer document is a block of its own). A block is one file image:

    magic 8 bytes, then 6 little-endian 64-bit numbers: documents, ids, bytes an id, null doc_ids, boundary bytes, doc_id bytes
    boundaries: Elias-Fano of the n + 1 offsets into the id array
    doc_ids:    the least doc_id, then Elias-Fano of the distances from it (doc_ids ascend, repeats allowed)
    ids:        the concatenated ids of all documents, 2 bytes each if the vocabulary allows, else 4

Elias-Fano keeps the low bits of each value packed and the high bits in unary, about 2 + log2(ids / documents) bits a
document. ``select`` finds the k-th boundary from a sample of every 256th one bit and a look into the bit array; no table of
64-bit offsets is stored or built. Blocks are binary rows of a Parquet table, since the shared store is reached through
Spark's writers only.

White space separates words for tokenizers that drop it, so a task encodes each distinct word once, new ones many at a time
between marks, and keeps it; for others
(``split_words=False``) whole texts are encoded. Words are told apart by 64-bit hashes and lengths.

Defined cases: a null or empty text has the end id alone; rows without doc_id come first; rows with equal doc_id stand in
the order of their texts; an empty table gives no block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.textbytes import NOT_SPACE, find_words, mix, slices, small_batches, text_buffer
from pixelloom.session import scratch_path

MAGIC = b"EFTOKEN1"
HEAD = struct.Struct("<8s6Q")
BLOCK_IDS = 2 << 20
SAMPLE = 256
#: Distinct words that a task keeps encoded; a fuller cache starts anew, which costs time but changes nothing.
CACHE_WORDS = 1 << 20
#: New words that are encoded as one text, and the byte between them, which no such word holds.
TOGETHER = 256
MARK = b"\x01"


class EliasFano:
    """A non-decreasing sequence of non-negative integers: low bits packed, high bits in unary with select samples."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        low_bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, np.packbits(low_bits.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, k: int) -> int:
        """Value k."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // SAMPLE])
        rest = k % SAMPLE
        while rest:
            # the one bits behind the sampled one, some bytes at a time
            byte = (at + 1) // 8
            bits = np.unpackbits(self.high[byte : byte + 128], bitorder="little")
            found = np.flatnonzero(bits[at + 1 - 8 * byte :])
            if len(found) >= rest:
                at += 1 + int(found[rest - 1])
                rest = 0
            else:
                rest -= len(found)
                at = 8 * (byte + 128) - 1
        return ((at - k) << self.width) | self._low(k, k + 1)[0]

    def _low(self, a: int, b: int) -> list[int]:
        if not self.width:
            return [0] * (b - a)
        first = a * self.width
        bits = np.unpackbits(self.low[first // 8 : (b * self.width + 7) // 8], bitorder="little")[first % 8 :][: (b - a) * self.width]
        return (bits.reshape(b - a, self.width).astype(np.int64) << np.arange(self.width)).sum(axis=1).tolist()

    def values(self) -> np.ndarray:
        """All values, read in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.width) | np.array(self._low(0, self.n), np.int64) if self.n else np.zeros(0, np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<5Q", self.n, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> EliasFano:
        n, width, a, b, c = struct.unpack_from("<5Q", raw)
        low = np.frombuffer(raw, np.uint8, a, 40)
        high = np.frombuffer(raw, np.uint8, b, 40 + a)
        return cls(n, width, low, high, np.frombuffer(raw, "<u4", c, 40 + a + b))


def write_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, id_bytes: int) -> bytes:
    """The file image of documents in order; doc_ids ascend, null ones first."""
    bounds = EliasFano.encode(np.concatenate(([0], np.cumsum(sizes)))).to_bytes()
    named = [d for d in doc_ids if d is not None]
    least = named[0] if named else 0
    names = struct.pack("<q", least) + EliasFano.encode(np.array([d - least for d in named], np.uint64)).to_bytes()
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), id_bytes, len(doc_ids) - len(named), len(bounds), len(names))
    return head + bounds + names + ids.astype(f"<u{id_bytes}").tobytes()


class Block:
    """A file image, read in place."""

    def __init__(self, raw: bytes):
        raw = memoryview(raw)
        magic, self.n_docs, self.n_ids, width, self.n_null, a, b = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.bounds = EliasFano.from_bytes(raw[HEAD.size : HEAD.size + a])
        at = HEAD.size + a
        (self.least,) = struct.unpack_from("<q", raw, at)
        self.names = EliasFano.from_bytes(raw[at + 8 : at + b])
        self.ids = np.frombuffer(raw, f"<u{width}", self.n_ids, at + b)

    def doc_id(self, k: int) -> int | None:
        return None if k < self.n_null else self.least + self.names.select(k - self.n_null)

    def document(self, k: int) -> np.ndarray:
        """Ids of document k of the block."""
        return self.ids[self.bounds.select(k) : self.bounds.select(k + 1)]


class WordEncoder:
    """Ids of whole texts from a cache of the ids of their words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [], []
        for i in range(0, len(texts), 1024):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False):
                own = e.ids
                sizes.append(len(own))
                flat += own
        return np.array(sizes, np.int64), np.array(flat, np.uint32)

    def whole(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self._encode([t or "" for t in texts])

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode``, many words to a text, which costs less a word. The ids of the mark tell where a word ends.

        Words that hold the mark, and tokenizers that don't give it one id of its own, take the other way.
        """
        if self.mark is None or not words:
            return self._encode([w.decode() for w in words])
        plain = np.array([MARK not in w for w in words])
        if not plain.all():
            sizes, ids = np.zeros(len(words), np.int64), np.zeros(len(words), object)
            for chosen, encode in ((plain, self._encode_words), (~plain, lambda own: self._encode([w.decode() for w in own]))):
                at = np.flatnonzero(chosen)
                sizes[at], flat = encode([words[k] for k in at])
                for k, own in zip(at, np.split(flat, np.cumsum(sizes[at])[:-1])):
                    ids[k] = own
            return sizes, np.concatenate(ids)
        between = b" " + MARK + b" "
        texts = [between.join(words[i : i + TOGETHER]).decode() + between.decode() for i in range(0, len(words), TOGETHER)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.mark)
        if len(ends) != len(words):
            return self._encode([w.decode() for w in words])
        return np.diff(ends, prepend=-1) - 1, flat[flat != self.mark]

    def words(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids a text, all ids in order)."""
        found = find_words(raw, bounds, NOT_SPACE, lower=False)
        keys = mix(found.hashes ^ (found.ends - found.starts).astype(np.uint64))
        own, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(own) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            sizes, flat = self._encode_words([data[a:b] for a, b in zip(found.starts[first[new]].tolist(), found.ends[first[new]].tolist())])
            places = np.searchsorted(self.keys, own[new])
            self.begin = np.insert(self.begin, places, len(self.flat) + np.cumsum(sizes) - sizes)
            self.count = np.insert(self.count, places, sizes)
            self.keys = np.insert(self.keys, places, own[new])
            self.flat = np.concatenate((self.flat, flat))
            at = np.searchsorted(self.keys, own)
        slot = at[which]
        sizes = self.count[slot]
        ends = np.cumsum(sizes)
        index = np.repeat(self.begin[slot] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        total = np.concatenate(([0], ends))
        return np.diff(total[found.first]), self.flat[index]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One a worker process: what it has encoded serves the next tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", split_words: bool = True) -> DataFrame:
    """(first_id, part, seq, n_docs, n_ids, image) rows: the documents' token ids in ascending order of id_col."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = picked.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal seq, names, counts, ids
            sizes, flat = np.concatenate(counts), np.concatenate(ids)
            row = [names[0], part, seq, len(names), len(flat), write_block(names, sizes, flat, encoder.id_bytes)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            seq, names, counts, ids = seq + 1, [], [], []
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)], names=["first_id", "part", "seq", "n_docs", "n_ids", "image"]
            )

        held = 0
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                column = piece.column("text")
                sizes, flat = encoder.words(*text_buffer(column)) if split_words else encoder.whole(column.to_pylist())
                ended = np.full(len(flat) + len(sizes), end_id, np.uint32)
                keep = np.ones(len(ended), bool)
                keep[np.cumsum(sizes + 1) - 1] = False
                ended[keep] = flat
                if names and held + len(ended) > BLOCK_IDS:
                    yield block()
                    held = 0
                names += piece.column("doc_id").to_pylist()
                counts.append(sizes + 1)
                ids.append(ended)
                held += len(ended)
        if names:
            yield block()

    return ordered.mapInArrow(run, "first_id long, part int, seq int, n_docs long, n_ids long, image binary")


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, split_words: bool = True) -> None:
    encode_blocks(docs, tokenizer, end_id, split_words=split_words).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    blocks = spark.read.parquet(path)
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "part", "seq")
    # a row a block of up to 2 million ids
    starts = blocks.select("first_id", "part", "seq", "n_ids").withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids")).select("part", "seq", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("image")):
                block = Block(image.as_buffer())
                bounds = block.bounds.values()
                names = [None] * block.n_null + (block.names.values() + block.least).tolist()
                wide = block.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * block.n_docs, pa.int32()),
                        pa.array([seq] * block.n_docs, pa.int32()),
                        pa.array(names, pa.int64()),
                        pa.array(bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    read = blocks.select("part", "seq", "image").mapInArrow(run, "part int, seq int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1, name: str = "tokens") -> DataFrame:
    """Write all documents to block files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, name)
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(spark, path)
