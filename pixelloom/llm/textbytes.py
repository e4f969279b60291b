"""Words of Arrow string columns as byte ranges and 64-bit hashes, by whole-array operations.

A word is a maximal run of "word bytes"; bytes of 0x80 and above always belong to words, so UTF-8 sequences are never
cut. Hashes are polynomials over a table of random byte values: equal words hash alike everywhere, different ones
collide with probability about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes hashed at a time: bounds memory, changes no result
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_VALUES = _random_words(256, 20_240_101)
ROOT = int(_random_words(1, 20_240_102)[0])
ROOT_INVERSE = pow(ROOT, -1, 1 << 64)

WHITE_SPACE = (0x20, *range(0x09, 0x0E))
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(WHITE_SPACE)] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT**i and ROOT**-i modulo 2**64 for i < n, kept between calls."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE + 65)
        for key, base in (("up", ROOT), ("down", ROOT_INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def small_batches(spark) -> None:
    """Hand texts to Python in small Arrow batches, unless the session has chosen its own sizes.

    A worker's memory then follows the batch, not the default of 10,000 rows, which long texts make large.
    """
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "268435456", BATCH_BYTES),
    ):
        now = str(spark.conf.get(key, default))
        if now.removesuffix("b") == default:
            spark.conf.set(key, str(value))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column: text i is bytes[bounds[i]:bounds[i+1]], a null one is empty."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``limit`` bytes of text, or one row if its text is longer."""
    n = batch.num_rows
    if n == 0:
        return
    _, bounds = text_buffer(batch.column(column))
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a run of texts: byte ranges, hashes, and for text i the words first[i] to first[i+1]."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, starts, ends, hashes, first):
        self.starts, self.ends, self.hashes, self.first = starts, ends, hashes, first


def find_words(raw: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray, lower: bool) -> Words:
    values = BYTE_VALUES[LOWER] if lower else BYTE_VALUES
    n = len(raw)
    is_bound = np.zeros(n + 1, bool)
    is_bound[bounds] = True
    starts, ends, hashes = [], [], []
    at = 0
    while at < n:
        end = min(at + PIECE, n)
        while end < n and word_bytes[raw[end]] and word_bytes[raw[end - 1]] and not is_bound[end]:
            # not inside a word: step back over its bytes, or forward if the piece is one word
            back = np.flatnonzero(~word_bytes[raw[at:end]] | (is_bound[at:end] & (np.arange(end - at) > 0)))
            if len(back) and back[-1] > 0:
                end = at + int(back[-1])
            else:
                ahead = np.flatnonzero(~word_bytes[raw[end : end + PIECE]] | is_bound[end : min(end + PIECE, n)])
                end = end + int(ahead[0]) if len(ahead) else min(end + PIECE, n)
        piece = raw[at:end]
        inside = word_bytes[piece]
        edge = is_bound[at:end]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = powers(end - at + 1)
        total = np.empty(end - at + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[piece] * up[: end - at], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if starts:
        s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    else:
        s, e, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Words(s, e, h, np.searchsorted(s, bounds))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of n words in a text; a shorter text that has words gives one run, the whole."""
    counts = np.diff(words.first)
    h = words.hashes
    steps = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(n)]
    rotated = [mix(h + step) for step in steps]
    total = max(0, len(h) - n + 1)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = out * np.uint64(ROOT) + rotated[k][k : k + total]
    runs = np.maximum(counts - n + 1, 0)
    long = runs > 0
    owner = np.repeat(np.arange(len(counts)), runs)
    begin = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
    found = mix(out[begin])
    short = np.flatnonzero(~long & (counts > 0))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j, d in enumerate(short):
            acc = int(counts[d])
            for w in range(int(words.first[d]), int(words.first[d + 1])):
                acc = (acc * ROOT + int(h[w])) % (1 << 64)
            extra[j] = acc
        found, owner = np.concatenate((found, mix(extra))), np.concatenate((owner, short))
    return found, owner
