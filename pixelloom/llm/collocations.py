"""Collocations: phrases that occur far more often than their parts would meet by chance, counted in partitioned suffix trees.

Texts are cut into pieces and words; each word occurrence is a suffix of at most ``LONGEST`` words that ends with its piece.
All occurrences of a phrase start suffixes that share it as a prefix, so a group of suffixes chosen by prefix holds every
count of the phrases below that prefix, and groups can be worked on independently (vertical partitioning, as in ERA):

1. *Prefixes.* A scan finds the prefixes that hold more than an eighth of ``budget`` suffixes: each slice of texts reports the
   prefixes that reach its share of half that number, so the sum of what slices keep to themselves is less than half and no
   such prefix is missed. The limit is never under 1/``HEAVY_PARTS`` of all suffixes, so at most 2 * ``HEAVY_PARTS``
   prefixes a depth are sent to tasks, 0.25 MB at 16,384.
2. *Groups.* A suffix goes to the group of its shortest prefix that is not too frequent, a hash of it modulo as many groups
   as the budget asks for. Equal suffixes of a slice travel once with their count, and a slice sends one packed block a group:
   its words once, and their numbers. Texts are shuffled in this form only, once.
3. *Subtrees.* A group is one tree truncated at ``LONGEST`` words, built level by level: a node's rows are split by their next
   word and the leaf totals summed. Nodes that are too rare end there. Prefixes that were split over groups are passed on with
   their partial totals, the root of a language (all its words) among them, and these are added up.

Counts, parts, scores and ranks of the frequent phrases are DataFrame operations on the table of frequent phrases. Words are
told apart by 64-bit hashes inside a slice and as strings beyond.

Defined cases: null or empty text has no words; a null language is ``und``; an empty table, or one without frequent phrases,
gives no rows; repeated rows count as often as they stand; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.textbytes import LOWER, ROOT, find_words, mix, slices, small_batches, text_buffer
from pixelloom.session import cut

LONGEST = 5
LEAST = 100
TOP = 2000
#: Suffixes a group may hold, about 80 MB in a worker.
BUDGET = 1 << 20
HEAVY_PARTS = 1 << 14
#: A prefix of more than this part of a group's suffixes is divided, so that groups come out even.
SHARE = 8
#: Beyond as many groups, tasks take several in turn.
MOST_TASKS = 1 << 15
#: Parts of a language whose best phrases are found apart.
PARTS = 64
#: A word and its separator take about so many bytes; it only sets how many groups there are.
WORD_BYTES = 5

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~SEPARATOR
IN_WORD[[0x20, 0x09]] = False

PREFIXES = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("prefix", T.LongType()), T.StructField("f", T.LongType())])
BLOCKS = T.StructType([T.StructField("grp", T.LongType()), T.StructField("block", T.BinaryType())])
PHRASES = T.StructType([T.StructField(k, t) for k, t in (("lang", T.StringType()), ("size", T.IntegerType()), ("phrase", T.StringType()), ("f", T.LongType()))])


class Suffixes:
    """Words of a slice of texts, how many words each suffix has, and the language of each word."""

    def __init__(self, part: pa.RecordBatch):
        self.raw, bounds = text_buffer(part.column("text"))
        self.words = find_words(self.raw, bounds, IN_WORD, lower=True)
        n = len(self.words.hashes)
        langs = part.column("lang").fill_null("und").dictionary_encode()
        self.langs = [v.encode() for v in langs.dictionary.to_pylist()]
        doc = np.repeat(np.arange(part.num_rows), np.diff(self.words.first))
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[doc]
        stops = np.concatenate(([0], np.cumsum(SEPARATOR[self.raw])))
        ends = np.ones(n, bool)
        if n:
            ends[:-1] = (stops[self.words.starts[1:]] != stops[self.words.ends[:-1]]) | (doc[1:] != doc[:-1])
        last = np.flatnonzero(ends)
        self.sizes = np.minimum(last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1, LONGEST) if n else np.zeros(0, np.int64)
        seeds = [int.from_bytes(hashlib.blake2b(v, digest_size=8).digest(), "little") for v in self.langs]
        self.root = np.array(seeds, np.uint64)[self.lang] if n else np.zeros(0, np.uint64)

    def extend(self, prefix: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """Hashes of the prefixes one word longer than ``prefix``, of ``depth`` words, of the suffixes ``at``."""
        return mix(prefix * np.uint64(ROOT) + self.words.hashes[at + depth - 1])

    def spelled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, lengths) of the words ``at``, in lower case."""
        s, lengths = self.words.starts[at], self.words.ends[at] - self.words.starts[at]
        shift = s - np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return LOWER[self.raw[np.repeat(shift, lengths) + np.arange(lengths.sum())]], lengths


def heavy_prefixes(docs: DataFrame, total_bytes: int, limit: int) -> list[np.ndarray]:
    """For depths 1 to LONGEST - 1 the sorted hashes of all prefixes of over ``limit`` suffixes, none of under half of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sfx = Suffixes(part)
                enough = limit / 2 * len(sfx.raw) / total_bytes
                at, prefix = np.arange(len(sfx.sizes)), sfx.root
                for depth in range(1, LONGEST):
                    prefix = sfx.extend(prefix, at, depth)
                    value, inverse, f = np.unique(prefix, return_inverse=True, return_counts=True)
                    often = f >= enough
                    if not often.any():
                        break
                    value, many = value[often], f[often]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), depth, np.int32)), pa.array(value.view(np.int64)), pa.array(many)], names=PREFIXES.names)
                    on = often[inverse] & (sfx.sizes[at] > depth)
                    at, prefix = at[on], prefix[on]

    found = docs.mapInArrow(scan, PREFIXES).groupBy("depth", "prefix").agg(F.sum("f").alias("f")).where(F.col("f") * 2 >= limit)
    out: list[list[int]] = [[] for _ in range(LONGEST)]
    for row in found.select("depth", "prefix").collect():
        out[row.depth].append(row.prefix)
    return [np.sort(np.array(v, np.int64).view(np.uint64)) for v in out]


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _pack(rows: np.ndarray, deep: np.ndarray, f: np.ndarray, words: tuple[np.ndarray, np.ndarray], langs: list[bytes]) -> bytes:
    """A block: rows of language and word numbers, depth of each row's group prefix, counts, and the spelled words."""
    data, lengths = words
    width = 2 if len(lengths) < 1 << 16 else 4
    names = b"".join(struct.pack("<I", len(v)) + v for v in langs)
    body = b"".join(
        [
            names,
            np.ascontiguousarray(rows.T).astype(f"<u{width}").tobytes(),
            deep.astype(np.uint8).tobytes(),
            f.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            data.tobytes(),
        ]
    )
    head = struct.pack("<6Q", len(body), len(rows), width, len(lengths), len(langs), len(data))
    return head + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, list[bytes]]:
    size, n, width, words, langs, data = struct.unpack_from("<6Q", block)
    body = pa.decompress(block[48:], decompressed_size=size, codec="zstd", asbytes=True)
    at, names = 0, []
    for _ in range(langs):
        (k,) = struct.unpack_from("<I", body, at)
        names.append(body[at + 4 : at + 4 + k])
        at += 4 + k
    rows = np.frombuffer(body, f"<u{width}", n * (LONGEST + 1), at).reshape(LONGEST + 1, n)
    at += rows.nbytes
    deep = np.frombuffer(body, np.uint8, n, at)
    f = np.frombuffer(body, "<u4", n, at + n)
    lengths = np.frombuffer(body, "<u4", words, at + 5 * n)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    spelled = pa.Array.from_buffers(pa.binary(), words, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body[-data:] if data else b"")])
    return rows, deep, f, spelled, names


def suffix_blocks(docs: DataFrame, heavy: list[np.ndarray], groups: int) -> DataFrame:
    """(grp, block): the suffixes of all texts, packed by slice and group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sfx = Suffixes(part)
                n = len(sfx.sizes)
                if not n:
                    continue
                _, first, local = np.unique(sfx.words.hashes, return_index=True, return_inverse=True)
                # the group's prefix, its depth (one more where a too frequent prefix is all there is), and the whole suffix
                whole, place, deep = sfx.root, sfx.root.copy(), np.zeros(n, np.int64)
                at, open_ = np.arange(n), np.ones(n, bool)
                whole = whole.copy()
                for depth in range(1, LONGEST + 1):
                    at = at[sfx.sizes[at] >= depth]
                    whole[at] = sfx.extend(whole[at], at, depth)
                    now = at[open_[at]]
                    place[now], deep[now] = whole[now], depth
                    hot = _is_in(whole[now], heavy[depth]) if depth < LONGEST else np.zeros(len(now), bool)
                    open_[now] = hot
                    deep[now[hot]] = depth + 1
                _, pick, f = np.unique(mix(whole + sfx.sizes.astype(np.uint64)), return_index=True, return_counts=True)
                grp = (place[pick] % np.uint64(groups)).astype(np.int64)
                order = np.lexsort((local[pick], grp))
                pick, grp, f = pick[order], grp[order], f[order]
                padded = np.concatenate((local + 1, np.zeros(LONGEST, np.int64)))
                rows = padded[pick[:, None] + np.arange(LONGEST)]
                rows[np.arange(LONGEST) >= sfx.sizes[pick][:, None]] = 0
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    used, mine = np.unique(rows[a:b], return_inverse=True)
                    if used[0] != 0:
                        used, mine = np.concatenate(([0], used)), mine + 1
                    lang, mine_lang = np.unique(sfx.lang[pick[a:b]], return_inverse=True)
                    numbers = np.column_stack((mine_lang + 1, mine.reshape(b - a, LONGEST)))
                    block = _pack(numbers, deep[pick[a:b]], f[a:b], sfx.spelled(first[used[1:] - 1]), [sfx.langs[k] for k in lang])
                    yield pa.RecordBatch.from_arrays([pa.array([int(grp[a])], pa.int64()), pa.array([block], pa.binary())], names=BLOCKS.names)

    return docs.mapInArrow(scan, BLOCKS)


def count_subtrees(blocks: pa.Table, least: int) -> pa.Table:
    """Frequent phrases of one group: (lang, size, phrase, f), partial for prefixes that other groups hold as well."""
    rows, deep, counts, spelled, langs, number = [], [], [], [], [], {}
    base = 0
    for chunk in blocks.column("block"):
        r, d, f, words, names = _unpack(chunk.as_py())
        r = r.astype(np.int64)
        lang = np.array([0] + [number.setdefault(v, len(number) + 1) for v in names])
        rows.append(np.vstack((lang[r[0]], np.where(r[1:] > 0, r[1:] + base, 0))).astype(np.int32))
        deep.append(d)
        counts.append(f)
        spelled.append(words)
        base += len(words)
    words = pa.concat_arrays(spelled).dictionary_encode()
    renumber = np.concatenate(([0], words.indices.to_numpy() + 1)).astype(np.int32)
    table = np.concatenate(rows, axis=1)
    rows.clear()
    for k in range(1, LONGEST + 1):
        table[k] = renumber[table[k]]
    deep, counts = np.concatenate(deep), np.concatenate(counts).astype(np.int64)
    langs, strings = list(number), words.dictionary.to_pylist()
    out: list[tuple[str, int, str, int]] = []
    at, node = np.arange(table.shape[1]), np.zeros(table.shape[1], np.int64)
    for depth in range(LONGEST + 1):
        on = table[depth][at] > 0
        at, node = at[on], node[on]
        if not len(at):
            break
        _, first, node = np.unique(node * (len(strings) + len(langs) + 1) + table[depth][at], return_index=True, return_inverse=True)
        f = np.bincount(node, counts[at])
        split = np.bincount(node, deep[at] > depth) > 0
        stays = (f >= least) | split
        for i in np.flatnonzero(stays):
            row = table[:, at[first[i]]]
            out.append((langs[row[0] - 1].decode(), depth, b" ".join(strings[k - 1] for k in row[1 : depth + 1]).decode(), int(f[i])))
        on = stays[node]
        at, node = at[on], node[on]
    lang, size, phrase, f = zip(*out) if out else ((), (), (), ())
    return pa.table([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.string()), pa.array(f, pa.int64())], names=PHRASES.names)


def frequent_phrases(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, size, phrase, f): all phrases of 1 to LONGEST words with f >= least; size 0 holds a language's number of words.

    The table is written to the shared folder.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("lang", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = -(-total // WORD_BYTES)
    heavy = heavy_prefixes(docs, max(total, 1), max(budget // SHARE, words // HEAVY_PARTS))
    groups = max(1, -(-words // budget))
    # about a group a task, however many the session's shuffles have
    blocks = suffix_blocks(docs, heavy, groups).repartition(min(groups, MOST_TASKS), "grp")
    counted = blocks.groupBy("grp").applyInArrow(lambda table: count_subtrees(table, least), PHRASES)
    summed = counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return cut(summed.where((F.col("f") >= least) | (F.col("size") == 0)), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """Each language's best ``top`` phrases by lowest-scoring cut: lang, rank, phrase, a, l, r, n, score.

    A phrase that stands inside a longer one with the same count is left out. Comparing with phrases one word longer is enough:
    counts never grow with length, so any phrases between two of equal count share that count. Products are
    taken in 38 digits, which holds them up to 10^12 words a language (1000 * a * n), and overflow raises under ANSI mode.
    """
    table = frequent_phrases(docs, least, budget)
    phrases = table.where("size > 0").select("lang", "phrase", "f")
    spelled = table.where("size > 1").withColumn("w", F.split("phrase", " "))
    inner = spelled.where("size > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(*(F.array_join(F.slice("w", F.lit(s), F.col("size") - 1), " ") for s in (1, 2)))).alias("phrase"))
    closed = spelled.join(inner.distinct(), (inner["lang"] == spelled["lang"]) & (inner["phrase"] == spelled["phrase"]) & (inner["a"] == spelled["f"]), "left_anti")
    cuts = closed.select("lang", "phrase", F.col("f").alias("a"), "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail")
    )
    parts = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]
    )
    # a table of its own, so that its size is known when the join is planned
    whole = cut(table.where("size = 0").select("lang", F.col("f").alias("n")), "languages")
    wide = "decimal(38,0)"
    score = F.expr(f"(1000 * cast(a as {wide}) * n) div (cast(l as {wide}) * r)")
    scored = parts.join(whole, "lang").withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the best of each part of a language first, so that a language of most phrases does not meet in one task
    part = F.pmod(F.hash("phrase"), F.lit(PARTS))
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    found = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", part.alias("part"))
    found = found.withColumn("rank", first).where(F.col("rank") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
