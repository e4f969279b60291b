"""Benchmark decontamination with suffix arrays over training shards.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``window`` consecutive words of a
benchmark item; an item with fewer words, but not none, is one window. Each task cuts its documents into shards of a few
MB and builds a suffix array of every shard: the positions of its words, ordered by the words that follow. Positions whose
first words begin no window can match none and are left out beforehand, which changes no result. Every distinct
benchmark suffix, as long as a window, is then found by binary search; the array range between its two bounds holds all
its occurrences. Consecutive occurrences of one item, each a word further in the item and in the document, are joined into the
longest verbatim matches with their places: one for every item, and place in it, that the document copies.

No shuffle: documents stay where they are read, and the benchmark comes to them. It is cut into blocks of at most about
``block_bytes`` of text by a hash of item_id; only one block is sent to the tasks at a time, and with several blocks each
pass hands its findings on to the next through a table in the shared folder.

Defined cases: null or empty texts have no words and are clean; items without item_id or without words match nothing; an
item_id that stands on several rows counts once; repeated documents are each judged alone; other columns pass through,
also if they bear the names of the added ones (those are then replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.textbytes import ALNUM, LOWER, find_words, slices, small_batches, text_buffer
from pixelloom.session import cut

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20

MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_start", T.LongType()),
        T.StructField("doc_start", T.LongType()),
        T.StructField("n_words", T.LongType()),
    ]
)
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(MATCH)),
]


class WindowIndex:
    """The distinct windows of one benchmark block as rows of word codes, in order, with the items that have them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        texts = pa.array([t for _, t in items], pa.large_string())
        raw, bounds = text_buffer(texts)
        words = find_words(raw, bounds, ALNUM, lower=True)
        self.vocabulary, first_at, codes = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.spellings = [bytes(LOWER[raw[words.starts[i] : words.ends[i]]]) for i in first_at]
        codes = codes.astype(np.int64) + 1
        windows: dict[tuple, list[tuple[int, int]]] = {}
        for i in range(len(items)):
            own = codes[words.first[i] : words.first[i + 1]].tolist()
            for at in range(max(1, len(own) - window + 1) if own else 0):
                windows.setdefault(tuple(own[at : at + window]), []).append((i, at))
        keys = sorted(windows)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.rows = np.zeros((len(keys), window), np.int64)
        for r, k in enumerate(keys):
            self.rows[r, : len(k)] = k
        self.places = [set(windows[k]) for k in keys]
        self.items = [{i for i, _ in windows[k]} for k in keys]
        self.ids = [i for i, _ in items]
        # prefixes of windows, grown a word at a time as far as the shortest window: what must follow a kept position
        self.prefixes = []
        node = np.zeros(len(keys), np.int64)
        for depth in range(min([3, *self.lengths.tolist()])):
            pairs = node * (len(self.vocabulary) + 1) + self.rows[:, depth]
            known, node = np.unique(pairs, return_inverse=True)
            self.prefixes.append(known)

    def codes_of(self, hashes: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary, 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(codes: np.ndarray, index: WindowIndex) -> np.ndarray:
    """Positions of ``codes`` that can begin a window, in the order of the ``window`` words from there.

    ``codes`` ends every text, and itself, with zeros.
    """
    at = np.flatnonzero(codes)
    node = np.zeros(len(at), np.int64)
    for depth, known in enumerate(index.prefixes):
        pairs = node * (len(index.vocabulary) + 1) + codes[at + depth]
        place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        stays = known[place] == pairs
        at, node = at[stays], place[stays]
    ahead = codes[at[:, None] + np.arange(index.window)]
    # words behind a text's end or an unknown word can't be part of a match
    ahead[np.cumsum(ahead == 0, axis=1) > 0] = 0
    return at[np.lexsort(ahead.T[::-1])]


def search(codes: np.ndarray, array: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its range [low, high) of the suffix array: the suffixes that begin with its words."""

    def bound(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            ahead = codes[array[middle][:, None] + np.arange(rows.shape[1])]
            ahead[np.cumsum(ahead == 0, axis=1) > 0] = 0
            want, n = rows[todo], lengths[todo]
            differs = (ahead != want) & (np.arange(rows.shape[1]) < n[:, None])
            first = differs.argmax(axis=1)
            each = np.arange(len(todo))
            order = np.where(differs.any(axis=1), np.sign(ahead[each, first] - want[each, first]), 0)
            right = order < 0 if not after_equal else order <= 0
            low[todo[right]] = middle[right] + 1
            high[todo[~right]] = middle[~right]
            todo = todo[low[todo] < high[todo]]
        return low

    return bound(False), bound(True)


def shard_matches(raw: np.ndarray, bounds: np.ndarray, index: WindowIndex) -> Iterator[tuple[int, list, list, list]]:
    """(words, hit spans, hit items, matches) of each text of a shard."""
    words = find_words(raw, bounds, ALNUM, lower=True)
    n_texts, window = len(bounds) - 1, index.window
    counts = np.diff(words.first)
    owner = np.repeat(np.arange(n_texts), counts)
    # each text is followed by a zero, the shard by as many as a window has words
    codes = np.zeros(len(owner) + n_texts + window, np.int64)
    place = np.arange(len(owner)) + owner
    codes[place] = index.codes_of(words.hashes)
    base = words.first[:-1] + np.arange(n_texts)
    hits: list[tuple[int, int]] = []  # (position in codes, window)
    if len(index.rows):
        array = suffix_array(codes, index)
        low, high = search(codes, array, index.rows, index.lengths)
        for w in np.flatnonzero(high > low):
            hits += [(int(p), int(w)) for p in array[low[w] : high[w]]]
    hits.sort()
    at = 0
    for d in range(n_texts):
        begin, end = int(base[d]), int(base[d]) + int(counts[d])
        spans: list[list[int]] = []
        items: set[int] = set()
        matches: list[list] = []
        now, before, carried = -1, {}, {}
        while at < len(hits) and hits[at][0] < end:
            p, w = hits[at]
            at += 1
            n = int(index.lengths[w])
            s = int(words.first[d]) + p - begin
            spelled = (bytes(LOWER[raw[words.starts[k] : words.ends[k]]]) for k in range(s, s + n))
            if any(index.spellings[c - 1] != t for c, t in zip(index.rows[w], spelled)):
                continue  # equal hashes of different words
            here = p - begin
            if spans and spans[-1][1] >= here:
                spans[-1][1] = max(spans[-1][1], here + n)
            else:
                spans.append([here, here + n])
            items |= index.items[w]
            # an item's places differ from the document's by its diagonal: a match goes on while each next window is there
            if here != now:
                before, carried, now = carried if now == here - 1 else {}, {}, here
            for i, j in index.places[w]:
                match = before.get((i, j - here))
                if match is None:
                    match = [i, j, here, n]
                    matches.append(match)
                match[3] = here - match[2] + n
                carried[i, j - here] = match
        matches.sort(key=lambda m: (m[2], index.ids[m[0]], m[1], m[0]))
        yield (
            int(counts[d]),
            [{"start": a, "end": b} for a, b in spans],
            sorted({index.ids[i] for i in items}),
            [{"item_id": index.ids[i], "item_start": j, "doc_start": k, "n_words": n} for i, j, k, n in matches],
        )


def _pass(docs: DataFrame, text_col: str, block: list[tuple[str, str]], window: int) -> DataFrame:
    """One benchmark block against all documents, findings appended to those of earlier blocks."""
    added = [f.name for f in FOUND]
    passed = [f for f in docs.schema.fields if f.name not in added]
    before = [n for n in added if n in docs.columns]
    schema = T.StructType([*passed, *FOUND])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    types = {f.name: f for f in _arrow_fields()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WindowIndex(shared.value, window)
        for batch in batches:
            for part in slices(batch, text_col, SHARD_BYTES):
                found = list(shard_matches(*text_buffer(part.column(text_col)), index))
                columns = {f.name: part.column(f.name) for f in passed}
                for k, name in enumerate(added):
                    values = [x[k] for x in found]
                    if before and name != "n_words":
                        values = [(old or []) + new for old, new in zip(part.column(name).to_pylist(), values)]
                    columns[name] = pa.array(values, types[name].type)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema)


def _arrow_fields() -> list[pa.Field]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    match = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
    return [
        pa.field("n_words", pa.int64()),
        pa.field("hit_spans", pa.list_(span)),
        pa.field("hit_items", pa.list_(pa.string())),
        pa.field("matches", pa.list_(match)),
    ]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_items`` (ids, sorted), ``matches`` (verbatim runs) and ``contaminated``."""
    if window < 1:
        raise ValueError("window must be at least 1")
    added = {*(f.name for f in FOUND), "n_hit", "contaminated"}
    docs = docs.drop(*[c for c in docs.columns if c in added])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    out = docs
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b) if n_blocks > 1 else items
        out = _pass(out, text_col, sorted((r["item_id"], r["text"]) for r in block.collect()), window)
        if b + 1 < n_blocks:
            out = cut(out, "decontaminate")
    spans = F.col("hit_spans")
    if n_blocks > 1:
        # spans of different blocks may overlap: join them in order of their starts
        spans = F.aggregate(
            F.array_sort(spans),
            F.array().cast(T.ArrayType(SPAN)),
            lambda done, x: F.when(
                (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]),
                F.concat(
                    F.slice(done, F.lit(1), F.size(done) - 1),
                    F.array(
                        F.struct(
                            F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                            F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end"),
                        )
                    ),
                ),
            ).otherwise(F.concat(done, F.array(x))),
        )
    out = out.withColumn("hit_spans", spans)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "n_words",
        n_hit.alias("n_hit"),
        F.array_sort(F.array_distinct("hit_items")).alias("hit_items"),
        "hit_spans",
        "matches",
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents that share no window with the benchmark, with their columns as they were."""
    held = docs.withColumnsRenamed({c: f"_own_{i}" for i, c in enumerate(docs.columns)})
    names = dict(zip(held.columns, docs.columns))
    inner = next(k for k, v in names.items() if v == text_col)
    clean = find_contamination(held, benchmark, inner, window).where(~F.col("contaminated"))
    return clean.select(*[F.col(k).alias(v) for k, v in names.items()])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: sizes of the overlap and a digest of the items found."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.array_max(F.transform("matches", lambda m: m["n_words"])).alias("longest_match"),
    )
