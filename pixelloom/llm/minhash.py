"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles; texts with equal sets form a class, and one member stands for it.
Classes get ``BANDS * ROWS`` and a few more minima. Equal bands make candidates; the low ``BITS`` bits of all minima are
packed into long integers, from which bit counts give the share of equal minima, corrected for chance agreement, and so an
estimate of the Jaccard similarity. Candidates whose estimate is far below the threshold go; the others are confirmed on
their full sets.

No bucket is expanded into pairs. Every bucket first compares its members with one pivot, and the links found are joined
into components. Only buckets that then still hold several components are looked at again, in blocks: members outside the
bucket's largest component are compared by signature with all its members, first to find who has a likely partner in
another component at all, then, for those, on their full sets. A block returns no more links than join its components. So a
group of thousands of near copies costs a few comparisons a member, while every likely pair of different components is
confirmed or refuted.

With five rows in a band and 25 bands a pair at exactly 0.85 is missed with probability 4e-7, closer pairs with less; the
estimate's margin of 0.2 is over five standard deviations.

Defined cases: null or empty texts have no set and are linked with nothing; equal rows are one class; a row without doc_id
can be linked, but the component's id is the smallest doc_id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.components import components
from pixelloom.llm.textbytes import NOT_SPACE, find_words, mix, shingles, slices, small_batches, text_buffer
from pixelloom.session import cut, discard

ROWS, BANDS, BITS, HASHES = 5, 25, 4, 128
LANES = 64 // BITS
MARGIN = 0.2
#: Members of an unresolved bucket that are compared in one block, those that ask and those asked: rows, and shingles of
#: their full sets (8 bytes each), of which the block holds all at once in the end.
ASKING, ASKED = 4096, 8192
ASKING_SHINGLES, ASKED_SHINGLES = 2 << 20, 4 << 20

_random = np.random.Generator(np.random.PCG64(7))
MULTIPLIERS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
ADDENDS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
BAND_FACTORS = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of text i are hashes[first[i]:first[i+1]]."""
    found, owner = shingles(find_words(raw, bounds, NOT_SPACE, lower=True), n)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(bounds)))


def digests(found: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for a set; None for the empty one."""
    out: list[bytes | None] = [None] * (len(first) - 1)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        one = np.add.reduceat(mix(found), first[:-1][full])
        two = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][full])
        joint = np.stack([mix(one + np.diff(first)[full].astype(np.uint64)), two], axis=1).astype(">u8")
        for i, d in zip(full.tolist(), joint):
            out[i] = d.tobytes()
    return out


def minima(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each set that is not empty, shape (sets, HASHES)."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(full), HASHES), np.uint32)
    if len(full):
        x, starts = (found >> np.uint64(32)).astype(np.uint32), first[:-1][full]
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(x * MULTIPLIERS[k] + ADDENDS[k], starts)
    return out


def bands_and_signature(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets, BANDS) from whole minima, and low bits packed into longs (sets, HASHES // LANES)."""
    rows = least[:, : ROWS * BANDS].reshape(len(least), BANDS, ROWS).astype(np.uint64)
    keys = mix((mix(rows + np.uint64(1)) * BAND_FACTORS).sum(axis=2) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = (least * np.uint32(2654435769)) >> np.uint32(32 - BITS)
    lanes = low.reshape(len(least), HASHES // LANES, LANES).astype(np.uint64) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))
    return keys.view(np.int64), np.bitwise_or.reduce(lanes, axis=2).view(np.int64)


def _lists(values: np.ndarray, full: np.ndarray, n: int) -> pa.Array:
    """Rows of ``values`` as Arrow lists at the places ``full`` of n rows, null elsewhere."""
    width = values.shape[1]
    sizes = np.zeros(n, np.int64)
    sizes[full] = width
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, node, bands, signature) of every document; node is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found, first = shingle_sets(*text_buffer(part.column("text")), n)
                full = np.flatnonzero(np.diff(first) > 0)
                keys, packed = bands_and_signature(minima(found, first))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(digests(found, first), pa.binary()),
                        _lists(keys, full, part.num_rows),
                        _lists(packed, full, part.num_rows),
                    ],
                    names=["doc_id", "n_shingles", "node", "bands", "signature"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_shingles long, node binary, bands array<long>, signature array<long>")


def equal_minima(a: str, b: str):
    """How many of the HASHES low-bit fields two signatures share, by bit counts."""
    spread = sum(1 << (BITS * i) for i in range(LANES))

    def differing(k: int):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(F.lit(spread)))

    total = differing(0)
    for k in range(1, HASHES // LANES):
        total = total + differing(k)
    return F.lit(HASHES) - total


def estimated_similarity(a: str, b: str):
    """Jaccard similarity from b-bit agreement, corrected for the 2**-BITS that agree by chance."""
    chance = 2.0**-BITS
    return (equal_minima(a, b) / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= threshold * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def _full_sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(node, items) of the chosen classes, items being the packed sorted shingle hashes of a member's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found, first = shingle_sets(*text_buffer(part.column("text")), n)
                mine = np.array([d == w.as_py() for d, w in zip(digests(found, first), part.column("node"))], bool)
                items = [found[first[i] : first[i + 1]].tobytes() for i in np.flatnonzero(mine)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").filter(pa.array(mine)), pa.array(items, pa.binary())], names=["node", "items"]
                )

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(chosen.withColumnRenamed("doc_id", "_want"), F.col("_id").eqNullSafe(F.col("_want"))).select("node", "text")
    return joined.mapInArrow(run, "node binary, items binary")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked when 100 * intersection >= threshold * union."""
    return _link(docs, id_col, text_col, n, threshold)[0]


def _link(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: int) -> tuple[DataFrame, list[DataFrame]]:
    """The links, and the tables in the shared folder that they are read from; all others are deleted on the way."""
    small_batches(docs.sparkSession)
    all_docs = cut(sketches(docs, id_col, text_col, n), "sketches")
    # the smallest doc_id of a class, and its sketch; equal sets have equal sketches
    classes = (
        all_docs.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "signature")])
    )
    classes = cut(classes, "classes")
    signatures = classes.select("node", "signature")
    members = cut(_shared_members(classes), "members")

    stars = members.groupBy("key").agg(F.min("node").alias("a"))
    pairs = members.join(stars, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    likely = cut(_likely(pairs, signatures, threshold), "pairs")
    nodes = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    sets = cut(_full_sets(docs, classes.select("node", "doc_id").join(nodes, "node"), id_col, text_col, n).dropDuplicates(["node"]), "sets")
    edges = cut(_confirm(likely, sets, threshold), "edges")
    discard(likely, sets)
    roots = components(edges)

    mixed = cut(_mixed_buckets(members, classes, roots), "mixed")
    discard(members)
    open_rows = cut(_open_members(mixed, threshold), "open")
    discard(mixed)
    if not open_rows.isEmpty():
        chosen = classes.select("node", "doc_id").join(open_rows.select("node").distinct(), "node")
        sets = cut(_full_sets(docs, chosen, id_col, text_col, n).dropDuplicates(["node"]), "sets")
        more = cut(_cross_links(open_rows, sets, threshold), "edges")
        discard(sets, roots)
        roots = components(edges.union(more))
        discard(more)
    discard(open_rows, edges)

    grouped = classes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = cut(grouped.join(least, "root").select(F.col("node"), "component_id"), "named")
    discard(classes, roots)
    linked = (
        all_docs.select("doc_id", "n_shingles", "node")
        .join(named, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    return linked, [all_docs, named]


def _shared_members(classes: DataFrame) -> DataFrame:
    """(node, n_shingles, band, key) of the band keys that several classes have; all others make no pair.

    Keys are counted alone, so that only one shuffle carries the digests of all classes, 25 times each.
    """
    members = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(shared.select("key"), "key")


def _likely(pairs: DataFrame, signatures: DataFrame, threshold: int) -> DataFrame:
    left = signatures.toDF("a", "signature_a")
    right = signatures.toDF("b", "signature_b")
    near = estimated_similarity("signature_a", "signature_b") >= F.lit(threshold / 100 - MARGIN)
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


BLOCK_KEYS = ["key", "q", "m"]
MEMBER = "key long, q int, m int, side int, node binary, root binary, band int, bands array<long>, signature array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which stand together and may go over from one batch to the next."""
    held: list[pa.RecordBatch] = []
    held_id = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in BLOCK_KEYS], axis=1)
        if held and (ids[0] != held_id).any():
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
            held = []
        held, held_id = [*held, batch.slice(cuts[-2])], ids[-1]
    if held:
        yield pa.Table.from_batches(held)


def _likely_in_block(block: pa.Table, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """(asking row, asked rows): pairs of different components with similar signatures, most similar first.

    A pair that shares several buckets counts in the one of its first common band only.
    """
    side, band = block.column("side").to_numpy(), int(block.column("band")[0].as_py())
    _, kind = np.unique(np.array([r.as_py().hex() for r in block.column("root")]), return_inverse=True)
    packed, bands = (
        np.asarray(block.column(c).combine_chunks().flatten()).view(np.uint64).reshape(len(side), -1) for c in ("signature", "bands")
    )
    least_equal = HASHES * (2.0**-BITS + (1 - 2.0**-BITS) * (threshold / 100 - MARGIN))
    fields = np.uint64(sum(1 << (BITS * i) for i in range(LANES)))
    asking, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for at in range(0, len(asking), 64):
        rows = asking[at : at + 64]
        x = packed[rows][:, None, :] ^ packed[asked][None, :, :]
        step = 1
        while step < BITS:
            x |= x >> np.uint64(step)
            step *= 2
        equal = HASHES - np.bitwise_count(x & fields).sum(axis=2, dtype=np.int64)
        equal[kind[rows][:, None] == kind[asked][None, :]] = -1
        for i in np.flatnonzero((equal >= least_equal).any(axis=1)):
            near = np.flatnonzero(equal[i] >= least_equal)
            near = near[~(bands[rows[i]][None, :band] == bands[asked[near]][:, :band]).any(axis=1)]
            if len(near):
                yield int(rows[i]), asked[near[np.argsort(-equal[i][near], kind="stable")]]


def _mixed_buckets(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of the buckets with several components, and in how many blocks each bucket is compared."""
    labelled = members.join(roots, "node", "left").select("key", "band", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = lambda rows, most, held, limit: F.ceil(F.greatest(rows / F.lit(most), held / F.lit(limit))).cast("int")
    n, s = F.col("size") - F.col("most.n"), F.col("held") - F.col("most.s")
    mixed = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("n", "root", "s")).alias("most"), F.sum("n").alias("size"), F.sum("s").alias("held"), F.count("*").alias("roots"))
        .where("roots > 1")
        .select("key", F.col("most.root").alias("main"), blocks(n, ASKING, s, ASKING_SHINGLES).alias("nq"), blocks(F.col("size"), ASKED, F.col("held"), ASKED_SHINGLES).alias("nm"))
    )
    return labelled.drop("n_shingles").join(mixed, "key").join(classes.select("node", "bands", "signature"), "node")


def _open_members(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows of blocks of the buckets with several components: those with a likely partner in another component."""
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["node", "root", "band", "bands", "signature"]
    asking = rows.where("root <> main").select("key", dealt("nq").alias("q"), each("nm").alias("m"), F.lit(0).alias("side"), *kept)
    asked = rows.select("key", each("nq").alias("q"), dealt("nm").alias("m"), F.lit(1).alias("side"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            take = {i for a, b in _likely_in_block(block, threshold) for i in (a, *b.tolist())}
            if take:
                yield from block.take(pa.array(sorted(take))).to_batches()

    return asking.union(asked).repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "side", "node").mapInArrow(run, MEMBER)


def _cross_links(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Confirmed links that join components within each block."""

    def links(block: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        nodes, roots = block.column("node").to_pylist(), block.column("root").to_pylist()
        items = [np.frombuffer(x, np.uint64) for x in block.column("items").to_pylist()]
        parent = {r: r for r in roots}

        def find(r: bytes) -> bytes:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        for i, partners in _likely_in_block(block, threshold):
            own, at, step = items[i], 0, 1
            while at < len(partners):
                mine = find(roots[i])
                some = [int(j) for j in partners[at : at + step] if find(roots[j]) != mine]
                at, step = at + step, min(step * 4, 256)
                if not some:
                    continue
                sizes = np.array([len(items[j]) for j in some])
                joint = np.concatenate([items[j] for j in some])
                place = np.minimum(np.searchsorted(own, joint), len(own) - 1)
                both = np.add.reduceat((own[place] == joint).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                for j, ok in zip(some, 100 * both >= threshold * (len(own) + sizes - both)):
                    if ok and find(roots[i]) != find(roots[j]):
                        parent[find(roots[j])] = find(roots[i])
                        yield nodes[i], nodes[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = list(links(block))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["a", "b"])

    dealt = rows.join(sets, "node").repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "side", "node")
    return dealt.mapInArrow(run, "a binary, b binary")


def deduplicate(docs: DataFrame, n: int = 3, threshold: int = 85) -> DataFrame:
    """One document of each component, with the columns of ``docs``.

    Rows that repeat a kept doc_id, or have none, can't be told apart by it: of those, equal texts stay once.
    """
    linked, tables = _link(docs, "doc_id", "text", n, threshold)
    kept = linked.where("kept").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = cut(kept.select(F.col("doc_id").alias("_kept"), ((F.col("rows") > 1) | F.col("doc_id").isNull()).alias("_many")), "kept")
    discard(*tables)
    held = docs.withColumnsRenamed({c: f"_own_{i}" for i, c in enumerate(docs.columns)})
    own = dict(zip(docs.columns, held.columns))
    number = F.col(own["doc_id"]).cast("long")
    out = held.join(kept.where("NOT _many"), number == F.col("_kept")).drop("_kept", "_many")
    many = kept.where("_many")
    if not many.isEmpty():
        rows = held.join(many, number.eqNullSafe(F.col("_kept"))).drop("_kept", "_many")
        out = out.union(rows.dropDuplicates([own["doc_id"], own["text"]]))
    return out.select(*[F.col(v).alias(k) for k, v in own.items()])
