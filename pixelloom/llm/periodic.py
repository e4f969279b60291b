"""Runs of words that repeat with a period, found by splitting texts at rare words and scanning lags of what is left.

A run is a stretch of consecutive words whose words one period apart are identical, at least ``least`` words and two periods
long, that no neighbouring word extends; its period is the smallest one. Every word of a run therefore occurs twice or more
inside it. So a word that occurs once in its segment belongs to no run: it splits the segment, the parts are looked at again
with their own frequencies, and parts of fewer than ``least`` words go, until nothing changes.

The lags of a surviving segment are then scanned. Lags below 8 are compared word by word. A run of period q in [2b, 4b) holds
q >= 2b positions in a row whose words equal those q further on, thus a block of b words that starts at a multiple of b and
stands again q words later. Only blocks that recur in their segment are kept from one b to the next, so ordinary text has next
to none of them beyond the first; each of at most 2n pairs (block, lag) of a level is extended to both sides by halving steps on
prefix hashes. Every run is compared word by word before it is returned, so a collision of hashes costs time and changes nothing.

Work is a map over documents without a shuffle; memory follows a slice of 4 MB of text, or one text if that is longer.

Defined cases: a null or empty text has no words and no runs, and its collapsed text is empty; repeated rows each keep their
own result; an empty table gives an empty table; columns named ``runs``, ``n_words`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.textbytes import NOT_SPACE, find_words, mix, powers, slices, small_batches, text_buffer

LEAST = 12
SMALL_LAGS = 8
RUN = T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")])
_RUN_ARROW = pa.struct([pa.field(k, pa.int64(), False) for k in ("start", "length", "period")])


def surviving_segments(codes: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the segments that are left when words alone in their segment have split it, to stability.

    ``codes`` are the words of all texts in a row, ``first`` the bounds of the texts. Whether a word is alone is read from its
    nearest equal neighbours, so a round costs the words of the segments that the last round changed.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    starts, ends = first[:-1], first[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        sizes = ends - starts
        owner = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        alone = (before[at] < starts[owner]) & (after[at] >= ends[owner])
        split = np.zeros(len(starts), bool)
        split[owner[alone]] = True
        done.append((starts[~split], ends[~split]))
        if not split.any():
            break
        left = split[owner] & ~alone
        at, owner = at[left], owner[left]
        if not len(at):
            break
        opens = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner) != 0)))
        starts = at[opens]
        ends = at[np.concatenate((opens[1:], [True]))] + 1
    s = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
    e = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(s)
    return s[order], e[order]


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def find_runs_in(hashes: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts whose word hashes stand in a row, by start and then period.

    Starts and ends count words over all texts; no run crosses a bound of ``first``.
    """
    _, codes = np.unique(hashes, return_inverse=True)
    starts, ends = surviving_segments(codes, first, least)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    # the surviving segments in a row, each closed by a word of its own
    sizes = ends - starts
    room = sizes + 1
    base = np.concatenate(([0], np.cumsum(room)[:-1]))
    n = int(room.sum())
    seg = np.repeat(np.arange(len(starts)), room)
    words = np.full(n, -1)
    inner = np.ones(n, bool)
    inner[base + sizes] = False
    words[inner] = codes[np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
    words[~inner] = -1 - np.arange(len(starts))
    close = (base + sizes)[seg]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # for words of a run of many periods: its end and period, for others 0 and 1
    inside, period = np.zeros(n, np.int64), np.ones(n, np.int64)

    def same(a, b, q):
        return np.array_equal(words[a : b - q], words[a + q : b])

    def keep(a, b, q):
        ok = (b - a >= 2 * q) & (b - a >= least)
        a, b, q = a[ok], b[ok], np.broadcast_to(q, len(ok))[ok]
        found.append((a, b, q))
        for i in np.flatnonzero(b - a >= 8 * np.maximum(q, SMALL_LAGS)):
            # a multiple of the period gives the same stretch again
            if inside[a[i]] < b[i] and same(a[i], b[i], q[i]):
                inside[a[i] : b[i]], period[a[i] : b[i]] = b[i], q[i]

    for q in range(1, min(SMALL_LAGS, int(sizes.max()) // 2 + 1)):
        a, b = _stretches(words[:-q] == words[q:])
        keep(a, b + q, q)

    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words.astype(np.uint64)) * up[:n], out=total[1:])

    def block(at, size):
        return (total[at + size] - total[at]) * down[at]

    def equal(at, lag, size):
        return block(at, size) == block(at + lag, size)

    b, at = SMALL_LAGS // 2, np.flatnonzero(inner)
    while len(at):
        at = at[(sizes[seg[at]] >= max(4 * b, least)) & (at + b <= close[at])]
        if not len(at):
            break
        _, rank, many = np.unique(mix(block(at, b)) + seg[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
        recurs = many[rank] > 1
        at, rank = at[recurs], rank[recurs]
        key = np.sort(rank * (n + 1) + at)
        anchor = (at - base[seg[at]]) % b == 0
        x, r = at[anchor], rank[anchor]
        lo = np.searchsorted(key, r * (n + 1) + np.minimum(x + 2 * b, n))
        hi = np.searchsorted(key, r * (n + 1) + np.minimum(x + 4 * b, n))
        times = np.maximum(hi - lo, 0)
        x = np.repeat(x, times)
        y = key[np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())] % (n + 1)
        if len(x):
            q = y - x
            known = (x + q + b <= inside[x]) & (q % period[x] == 0)
            near = np.flatnonzero((seg[x] == seg[y]) & ~known)
            x, q = x[near], q[near]
            right, back = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            top, bottom = close[x], base[seg[x]]
            for k in reversed(range(int(sizes.max()).bit_length())):
                step = 1 << k
                go = np.flatnonzero(x + q + right + step <= top)
                go = go[equal(x[go] + right[go], q[go], step)]
                right[go] += step
                go = np.flatnonzero(x - back - step >= bottom)
                go = go[equal(x[go] - back[go] - step, q[go], step)]
                back[go] += step
            found_at = np.unique(np.stack((x - back, x + q + right, q)), axis=1)
            keep(*found_at)
        b *= 2

    a, e, q = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    if not len(a):
        return a, e, q
    sure = np.ones(len(a), bool)
    for i in range(len(a)):
        if q[i] >= SMALL_LAGS:
            sure[i] = same(a[i], e[i], q[i])
    if not sure.all():
        again = {(int(seg[i]), int(k)) for i, k in zip(a[~sure], q[~sure])}
        a, e, q = a[sure], e[sure], q[sure]
        for s, k in again:
            part = words[base[s] : base[s] + sizes[s]]
            x, y = _stretches(part[:-k] == part[k:])
            ok = y - x >= max(k, least - k)
            a, e, q = np.concatenate((a, x[ok] + base[s])), np.concatenate((e, y[ok] + k + base[s])), np.concatenate((q, np.full(int(ok.sum()), k)))
    # one stretch found with several periods has all multiples of the smallest
    order = np.lexsort((q, e, a))
    a, e, q = a[order], e[order], q[order]
    new = np.concatenate(([True], (np.diff(a) != 0) | (np.diff(e) != 0)))
    a, e, q = a[new], e[new], q[new]
    order = np.lexsort((q, a))
    a, e, q = a[order], e[order], q[order]
    shift = starts[seg[a]] - base[seg[a]]
    return a + shift, e + shift, q


def _collapse(raw: np.ndarray, words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the texts' words that are not gone, each two joined by one space."""
    kept = ~gone
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[kept]
    s, e = words.starts[kept], words.ends[kept]
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[s] += 1
    mark[e] -= 1
    take = np.cumsum(mark[:-1], dtype=np.int8).view(bool) if len(raw) else np.zeros(0, bool)
    gap = e[:-1][owner[1:] == owner[:-1]]
    out = raw.copy()
    out[gap] = 0x20
    take[gap] = True
    lengths = np.bincount(owner, e - s, len(words.first) - 1).astype(np.int64) if len(s) else np.zeros(len(words.first) - 1, np.int64)
    lengths += np.bincount(owner[1:][owner[1:] == owner[:-1]], minlength=len(lengths)).astype(np.int64) if len(s) else 0
    return out[take], np.concatenate(([0], np.cumsum(lengths)))


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def find_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, least: int = LEAST) -> DataFrame:
    """The columns ``keep`` (default: all) of every document with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are all runs of at least ``least`` words as structs of start (word number from 0), length and period, by start and
    then period. ``collapsed`` holds the words that stand in no run or in the first period of each run that contains them.
    """
    small_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "runs", "collapsed")]
    docs = docs.select(*dict.fromkeys([*names, text]))
    extra = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in names), *extra])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                raw, bounds = text_buffer(part.column(text))
                words = find_words(raw, bounds, NOT_SPACE, lower=False)
                a, e, q = find_runs_in(words.hashes, words.first, least)
                owner = np.searchsorted(words.first, a, "right") - 1
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(cover, a + q, 1)
                np.add.at(cover, e, -1)
                data, ends = _collapse(raw, words, np.cumsum(cover)[:-1] > 0)
                counts = np.bincount(owner, minlength=part.num_rows)
                fields = [pa.array(v.astype(np.int64)) for v in (a - words.first[owner], e - a, q)]
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_RUN_ARROW)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(np.diff(words.first).astype(np.int64)), runs, _strings(data, ends)],
                    names=[*names, "n_words", "runs", "collapsed"],
                )

    return docs.mapInArrow(scan, schema)


def _planted(text: Column, doc_id: Column) -> Column:
    """The text, or for one document in ten its words with a periodic tail: word i >= a is word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        rest = n - a
        p = (F.floor(rest / (3 + g % 8)) + 1).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(rest / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, rest)), " ")

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(""))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one and digests of all runs and of the collapsed text.

    A null doc_id plants nothing; see the module for the other cases.
    """
    docs = docs.select("doc_id", _planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs, keep=["doc_id"])
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumns({"best": best, "lines": F.array_join(F.transform(listed, lambda s: F.concat(s, F.lit("\n"))), "")})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
