"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (3 to 5 characters, lower case) of the whole text, hashed into 2**20 columns.
On the training texts each column gets the log ratio of its smoothed frequencies in toxic and clean texts; the columns with
the strongest evidence are kept, their values are those ratios, and a regularised logistic regression sets one weight a
column. Scoring sums weights times ratios of the columns present, without a shuffle.

The model is fitted on at most about ``MAX_ROWS`` labelled texts, chosen by a hash of doc_id; everything else reads all
documents.

Defined cases: null or empty texts have no n-grams and score as the intercept says; labels that are null, or of documents
that don't exist, are left out, several labels of one doc_id count as their largest; without labels of both kinds the score
is the smoothed share of toxic labels for every text; rows without doc_id are scored, never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.textbytes import mix, slices, small_batches
from pixelloom.session import cut, discard

GRAMS = (3, 4, 5)
BITS = 20
MAX_ROWS = 16_000
FEATURES = 8192
EVIDENCE = 4.0  # standard deviations
THRESHOLD = 0.7
_STEP = 0x9E3779B97F4A7C15


@dataclass
class Model:
    weights: np.ndarray  # of each hashed column
    used: np.ndarray  # which columns have one
    intercept: float


def gram_columns(texts: list[str | None], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, column) of the distinct n-grams of each text, of the used columns only if given."""
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = mix(np.concatenate([*codes, np.zeros(0, np.uint32)]).astype(np.uint64) + np.uint64(1))
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at, hashed, keys = np.arange(len(flat)), np.zeros(len(flat), np.uint64), []
    factor = 1
    for n in range(1, max(GRAMS) + 1):
        hashed = hashed[: max(0, len(flat) - n + 1)] + flat[n - 1 :] * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
        if n in GRAMS:
            column = ((hashed + np.uint64(n)) * np.uint64(_STEP) >> np.uint64(64 - BITS)).astype(np.int64)
            whole = at[: len(column)] + n <= ends[: len(column)]
            if used is not None:
                whole &= used[column]
            pick = np.flatnonzero(whole)
            keys.append((owner[pick] << BITS) | column[pick])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of about max_rows labelled documents at most that ``held_out`` doesn't name."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    n = marked.count()
    if n > max_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(max_rows / n * (1 << 30))))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a row of ids and labels for each text that is trained on: bounded by max_rows
    return picked.join(F.broadcast(marked), "doc_id")


def held_out_third(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def _counts(rows: DataFrame) -> DataFrame:
    """(column, toxic, clean): in how many training texts of either kind a column occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                kind = part.column("label").to_numpy() > 0
                owner, column = gram_columns(part.column("text").to_pylist())
                for k in (0, 1):
                    seen[k] += np.bincount(column[kind[owner] == bool(k)], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(seen.sum(axis=0))
        for i in range(0, len(at), 1 << 16):
            c = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(seen[1][c], pa.int64()), pa.array(seen[0][c], pa.int64())], names=["column", "toxic", "clean"])

    return rows.mapInArrow(run, "column long, toxic long, clean long").groupBy("column").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(rows: DataFrame) -> Model:
    """Fit on (text, label) rows, as ``training_rows`` makes them."""
    small_batches(rows.sparkSession)
    rows = cut(rows.select("text", "label"), "toxic-rows")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)), F.lit(0))).first()
    none = Model(np.zeros(1 << BITS), np.zeros(1 << BITS, bool), float(np.log((toxic + 1) / (n - toxic + 1))))
    if toxic == 0 or toxic == n:
        return none
    ratio = F.log((F.col("toxic") + 1) / F.lit(toxic + 2.0)) - F.log((F.col("clean") + 1) / F.lit(n - toxic + 2.0))
    # difference of the two shares over the spread that chance alone would give it
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(n))
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(0.5 / n)) * F.lit(1 / toxic + 1 / (n - toxic)))
    evidence = F.abs(F.col("toxic") / F.lit(float(toxic)) - F.col("clean") / F.lit(float(n - toxic))) / spread
    top = _counts(rows).select("column", ratio.alias("ratio"), evidence.alias("evidence")).where(F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "column").limit(FEATURES).collect()
    columns = np.array([r["column"] for r in top], np.int64)
    if not len(columns):
        return none
    used = np.zeros(1 << BITS, bool)
    used[columns] = True
    order, ratios = np.zeros(1 << BITS, np.int64), np.array([r["ratio"] for r in top])
    order[columns] = np.arange(len(columns))

    size = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                owner, column = gram_columns(part.column("text").to_pylist(), used)
                own = order[column]
                by_place = np.lexsort((own, owner))
                own = own[by_place]
                ends = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                # a sparse vector: kind 0, size, places and values
                fields = [
                    pa.array(np.zeros(part.num_rows, np.int8)),
                    pa.array(np.full(part.num_rows, size, np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(own.astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(ratios[own])),
                ]
                features = pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])
                label = pa.array((part.column("label").to_numpy() > 0).astype(np.float64))
                yield pa.RecordBatch.from_arrays([label, features], names=["label", "features"])

    data = cut(rows.mapInArrow(run, T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])), "toxic-features")
    fitted = LogisticRegression(maxIter=100, regParam=1e-4, standardization=False).fit(data)
    discard(rows, data)
    weights = np.zeros(1 << BITS)
    weights[columns] = fitted.coefficients.toArray() * ratios
    return Model(weights, used & (weights != 0), float(fitted.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` from 0 to 1; a column of that name is replaced."""
    docs = docs.drop("score")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, text_col, 1 << 19):
                owner, column = gram_columns(part.column(text_col).to_pylist(), m.used)
                total = np.bincount(owner, m.weights[column], minlength=part.num_rows) + m.intercept
                yield part.append_column("score", pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500)))))

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the labels outside the held-out third."""
    model = fit(training_rows(docs, labels, "toxic", held_out_third, max_rows))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out_third(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that score below the threshold, with their columns as they were."""
    model = fit(training_rows(docs, labels, "toxic", held_out_third, max_rows))
    held = docs.withColumnsRenamed({c: f"_own_{i}" for i, c in enumerate(docs.columns)})
    inner = held.columns[docs.columns.index("text")]
    clean = score(held, model, inner).where(F.col("score") < THRESHOLD)
    return clean.select(*[F.col(k).alias(v) for k, v in zip(held.columns, docs.columns)])
