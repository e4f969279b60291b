"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on the statistics of labelled texts; every path from a root to a node below it is a conjunctive
rule. A logistic regression with a lasso penalty weighs the rules and drops most. The remaining ones are compiled into Spark
column expressions, so scoring is a sum of comparisons over statistics that one pass over the text has taken.

The model is fitted on at most about ``MAX_ROWS`` labelled texts, chosen by a hash of doc_id; everything else reads all
documents.

Defined cases: null and empty texts have statistics of 0 and are scored like others; labels that are null, or of documents
that don't exist, are left out, several labels of one doc_id count as their largest; without labels of both kinds the score
is the smoothed share of label 1; rows without doc_id are scored, never trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.textbytes import NOT_SPACE, find_words, slices, small_batches, text_buffer
from pixelloom.llm.toxicity import training_rows
from pixelloom.session import cut

MAX_ROWS = 16_000
TREES, DEPTH, LASSO = 20, 3, 1e-3
THRESHOLD = 0.3

STATISTICS = (
    "bytes", "words", "lines", "word_bytes", "line_words", "upper_share", "digit_share", "symbol_share", "stop_share",
    "shout_share", "wide_share", "distinct_words", "distinct_lines", "repeated_line_bytes", "one_letter_words", "most_frequent_word",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = {
    "upper_share": _class(bytes(range(0x41, 0x5B))),
    "digit_share": _class(bytes(range(0x30, 0x3A))),
    "symbol_share": _class(b"#$%&*+<=>@\\^_`{|}~/"),
    "stop_share": _class(b".,;:?"),
    "shout_share": _class(b"!"),
    "wide_share": _class(bytes(range(0x80, 0x100))),
}
NOT_BREAK = ~_class(b"\n\r")


def statistics(raw: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Each statistic of each text."""
    n = len(bounds) - 1
    sizes = np.diff(bounds).astype(float)
    out = {"bytes": sizes}
    at = np.maximum(sizes, 1)
    for name, members in CLASSES.items():
        total = np.concatenate(([0], np.cumsum(members[raw], dtype=np.int64)))
        out[name] = np.diff(total[bounds]) / at

    def groups(first: np.ndarray, hashes: np.ndarray, weights: np.ndarray):
        """Distinct values, weight in repeated ones, and largest count, for each text."""
        owner = np.repeat(np.arange(n), np.diff(first))
        order = np.lexsort((hashes, owner))
        o, h = owner[order], hashes[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(o)))
        weight = np.add.reduceat(weights[order], begin) if len(begin) else np.zeros(0)
        distinct = np.bincount(o[begin], minlength=n)
        repeated = np.bincount(o[begin], np.where(count > 1, weight, 0), minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, o[begin], count)
        return distinct, repeated, most

    words = find_words(raw, bounds, NOT_SPACE, lower=True)
    counts = np.diff(words.first).astype(float)
    lengths = words.ends - words.starts
    distinct, _, most = groups(words.first, words.hashes, lengths)
    some = np.maximum(counts, 1)
    before = np.concatenate(([0], np.cumsum(lengths)))
    ones = np.concatenate(([0], np.cumsum(lengths == 1)))
    out["words"], out["word_bytes"] = counts, np.diff(before[words.first]) / some
    out["distinct_words"], out["most_frequent_word"] = distinct / some, most / some
    out["one_letter_words"] = np.diff(ones[words.first]) / some
    lines = find_words(raw, bounds, NOT_BREAK, lower=True)
    rows = np.diff(lines.first).astype(float)
    distinct, repeated, _ = groups(lines.first, lines.hashes, lines.ends - lines.starts)
    out["lines"], out["line_words"] = rows, counts / np.maximum(rows, 1)
    out["distinct_lines"], out["repeated_line_bytes"] = distinct / np.maximum(rows, 1), repeated / at
    return out


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and one double column for each statistic."""
    small_batches(docs.sparkSession)
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                values = statistics(*text_buffer(part.column("_text")))
                columns = [*(part.column(k) for k in keep), *(pa.array(np.asarray(values[s], float)) for s in STATISTICS)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *STATISTICS])

    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{s} double" for s in STATISTICS)]))


@dataclass
class Model:
    intercept: float
    rules: list[tuple[float, tuple[tuple[str, str, float], ...]]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def condition(rule: tuple[tuple[str, str, float], ...]) -> Column:
    out = F.lit(True)
    for name, side, limit in rule:
        out = out & (F.col(name) <= limit if side == "<=" else F.col(name) > limit)
    return out


def tree_rules(forest) -> list[tuple[tuple[str, str, float], ...]]:
    """The distinct paths from roots to all nodes below them; limits of one statistic on a path are drawn together."""
    rules = set()

    def simple(path: tuple) -> tuple:
        tight: dict[tuple[str, str], float] = {}
        for name, side, limit in path:
            old = tight.get((name, side), limit)
            tight[name, side] = min(old, limit) if side == "<=" else max(old, limit)
        return tuple(sorted((n, s, v) for (n, s), v in tight.items()))

    def walk(node, path: tuple) -> None:
        if path:
            rules.add(simple(path))
        if node.subtreeDepth() > 0:
            name, limit = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
            walk(node.leftChild(), (*path, (name, "<=", limit)))
            walk(node.rightChild(), (*path, (name, ">", limit)))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return sorted(rules)


def fit(rows: DataFrame) -> Model:
    """Fit on (text, label) rows."""
    data = cut(with_statistics(rows, keep=("label",)), "quality-rows")
    n, good = data.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)), F.lit(0))).first()
    if good == 0 or good == n:
        return Model(math.log((good + 1) / (n - good + 1)))
    data = data.withColumn("label", F.when(F.col("label") > 0, 1.0).otherwise(0.0))
    vectors = data.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=11).fit(vectors)
    rules = tree_rules(forest)
    if not rules:
        return Model(math.log((good + 1) / (n - good + 1)))
    fired = cut(data.select("label", F.array(*[condition(r).cast("double") for r in rules]).alias("fired")), "quality-rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=200, standardization=False).fit(fired.select("label", array_to_vector("fired").alias("features")))
    weights = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), [(float(w), r) for w, r in zip(weights, rules) if w != 0.0])


def held_out_fifth(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the labels outside the held-out fifth."""
    model = fit(training_rows(docs, labels, "quality", held_out_fifth, max_rows))
    scored = with_statistics(docs).withColumn("score", model.score())
    return scored.select("doc_id", held_out_fifth(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
