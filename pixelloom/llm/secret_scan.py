"""Secret scan: three fixed patterns, and character Markov models of random strings and ordinary identifiers.

The patterns give the base spans. The models add long tokens that look random: first-order transitions between characters
are counted over all documents, values of base spans as random strings and all other words as identifiers, and
smoothed towards the frequency of the second character. A token is added when its log-likelihood ratio passes a threshold and no
base span overlaps it. Equal words are counted first, so what is shuffled is a row a word and task. Scoring has no
shuffle, and all is DataFrame functions.

Offsets count code points, ends are exclusive. Defined cases: a null text is empty and has no spans; repeated rows are
scanned one by one; without any string both models are uniform and nothing is added; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns; group 2 of the first is the value, which must have 6 characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SMOOTHING = 2.0
#: Prior odds that a long token is an identifier: the log-likelihood ratio must outweigh them.
IDENTIFIER_ODDS = 100.0

SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _located(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans of the pattern's matches whose group has ``least`` characters.

    The parts between matches and the matches themselves, laid end to end, give the offsets.
    """
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(parts, found, lambda p, m: F.struct(F.char_length(p).cast("long").alias("gap"), m.alias("match"), F.char_length(m).cast("long").alias("size")))
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        both = F.zip_with(both, values, lambda b, v: F.struct(b["gap"].alias("gap"), v.alias("match"), b["size"].alias("size")))
    placed = F.aggregate(
        F.filter(both, lambda b: b["size"].isNotNull()),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda done, b: F.struct(
            (done["at"] + b["gap"] + b["size"]).alias("at"),
            F.when(F.char_length(b["match"]) < least, done["spans"])
            .otherwise(
                F.concat(
                    done["spans"],
                    F.array(
                        F.struct(
                            (done["at"] + b["gap"]).alias("start"),
                            F.lit(kind).alias("kind"),
                            (done["at"] + b["gap"] + b["size"]).alias("end"),
                            b["match"].alias("value"),
                        )
                    ).cast(SPAN),
                )
            )
            .alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return placed


def _when(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def _may_assign(text: Column) -> Column:
    """False only where no keyword occurs in any case: a cheap test before the pattern."""
    low = F.lower(text)
    test = F.contains(low, F.lit(KEYWORDS[0]))
    for word in KEYWORDS[1:]:
        test = test | F.contains(low, F.lit(word))
    return test


def base_spans(text: Column) -> dict[str, Column]:
    """Span arrays of the fixed patterns."""
    return {
        "assign": _when(_may_assign(text), _located(text, ASSIGN, 0, 6, group=2)),
        "access": _when(F.contains(text, F.lit("AKIA")), _located(text, ACCESS, 1, 20)),
        "hex": _when(text.rlike(r"[0-9a-f]{24}"), _located(text, HEX, 2, 24)),
    }


def _code(c: Column) -> Column:
    """Place of a character in the alphabet, from 0."""
    return F.instr(F.lit(ALPHABET), c) - 1


def _transitions(values: DataFrame) -> DataFrame:
    """(pair, n): how often a pair of neighbouring characters occurs in the strings, pair = first * alphabet + second."""
    pairs = values.groupBy("value").agg(F.count("*").alias("times")).select("times", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("value") - 1), lambda i: F.substr(F.col("value"), i, F.lit(2)))).alias("two"))
    counted = pairs.groupBy("two").agg(F.sum("times").alias("n"))
    return counted.select((_code(F.substr("two", F.lit(1), F.lit(1))) * len(ALPHABET) + _code(F.substr("two", F.lit(2), F.lit(1)))).alias("pair"), "n")


def fit(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratio, random over identifier, of every transition."""
    size = len(ALPHABET)
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hinted = _may_assign(F.col("text")) | F.contains("text", F.lit("AKIA")) | F.col("text").rlike(r"[0-9a-f]{24}")
    spans = base_spans(F.col("text"))
    found = rows.where(hinted).select(F.explode(F.concat(*spans.values())).alias("span")).select(F.col("span.value").alias("value"))
    random = found.where(F.char_length("value") >= 2).select(F.regexp_replace("value", r"[^A-Za-z0-9+/_=-]", "").alias("value")).where("char_length(value) >= 2")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), ACCESS, " "), r"[0-9a-f]{24,}", " ")
    words = rows.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0))).alias("value"))

    def logs(values: DataFrame) -> list[float]:
        # at most one row for each pair of characters of the alphabet
        counts = {r["pair"]: r["n"] for r in _transitions(values).collect()}
        ends = [1 + sum(counts.get(a * size + b, 0) for a in range(size)) for b in range(size)]
        out = []
        for a in range(size):
            # a rare first character says little: its row leans on how frequent the second one is at all
            row = [counts.get(a * size + b, 0) + SMOOTHING * size * ends[b] / sum(ends) for b in range(size)]
            whole = math.log(sum(row))
            out += [math.log(x) - whole for x in row]
        return out

    return [r - i for r, i in zip(logs(random), logs(words))]


def log_ratio(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string over the alphabet."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    codes = F.transform(F.sequence(F.lit(1), F.char_length(value)), lambda i: _code(F.substr(value, i, F.lit(1))))
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def find_secrets(docs: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (start, kind, end, value) in order; kind is a place in KINDS."""
    docs = docs.drop("base", "spans")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.withColumn("base", F.array_sort(F.concat(*base_spans(text).values())))
    tokens = F.transform(
        _located(text, TOKEN, 3, 16),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), log_ratio(s["value"], ratios).alias("ratio")),
    )
    random = base.withColumn(
        "_random", F.filter(tokens, lambda s: s["ratio"] >= math.log(IDENTIFIER_ODDS))
    )
    free = F.filter("_random", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPAN)
    return random.withColumn("spans", F.array_sort(F.concat("base", added))).drop("_random")


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    found = find_secrets(docs.select("doc_id", "text"), fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
