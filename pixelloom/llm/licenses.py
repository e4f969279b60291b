"""Licence scan: digests of canonical texts, joined to the digests of known licences.

Text is made canonical - copyright lines dropped, lower case, equivalent spellings alike, punctuation and white space as
single blanks - and hashed as a whole. Units are entire documents, entire lines of them and two lines after one another, so a
licence file, a notice line and a notice wrapped once are found; a text that only contains a licence among other words on the
same line is not. The known texts are a table of (license_id, text) or (license_id, digest), or both columns with nulls. The
default one holds common notices and ``license_digests.tsv``: digests of the whole texts of common licences, with and without
title, rights line, appendix and https addresses, as they are wrapped, with a line a paragraph, and wrapped at usual widths.

Defined cases: null and empty texts have the digest of the empty text and match nothing; known rows without id or words are
ignored; of several known texts with one digest the smallest id counts; line findings are per doc_id, so rows that repeat
one share them; rows without doc_id share theirs as well.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.session import cut

# Common licence notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)

# Spellings that count as the second one.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("organisation", "organization"), ("authorised", "authorized"),
    ("modelled", "modeled"), ("merchantable", "merchantability"), ("noncommercial", "non commercial"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"), ("sub license", "sublicense"),
)

COPYRIGHT_LINE = r"(?m)^[^a-z\n]*(copyright|\(c\)|©)[^\n]*$"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(low, BREAKS, " "), F.lit(" "))
    for spelled, meant in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelled} "), F.lit(f" {meant} "))
    return F.trim(F.regexp_replace(out, r"\x20+", " "))


def known_licenses(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The known licences in the table at ``path``, or the default ones."""
    if path is not None:
        return spark.read.parquet(path)
    digests = [line.split("\t") for line in Path(__file__).with_name("license_digests.tsv").read_text().splitlines()]
    return spark.createDataFrame([*((i, t, None) for i, t in NOTICES), *((i, None, d) for i, d in digests)], "license_id string, text string, digest string")


#: Known digests of at most so many bytes are sent to every task; of more, the join is left to Spark.
SENT_BYTES = 8 << 20


def _joined(parts: Column) -> Column:
    """The canonical form of texts after one another, from their canonical forms."""
    out = F.concat(F.lit(" "), F.array_join(F.filter(parts, lambda x: x != ""), " "), F.lit(" "))
    for spelled, meant in SPELLINGS:
        if " " in spelled:
            # words that only meet at a seam
            out = F.replace(out, F.lit(f" {spelled} "), F.lit(f" {meant} "))
    return F.trim(out)


def known_digests(known: DataFrame) -> DataFrame:
    """(known_digest, known_license), one row a digest."""
    own = F.lit(None).cast("string")
    if "text" in known.columns:
        body = canonical(F.col("text"))
        own = F.when(body != "", F.sha2(body, 256))
    table = known.select("license_id", F.coalesce("digest", own).alias("known_digest") if "digest" in known.columns else own.alias("known_digest"))
    table = table.where("license_id IS NOT NULL AND known_digest IS NOT NULL").groupBy("known_digest").agg(F.min("license_id").alias("known_license"))
    table = cut(table, "licenses")
    size = table.agg(F.coalesce(F.sum(F.octet_length("known_digest") + F.octet_length("known_license")), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= SENT_BYTES else table


def scan(docs: DataFrame, known: DataFrame | str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``digest`` and ``license`` of the whole text and ``line_licenses``, the sorted ids found on lines.

    Each line is made canonical once; whole texts and pairs of lines are put together from that. Only lines that are a known
    licence leave their task. ``known``: the known licences, or the path of their table. Columns of ``docs`` with the names of
    the results are replaced; other names, whatever they are, don't matter.
    """
    if known is None or isinstance(known, str):
        known = known_licenses(docs.sparkSession, known)
    table = known_digests(known)
    names = [c for c in docs.columns if c not in ("digest", "license", "line_licenses")]
    held = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names)])
    text, doc_id = F.col(f"own_{names.index(text_col)}").cast("string"), F.col(f"own_{names.index('doc_id')}")
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    lined = held.withColumn("lines", F.transform(split, canonical))
    pairs = F.zip_with(
        F.slice("lines", F.lit(1), F.size("lines") - 1), F.slice("lines", F.lit(2), F.size("lines")), lambda x, y: F.when((x != "") & (y != ""), _joined(F.array(x, y)))
    )
    units = F.filter(F.array_union("lines", pairs), lambda x: x.isNotNull() & (x != ""))
    found = lined.select(doc_id.alias("line_id"), F.explode(units).alias("unit")).withColumn("line_digest", F.sha2(F.col("unit"), 256))
    on_lines = found.join(table, F.col("line_digest") == F.col("known_digest")).groupBy("line_id").agg(
        F.array_join(F.array_sort(F.collect_set("known_license")), ",").alias("line_licenses")
    )
    whole = lined.withColumn("digest", F.sha2(_joined(F.col("lines")), 256)).drop("lines")
    whole = whole.join(table, F.col("digest") == F.col("known_digest"), "left")
    out = whole.join(on_lines, doc_id.eqNullSafe(F.col("line_id")), "left")
    return out.select(
        *[F.col(f"own_{i}").alias(c) for i, c in enumerate(names)], "digest", F.col("known_license").alias("license"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses")
    )


def license_report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "digest", "license", "line_licenses")
