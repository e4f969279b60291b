"""The registered queries of the operators in this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import ann, chat, collocations, decontaminate, licenses, line_dedup, minhash, mixing, periodic, quality, secret_scan, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark."""
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op2_licenses")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that are the whole of a document or of one of its lines."""
    return licenses.license_report(_table(spark, sf_dir, "documents"))


@_query("op3_lines")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and how many repeat earlier ones, exactly or nearly."""
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), least_words=1)


@_query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op5_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.link(_table(spark, sf_dir, "documents"))


@_query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    return mixing.mixing_report(_table(spark, sf_dir, "documents"))


@_query("op7_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth one."""
    return ann.search(_table(spark, sf_dir, "embeddings"))


@_query("op8_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to block files and read back."""
    import public_tokenizers

    return tokens.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


@_query(
    "op11_chat",
    r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM said
), drawn AS (
  SELECT *, replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') AS marked,
         regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g') AS body
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn >') + length(marked) + length(body) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM drawn GROUP BY conv_id
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted and read back."""
    return chat.chat_report(spark, _table(spark, sf_dir, "conversations"))


@_query(
    "op12_collocations",
    r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), spelled AS (
  SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0
), total AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM spelled GROUP BY lang
), counted AS (
  SELECT lang, p, count(*)::HUGEINT AS f
  FROM (SELECT lang, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, least(i + 4, len(w)) + 1), lambda j: w[i:j])))) AS p FROM spelled)
  GROUP BY lang, p HAVING count(*) >= 100
), inner_ones AS (
  SELECT DISTINCT lang, unnest(flatten(list_transform(range(2, len(p)), lambda m: list_transform(range(1, len(p) - m + 2), lambda i: p[i:i + m - 1])))) AS p, f
  FROM counted WHERE len(p) > 2
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, unnest(range(1, len(c.p))) AS k
  FROM counted c WHERE len(c.p) > 1
    AND NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = c.lang AND i.p = c.p AND 100 * i.f >= 100 * c.f)
), scored AS (
  SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, t.n, (1000 * c.a * t.n) // (l.f * r.f) AS score
  FROM cuts c JOIN total t ON t.lang = c.lang
  JOIN counted l ON l.lang = c.lang AND l.p = c.p[1:c.k]
  JOIN counted r ON r.lang = c.lang AND r.p = c.p[c.k + 1:len(c.p)]
), best AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@_query(
    "op13_periodic",
    r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda i: (ord(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT >> (i % 8)) & 1) AS bits
  FROM documents
), hashed AS (
  SELECT rid, doc_id, w, len(w) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) AS h
  FROM split
), tails AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed
), periods AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM tails
), words AS (
  SELECT rid, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM periods)
), grams AS (
  SELECT rid, i, word, lead(word, 5) OVER s IS NOT NULL AS full_one,
         word || ' ' || lead(word, 1) OVER s || ' ' || lead(word, 2) OVER s || ' ' || lead(word, 3) OVER s || ' ' || lead(word, 4) OVER s || ' ' || lead(word, 5) OVER s AS gram
  FROM words WINDOW s AS (PARTITION BY rid ORDER BY i)
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.gram = y.gram AND y.i > x.i WHERE x.full_one
), islands AS (
  SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs)
  GROUP BY rid, q, island
), runs AS (
  SELECT rid, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY rid, start, length
), listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first(struct_pack(s := start, l := length, q := period) ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY rid
), gone AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM split d LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return periodic.run_report(_table(spark, sf_dir, "documents"))
