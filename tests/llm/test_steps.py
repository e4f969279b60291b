"""What the steps of a job write and leave behind."""

import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pixelloom.llm")

from pixelloom import session  # noqa: E402
from pixelloom.llm import line_dedup, minhash  # noqa: E402


def test_only_shared_band_keys_are_written(spark, monkeypatch):
    """pipeline, near duplicates: the steps after the first one see the members of buckets with several classes only."""
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[100 * k : 100 * k + 100]) for k in range(30)]
    texts += [texts[0] + " more", texts[7] + " more"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {}

    def counted(df, name):
        out = session.cut(df, name)
        sizes[name] = (out.count(), out.select("node").distinct().count()) if "node" in out.columns else (out.count(), None)
        return out

    monkeypatch.setattr(minhash, "cut", counted)
    got = {r.doc_id: r.component_id for r in minhash.link(rows, n=3, threshold=85).collect()}
    assert got == {k: {30: 0, 31: 7}.get(k, k) for k in range(32)}
    assert sizes["classes"] == (32, 32) and sizes["members"][1] == 4 and sizes["members"][0] <= 4 * minhash.BANDS


def test_steps_leave_no_shuffle_files(spark):
    """pipeline, op3_lines, build_splits_declustered: shuffles of written steps must not add up on disk."""
    folders = [Path(str(f)) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    before = files()
    rows = session.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.monotonic() + 20
    while files() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - before
    assert sorted(tuple(r) for r in rows.collect())[0] == (0, 143)
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


def test_keys_of_lines_are_shuffled_once(spark):
    """op3_lines: the join with the first occurrences deals the keys; making them distinct needs no second exchange."""
    rows = [(None, 0, 5, 1, [1]), (0, 0, 5, 1, [1]), (0, 2, 6, 2, [2]), (0, 2, 6, 2, [2]), (3, 1, 7, 3, [3]), (2, 9, 7, 3, [3])]
    hashed = spark.createDataFrame(rows, "doc_id long, line long, node long, simhash long, keys array<long>")
    nodes = session.cut(hashed.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("first")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = line_dedup._first_occurrences(hashed, nodes)
        plan = once._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.node, r.simhash, r["keys"]) for r in once.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(5, 1, [1]), (6, 2, [2]), (7, 3, [3])]
    assert plan.count("Exchange hashpartitioning") == 2


def test_edit_distances_are_exact():
    """op3_lines: what rules pairs out before their distance is taken, and the distance along diagonals, lose and add none."""
    rng = np.random.Generator(np.random.PCG64(5))
    rows = []
    for i in range(600):
        letters = ["ab", "abcdefgh é", "aé漢😀 bcd"][i % 3]
        x = list(rng.choice(list(letters), rng.integers(1, 90)))
        y = x[:]
        for _ in range(rng.integers(0, 12)):
            k = int(rng.integers(0, len(y) + 1))
            y[k : k + int(rng.integers(0, 2))] = list(rng.choice(list(letters), rng.integers(0, 2)))
        rows.append((i, i, "".join(x), "".join(y) or "a"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {i for i, _, x, y in rows if distance(x, y) <= int(max(len(x), len(y)) * line_dedup.EDITS)}
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["a", "b", "left", "right"])
    got = [k for part in line_dedup._alike_pairs(iter([batch])) for k in part.column("a").to_pylist()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(rows)


def test_pairs_of_lines_are_confirmed_in_rounds(spark):
    """op3_lines: many pairs of few lines don't put their lines on disk all at once, and no pair is lost."""
    texts = [(i, "the same words again and again, but number " + chr(97 + i)) for i in range(16)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    nodes = spark.createDataFrame([(i, (i, 0)) for i in range(16)], "node long, first struct<doc_id: long, line: long>")
    pairs = [(a, b) for a in range(16) for b in range(a + 1, 16)]
    found = line_dedup._confirmed(docs, nodes, session.cut(spark.createDataFrame(pairs, "a long, b long")))
    folders = {f.rpartition("/")[0] for f in found.inputFiles()}
    assert sorted(tuple(r) for r in found.collect()) == pairs
    assert len(folders) == 4


def test_line_keys_are_counted_in_rounds(spark):
    """op3_lines: the rounds hold every key once, and a task gives those of a repeated line once."""
    text = "some line that comes again and again in all the texts"
    docs = spark.createDataFrame([(i, f"{text}\n{text} number {i}x") for i in range(8)], "doc_id long, text string").coalesce(1)
    rows = line_dedup.hashed_lines(docs, 1).collect()
    keys = [[k for c in line_dedup.KEY_COLUMNS for k in r[c]] for r in rows]
    assert all(k % line_dedup.ROUNDS == i for r in rows for i, c in enumerate(line_dedup.KEY_COLUMNS) for k in r[c])
    first = [k for r, k in zip(rows, keys) if r.line == 0]
    assert len(first) == 8 and sum(map(bool, first)) == 1 and len(set(max(first, key=len))) >= line_dedup.KEYS


def test_unlike_lines_are_ruled_out_before_they_are_fetched(spark, monkeypatch):
    """op3_lines: lines of one small vocabulary share keys; only near copies among them are worth fetching their texts."""
    rng = np.random.Generator(np.random.PCG64(8))
    parts = ["the", "and", "tion", "er", "in", "th", "on", "re", "at", "en"]
    lines = [" ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(8, 60))) for _ in range(1500)]
    lines += [line[:40] + "x" + line[41:] for line in lines[:20]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    asked, confirmed = [], line_dedup._confirmed
    monkeypatch.setattr(line_dedup, "_confirmed", lambda *a: asked.append(a[2].count()) or confirmed(*a))
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_report(docs, 1).collect()}
    assert sum(got[1500 + i] for i in range(20)) >= 18 and not any(got[i] for i in range(1500))
    assert sum(asked) < 500


def test_buckets_of_lines_are_paired_whole():
    """op3_lines: small buckets give all close pairs, large ones those with a pivot and their members, in one step or several."""
    rng = np.random.Generator(np.random.PCG64(9))
    sizes = [1, 2, 5, line_dedup.SMALL, line_dedup.SMALL + 1, 60]
    rows = np.zeros(sum(sizes), line_dedup.BUCKET_ROW)
    rows["key"], rows["node"] = np.repeat(np.arange(len(sizes)), sizes), rng.permutation(len(rows))
    rows["chars"] = rng.choice([100, 105, 200], len(rows))
    rows["sign0"] = rng.choice([0, -1], len(rows), p=[0.8, 0.2])
    rows["sign1"] = rows["sign0"]
    near = lambda x, y: abs(int(x["chars"]) - int(y["chars"])) <= int(max(x["chars"], y["chars"]) * line_dedup.EDITS) and x["sign0"] == y["sign0"]
    all_pairs = {(min(x["node"], y["node"]), max(x["node"], y["node"])): int(x["key"]) for i, x in enumerate(rows) for y in rows[:i] if x["key"] == y["key"] and near(x, y)}
    dealt = np.concatenate([rows, rows[:20]])[rng.permutation(len(rows) + 20)]
    for steps in (1, 3):
        held, pairs, members = dealt[:0], set(), []
        for k, part in enumerate(np.array_split(dealt, steps)):
            own, large, held = line_dedup._paired(np.concatenate([held, part]), last=k == steps - 1)
            pairs |= {(int(a), int(b)) for a, b, _ in own}
            members += large.tolist()
        assert {p for p in pairs if all_pairs[p] < 4} == {p for p, key in all_pairs.items() if key < 4}
        assert pairs <= set(all_pairs) and {all_pairs[p] for p in pairs} >= {4, 5}
        assert {(m[0], m[1]) for m in members} == {(r["key"], r["node"]) for r in rows if r["key"] >= 4}


def test_new_words_are_encoded_many_at_a_time(monkeypatch):
    """op8_tokens: a text for every new word cost most of the job; the ids are those of the words alone."""
    import public_tokenizers

    from pixelloom.llm import tokens

    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [f"word{i}," for i in range(700)] + ["́x", "é漢", "<|endoftext|>", "\x01", "a\x01b", "'s", "　", "​", "İ"]
    want = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    for own in (words, words[:700], [w for w in words if "\x01" in w]):
        sizes, flat = encoder._encode_words([w.encode() for w in own])
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [want[words.index(w)] for w in own]
    asked = []
    encode = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: asked.extend(texts) or encode(texts))
    raw = " ".join(words).encode()
    encoder.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert sorted(asked) == ["\x01", "a\x01b"]
