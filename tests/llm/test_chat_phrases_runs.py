"""Chat formatting, collocations and periodic runs against plain Python on random and hand-made rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("pixelloom.llm")

from pixelloom.llm import chat, collocations, periodic  # noqa: E402
from pixelloom.llm.textbytes import mix  # noqa: E402

DOCS = "doc_id long, text string, lang string, runs string, size int"


# periodic runs


def plain_runs(words, least=12):
    words, best = np.array([hash(w) for w in words]), {}
    for q in range(1, len(words) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (words[:-q] == words[q:]).astype(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a + q >= max(least, 2 * q):
                best.setdefault((int(a), int(b - a + q)), q)
    return sorted((*k, q) for k, q in best.items())


def random_words(rng):
    n, k = rng.randint(0, 160), rng.choice([1, 2, 3, 6, 60])
    words = [f"w{rng.randrange(k)}" for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 2))
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    if n and rng.random() < 0.4:
        words[rng.randrange(n)] = "once"
    return words


def numbers(texts):
    codes = {}
    flat = np.array([codes.setdefault(w, len(codes)) for t in texts for w in t], np.uint64)
    return mix(flat + np.uint64(11)), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def test_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(250):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        hashes, first = numbers(texts)
        found = [[] for _ in texts]
        for a, e, q in zip(*periodic.find_runs_in(hashes, first)):
            d = int(np.searchsorted(first, a, "right")) - 1
            found[d].append((int(a - first[d]), int(e - a), int(q)))
        assert found == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("name", ["squares without cubes", "golden", "one word", "two levels"])
def test_runs_of_repetitive_texts(name):
    if name == "squares without cubes":
        # polynomial hashes modulo 2**64 collide on this sequence from 2,048 words on
        words = [bin(i).count("1") & 1 for i in range(9000)]
    elif name == "golden":
        words, last = [0, 1], [0]
        while len(words) < 3000:
            words, last = words + last, words
    elif name == "one word":
        words = [7] * 5000
    else:
        block = [1] * 40 + [2, 3] * 30 + [4]
        words = block * 12
    hashes, first = numbers([words])
    assert [(int(a), int(e - a), int(q)) for a, e, q in zip(*periodic.find_runs_in(hashes, first))] == plain_runs(words)


def test_rare_words_split_segments():
    # "b" is alone only after "x" has split the text
    words = "b c b c b c x b a a a a a a a a a a a a".split()
    hashes, first = numbers([words])
    starts, ends = periodic.surviving_segments(hashes, first)
    assert [(int(a), int(b)) for a, b in zip(starts, ends)] == [(8, 20)]


def run_rows():
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", "\t  "]).join(random_words(rng)), "en", "clash", i) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "x", 1), (62, " \n ", "en", "x", 1), (None, "a b " * 20, None, "x", 1), rows[5], rows[5]]
    return rows + [(63, "la li " * 20_000 + "end é", "fr", "x", 1), (-64, "é ü " * 9, "de", "x", 1)]


def test_run_report(spark):
    rows = run_rows()
    want = []
    for d, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(w)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 10_000 else [(0, 40_000, 2)]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        rest = " ".join(x for i, x in enumerate(w) if i not in gone)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, rest)]
        want.append((d, len(runs), s, length, q, runs and 1000 * length // q or None, *digests))
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    docs = spark.createDataFrame(rows, DOCS)
    got = periodic.run_report(docs)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    full = periodic.find_runs(docs)
    assert full.columns == ["doc_id", "text", "lang", "size", "n_words", "runs", "collapsed"] and full.count() == len(rows)
    assert periodic.run_report(spark.createDataFrame([], DOCS)).count() == 0


# collocations


def plain_phrases(rows, least):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for i in range(len(w)):
                for k in range(1, min(5, len(w) - i) + 1):
                    f[(lang or "und", *w[i : i + k])] += 1
    good = {k: v for k, v in f.items() if v >= least}
    closed = set()
    for k, v in good.items():
        for m in range(2, len(k) - 1):
            for s in range(1, len(k) - m + 1):
                if v >= f[(k[0], *k[s : s + m])]:
                    closed.add((k[0], *k[s : s + m]))
    return f, n, {k: v for k, v in good.items() if len(k) > 2 and k not in closed}


def phrase_rows():
    rng = random.Random(2)
    words = ["the", "of", "New", "york", "CITY", "hall", "ist", "é", "x y"] + [f"v{i}" for i in range(30)]
    rows = []
    for i in range(120):
        w = rng.choices(words, [30, 9, 5, 5, 5, 5, 3, 3, 3] + [1] * 30, k=rng.randint(1, 60))
        text = "".join(x + rng.choice([" ", " ", " ", "\t", ", ", ".\n"]) for x in w) + rng.choice(["", " New York City Hall of the"])
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"]), "x", 1))
    rows += [(200, None, "en", None, None), (201, "", "fr", "x", 1), (202, " ., !", "es", "x", 1), rows[3], rows[3]]
    return rows + [(203, "to be " * 15_000, "en", "x", 1), (204, "w" * 70_000 + " the of", "en", "x", 1), (None, "the of the", None, "x", 1)]


@pytest.mark.parametrize("budget", [collocations.BUDGET, 400])
def test_collocations_by_brute_force(spark, budget):
    rows, least, top = phrase_rows(), 6, 25
    f, n, good = plain_phrases(rows, least)
    want = []
    for lang in {k[0] for k in good}:
        scored = []
        for k, a in good.items():
            if k[0] == lang:
                cuts = [(1000 * a * n[lang] // (f[k[: i + 1]] * f[(lang, *k[i + 1 :])]), i) for i in range(1, len(k) - 1)]
                score, i = min(cuts)
                scored.append((-score, -a, " ".join(k[1:]).encode(), f[k[: i + 1]], f[(lang, *k[i + 1 :])]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            want.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, least, top, budget).collect()))
    assert got == sorted(want) and len({w[0] for w in want}) >= 3


def test_frequent_prefixes_are_all_found(spark):
    rows = phrase_rows()
    f, _, _ = plain_phrases(rows, 1)
    docs = spark.createDataFrame(rows, DOCS).select("lang", "text").repartition(4)
    total = sum(len((r[1] or "").encode()) for r in rows)
    heavy = collocations.heavy_prefixes(docs, total, 400)
    for depth in range(1, 5):
        assert sum(1 for k, v in f.items() if len(k) == depth + 1 and v >= 400) <= len(heavy[depth]) <= sum(1 for k, v in f.items() if len(k) == depth + 1 and v >= 200)
    assert len(heavy[4]) == 2


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b c", "en", "", 1)], DOCS)).count() == 0


# chat


def plain_fold(events):
    """Every conversation as a dict of turns, one event after the other."""
    state, roles = collections.defaultdict(dict), {}
    for conv, _, kind, turn, role, text in events:
        turns = state[conv]
        if role is not None:
            roles[conv, turn] = role
        if kind == "regenerate":
            for later in [t for t in turns if t > turn]:
                del turns[later]
            turns[turn] = ""
        elif kind == "delta":
            turns[turn] = turns.get(turn, "") + (text or "")
        else:
            turns[turn] = text or ""
    return {c: [(t, roles.get((c, t), ""), turns[t]) for t in sorted(turns)] for c, turns in state.items()}


TEXTS = ["Hi", "</turn>", "<", "turn x>", "\\", "<\\/turn>\n", "<turn user>", "é ", "", None, "a $1 \\1 b"]


def event_log(seed=4, n=500):
    rng = random.Random(seed)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", None]
    return [(i % 9, i, rng.choice(kinds), rng.randrange(6), rng.choice(["user", "assistant", "to%ol\n<>", None]), rng.choice(TEXTS)) for i in range(n)]


EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"


@pytest.mark.parametrize("part_chars", [1, 60, 1 << 20])
def test_event_logs(spark, part_chars):
    log = event_log()
    want = plain_fold(log)
    shuffled = random.Random(1).sample(log, len(log))
    turns = chat.fold(spark.createDataFrame(shuffled, EVENTS))
    got = collections.defaultdict(list)
    for r in turns.collect():
        got[r.conv_id].append((r.turn, r.role, r.text))
    assert {c: sorted(v) for c, v in got.items()} == want
    parts = chat.format_conversations(turns, part_chars).collect()
    for conv, said in want.items():
        mine = sorted((r for r in parts if r.conv_id == conv), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(len(mine)))
        assert [t for r in mine for t in chat.read_part(r.text)] == [(role, text) for _, role, text in said]
        heard = [chat.unescape_text(r.text[s.start : s.end]) for r in mine for s in r.loss]
        assert heard == [text for _, role, text in said if role == "assistant"]
    assert len(parts) == (9 if part_chars > 1000 else len(parts)) and (part_chars > 1 or len(parts) == sum(map(len, want.values())))


@pytest.mark.parametrize("part_chars", [40, 1 << 20])
def test_digests_read_back(spark, part_chars):
    said = plain_fold(event_log(5))
    parts = chat.format_conversations(chat.fold(spark.createDataFrame(event_log(5), EVENTS)), part_chars)
    got = {r.conv_id: r for r in chat.digest_parts(parts).collect()}
    assert set(got) == set(said)
    for c, turns in said.items():
        heard = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(heard)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(heard.encode()).hexdigest()


@given(st.text(st.sampled_from("<\\/turn >a")))
@settings(max_examples=300, deadline=None)
def test_escape_goes_back(text):
    escaped = re.sub(r"<(\\*/?turn)", r"<\\\1", text)
    assert chat.unescape_text(escaped) == text and "</turn" not in escaped and "<turn" not in escaped


def test_chat_report(spark):
    rows = [(1, 2, "assistant", "b", "x"), (1, 0, None, None, "x"), (1, 2, "assistant", "b", "x"), (1, None, "user", "first", "x"), (None, 0, "assistant", "nobody", "x"), (2, 0, "user", "é" * 300_000, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.chat_report(spark, table).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == digest("user\nfirst\n\n\nassistant\nb\nassistant\nb\n") and got[1].loss_sha256 == digest("bb")
    odd = r"\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == digest(f"user\n{odd}\nassistant\n{odd}\n") and got[-7].loss_sha256 == digest(odd)
    assert got[-7].formatted_chars == 2 * (len(odd) + 1) + len("<turn user><turn assistant>") + 2 * len("</turn>\n")
    assert got[None].loss_chars == 6 and got[2].loss_chars == 0 and set(got) == {1, 2, None, -7}
    assert [r.conv_id for r in chat.chat_report(spark, table.limit(0)).collect()] == [-7]
