"""Spelling variants, language identification and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.llm import language_id, periodic_runs, queries, spelling
from faultscope.llm.words import mix

DOCS = "doc_id bigint, text string, lang string, word string, n string, runs string"


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def described(counts, ratio):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    rows = {}
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, n_near, form_n)
    return rows


def test_acceptor_is_minimal_and_pairs_have_one_path():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(150)})
    acceptor = spelling.Acceptor(words)
    assert len({(tuple(sorted(a.items())), n & 1) for a, n in zip(acceptor.arcs, acceptor.lengths, strict=True)}) == len(acceptor.arcs)
    found = [frozenset(p) for m in range(8) for p in spelling.one_edit_pairs(acceptor, m, m + 1)]
    assert len(found) == len(set(found))
    assert set(found) == {frozenset((a, b)) for a in words for b in words if near(a, b)}
    assert [spelling.Acceptor([]).arcs, spelling.Acceptor([""]).lengths] == [[{}], [1]]


@pytest.mark.parametrize("most_words", [2, 7, 20_000])
def test_variants_match_brute_force(spark, most_words):
    rng = random.Random(most_words)
    counts = Counter()
    for _ in range(60):
        base = "".join(rng.choice("abcß") for _ in range(rng.randint(6, 9)))
        counts[base] += rng.choice([5, 30, 200])
        for _ in range(4):
            i = rng.randrange(len(base))
            base = rng.choice([base[:i] + base[i + 1:], base[:i] + rng.choice("ab") + base[i:], base[:i] + rng.choice("ab") + base[i + 1:]])
            counts[base] += rng.choice([1, 5, 6, 30])
    counts |= {"z" * 3000: 5, "z" * 2999: 50, "z" * 3001: 1}
    rows = [(w, n, "x") for w, n in counts.items()] + [("aaaaaaa", 3, "x"), (None, 5, "x"), ("nothing", None, "x"), ("zero", 0, "x")]
    counts["aaaaaaa"] += 3
    table = spark.createDataFrame(rows, "word string, n bigint, near string")
    found = spelling.spelling_variants(table, 5, most_words).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == described(counts, 5)
    assert len(found) == len(counts) and any(r.root != r.form for r in found if r.form)


def test_word_counts(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abÉé÷Z") for _ in range(rng.randint(4, 8))) for _ in range(rng.randint(0, 400))) + rng.choice(["", "...", "7x"]) for _ in range(30)]
    rows = [(i, t, None, "w", "n", "r") for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None), (90, None, None, None, None, None), (91, "", None, None, None, None), (3, texts[3], None, None, None, None)]
    expected = Counter()
    for i, t, *_ in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 7 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            expected[word] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 2}
    docs = spark.createDataFrame(rows, DOCS)
    found = spelling.count_words(docs, least_count=2, misspelt=7).collect()
    assert {r.word: r.n for r in found} == expected and len(found) == len(expected) > 50
    empty = spelling.spelling_variants(spelling.count_words(docs.limit(0)))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def brute_runs(words, least=12):
    code = {}
    x = np.array([code.setdefault(w, len(code)) for w in words])
    found = {}
    for q in range(1, len(x) // 2 + 1):
        same = np.diff(np.concatenate(([0], (x[q:] == x[:-q]).astype(int), [0])))
        for a, b in zip(np.flatnonzero(same == 1), np.flatnonzero(same == -1), strict=True):
            if b + q - a >= max(least, 2 * q):
                found.setdefault((int(a), int(b + q)), q)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, depth):
    """Words with runs inside runs."""
    if not depth:
        return [rng.choice("abc") for _ in range(rng.randint(1, 9))]
    part = repetitive(rng, depth - 1)
    kind = rng.random()
    if kind < 0.5:
        return (part * rng.randint(2, 6) + part[:rng.randint(0, len(part))])[:1500]
    at = rng.randrange(len(part) + 1)
    return (part + repetitive(rng, depth - 1) if kind < 0.75 else part + part[:at] + [rng.choice("abcd")] + part)[:1500]


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng, rng.randint(2, 7)) for _ in range(25)]
    for _ in range(6):  # periods that begin with a long run of a short period: no minimizer is left there
        short = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
        period = short * rng.randint(10, 60) + short[:rng.randint(0, len(short))]
        texts.append(period[rng.randint(0, len(period)):] + period * rng.randint(1, 3) + ["c"])
    values, starts, ends = [], [], []
    for i, t in enumerate(texts):
        starts.append(len(values))
        values += [ord(c) for c in t]
        ends.append(len(values))
        values.append(1000 + i)
    found = periodic_runs.find_runs(mix(np.array(values, dtype=np.uint64)), np.array(starts), np.array(ends)).tolist()
    expected = [(a + s, a + s + n, q) for t, s in zip(texts, starts, strict=True) for a, n, q in brute_runs(t)]
    assert [tuple(r) for r in found] == expected and max(q for *_, q in expected) > 96


def test_runs_of_sequences_that_prefix_digests_cannot_tell_apart():
    text = "a"
    while len(text) < 4096:
        text += text.translate(str.maketrans("ab", "ba"))
    text = "c" * 40 + text + text[:100]
    values = mix(np.array([ord(c) for c in text] + [0], dtype=np.uint64))
    found = periodic_runs.find_runs(values, np.array([0]), np.array([len(text)])).tolist()
    assert [(a, b - a, q) for a, b, q in found] == brute_runs(text)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(repetitive(rng, rng.randint(0, 6))) for _ in range(120)]
    texts += ["\t".join(["x"] * 50_000), " ".join(f"w{i}" for i in range(3000)), None, "", " \n", "é é\x0cé\né é é é é é é é é ", "one"]
    rows = [(i, t, "en", "w", "n", "r") for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None), (1, texts[1], None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    expected = []
    for i, t, *_ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = brute_runs(w) if len(w) < 10_000 else [(0, len(w), 1)]
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        a, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digests = ["".join(f"{a},{n},{q}\n" for a, n, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone)]
        expected.append((i, len(runs), a, n, q, n and 1000 * n // q, *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


SYLLABLES = {"aa": ["ing", "the", "er", "ou"], "bb": ["sch", "ein", "ü", "ver"], "cc": ["ción", "los", "ñ", "que"]}


def sentence(rng, language):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, k), k, "w", "n", "r") for i in range(600) for k in [rng.choice(["aa"] * 8 + ["bb", "cc"])]]
    rows += [(700, None, "aa", "", "", ""), (701, "", "aa", "", "", ""), (702, "12 _ ½ 7!", "bb", "", "", ""), (703, "ing", None, "", "", ""), (None, "sch ver", "aa", "", "", ""), (704, "the " * 400_000, None, "", "", ""), rows[5]]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("s")).cache()


def test_language_of_held_out_documents(spoken):
    rows = language_id.language_id(spoken).collect()
    known = {r.doc_id: r.lang for r in spoken.collect()}
    assert len(rows) == spoken.count()
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(judged) > 80 and np.mean([r.lang_pred == known[r.doc_id] for r in judged]) > 0.98
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by[700] == by[701] == by[702] == ("und", 0.0) and by[None][0] == "bb" and by[704][0] == "aa"
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 5}) == 1


def test_held_out_and_null_languages_teach_nothing(spark, spoken):
    changed = spoken.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = language_id.train(spoken), language_id.train(changed.repartition(3))
    assert a.languages == b.languages == ["aa", "bb", "cc"]
    assert np.array_equal(a.weights, b.weights) and a.temperature == b.temperature
    none = language_id.language_id(spoken.withColumn("lang", F.lit(None).cast("string")))
    assert none.select("lang_pred", "score").distinct().collect() == [("und", 0.0)]
    assert language_id.language_id(spoken.limit(0)).count() == 0
    one = language_id.language_id(spoken.withColumn("lang", F.lit("xx"))).where("lang_pred <> 'und'")
    assert one.select("lang_pred").distinct().collect() == [("xx",)]


def test_features_and_leader():
    counts = language_id.term_counts(language_id.letters_of("Ab, 1 aB"), 1 << 15)
    assert counts.sum() == 7 + 6 + 5 and counts.max() == 3  # " ab ab ": blank three times
    assert language_id.sparse("7 +") is None
    long = "ab cd " * 300_000
    steps = language_id.term_counts(language_id.letters_of(long))
    assert steps.sum() == 3 * (len(long) + 1) - 3
    leader = language_id.Leader(4, 2, l1=0.5)
    for _ in range(300):
        leader.learn(np.array([0, 2]), np.array([1.0, 0.01]), 0)
        leader.learn(np.array([1, 2]), np.array([1.0, 0.01]), 1)
    w = leader.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and not w[2].any() and not w[3].any()


def test_temperature_makes_confidence_match_accuracy():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 4000)
    right = rng.random(4000) < 0.8
    scores = np.zeros((4000, 2))
    scores[np.arange(4000), np.where(right, labels, 1 - labels)] = 9.0
    p = language_id.softmax(scores / language_id.temperature(scores, labels)).max(axis=1).mean()
    assert abs(p - right.mean()) < 0.01
