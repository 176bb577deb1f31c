"""Small cases with defined results, and comparisons with plain Python over small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape
from html.entities import html5

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.llm import metric_tree, mixing, near_dedup, packing, paragraph_sketch, pii, substring_dedup, token_counts, tokens, toxicity, warc
from faultscope.llm.components import component_of
from faultscope.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BLANKS = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in BLANKS.split(text or "") if w]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(7)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, rng.randint(1, 120))) for i in range(60)]
    base = sentence(rng, 150)
    for i in range(60, 70):
        w = base.split()
        w[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(70, rows[5][1]), (71, rows[5][1]), (72, None), (73, ""), (74, " \n\t "), (75, "one two"), (76, "one two")]
    rows += [(i, f"{sentence(rng, 30)} {passage} {sentence(rng, 5)}") for i in range(77, 83)]
    rows += [(83, sentence(rng, 30_000)), (84, "x" * 50_000), (85, passage + " " + passage), (86, "é ü ñ 漢字 <|endoftext|> 'S it's"), (87, rows[0][1])]
    rows.append(rows[9])
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With extra columns whose names operators use inside."""
    extra = {"chunk": F.lit(1), "class_id": F.lit("x"), "score": F.lit(0.5), "mix_source": F.lit(2), "length": F.lit(None).cast("int")}
    return spark.createDataFrame(corpus, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_windows():
    from faultscope.llm.words import windows_of, words_of

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t  ") for _ in range(rng.randint(0, 80))) for _ in range(50)] + ["z" * 1000, "z" * 1001, ""]
    found = words_of([t.encode() for t in texts])
    plain = [w for t in texts for w in words(t)]
    assert found.counts().tolist() == [len(words(t)) for t in texts]
    assert len(set(found.digests.tolist())) == len(set(plain))
    assert len({(d, w) for d, w in zip(found.digests.tolist(), plain, strict=True)}) == len(set(plain))
    digests, at = windows_of(found, 3)
    expected = [tuple(words(t)[i:i + 3]) for t in texts for i in range(len(words(t)) - 2)]
    assert len(set(zip(digests.tolist(), expected, strict=True))) == len(set(expected)) == len(set(digests.tolist()))
    assert [tuple(plain[i:i + 3]) for i in at] == expected


def test_duplicate_spans_match_brute_force(docs, corpus):
    seen, expected = set(), []
    for i, text, *_ in sorted(corpus, key=lambda r: (r[0], r[1] or "")):
        w = words(text)
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k:k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    rows = substring_dedup.duplicate_spans(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows) == sorted(expected)
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in rows)


def test_near_duplicates_match_brute_force(docs, corpus):
    texts = [(t or "").encode() for _, t, *_ in corpus]
    owner, key, tf = near_dedup.shingles(texts)
    _, which, df = np.unique(key, return_inverse=True, return_counts=True)
    weight = tf * near_dedup.idf(df[which], len(texts))
    bags = [dict(zip(key[owner == k].tolist(), weight[owner == k].tolist(), strict=True)) for k in range(len(texts))]
    root = {i: i for i, *_ in corpus}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = sum(min(v, bags[b][k]) for k, v in bags[a].items() if k in bags[b])
            if both and both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = sorted((find(corpus[a][0]), find(corpus[b][0])))
                root[y] = x
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(corpus)
    assert {(r.doc_id, r.class_id) for r in rows} == {(i, find(i)) for i in root}


def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 1 << 48, 200, dtype=np.uint64)
    a, b = rng.uniform(1, 4, 200), rng.uniform(1, 4, 200)
    order = np.argsort(key)
    key, a, b = key[order], a[order], b[order]
    found = near_dedup.weighted_samples(np.concatenate([key, key]), np.concatenate([a, b]), np.array([0, 200]), 4000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - true) < 0.04
    nibbles = near_dedup.nibbles_of(found)
    assert nibbles.shape == (2, 250)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (5, 6), (9, 9), (7, 8), (8, 10), (10, 12), (12, 11), (11, 4)], "u bigint, v bigint")
    assert {tuple(r) for r in component_of(links).collect()} == {(2, 1), (3, 1), (6, 5), (7, 4), (8, 4), (10, 4), (11, 4), (12, 4)}
    assert component_of(links.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pre_tokens_agree_with_the_library(name):
    cut = tokens.word_pre_tokens if name.startswith("word") else tokens.byte_pre_tokens
    library, rng = tokens.tokenizer(vocabulary(name)), random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice("aBé ñß²½'s'll1٣\n\t\x1c\x85\xa0́.,!ÆİK_-ªA ") for _ in range(rng.randint(0, 30)))
        pre_tokens = cut(text)
        if pre_tokens is not None:
            assert [i for w in pre_tokens for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_beyond_latin_are_cut_as_well(name):
    cut = tokens.word_pre_tokens if name.startswith("word") else tokens.byte_pre_tokens
    library, rng = tokens.tokenizer(vocabulary(name)), random.Random(6)
    for text in ("“Quoted” — text…", "日本語のテキスト、12。", "ΟΔΟΣ Σ οδός", "İstanbul ȺȾ", "привет, мир!", "👍🏽 ok 𝔘 𝟙", "한국어 각 e\u0301", "ara: ١٢٣ مرحبا", "a\u2003\u3000 \u2028b"):
        assert cut(text), text
        assert [i for w in cut(text) for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids, text
    whole = 0
    for _ in range(3000):
        text = "".join(rng.choice(["a", "É", "J", " ", "  ", "'s", "1", "½", "٣", "“", "—", "…", "Σ", "ς", "İ", "\u0301", "\u030c", "\u0316", "\u2003", "\u3000", "日", "가", "ᄀ", "ᅡ", "ᆨ", "👍", "🏽", "\u200d", "𝔘", "𝟙", "𞤀", "\ue000", "Ⅷ", "ⓐ", "ﬁ", "Å", "\u1c89"]) for _ in range(rng.randint(0, 20)))
        pre_tokens = cut(text)
        whole += pre_tokens is None
        if pre_tokens is not None:
            assert [i for w in pre_tokens for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids, text
    assert whole < 1500


def test_token_counts(docs, corpus, nothing):
    path = vocabulary("word_bpe_49k.json")
    library = tokens.tokenizer(path)
    rows = token_counts.token_counts(docs, path, limit=100, sample_docs=20, table_size=50).collect()
    expected = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t, *_ in corpus)
    assert sorted(tuple(r) for r in rows) == expected
    assert token_counts.token_counts(nothing, path).collect() == []


def test_frequent_pre_tokens_are_of_all_documents(spark, monkeypatch):
    # A sample of 2000 of these by hash of the id holds none of the documents with "late".
    text = F.when(F.expr("pmod(xxhash64(id), 1 << 20) < 419430"), "early early").otherwise("late late late")
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", text, F.concat(F.lit("word"), "id")).alias("text"))
    monkeypatch.setattr(token_counts, "MOST_COUNTED", 100)
    tables = []
    find = token_counts.frequent_pre_tokens
    monkeypatch.setattr(token_counts, "frequent_pre_tokens", lambda *a: tables.append(find(*a)) or tables[-1])
    token_counts.token_counts(docs, vocabulary("word_bpe_49k.json"), table_size=3)
    assert tables[0][0] == "late" and tables[0][1] == "word"


def test_packing_covers_every_token_once(docs, corpus, nothing):
    path = vocabulary("byte_bpe_50k.json")
    library = tokens.tokenizer(path)
    rows = packing.packed(docs, path, size=256, with_ids=True).collect()
    ids = {}
    for i, t, *_ in corpus:
        ids[i] = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
    used, covered = defaultdict(list), Counter()
    for r in rows:
        part = ids[r.doc_id][4 * r.start:4 * (r.start + r.length)]
        assert bytes(r.ids) == part and zlib.crc32(part) == r.ids_crc32 and r.doc_tokens * 4 == len(ids[r.doc_id])
        used[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
    assert all(covered[i] == len(ids[i]) // 4 * n for i, n in Counter(i for i, *_ in corpus).items())
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.packed(nothing, path).collect() == []


def test_packing_patterns_use_the_histogram():
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 500) for n in range(1, 256)}
    used = packing.patterns(histogram, 256)
    assert Counter({n: c for n, c in histogram.items()}) == sum((Counter({n: k * pattern.count(n) for n in set(pattern)}) for pattern, k in used), Counter())
    assert max(sum(p) for p, _ in used) <= 256
    assert sum(n * c for n, c in histogram.items()) / (256 * sum(c for _, c in used)) > 0.97
    assert packing.patterns({10: 1000}, 256) and packing.patterns({}, 256) == []


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(float).tolist(), "x") for i in range(900)]
    rows += [(1000 + i, rows[3][1], "copy") for i in range(300)]
    rows += [(2000, None, "null"), (2050, [1.0, None, *[0.0] * 6], "hole"), (2100, [float("nan")] * 8, "nan"), (2150, [float("inf")] * 8, "inf"), (None, rows[0][1], "no id"), (2200, [0.0] * 8, "zero")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    found = metric_tree.top_k(df, F.col("vec_id") % 50 == 0, k=5, block_rows=400, query_rows=10).collect()
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, _ in rows if i is not None and i not in (2000, 2050, 2100, 2150)]
    expected = set()
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in found} == expected
    assert metric_tree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_tree_search_skips_pages():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16)) * 400
    vectors = np.floor(np.repeat(centers, 200, axis=0) + rng.normal(size=(8000, 16)) * 5).astype(np.int64)
    tree = metric_tree.Tree(np.arange(8000), vectors)
    tree.search(0, vectors[0], 5)
    assert tree.pages < 40


def test_edited_fingerprints(docs, corpus, nothing):
    rows = sorted(paragraph_sketch.edited_fingerprints(docs).collect(), key=lambda r: r.doc_id)
    order = sorted((i, t or "") for i, t, *_ in corpus)

    def bag(text):
        return set(paragraph_sketch.paragraphs_of([text.encode()]).key.tolist())

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    expected = []
    for k, (i, t) in enumerate(order):
        following, tail = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[:len(t) - tail] + following[:tail]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(bag(t), bag(edited)), alike(bag(t), bag(following))))
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    assert got == sorted((a, b, c, round(d, 9), round(e, 9)) for a, b, c, d, e in expected)
    by_text = defaultdict(set)
    texts = dict(order)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert paragraph_sketch.edited_fingerprints(nothing).collect() == []


def test_versions_differ_by_recovered_paragraphs(spark):
    old = "\n".join(f"line {i} of the text" for i in range(300))
    new = old.replace("line 7 of", "line seven of") + "\nlast"
    rows = spark.createDataFrame([(1, old, new), (2, old, old), (3, None, ""), (None, None, new)], "doc_id bigint, text string, other_text string")
    found = {r.doc_id: r for r in paragraph_sketch.compare_versions(rows).collect()}
    a, b = (set(paragraph_sketch.paragraphs_of([t.encode()]).key.view(np.int64).tolist()) for t in (old, new))
    assert set(found[1].only_here) == a - b and set(found[1].only_other) == b - a
    assert found[2].likeness == 1.0 and found[3].likeness == 1.0 and found[None].likeness == 0.0


def test_mixing_meets_marginals(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randint(1, 40)) + (" @" if i % 7 == 0 else ""), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), 0) for i in range(3000)]
    rows += [(None, None, None, None, None), (5000, "", "xx", "new", 0), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("mix_topic", F.lit(1))
    found = mixing.sampled(docs, temperature=0.7, sweeps=12)
    assert found.count() == len(rows) and found.where("probability > 1.000001 OR probability < 0").count() == 0
    assert found.where("doc_id = 5000").first().probability == 1.0
    expected_tokens = found.withColumn("e", F.col("probability") * F.col("n_tokens"))
    total = expected_tokens.agg(F.sum("e")).first()[0]
    for margin in mixing.MARGINS:
        own = {r[0]: r[1] for r in found.groupBy(margin).agg(F.sum("n_tokens")).collect() if r[1]}
        power = {k: v ** 0.7 for k, v in own.items()}
        for r in expected_tokens.where("n_tokens > 0").groupBy(margin).agg(F.sum("e")).collect():
            assert r[1] / total == pytest.approx(power[r[0]] / sum(power.values()), rel=1e-4)
    kept = mixing.mixed(docs, temperature=0.7, sweeps=12)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count()
    assert mixing.sampled(docs.limit(0)).collect() == []


def test_toxicity_trains_alike_on_spark_and_in_one_process(spark):
    rng = random.Random(5)
    filler = [[f"w{rng.randrange(10**6)}" for _ in range(12)] for _ in range(150)]
    rows = [(i, " ".join(w) + (' said "snorkwort"' if i % 3 == 0 else " plain"), int(i % 3 == 0)) for i, w in enumerate(filler, 200)]
    rows += [(100, None, 0), (101, "", 0), (102, "plain words 4", 1), (103, "SNORKWORT said number", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    used = [(t or "", x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5 and x is not None]
    expected, found = toxicity.fit(used), toxicity.train(docs, marks)
    assert expected["terms"] and found.pop("terms") == [list(t) for t in expected.pop("terms")]
    assert found == expected


def test_toxicity_learns_words_stems_and_misspellings(spark):
    rng = random.Random(11)
    bad, rows, labels = ["ghastlyword", "vilestterm"], [], []
    for i in range(1500):
        toxic = i % 6 == 0
        text = sentence(rng, rng.randint(5, 60))
        if toxic:
            text += f" {rng.choice(bad) if i % 12 else 'stemm' + sentence(rng, 1)} {sentence(rng, 3)}"
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(toxic)))
    rows += [(9000, "you ghastlywrod here", "en", "s", 0), (9001, "a GHASTLYWORD", "en", "s", 0), (9002, None, None, None, None), (9003, "", "en", "s", 0), (None, "plain abc", "en", "s", 0)]
    rows += [(9004, "they said ghastlyword once", "en", "s", 0), (9005, "ghastlyxord", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("predicted", F.lit(9))
    marks = spark.createDataFrame([*labels, (1, None), (3, 5), (None, 1), (0, 1)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(found) == len(rows)
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(found[i].predicted == y for i, y in held) / len(held) > 0.97
    assert found[9001].predicted == found[9005].predicted == 1 and found[9002].predicted == found[9003].predicted == found[None].predicted == 0
    assert found[9004].score < found[9001].score
    none = toxicity.toxicity(docs, marks.limit(0)).collect()
    assert {r.predicted for r in none} == {0}


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(8)
    terms = [("abcde", False), ("bcdea", False), ("abcabcabcabc", False), ("dcba", False)]
    machine = toxicity.Automaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(3, 13)))
        near = [(distance(word, t), i) for i, (t, s) in enumerate(terms) if distance(word, t) <= toxicity.allowed_errors(t, s)]
        found = machine.nearest(word)
        assert (found and found[1]) == (min(near)[0] if near else None)


def plain_spans(text):
    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_spans_match_the_patterns():
    rng = random.Random(6)
    for alphabet in ("a@.1 +-(8)2", "0123456789 -", "a.@b-", "25.+1 9"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 50_000) == [] and pii.base_spans("a" * 50_000 + "@") == []


def test_similar_mentions_take_the_label(spark):
    text = "mail jan.doe7@mail.example.com or +1 (988) 555-2485 again (988) 555-2485, JAN.DOE7 but 123-4567-8901 and 4111111111111112"
    rows = [(1, text), (2, "call (988) 555-2485"), (3, None), (4, ""), (None, "x@y.zz"), (1, text), (5, "5.5.5.5 999.1.1.1 " * 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(0))
    found = pii.personal_data(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    base, every = ([(r.text[s.start:s.stop], s.kind) for s in spans] for r in [by_id[1]] for spans in (r.base, r.spans))
    assert base == [("jan.doe7@mail.example.com", "email"), ("+1 (988) 555-2485", "phone")]
    assert every == [*base, ("(988) 555-2485", "phone"), ("JAN.DOE7", "email")]
    assert by_id[2].spans == by_id[3].spans == by_id[4].spans == [] and len(by_id[5].base) == 400 == len(by_id[5].spans)
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[1] == "mail [EMAIL] or [PHONE] again [PHONE], [EMAIL] but 123-4567-8901 and 4111111111111112"
    assert clean[3] is None and clean[None] == "[EMAIL]" and pii.redacted(docs).columns == docs.columns
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_derived_records(spark):
    html = '<html lang="de"><head><title>A &amp; B</title><script>x<1</script></head><body><p>One<b>two</b></p><!-- <p>no</p> --><a href="/u">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://x.example/", html), (2, None, None), (3, "u", ""), (1, "http://x.example/", html), (None, "u", "1 < 2 <b")], "page_id bigint, url string, html string")
    source = warc.responses(pages.withColumn("block", F.lit(1)))
    records = warc.derivatives(source).collect()
    assert len(records) == 10
    of = {(r.page_id, r.record_type): r for r in records}
    one, about = of[1, "conversion"], of[1, "metadata"]
    assert one.block == "A & B\nOnetwo\nlink" and one.content_length == len(one.block.encode())
    assert about.block == f"title: A & B\r\nlanguage: de\r\npayload-length: {len(html)}\r\noutlink: /u\r\n"
    assert one.refers_to == about.refers_to == source.where("page_id = 1").first().record_id and one.record_id != about.record_id
    assert one.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert one.block_digest == "sha256:" + hashlib.sha256(one.block.encode()).hexdigest()
    assert of[2, "conversion"].block == "" and of[None, "conversion"].block == "1 < 2"
    text = warc.serialized(warc.derivatives(source)).first().record
    assert text.startswith("WARC/1.1\r\nWARC-Type: ") and text.endswith("\r\n\r\n")


def test_source_headers_are_kept(spark):
    fields = {"WARC-IP-Address": "10.0.0.1", "HTTP-Status": "200", "content-type": "text/html", "WARC-Date": "x", "Odd": "a\r\nb", "None": None}
    rows = [(1, "u", "<p>a</p>", "2024-05-01T10:00:00Z", fields), (2, "v", "b", None, None), (3, "w", "c", "2024-05-02T10:00:00Z", {"None": None})]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at string, fields map<string,string>")
    plain, full = warc.derivatives(warc.responses(pages)), warc.derivatives(warc.responses(pages, date="at", headers="fields"))
    assert full.columns == [*plain.columns, "warc_date", "source_headers"]
    assert sorted(map(tuple, full.drop("warc_date", "source_headers").collect())) == sorted(map(tuple, plain.collect()))
    heads = {}
    for kind in ("metadata", "conversion"):
        for i in (1, 2, 3):
            text = warc.serialized(full.where((F.col("page_id") == i) & (F.col("record_type") == kind))).first().record
            heads[i, kind] = text.split("\r\n\r\n")[0].split("\r\n")[9:]
        assert heads[1, kind] == ["WARC-Date: 2024-05-01T10:00:00Z", "HTTP-Status: 200", "Odd: a b", "WARC-Source-Date: x", "WARC-IP-Address: 10.0.0.1", "WARC-Source-content-type: text/html"]
        assert heads[2, kind] == [] and heads[3, kind] == ["WARC-Date: 2024-05-02T10:00:00Z"]
    stamped = warc.responses(pages.withColumn("at", F.timestamp_seconds(F.lit(1714557600))), date="at")
    assert stamped.first().warc_date == "2024-05-01T10:00:00Z"


MALFORMED = {
    "<a href='/one'>1</a><A class=x HREF=/two>2</a><a title=\"href='/no'\" href = \"/three?a=1&amp;b\">3</a><a name=x>4</a><abbr href=/no>": ("123 4".replace(" ", ""), ["/one", "/two", "/three?a=1&amp;b"]),
    'a<script>var x=1; if (a<b) {': ("a", []),
    'a<style>p > q {}</style >b<script src="x>y">z</script>c': ("abc", []),
    'x<img alt="a > b">text': ("xtext", []),
    'x<img alt="a > b text <a href=/no>': ("x", []),
    'a<!-- <a href="/no"> -->b<a href="/yes">c<!-- never closed <p>d': ("abc", ["/yes"]),
    "<!DOCTYPE html>a<?xml?>b</ odd>c</p >d<p\nclass='>'>e": ("abc\nd\ne", []),
    "1 < 2 > 0 <3 <b": ("1 < 2 > 0 <3", []),
    "<scripted>a</scripted><html lang=de-AT><title>T &lt;x</title lang>U": ("a\nT <x\nU", []),
    "<a href>x</a><a href=''>y</a><a href='/a\nb'>z": ("xyz", ["", "/a b"]),
}


def test_malformed_pages(spark, tmp_path):
    import duckdb

    from faultscope.llm.expected import EXPECTED

    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate([*MALFORMED, None, ""])], "page_id bigint, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    got = {(r.page_id, r.record_type): r.block for r in records.collect()}
    for i, (text, links) in enumerate(MALFORMED.values()):
        assert got[i, "conversion"] == text
        assert [x[9:] for x in got[i, "metadata"].split("\r\n") if x.startswith("outlink: ")] == links
    assert "language: de-AT" in got[8, "metadata"] and got[8, "metadata"].startswith("title: T <x")
    pages.write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    told = con.execute(EXPECTED["op9_warc_derivatives"])
    assert sorted(told.fetchall()) == sorted(map(tuple, records.select(*[c[0] for c in told.description]).collect()))


def test_hostile_pages_take_linear_time(spark):
    import time

    starts = ["<!--", "<script>", "<a ", '<a x="', "<a x='y' ", "</p ", "<style ", "</script", "&amp", "<title>", "<p a=", "<", "<a href="]
    spark.createDataFrame([(0, "u", "<a href=x>")], "page_id bigint, url string, html string").transform(warc.responses).transform(warc.derivatives).collect()
    pages = spark.createDataFrame([(i, "u", s * (1_000_000 // len(s))) for i, s in enumerate(starts)], "page_id bigint, url string, html string").repartition(len(starts))
    begun = time.time()
    assert warc.derivatives(warc.responses(pages)).agg(F.sum("content_length")).first()[0] > 0
    assert time.time() - begun < 60


def test_pieces_and_patterns_agree(spark, monkeypatch):
    """Pages cut at their tags give what patterns find in whole ones; what stands around < and > otherwise is not cut."""
    rng = random.Random(9)
    tags = ["<p>", "</P >", "<br/>", "<hr\t>", "<bloc\u212aquote>", "<H7>", "<b>", "</i>", "<a href='/q'>", "<A HREF=/u>", "<a/href=q>", "<a =x href=1>", '<a href = "/x y">', "<a x=y\">", "<html\nlang=de>", "<header>", "<p=x>", "</ odd>", "<?x?>", "<title>", "</title>"]
    texts = ["a", "b c", "  ", "\n", "\t", "\x0b", "\r\n", "&amp;", "&lt;", "&nbsp;", "&copy;", "&#10;", "&eacute;", "&amp", "&am", "&", "é", "\U0001f600", '"', "="]
    odd = ["<", ">", " > ", "<a title='>", '<img alt="a > b">', '<img alt="<a href=/no>">', "<td"]
    pages = ["".join(rng.choice(tags if rng.random() < 0.5 else texts) for _ in range(rng.randint(0, 15))) for _ in range(1500)]
    pages += [p + rng.choice(odd) + rng.choice(pages) for p in pages[:300]] + [rng.choice(tags) * 100_000]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, v string").repartition(4)
    v, cut = F.col("v"), warc.turns(F.col("v"))
    none = F.lit(None).cast("array<string>")
    got = df.select("page_id", v, cut.alias("cut"), warc.plain_text(v, cut).alias("text"), warc.linking_tags(v, cut).alias("tags")).collect()
    monkeypatch.setattr(warc, "LONG", -1)
    whole = {r.page_id: r for r in df.select("page_id", warc.turns(v).alias("cut"), warc.plain_text(v).alias("text"), warc.linking_tags(v, none).alias("tags")).collect()}
    for r in got:
        told = whole[r.page_id]
        assert (r.text, r.tags) == (told.text, told.tags) and told.cut is None
        if r.cut is not None:
            assert r.v == "".join(x if i % 2 == 0 else f"<{x}>" for i, x in enumerate(r.cut))
    assert sum(r.cut is not None for r in got if r.page_id < 1500) > 1400 and all(r.cut is None for r in got if r.page_id >= 1500)


def test_pages_take_the_time_of_few_passes(spark):
    """Nearly all of the time went into ten patterns that each passed the whole page."""
    import time

    words = " ".join(f"wört{i % 7} of" for i in range(60))
    part = f'<div class="ad"><p><b>{words}</b> &amp; {words}<br>{words}</p><a href="/x">{words}</a></div>'
    page = F.concat(F.lit("<!DOCTYPE html><html lang=de><head><title>T</title><style>p{}</style></head><body><!-- ad -->"), F.repeat(F.lit(part), 4), F.lit("&middot; &copy;"))
    pages = spark.range(0, 6000, 1, 4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(page, F.col("id").cast("string")).alias("html")).cache()

    def least(df):
        spent = []
        for _ in range(4):
            begun = time.time()
            df.write.format("noop").mode("overwrite").save()
            spent.append(time.time() - begun)
        return min(spent)

    assert pages.count() == 6000
    passes = F.col("html")
    for i in range(4):
        passes = F.regexp_replace(passes, f"[\x01-{chr(i + 2)}]", "")
    one = least(pages.select(passes)) / 4
    assert least(warc.derivatives(warc.responses(pages))) < 8 * one
    pages.unpersist()


def test_references_are_decoded(spark, column):
    bodies = {
        "<title>Caf&eacute; &#233; &middot;</title><p>&copy; A &hellip;</p>": ("Café é ·", "Café é ·\n© A …"),
        "&amp;copy; &amp;#233; &#38;lt; &#x26;amp;": ("", "&copy; &#233; &lt; &amp;"),
        "&copy &notit; &notin; &NotEqualTilde; &nosuch; &AT&T AT&T & &; &#; &#x; &": ("", "© ¬it; ∉ ≂̸ &nosuch; &AT&T AT&T & &; &#; &#x; &"),
        "a&nbsp;&#160;&#xA0;&nbsp b": ("", "a b"),
        "&#x1F600;&#128;&#0;&#xD800;&#99999999999999999999;&#x110000;&#1;.": ("", "😀€\ufffd\ufffd\ufffd\ufffd."),
    }
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(bodies)], "page_id bigint, url string, html string")
    got = {(r.page_id, r.record_type): r.block for r in warc.derivatives(warc.responses(pages)).collect()}
    for i, (title, text) in enumerate(bodies.values()):
        assert got[i, "conversion"] == text
        assert got[i, "metadata"].startswith(f"title: {title}\r\n")


def test_references_agree_with_the_library(column):
    rng = random.Random(3)
    parts = ["&", "&amp", ";", "#", "#x", "lt", "copy", "eacute;", "notin;", "233;", "e9;", "0128", "A", " ", "é", "&quot;", "&middot;", "&#39;", "&#", "&#x"]
    texts = [f"&{k}" for k in html5] + [f"&#{n};" for n in range(0x200)] + [f"&#{n:x};" for n in range(0x200)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    assert column(warc.decoded, [*texts, None]) == [*(unescape(t).replace("\xa0", " ") for t in texts), None]


def test_empty_tables(nothing):
    assert substring_dedup.duplicate_spans(nothing).collect() == []
    assert near_dedup.near_duplicates(nothing).collect() == []
    assert warc.derivatives(warc.responses(nothing.select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.lit("").alias("html")))).collect() == []


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect()), key=str) == [(1, 1), (2, 1), (None, None), (None, None)]
    assert substring_dedup.duplicate_spans(docs, width=3).agg(F.sum("n_removed")).first()[0] == 18
    assert paragraph_sketch.edited_fingerprints(docs).count() == 4


def test_sampling_holds_little_beside_its_result():
    """Shingles and samples of a chunk are made in lots: what a worker takes for them does not grow with the chunk."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [b" ".join(b"%d" % w for w in rng.integers(0, 100_000, 1000)) for _ in range(600)]
    tracemalloc.start()
    owner, key, count = near_dedup.shingles(texts)
    shingling = tracemalloc.get_traced_memory()[1]
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    samples = near_dedup.weighted_samples(key, count * 1.5, starts, 8)
    sampling = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert shingling < 3 * (owner.nbytes + key.nbytes + count.nbytes)
    assert sampling < 20 << 20 and len(key) * 8 * 4 > 16 << 20
    alone = near_dedup.weighted_samples(key[starts[7]:starts[8]], count[starts[7]:starts[8]] * 1.5, np.zeros(1, np.int64), 8)
    assert (samples[7] == alone[0]).all()


def test_placing_pieces_needs_no_rows_from_python_workers(spark):
    """Counts and places reach the executors as Arrow data, not as pickled rows that a second set of Python workers reads."""
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(8)], "doc_id long, text string")
    plan = packing.packed(docs, vocabulary("byte_bpe_50k.json"))._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan
