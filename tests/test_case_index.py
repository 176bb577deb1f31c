"""A kept index of cases: growth, search in place, bounds, fills."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultscope.operators import case_index, tfidf
from faultscope.operators.similarity import similar_cases


def words(text):
    return [w for w in (text or "").split() if len(w) >= 2]


def grams(text):
    w = words(text)
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def brute(history, queries, k):
    """All rows of the k most similar cases, from whole vectors."""
    df = Counter(t for _, text in history for t in grams(text))
    idf = {t: math.log((1 + len(history)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(text):
        v = {t: n * idf[t] for t, n in grams(text).items() if t in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()} if length else {}

    vectors, out = [(i, unit(t)) for i, t in history], []
    for q, text in queries:
        asked = unit(text)
        if asked:
            sims = sorted((-round(sum(x * v.get(t, 0) for t, x in asked.items()), 9) + 0.0, i) for i, v in vectors)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sims[:k])]
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(120)]

    def text():
        return " ".join(vocabulary[min(int(rng.expovariate(0.05)), 119)] for _ in range(rng.randint(3, 40)))

    history = [(i, text()) for i in range(400)]
    history += [(400, None), (401, ""), (402, history[7][1]), (403, history[7][1]), (404, "x y 7"), (405, "solitary word")]
    queries = [(f"q{i}", text()) for i in range(40)] + [("same", history[7][1]), ("none", "zz qq"), ("null", None), ("few", "solitary")]
    return history, queries


def found(rows):
    return sorted((r[0], r[1], r[2], round(r[3], 8)) for r in rows)


def frames(spark, history, queries):
    return spark.createDataFrame(history, "doc_id bigint, text string"), spark.createDataFrame(queries, "item_id string, text string")


def expected(history, queries, k):
    return sorted((q, n, i, round(s, 8)) for q, n, i, s in brute(history, queries, k))


@pytest.mark.parametrize("k, most_entries", [(10, 4_000_000), (3, 200)])
def test_search_matches_brute_force(spark, tables, tmp_path, k, most_entries):
    docs, asked = frames(spark, *tables)
    index = case_index.build_index(docs, str(tmp_path / "index"))
    result = case_index.search(index, asked, k=k, most_entries=most_entries)
    assert found(result.cases.collect()) == expected(*tables, k)
    assert result.cases.where("item_id = 'few' AND rank > 1 AND similarity > 0").isEmpty()
    report = result.report.first()
    assert 0 <= report.n_skipped < report.n_pairs


def test_skipping_loses_nothing(spark, tables, tmp_path, monkeypatch):
    """Cases that share little with the queries are passed over once k better ones are known."""
    history, queries = tables
    asked = [(f"copy{i}", history[i][1]) for i in range(16)]
    many = [(i, t) for i, t in history if t] + [(1000 + i * 16 + j, f"{history[i][1]} extra") for i in range(16) for j in range(3)]
    docs, q = frames(spark, many, asked)
    index = case_index.build_index(docs.orderBy(F.desc("doc_id")).coalesce(1), str(tmp_path / "index"), buckets=1)
    monkeypatch.setattr(case_index, "HELD_SUMS", 1 << 10)
    result = case_index.search(index, q, k=2)
    assert found(result.cases.collect()) == expected(many, asked, 2)


def test_growth_equals_a_rebuild_and_reads_no_text(spark, tables, tmp_path):
    history, queries = tables
    path = str(tmp_path / "index")
    docs, asked = frames(spark, *tables)
    index = case_index.build_index(docs.where("doc_id < 150"), path)
    index = case_index.append_cases(spark, index, docs.where("doc_id BETWEEN 150 AND 399"))
    assert found(case_index.search(index, asked).cases.collect()) == expected(history[:400], queries, 10)
    index = case_index.append_cases(spark, index, docs.where("doc_id >= 400"))
    case_index.drop_tables(spark, index)  # as in another session
    kept = case_index.load_index(spark, path)
    assert kept == index and kept.version == 3 and kept.n_cases == len(history)
    assert found(case_index.search(kept, asked).cases.collect()) == expected(history, queries, 10)
    side = case_index.history_side(spark, kept)
    plan = side._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "text" not in side.columns
    one = case_index.compact(spark, kept)
    assert len(one.segments) == 1 and len(case_index.load_index(spark, path).segments) == 1
    assert found(case_index.search(one, asked).cases.collect()) == expected(history, queries, 10)
    rebuilt = case_index.build_index(docs, str(tmp_path / "again"))
    lengths = [{r.doc_id: r.norm for r in case_index.history_side(spark, i).collect()} for i in (one, rebuilt)]
    assert lengths[0].keys() == lengths[1].keys() and all(abs(lengths[0][i] - n) < 1e-9 for i, n in lengths[1].items())


def test_fixed_vocabulary(spark, tables, tmp_path):
    docs, asked = frames(spark, *tables)
    trained = docs.where("doc_id < 200")
    postings = tfidf.count_terms(tfidf.add_grams(trained, "text"), "doc_id")
    vocabulary = tfidf.fit_vocabulary(postings, 200, max_features=150)
    plain = similar_cases(docs, asked, vocabulary, k=5)
    index = case_index.build_index(docs.where("doc_id < 300"), str(tmp_path / "index"), vocabulary=vocabulary)
    index = case_index.append_cases(spark, index, docs.where("doc_id >= 300"))
    assert found(case_index.search(index, asked, k=5).cases.collect()) == found(plain.collect())
    idf = {r.term: r.idf for r in vocabulary.collect()}
    norm = {r.doc_id: r.norm for r in case_index.history_side(spark, index).collect()}
    for i, text in tables[0]:
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in grams(text).items() if t in idf))
        assert abs(norm.get(i, 0.0) - length) < 1e-9


def test_text_ids_ties_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(x, "red pump") for x in ("b", "a", "é", "z")] + [("c", "blue")], "name string, text string")
    asked = spark.createDataFrame([(1, "red pump"), (2, "pump pump blue")], "id int, text string")
    index = case_index.build_index(docs, str(tmp_path / "one"), "name")
    rows = case_index.search(index, asked, "id", k=4).cases.collect()
    assert [r.name for r in sorted(rows, key=lambda r: r.rank) if r.id == 1] == ["a", "b", "z", "é"]
    assert case_index.search(index, asked.limit(0), "id").cases.collect() == []
    nothing = case_index.build_index(docs.limit(0), str(tmp_path / "two"), "name")
    assert case_index.search(nothing, asked, "id").cases.collect() == []
    grown = case_index.append_cases(spark, nothing, docs)
    assert found(case_index.search(grown, asked, "id", k=4).cases.collect()) == found(rows)
