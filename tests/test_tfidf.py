import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultscope.operators import similarity as sim
from faultscope.operators import tfidf as tf

DOCS = [
    "the pump failed and the pump stopped",
    "the scanner is fine",
    "pump pump pump",
    "12 ! a b",
    "the the the scanner pump",
    "the pump failed and the pump stopped",
]


def grams(text):
    w = [x for x in re.findall("[a-z_]+", text.lower()) if len(x) > 1]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_vocabulary(texts, min_df=1, most=None):
    counted = [Counter(grams(t)) for t in texts]
    df, cf = Counter(), Counter()
    for c in counted:
        df.update(c.keys())
        cf.update(c)
    terms = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t))[:most]
    return {t: (df[t], cf[t], math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in terms}


def brute_weights(text, vocabulary):
    raw = {t: n * vocabulary[t][2] for t, n in Counter(grams(text)).items() if t in vocabulary}
    norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
    return {t: w / norm for t, w in raw.items()}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id bigint, text string")


@pytest.fixture
def postings(docs):
    return tf.count_terms(tf.add_grams(docs, "text"), "doc_id")


def test_counts(postings):
    got = {(r["doc_id"], r["term"]): r["tf"] for r in postings.collect()}
    want = {(i, t): n for i, d in enumerate(DOCS) for t, n in Counter(grams(d)).items()}
    assert got == want


@pytest.mark.parametrize("min_df, most", [(1, None), (2, None), (1, 5), (2, 3), (1, 1000)])
def test_vocabulary(postings, min_df, most):
    got = {r["term"]: (r["df"], r["cf"], r["idf"]) for r in tf.fit_vocabulary(postings, len(DOCS), min_df, most).collect()}
    want = brute_vocabulary(DOCS, min_df, most)
    assert got.keys() == want.keys()
    assert all(got[t][:2] == want[t][:2] and abs(got[t][2] - want[t][2]) < 1e-12 for t in want)


@pytest.mark.parametrize("max_broadcast", [10**6, 0])
def test_weights_with_broadcast_and_salted_join(postings, max_broadcast):
    vocabulary = tf.fit_vocabulary(postings, len(DOCS))
    joined = tf.join_terms(postings, vocabulary, F.col("doc_id"), max_broadcast)
    assert joined.count() == postings.count()
    got = {(r["doc_id"], r["term"]): r["idf"] for r in joined.collect()}
    assert len(got) == joined.count()
    want = brute_vocabulary(DOCS)
    assert all(abs(v - want[t][2]) < 1e-12 for (_, t), v in got.items())


def test_unit_length(postings):
    vocabulary = tf.fit_vocabulary(postings, len(DOCS), 2)
    want = brute_vocabulary(DOCS, 2)
    got = {}
    for r in tf.weigh(postings, vocabulary, "doc_id").collect():
        got.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for i, d in enumerate(DOCS):
        expected = brute_weights(d, want)
        assert got.get(i, {}).keys() == expected.keys()
        assert all(abs(got[i][t] - w) < 1e-12 for t, w in expected.items())
    assert 3 not in got


def test_keywords(postings):
    vocabulary = tf.fit_vocabulary(postings, len(DOCS))
    lists = {r["doc_id"]: [(k["word"], k["pct"]) for k in r["top_keywords"]]
             for r in tf.keyword_lists(tf.top_keywords(postings, vocabulary, "doc_id", 3), "doc_id").collect()}
    want = brute_vocabulary(DOCS)
    for i, d in enumerate(DOCS):
        best = sorted(((t, n * want[t][2]) for t, n in Counter(grams(d)).items()), key=lambda x: (-round(x[1], 9), x[0]))[:3]
        if best:
            assert [t for t, _ in lists[i]] == [t for t, _ in best]
            assert all(abs(p - 100 * w / sum(x for _, x in best)) <= 0.051 for (_, p), (_, w) in zip(lists[i], best))
    assert 3 not in lists


def brute_similar(query, vocabulary, k):
    q = brute_weights(query, vocabulary)
    if not q:
        return []
    sims = [(round(sum(q.get(t, 0) * w for t, w in brute_weights(d, vocabulary).items()), 9), i) for i, d in enumerate(DOCS)]
    return sorted(sims, key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("k", [2, 6, 10])
def test_similar_cases(spark, docs, postings, k):
    queries = ["the pump", "unknown words only", "scanner fine", "stopped and stopped", ""]
    asked = spark.createDataFrame(list(enumerate(queries)), "item_id int, text string")
    vocabulary = tf.fit_vocabulary(postings, len(DOCS))
    got = {}
    for r in sim.similar_cases(docs, asked, vocabulary, k=k).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["similarity"]))
    known = brute_vocabulary(DOCS)
    for i, text in enumerate(queries):
        want = brute_similar(text, known, k)
        assert [x[0] for x in got.get(i, [])] == list(range(1, len(want) + 1))
        assert [x[1] for x in got.get(i, [])] == [x[1] for x in want], text
        assert all(abs(a[2] - b[0]) < 1e-8 for a, b in zip(got.get(i, []), want))


def test_similar_case_view(spark, docs):
    history = docs.withColumn("text", F.repeat("text", 20)).withColumn("date_received", F.lit("20240101"))
    cases = spark.createDataFrame([(7, 1, 0, 0.98765), (7, 2, 1, 0.5)], "item_id int, rank int, doc_id bigint, similarity double")
    rows = {r["rank"]: r for r in sim.similar_case_view(cases, history, "doc_id", "item_id", "text").collect()}
    assert rows[1]["similarity_pct"] == 98.8 and rows[1]["date"] == "20240101" and rows[1]["detected_type"] == ""
    assert len(rows[1]["excerpt"]) == 201 and rows[1]["excerpt"].endswith("…")


def test_texts_are_cleaned_once(docs, tmp_path):
    """The optimiser must not copy the cleaning into what is done for each gram."""
    from faultscope.operators.case_index import term_arrays
    from faultscope.operators.term_table import TermTable, strongest_terms

    path = str(tmp_path / "terms")
    docs.sparkSession.range(2).selectExpr("cast(id AS string) AS term", "id AS hash", "1.0D AS idf", "cast(id AS int) AS `index`").write.parquet(path)
    table = TermTable(path, 2)
    weighed = table.weigh(docs, "text")
    plans = [tf.count_terms(tf.add_grams(docs, "text"), "doc_id"), term_arrays(docs, "doc_id", "text", (1, 2)),
             weighed.select("features", strongest_terms(F.col("weighted_terms"), 5))]
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == 1


@pytest.mark.parametrize("ngrams", [(1, 2), (2, 3)])
def test_keywords_of_whole_texts(spark, ngrams):
    """Those of the postings, with repeated and null ids, ties, more and fewer terms than asked for, and no row for each term."""
    from faultscope.operators.text_keywords import text_keywords

    texts = ["", None, "a 1", "fire", "Été ½ pump", "pump pump fire", *(" ".join(f"w{'abcdefghij'[(i * j) % 10]}{'xyz'[j % 3]}" for j in range(1 + 7 * i)) for i in range(12))]
    rows = [(None if i % 7 == 3 else i % 11, t) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    postings = tf.text_postings(docs, "text", "id", ngrams)
    vocabulary = tf.fit_vocabulary(postings, len(rows))
    for k in (1, 5, 400):
        found = text_keywords(docs, "text", "id", k, ngrams)
        assert found.columns == ["id", "rank", "word", "pct"]
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, tf.top_keywords(postings, vocabulary, "id", k).collect()))
    assert text_keywords(docs.limit(0), "text", "id").collect() == []
    assert text_keywords(docs.where("text = 'a 1'"), "text", "id").collect() == []
