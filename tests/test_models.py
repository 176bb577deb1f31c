import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from faultscope.operators import evaluation as ev
from faultscope.operators import learning as ml
from faultscope.operators.tfidf import add_grams, count_terms, top_keywords
from faultscope.plans import scoring

GOOD, BAD = "the device works fine today", "fire and smoke burned the pump"


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, f"{BAD} ward{'abcdefg'[i % 7]}" if i % 3 == 0 else f"{GOOD} room{'abcde'[i % 5]}", int(i % 3 == 0)) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


@pytest.fixture(scope="module")
def model(train):
    return ml.train_text_classifier(train, "text", "label", "doc_id")


def test_scores_and_labels(spark, model):
    asked = spark.createDataFrame([(1, BAD), (2, GOOD), (3, "")], "id int, text string")
    got = {r["id"]: r for r in ml.score_texts(asked, model, "text").collect()}
    assert got[1]["proba"] > 0.5 > got[2]["proba"] and got[1]["label_text"] == "Critique" and got[2]["label_text"] == "Pas critique"
    assert got[1]["pred"] == 1 and 0 < got[3]["proba"] < 1
    strict = ml.score_texts(asked, model, "text", threshold=0.999).filter("id = 1").first()
    assert strict["pred"] == 0


def test_logistic_regression_matches_newton(spark):
    """Same optimum as the summed loss plus half the squared weights, solved independently."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=150) > 0).astype(int)
    df = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "embedding array<double>, label int")
    fitted = ml.train_embedding_classifier(df, "embedding", "label").stages[0]
    a = np.hstack([x, np.ones((150, 1))])
    w, ridge = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a.T * (p * (1 - p))) @ a + ridge, a.T @ (p - y) + ridge @ w)
    assert np.allclose([*fitted.coefficients, fitted.intercept], w, atol=1e-3)


def test_tfidf_vectors_have_unit_length(train, model):
    rows = model.transform(train).select("features").collect()
    assert all(abs(r[0].norm(2) - 1) < 1e-9 for r in rows)


def test_forest_presets_and_unknown_classifier(spark, train):
    preset = ml.Preset(classifier="rf", trees=5, max_depth=4, min_df=2, max_features=30)
    forest = ml.train_text_classifier(train, "text", "label", "doc_id", preset)
    scored = ml.score_texts(train, forest, "text")
    assert scored.filter("pred = label").count() == 60
    assert ml.FULL_FOREST.trees == 300 and ml.WHOLE_VOCABULARY.max_features is None
    with pytest.raises(ValueError):
        ml.classifier(ml.Preset(classifier="svm"), 1)


def test_whole_vocabulary_and_cleaned_input(train):
    cleaned = train.withColumn("text_clean", F.lower("text"))
    model = ml.train_text_classifier(cleaned, "text_clean", "label", "doc_id", ml.Preset(max_features=None, max_iter=20), cleaned=True)
    assert model.stages[0].terms(train.sparkSession).count() > 30
    plain = ml.score_texts(cleaned, model, "text_clean", cleaned=True).select("doc_id", F.round("proba", 9))
    assert sorted(plain.collect()) == sorted(ml.score_texts(train, model, "text").select("doc_id", F.round("proba", 9)).collect())


def test_save_load_and_fallback(spark, model, train, tmp_path):
    path = str(tmp_path / "model")
    ml.save_model(model, path)
    loaded = ml.load_model(spark, path)
    assert ml.load_model(spark, path).uid == loaded.uid  # read anew each time, so a model saved again is seen
    again = ml.load_model(spark, str(tmp_path / "absent"), fallback=path)
    assert sorted(again.stages[0].terms(spark).collect()) == sorted(model.stages[0].terms(spark).collect())
    a = ml.score_texts(train, model, "text").agg(F.sum("proba")).first()[0]
    b = ml.score_texts(train, loaded, "text").agg(F.sum("proba")).first()[0]
    assert abs(a - b) < 1e-9
    with pytest.raises(Exception):
        ml.load_model(spark, str(tmp_path / "none"))
    (tmp_path / "broken" / "metadata").mkdir(parents=True)
    (tmp_path / "broken" / "metadata" / "part-00000").write_text("{not json\n")
    with pytest.raises(Exception):  # it is there, so the fallback does not hide it
        ml.load_model(spark, str(tmp_path / "broken"), fallback=path)
    ml.save_model(loaded, path)  # over itself
    assert abs(a - ml.score_texts(train, ml.load_model(spark, path), "text").agg(F.sum("proba")).first()[0]) < 1e-9


def test_pluggable_embedder(train):
    def embedder(texts):
        return [[len(t), t.count("e")] for t in texts]

    got = ml.embed_texts(train, "text", embedder, batch=7).select("text", "embedding").collect()
    assert all(list(r["embedding"]) == [len(r["text"]), r["text"].count("e")] for r in got)


def test_predict(spark, model):
    asked = spark.createDataFrame([(1, BAD), (2, "zz qq")], "id int, text string")
    rows = {r["id"]: r for r in scoring.predict(asked, model, "text", "id", k=4).collect()}
    assert rows[1]["label"] == "Critique" and len(rows[1]["keywords"]) == 4
    assert abs(sum(k["pct"] for k in rows[1]["keywords"]) - 100) < 0.5 and rows[2]["keywords"] is None
    assert scoring.predict(asked, model, "text", "id", return_keywords=False).first()["keywords"] is None


# ---- evaluation

def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, proba double").withColumn("pred", (F.col("proba") >= 0.5).cast("int"))


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


ROWS = [(int((i * 7) % 11 > 4), round(((i * 13) % 17) / 16, 4)) for i in range(200)]


def test_binary_metrics(spark):
    df = scored(spark, ROWS)
    m = ev.binary_metrics(df).first()
    tp = sum(y and s >= 0.5 for y, s in ROWS)
    said, real = sum(s >= 0.5 for _, s in ROWS), sum(y for y, _ in ROWS)
    assert m["n_samples"] == 200 and abs(m["f1"] - 2 * tp / (said + real)) < 1e-12
    assert abs(m["accuracy"] - sum(y == (s >= 0.5) for y, s in ROWS) / 200) < 1e-12
    assert abs(m["roc_auc"] - brute_auc(ROWS)) < 1e-12
    spark_auc = BinaryClassificationEvaluator(rawPredictionCol="proba", numBins=0).evaluate(df)
    assert abs(m["roc_auc"] - spark_auc) < 1e-12


def test_undefined_metrics(spark):
    one = ev.binary_metrics(scored(spark, [(0, 0.1), (0, 0.2)])).first()
    assert one["f1"] == 0 and one["accuracy"] == 1 and math.isnan(one["roc_auc"])


def test_many_ties_at_one_score(spark):
    rows = [(i % 2, 0.5) for i in range(90)] + [(1, 0.9), (0, 0.1)]
    assert abs(ev.binary_metrics(scored(spark, rows)).first()["roc_auc"] - brute_auc(rows)) < 1e-12


def test_curves(spark):
    df = scored(spark, ROWS)
    p, n = sum(y for y, _ in ROWS), sum(1 - y for y, _ in ROWS)
    full = sorted((tuple(r) for r in ev.roc_points(df, drop_intermediate=False).collect()), reverse=True)
    assert full[0] == (math.inf, 0.0, 0.0) and full[-1][1:] == (1.0, 1.0)
    for s, fpr, tpr in full[1:]:
        assert abs(fpr - sum(1 - y for y, v in ROWS if v >= s) / n) < 1e-12
        assert abs(tpr - sum(y for y, v in ROWS if v >= s) / p) < 1e-12
    few = {tuple(r) for r in ev.roc_points(df).collect()}
    assert few <= set(full) and {full[0], full[1], full[-1]} <= few
    straight = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)]
    kept = sorted(r["threshold"] for r in ev.roc_points(scored(spark, straight)).collect())
    assert kept == [0.5, 0.7, 0.9, math.inf]
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in ev.pr_points(df).collect()}
    assert pr[None] == (1.0, 0.0) and len(pr) == len({s for _, s in ROWS}) + 1
    for s, (precision, recall) in ((k, v) for k, v in pr.items() if k is not None):
        above = [y for y, v in ROWS if v >= s]
        assert abs(precision - sum(above) / len(above)) < 1e-12 and abs(recall - sum(above) / p) < 1e-12


def test_confusion_and_report(spark):
    df = scored(spark, [(1, 0.9), (1, 0.8), (1, 0.1), (0, 0.2)])
    assert {(r["label"], r["pred"]): r["n"] for r in ev.confusion(df).collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    rep = {r["class"]: r for r in ev.class_report(df).collect()}
    assert abs(rep["1"]["recall"] - 2 / 3) < 1e-12 and rep["1"]["precision"] == 1 and rep["1"]["support"] == 3
    assert rep["0"]["precision"] == 0.5 and rep["accuracy"]["f1"] == 0.75
    assert abs(rep["weighted avg"]["precision"] - (0.5 * 1 + 1 * 3) / 4) < 1e-12
    assert abs(rep["macro avg"]["recall"] - (1 + 2 / 3) / 2) < 1e-12


@pytest.mark.parametrize("wrong", [None, float("nan")])
def test_missing_scores_are_an_error(spark, wrong):
    with pytest.raises(Exception, match="null or NaN"):
        ev.binary_metrics(scored(spark, [(1, 0.5), (0, wrong)])).collect()


def test_keywords_come_from_the_row(spark, train, model):
    texts = train.select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "zz qq")], "doc_id bigint, text string"))
    vocabulary = model.stages[0].terms(spark).select("term", F.lit(1).cast("bigint").alias("df"), "idf")
    want = {tuple(r) for r in top_keywords(count_terms(add_grams(texts, "text"), "doc_id"), vocabulary, "doc_id", 5).collect()}
    got = {tuple(r) for r in scoring.explain(texts, model, "text", "doc_id", 5).collect()}
    assert got == want and got


def test_a_model_brings_its_own_terms(spark, train, tmp_path):
    """A unigram model sees no bigrams, also after it was saved; lookups and joins give the same vectors."""
    single = ml.train_text_classifier(train, "text", "label", "doc_id", ml.Preset(ngrams=(1, 1), max_iter=20))
    ml.save_model(single, str(tmp_path / "single"))
    kept = ml.load_model(spark, str(tmp_path / "single"))
    assert kept.stages[0].ngrams == (1, 1) and kept.stages[0].terms(spark).where("term LIKE '% %'").isEmpty()
    texts = train.select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, "zz qq"), (902, "pump pump fire")], "doc_id bigint, text string"))
    words = {w["word"] for r in ml.explain_texts(texts, kept, "text", 50).collect() for w in r["top_keywords"] or []}
    assert words and not any(" " in w for w in words)
    table = kept.stages[0]
    looked, joined = (table.weigh(texts, "text", most_shared=n).select("doc_id", "weighted_terms", "features") for n in (1 << 20, 0))
    assert sorted(looked.collect()) == sorted(joined.collect()) and looked.count() == 63
    by = {r["doc_id"]: r for r in looked.collect()}
    assert by[900]["weighted_terms"] == by[901]["weighted_terms"] == [] and by[900]["features"].numNonzeros() == 0
    idf = {r["term"]: (r["index"], r["idf"]) for r in table.terms(spark).collect()}
    assert sorted(i for i, _ in idf.values()) == list(range(len(idf)))
    a, b = 2 * idf["pump"][1], idf["fire"][1]
    assert abs(by[902]["features"][idf["pump"][0]] - a / math.hypot(a, b)) < 1e-12


def test_predict_by_embedding_model(spark, train, model):
    def embedder(texts):
        return [[len(t), t.count("e")] for t in texts]

    dense = ml.train_embedding_classifier(ml.embed_texts(train, "text", embedder), "embedding", "label")
    row = scoring.predict(train, dense, "text", "doc_id", model_name="embedding", embedder=embedder).orderBy("doc_id").first()
    assert 0 < row["proba"] < 1 and row["model"] == "embedding" and row["keywords"] is None
    marked = train.withColumnRenamed("doc_id", "key")
    rows = scoring.score_documents(marked, dense, "key", "text", embedder=embedder, keyword_model=model, keep=("key",)).collect()
    assert sorted(r["key"] for r in rows) == list(range(60)) and all(r["top_keywords"] for r in rows)
