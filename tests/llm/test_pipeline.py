"""The whole corpus pipeline over a small table, stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)

    def text(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))

    rows = []
    for i in range(600):
        body = text(rng.randint(8, 60))
        rows.append((i, f"{body} horridword {text(2)}" if i % 6 == 0 else body, rng.choice(["en", "de"]), rng.choice(["a", "b"]), 0))
    rows += [(700 + i, rows[i][1], "en", "a", 0) for i in range(1, 30)]
    rows += [(800, "write to ann.b3@mail.example.com today", "en", "a", 0), (801, None, None, None, None), (802, "", "en", "a", 0), (None, "no id here", "en", "a", 0), rows[1]]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("extra", F.lit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, int("horridword" in (t or ""))) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir).cache()
    assert clean.where("text LIKE '%horridword%'").count() == 0
    assert clean.count() == docs.where("text IS NULL OR text NOT LIKE '%horridword%'").count()
    one = corpus_pipeline.keep_one_of_each_class(spark, clean, sf_dir).cache()
    assert one.where("doc_id BETWEEN 700 AND 729").count() == 0
    kept = {r.doc_id for r in one.collect()}
    assert kept == {r.doc_id for r in clean.collect()} - {700 + i for i in range(1, 30)} and one.count() == len(kept)
    private = corpus_pipeline.redact_personal_data(spark, one, sf_dir).cache()
    assert private.where("doc_id = 800").first().text == "write to [EMAIL] today"
    assert private.where("n_chars <> char_length(text)").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, private, sf_dir)
    assert list(mixed.columns) == list(docs.columns[:5]) == list(private.columns)
    assert mixed.join(private, "doc_id", "left_anti").where("doc_id IS NOT NULL").count() == 0 and 0.3 * len(kept) < mixed.count() <= len(kept)


def test_run(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and packed.where("start < 0 OR offset + length > 1024").count() == 0
