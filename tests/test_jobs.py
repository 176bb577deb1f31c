import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultscope.operators import learning as ml
from faultscope.plans import ingest, scoring
from faultscope.sources import history as h
from faultscope.streaming import jobs


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "fire and smoke pump" if i % 2 else "works fine scanner", i % 2) for i in range(20)]
    return ml.train_text_classifier(spark.createDataFrame(rows, "id int, text string, label int"), "text", "label", "id")


def translated(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [tuple(r)[2:] for r in scoring.translate_if_needed(df, "t", **kw).orderBy("i").select("i", "t", "model_text", "src_lang", "translated").collect()]


EN, FR = "the pump is on fire", "le scanner est dans la salle"


def test_translation_policy(spark):
    upper = lambda texts: [t.upper() for t in texts]
    assert translated(spark, [EN, FR, " ", None]) == [(EN, "en", 0), (FR, "fr", 0), (" ", "fr", 0), ("", "fr", 0)]
    assert translated(spark, [EN, FR, " "], translator=upper) == [(EN.upper(), "en", 1), (FR, "fr", 0), (" ", "fr", 0)]
    assert translated(spark, [EN, FR], translator=upper, choice="Français") == [(EN, "fr", 0), (FR, "fr", 0)]
    assert translated(spark, [EN, FR], translator=upper, choice="Anglais") == [(EN.upper(), "en", 1), (FR.upper(), "en", 1)]
    assert translated(spark, [EN], translator=upper, force=False) == [(EN, "en", 0)]

    def broken(texts):
        raise RuntimeError("no model")

    assert translated(spark, [EN], translator=broken) == [(EN, "en", 0)]
    assert translated(spark, [EN.upper() + " the is"], translator=lambda x: x)[0][2] == 0


def test_score_documents(spark, model):
    docs = spark.createDataFrame(
        [("a.txt", " the pump is on fire and smoke \x00"), ("b.txt", "le scanner"), ("c.txt", " \n"), ("d.txt", "qqq")], "name string, text string")
    rows = {r["file_name"]: r for r in scoring.score_documents(docs, model, "name", "text").collect()}
    assert set(rows) == {"a.txt", "b.txt", "d.txt"}
    assert rows["a.txt"]["detected_type"] == "Pompe à perfusion" and rows["a.txt"]["src_lang"] == "en"
    assert rows["a.txt"]["label"] == "Critique" and rows["a.txt"]["top_keywords"] and rows["d.txt"]["top_keywords"] is None
    assert rows["a.txt"]["cleaned_text"] == "the pump is on fire and smoke"
    compat = {r["file_name"]: r["src_lang"] for r in scoring.score_documents(docs, model, "name", "text", compat_language=True).collect()}
    assert compat["a.txt"] == "fr"
    cut = scoring.score_documents(docs, model, "name", "text", max_chars=8).filter("file_name = 'a.txt'").first()
    assert cut["input_text"] == "the pump"
    export = scoring.keyword_export(scoring.score_documents(docs, model, "name", "text"))
    assert export.columns == ["file_name", "word", "pct"] and export.filter("file_name = 'd.txt'").count() == 0


def test_prepare_and_report(spark, tmp_path):
    raw = spark.createDataFrame([("20200101", "Death", "a", "b", "text"), (None, "Other", "a", "b", "")], ingest.RAW_SCHEMA)
    df = ingest.prepare(raw, str(tmp_path / "processed"))
    assert df.count() == 2  # the second text falls back to the other columns
    doc = ingest.write_quality_report(df, str(tmp_path / "q.json"), str(tmp_path / "q.md"), "md5")
    assert json.loads(doc)["rows"] == 2
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "q.json"), wholetext=True).collect()))["file_md5"] == "md5"


def events(spark, path, rows):
    spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, kind string").coalesce(1).write.mode("append").parquet(path)


def test_streams_pick_up_where_they_stopped(spark, tmp_path, model):
    src, out, cp = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [(i, datetime(2024, 1, 1 + i // 4), "ab"[i % 2]) for i in range(12)]
    events(spark, src, rows[:8] + rows[:3])
    schema = spark.read.parquet(src).schema
    stream = lambda: jobs.read_stream(spark, src, schema, files_per_batch=1)
    jobs.dedup_stream(stream(), ["event_id"], "ts", "30 days", out, cp).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(8))
    events(spark, src, rows[4:])
    jobs.dedup_stream(stream(), ["event_id"], "ts", "30 days", out, cp).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(12))


def test_counts_equal_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, datetime(2024, 1 + i % 3, 1 + i % 5), "ab"[i % 2]) for i in range(40)]
    events(spark, src, rows[:25])
    events(spark, src, rows[25:])
    schema = spark.read.parquet(src).schema
    stream = lambda: jobs.read_stream(spark, src, schema, files_per_batch=1)
    jobs.publish_counts(jobs.daily_counts(stream(), "ts", ["kind"]), str(tmp_path / "d"), str(tmp_path / "cd")).awaitTermination()
    jobs.publish_counts(jobs.monthly_counts(stream(), "ts", ["kind"]), str(tmp_path / "m"), str(tmp_path / "cm")).awaitTermination()
    batch = spark.read.parquet(src)
    for path, unit in (("d", "day"), ("m", "month")):
        want = {tuple(r) for r in batch.groupBy(F.to_date(F.date_trunc(unit, "ts")).alias("p"), "kind").count().collect()}
        assert {tuple(r) for r in spark.read.parquet(str(tmp_path / path)).collect()} == want


def test_stream_scoring(spark, tmp_path, model):
    src, out, cp = str(tmp_path / "src"), str(tmp_path / "history"), str(tmp_path / "cp")
    rows = [(f"t{i}", "fire and smoke" if i % 2 else "works fine", datetime(2024, 1, 1, 0, 0, i)) for i in range(6)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "name string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = jobs.read_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
    jobs.score_stream(stream, model, "name", "text", "ts", out, cp).awaitTermination()
    got = {r["file_name"]: (r["label"], r["ts"]) for r in h.read_history(spark, out).collect()}
    assert got == {n: ("Critique" if "fire" in t else "Pas critique", ts.strftime("%Y-%m-%dT%H:%M:%SZ")) for n, t, ts in rows}
    assert h.read_history(spark, out).select("run").distinct().count() == 2


def test_streams_share_a_history_and_repeated_names_stay_single(spark, model, tmp_path):
    history_path = str(tmp_path / "history")
    schema = "name string, text string, ts timestamp"
    for k, rows in enumerate(([("same", "pump failure alarm", "2024-01-01 10:00:00"), ("same", "screen works well", "2024-01-01 11:00:00")], [("n2", "pump stopped", "2024-01-01 12:00:00")])):
        folder = str(tmp_path / f"in{k}")
        spark.createDataFrame(rows, "name string, text string, ts string").selectExpr("name", "text", "CAST(ts AS timestamp) AS ts").write.parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.score_stream(stream, model, "name", "text", "ts", history_path, str(tmp_path / f"checkpoint{k}")).awaitTermination()
    stored = spark.read.parquet(history_path).collect()
    assert sorted(row.file_name for row in stored) == ["n2", "same", "same"] and len({row.id for row in stored}) == 3
    assert len({row.ts for row in stored}) == 3
