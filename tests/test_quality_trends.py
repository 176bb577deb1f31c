import json
from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from faultscope.operators import quality as q
from faultscope.operators import trends as t
from faultscope.plans.dashboard import enrich, selection

ROWS = [("a", 1, "x"), ("a", 1, "x"), ("a", None, "x"), (None, 0, None), (None, 0, None), ("bb", 2, "y")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "event_text string, label int, event_type string")


def test_counts(spark):
    got = q.quality_counts(frame(spark)).first().asDict()
    assert got == {"n_rows": 6, "n_cols": 3, "dup_rows": 2, "nulls_event_text": 2, "nulls_label": 1, "nulls_event_type": 2}


def test_digest_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "a"), ("-", "a"), ("=", "a"), ("", "a"), ("a", None)], "x string, y string")
    assert q.quality_counts(df).first()["dup_rows"] == 0


def test_report_documents(spark):
    doc = json.loads(q.report_to_json(q.quality_report(frame(spark)), "abc"))
    assert doc["rows"] == 6 and doc["cols"] == 3 and doc["dup_rows"] == 2 and doc["file_md5"] == "abc"
    assert doc["class_balance"] == {"1": 2, "0": 2, "2": 1, "nan": 1}
    assert doc["top_event_type"] == {"x": 3, "y": 1}
    assert "| rows | 6 |" in q.report_to_markdown(json.dumps(doc))


def test_fingerprint_ignores_order(spark):
    df = frame(spark)
    assert q.fingerprint(df).first() == q.fingerprint(df.orderBy(F.desc("event_text")).repartition(3)).first()
    assert q.fingerprint(df).first() != q.fingerprint(df.filter("label = 1")).first()


def test_gate(spark):
    bad = q.dataset_gate(frame(spark)).first()
    assert not bad["passed"] and bad["failed_checks"] == ["null text", "non-binary label"] and bad["dup_texts"] == 3
    good = q.dataset_gate(frame(spark, [("abc", 1, ""), ("abcdef", 0, ""), ("abc", 0, "")])).first()
    assert good["passed"] and good["failed_checks"] == [] and good["dup_texts"] == 1
    assert (good["len_min"], good["len_p50"], good["len_p95"], good["len_max"]) == (3, 3, 5, 6)
    absent = q.dataset_gate(frame(spark).drop("label")).first()
    assert not absent["passed"] and absent["failed_checks"] == ["missing columns: label"]
    assert absent.__fields__ == good.__fields__ and absent["len_max"] is None
    empty = q.dataset_gate(frame(spark).limit(0)).first()
    assert empty["passed"] and empty["n_rows"] == 0 and empty["label_ratio"] is None


def test_value_counts(spark):
    df = frame(spark)
    assert [tuple(r) for r in t.value_counts(df, "event_type").collect()] == [("x", 3), ("nan", 2), ("y", 1)]
    assert [tuple(r) for r in t.value_counts(df, "event_type", 1, "drop").collect()] == [("x", 3)]
    assert [r[0] for r in t.distinct_values(df, "label").collect()] == [0, 1, 2]


def dated(spark, days, kind="m"):
    return spark.createDataFrame([(datetime.fromisoformat(d) if d else None, kind) for d in days], "date_dt timestamp, g string")


def test_monthly_and_kpis(spark):
    df = dated(spark, ["2024-01-05", "2024-01-31", "2024-03-01", None])
    assert sorted(tuple(r) for r in t.monthly_counts(df).collect()) == [(date(2024, 1, 1), 2), (date(2024, 3, 1), 1)]
    assert tuple(t.kpis(df).first()) == (4, "2024-03-01")
    assert tuple(t.kpis(df.filter("date_dt IS NULL")).first()) == (1, "—")


def test_severity_filter(spark):
    df = frame(spark)
    assert t.filter_severity(df).count() == 4
    assert t.filter_severity(df, []).count() == 6
    assert t.filter_severity(df, ["y"]).count() == 1
    alerts = df.select(F.col("event_type").alias("Alerte"))
    assert t.filter_severity(alerts, ["x"]).count() == 3
    assert t.filter_severity(df.select("label"), ["x"]).count() == 6


def test_forecast_is_least_squares(spark):
    months = [date(2024, m, 1) for m in (1, 2, 3, 5, 6, 7, 8)]
    values = [5, 7, 6, 9, 12, 11, 15]
    df = spark.createDataFrame(list(zip(months, values)), "month date, incidents bigint")
    slope, intercept = np.polyfit(range(7), values, 1)
    got = {r["month"]: r["incidents"] for r in t.forecast(df).collect()}
    want = {date(2024, 9 + i, 1): intercept + slope * (7 + i) for i in range(3)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert t.forecast(df.limit(5)).count() == 0
    falling = spark.createDataFrame(list(zip(months, [60, 50, 40, 30, 20, 10, 0])), "month date, incidents bigint")
    assert [r["incidents"] for r in t.forecast(falling).collect()] == [0.0] * 3
    filled = t.forecast(df, fill_gaps=True).orderBy("month").first()["incidents"]
    s2, i2 = np.polyfit(range(8), [5, 7, 6, 0, 9, 12, 11, 15], 1)
    assert abs(filled - (i2 + s2 * 8)) < 1e-9


def test_enrich_and_select(spark):
    df = spark.createDataFrame([("Critique x", "the pump", "20240102"), ("Faible", "none", "bad")], "Alerte string, Texte string, Date string")
    rich = enrich(df)
    assert [r["TypeDetecte"] for r in rich.collect()] == ["Pompe à perfusion", "Autre"]
    assert selection(rich, "Autre").count() == 1
    assert selection(rich, severities=["Faible"]).first()["date_dt"] is None
    assert "Recommandation" in rich.columns
