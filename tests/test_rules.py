import pytest

from faultscope.functions import rules as r


def test_first_and_last_rule(column):
    texts = ["Ventilator monitor", "the MRI room", "CT and x ray", "xray", "x-ray", "connect", "hemodialysis unit", None, "", "pump_x", "spo2."]
    assert column(lambda v: r.device_type(v, "first"), texts) == [
        "Ventilateur", "IRM", "Scanner", "Radiologie", "Radiologie", None, "Dialyse", None, None, None, "Moniteur patient"]
    assert column(lambda v: r.device_type(v, "last"), texts) == [
        "Moniteur patient", "IRM", "Radiologie", "Radiologie", "Radiologie", None, "Dialyse", None, None, None, "Moniteur patient"]


def test_unicode_word_bounds(column):
    assert column(lambda v: r.device_type(v, "first"), ["été-pump", "épump", "pumpé", "pump"]) == [
        "Pompe à perfusion", None, None, "Pompe à perfusion"]


def test_policy_is_checked(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        r.device_type(F.lit("x"), "any")


def test_table_type_uses_names_and_default(spark):
    df = spark.createDataFrame([("Pump", None, "a pacemaker"), (None, "ECG", "x"), ("none", "none", "nothing")],
                               "generic_name string, brand_name string, event_text string")
    got = [x["TypeDetecte"] for x in r.add_detected_type(df, "event_text").collect()]
    assert got == ["Pacemaker", "Moniteur patient", "Autre"]
    got = [x["TypeDetecte"] for x in r.add_detected_type(df.select("event_text"), "event_text").collect()]
    assert got == ["Pacemaker", "Autre", "Autre"]


def test_critical_words(column):
    cleaned = ["smoke seen", "overheating", "overheat", "fumee noire", "brulure", "deces", "short circuit", "shortcircuit",
               "stoped", "stopped", "arret", "risque", "injury", "injur", "x_fire", "", None]
    assert column(r.critical_by_words, cleaned) == [1, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    folded = column(lambda v: r.critical_by_words(v, folded=True), cleaned)
    assert folded[3:6] == [1, 1, 1] and folded[:3] == [1, 0, 1]


def test_event_type_label(column):
    types = ["Death", " injury ", "Malfunction", None, "", "DEATH"]
    assert column(r.critical_by_event_type, types) == [1, 1, 0, 0, 0, 1]
    assert column(lambda v: r.critical_by_event_type(v, trim=False), types) == [1, 0, 0, 0, 0, 1]


def test_fallback_label(column):
    assert column(r.critical_by_fallback, ["Cardiac arrest", "injury", "injur", "SEVERE", None]) == [1, 0, 1, 1, 0]


def test_recommendation(column):
    advice = column(r.recommendation, ["Critique - x", "Modérée", "Faible", None, "critique"])
    assert advice == ["⚠️ Maintenance immédiate requise", "🔍 Surveillance accrue"] + ["✅ Fonctionnement normal"] * 3


def test_maintenance_hours(column):
    assert column(r.maintenance_hours, ["IRM", "Brancard", None]) == [2000, 1000, 1000]


def test_event_type_ignores_all_outer_white_space(column):
    assert column(r.critical_by_event_type, ["\tDeath\n", " injury ", "Other", None]) == [1, 1, 0, 0]
