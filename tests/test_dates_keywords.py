from datetime import datetime

from pyspark.sql import functions as F

from faultscope.functions import dates as d
from faultscope.functions import keywords as k


def test_parse_date(column):
    cases = {
        "20200131": datetime(2020, 1, 31), "20209999": None, "2020-01-31": datetime(2020, 1, 31),
        "2020-01-31 10:20:30": datetime(2020, 1, 31, 10, 20, 30), "2020-01-31T10:20:30Z": datetime(2020, 1, 31, 10, 20, 30),
        "2020-01-31T10:20:30+02:00": datetime(2020, 1, 31, 8, 20, 30), "2020-01-31 10:20:30.250": datetime(2020, 1, 31, 10, 20, 30, 250000),
        "01/31/2020": datetime(2020, 1, 31), "31/01/2020": datetime(2020, 1, 31), "Jan 5, 2020": datetime(2020, 1, 5),
        "5 January 2020": datetime(2020, 1, 5), "2020/1/5": datetime(2020, 1, 5), "2020-02": datetime(2020, 2, 1),
        "": None, "n/a": None, None: None, "99991231": None, "2020-02-30": None, "12345": None,
    }
    assert column(d.parse_date, list(cases)) == list(cases.values())


def test_date_column_choice(spark):
    df = spark.createDataFrame([("20200102", "20210304")], "date_received string, Date string")
    assert d.add_parsed_date(df).first()["date_dt"] == datetime(2020, 1, 2)
    assert d.add_parsed_date(df.select("Date")).first()["date_dt"] == datetime(2021, 3, 4)
    assert d.add_parsed_date(df.select(df["Date"].alias("x"))).first()["date_dt"] is None


def test_iso_is_utc_in_any_session_zone(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        stamp = spark.range(1).select(d.iso_utc(F.timestamp_seconds(F.lit(1704067200))).alias("ts")).first()["ts"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert stamp == "2024-01-01T00:00:00Z"


def test_iso_and_month(column):
    ts = [datetime(2024, 5, 6, 7, 8, 9)]
    assert column(d.iso_utc, ts, "timestamp") == ["2024-05-06T07:08:09Z"]
    assert str(column(d.month_of, ts, "timestamp")[0]) == "2024-05-01"


KIND = k.KEYWORDS_TYPE


def test_keywords_to_json(column):
    got = column(k.keywords_to_json, [[("fumée", 60.0), ('a"b', 39.5)], [], None], KIND)
    assert got == ['[["fumée", 60.0], ["a\\"b", 39.5]]', "[]", "[]"]


def test_keywords_from_json(column):
    got = column(k.keywords_from_json, ['[["fumée", 60.0], ["a\\"b", 39.5]]', "[]", None, "broken["])
    assert [[tuple(x) for x in row] for row in got] == [[("fumée", 60.0), ('a"b', 39.5)], [], [], []]


def test_keywords_to_text(column):
    kw = [(w, 10.0) for w in "abcdefg"]
    assert column(k.keywords_to_text, [kw, None], KIND) == ["a (10.0%), b (10.0%), c (10.0%), d (10.0%), e (10.0%)", ""]
