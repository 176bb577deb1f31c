import base64
import io
import json
import zipfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultscope.sources import documents as d
from faultscope.sources import history as h
from faultscope.sources import tables as t


def test_csv_with_line_breaks_quotes_and_null_tokens(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    rows = [("a\nb", 'say "x", ok', "1"), ("N/A", " nan", "20200101"), (None, "NA", "x"), ("\\", "a\\\"b", "2")]
    df = spark.createDataFrame(rows, "event_text string, b string, label string")
    t.write_csv(df.coalesce(1), path)
    got = sorted(map(str, (tuple(r) for r in t.read_csv(spark, path).collect())))
    assert got == sorted(map(str, [rows[0], (None, " nan", "20200101"), (None, None, "x"), rows[3]]))
    typed = t.read_csv(spark, path, t.PROCESSED_SCHEMA)
    assert typed.columns == ["event_text", "label"]
    assert {r["label"] for r in typed.collect()} == {1, 20200101, None, 2}


def test_csv_written_by_another_tool(spark, tmp_path):
    path = tmp_path / "y.csv"
    path.write_text('date_received,event_text\n20200101,"l1\nl2 ""q"""\n,NULL\n', encoding="utf-8")
    assert [tuple(r) for r in t.read_csv(spark, str(path)).collect()] == [("20200101", 'l1\nl2 "q"'), (None, None)]


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    t.write_table(spark.range(3), path)
    t.write_table(spark.range(5), path, force=False)
    assert spark.read.parquet(path).count() == 3
    t.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_fallback_chain(spark, tmp_path):
    processed, raw = str(tmp_path / "p"), str(tmp_path / "r.csv")
    assert t.load_main_dataset(spark, [processed], [raw]).columns == t.PROCESSED_SCHEMA.names
    with pytest.raises(FileNotFoundError):
        t.load_main_dataset(spark, [processed], [raw], required=True)
    t.write_csv(spark.range(4), raw)
    assert t.load_main_dataset(spark, [processed], [raw]).count() == 4
    spark.range(0).write.parquet(processed)
    assert t.load_main_dataset(spark, [processed], [raw]).count() == 4
    spark.range(9).write.mode("overwrite").parquet(processed)
    assert t.load_main_dataset(spark, [processed], [raw]).count() == 9


def test_event_archive(spark, tmp_path):
    path = tmp_path / "e"
    path.mkdir()
    (path / "a.jsonl").write_text('{"date_received":"20200101","device":[{"brand_name":"é"}],"extra":1}\n{broken\n', encoding="utf-8")
    rows = t.read_events(spark, str(path)).orderBy("date_received").collect()
    assert rows[0]["_corrupt_record"] == "{broken" and rows[1]["device"][0]["brand_name"] == "é" and rows[1]["mdr_text"] is None
    out = str(tmp_path / "out")
    for _ in range(2):
        t.write_event_archive(t.read_events(spark, str(path)).filter("date_received IS NOT NULL").drop("_corrupt_record"), out)
    assert t.read_events(spark, out).drop("_corrupt_record").count() == 1


def test_metrics_and_checksums(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(0.9, 0.8, float("nan"), 5)], t.METRICS_SCHEMA)
    t.write_metrics(df, path)
    assert t.read_metrics(spark, path).first()["n_samples"] == 5
    f = tmp_path / "file.bin"
    f.write_bytes(b"abc")
    assert t.file_checksums(spark, str(f)).first()["file_md5"] == "900150983cd24fb0d6963f7d28e17f72"


# ---- documents

def docx(paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


FILES = {
    "a.CSV": (b"x,y,z\n1,a b,\n2,,3.5\n", "1 a b nan\n2 nan 3.5"),
    "b.json": ('{"é": [1, "x"]}'.encode(), json.dumps({"é": [1, "x"]}, ensure_ascii=False, indent=2)),
    "bad.json": (b"{", ""),
    "c.docx": (docx(["<w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r>", "", "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink>"]), "one\ttwo\n\nlink"),
    "bad.docx": (b"zip?", ""),
    "d.png": (b"pixels", ""),
    "e.pdf": (b"%PDF", ""),
    "f.xlsx": (b"PK", ""),
    "g.txt": (b"ok \xff\xfe \xc3\xa9", "ok  é"),
    "noext": (b"plain", "plain"),
    "empty.csv": (b"", ""),
}


def test_extract_by_extension(spark):
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in FILES.items()], "path string, content binary")
    got = {r["path"]: r["text"] for r in d.extract_text(df).collect()}
    assert got == {k: v[1] for k, v in FILES.items()}


PLAIN_SHEETS = [
    b'a,b,c\n1,"x y",17.0\n-2,"z",0.50\n', b"a\n1\n\n2\n", b"a,b\n1,NA\n2,3\n", b"a,b\nNA,x\nnull,\n", b"a,b\n1,2.50\n,3\n", b"a,a\n7,7\n",
    b'a,b\n"1,5","q""r"\n2,s\n', b"a,b\n007,1e3\n", b"a\ntrue\nFalse\n", b"a\nTrue\nx\n", b"a\ninf\n1\n", b"a,b\n1\n2,3\n", b"a\n1,2\n3,4\n",
    "a,b\né,٣\n".encode(), b"\xef\xbb\xbfa\n1\n", b"a\n\xff\n", b"a\r\n1\r\n", b"a\n 1\n2 \n", b'a\n"x\n', b'a\n"x\ny"\n', b"a", b"", b"\n", b"a\n-0\n",
    b"a\n12345678901234567890\n", b"a\n0.30000000000000004\n", b"a\n1_0\n", b"a,b\n,\n,\n",
]


def test_sheets_are_read_as_pandas_reads_them(monkeypatch):
    def by_pandas(payload):
        frame = pd.read_csv(io.BytesIO(payload))
        return "\n".join(" ".join(map(str, row)) for row in frame.itertuples(index=False, name=None))

    for payload in PLAIN_SHEETS:
        assert d._safely(d._csv_text, payload) == d._safely(by_pandas, payload), payload
    monkeypatch.setattr(d.pd, "read_csv", None)  # plain files do without it
    assert d._csv_text(PLAIN_SHEETS[0]) == "1 x y 17.0\n-2 z 0.5" and d._csv_text(b"a,b\n1,NA\n2,3\n") == "1 nan\n2 3.0"


@pytest.mark.parametrize("value", [{"k": 76}, {}, [], {"a": [1, {"é\n": None}], "b": {}, "c": [[]]}, "x", 1.5, True, None, float("nan"), 1e300, 10**30, ["a\"b"]])
def test_json_is_indented_as_before(value):
    payload = json.dumps(value).encode()
    assert d._json_text(payload) == json.dumps(json.loads(payload), ensure_ascii=False, indent=2)
    assert d._json_text(b"[" * 150 + b"]" * 150) == json.dumps(json.loads("[" * 150 + "]" * 150), indent=2)


def test_a_filter_on_texts_reads_files_once(spark, tmp_path):
    def reader(payload):
        with open(tmp_path / "calls", "a") as calls:
            calls.write("x")
        return payload.decode()

    files = spark.createDataFrame([(f"{i}.pdf", bytearray(b"text &eacute; " * (i % 2))) for i in range(6)] + [("a.html", bytearray(b"<p>&eacute;"))], "path string, content binary")
    read = d.extract_text(files.repartition(2, "path"), readers={"pdf": reader}).where("trim(text) <> ''")
    assert sorted(r["text"].strip() for r in read.collect()) == ["text &eacute;"] * 3 + ["é"]
    assert (tmp_path / "calls").read_text() == "x" * 6


def test_extra_reader_and_binary_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.pdf").write_bytes(b"abc")
    got = d.extract_text(d.read_documents(spark, str(tmp_path)), readers={"pdf": lambda payload: payload.decode().upper()})
    assert [r["text"] for r in got.collect()] == ["ABC"]
    assert d.read_documents(spark, str(tmp_path), "*.txt").count() == 0


def test_html(column):
    cases = {
        "<html><head><title>T</title><script>var t='</p>';</script><STYLE>p{}</STYLE></head><body><p>a<b>b</b></p></body>": "T a b",
        '<!DOCTYPE html><!-- no <p>x</p> --><a title="x > y" href=\'q"\'>link</a>': "link",
        "a &lt;b&gt; &amp;amp; c &eacute; &#233; &copy;": "a <b> &amp; c é é ©",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "x<script>never closed": "x",
        "<p data-x='" + "y" * 20000 + "'>long</p>": "long",
        "&amp;lt;": "&lt;",
        "a<img alt=John's>b": "a b",
    }
    got = column(d.html_to_text, list(cases))
    assert [" ".join(t.split()) for t in got] == list(cases.values())
    assert column(d.html_to_text, [None]) == [None]


def test_trace_of_unreadable_files(column):
    got = column(d.text_or_trace, [bytearray(b"\xff" * 100), bytearray(b"text"), bytearray(b" \n")], "binary")
    assert got[0] == "(binaire) " + base64.b64encode(b"\xff" * 64).decode() + "…"
    assert got[1] == "text" and got[2] == "(binaire) IAo=…"


# ---- history

def predictions(spark, rows):
    return spark.createDataFrame(rows, "n int, file_name string, input_text string, at timestamp").select(
        "*", F.lit("doc").alias("source"), F.lower("input_text").alias("cleaned_text"), F.lit("TFIDF").alias("model_type"),
        F.lit("Critique").alias("label"), F.lit(0.98765).alias("proba"), F.lit(None).cast("string").alias("detected_type"),
        F.lit("fr").alias("src_lang"), F.lit(True).alias("translated"),
        F.array(F.struct(F.lit("fumée").alias("word"), F.lit(100.0).alias("pct"))).alias("top_keywords"))


ROWS = [(i, None if i % 2 else f"File_{i}.TXT", f"text {i} 50%" if i < 5 else "back\\slash x", datetime(2024, 1, 1 + i // 3, 0, 0, i)) for i in range(12)]


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = h.history_rows(predictions(spark, ROWS), "r1", F.col("at"), ["n"])
    for _ in range(2):  # the same run twice adds nothing
        h.append_history(rows, path)
    h.append_history(h.history_rows(predictions(spark, ROWS[:1]), "r2", datetime(2023, 5, 5), ["n"]), path)
    stored = h.read_history(spark, path)
    assert stored.count() == 13 and stored.select("id").distinct().count() == 13
    recent = h.recent_predictions(stored, 4).collect()
    assert [r["ts"] for r in recent] == [f"2024-01-04T00:00:{s:02d}Z" for s in (11, 10, 9)] + ["2024-01-03T00:00:08Z"]
    assert [tuple(k) for k in recent[0]["top_keywords"]] == [("fumée", 100.0)]
    assert h.recent_predictions(stored, 1000).count() == 13
    plan = h.recent_predictions(stored, 4)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ts_date" in plan
    view = h.history_view(h.recent_predictions(stored, 1)).first()
    assert (view["proba"], view["detected_type"], view["translated"], view["top_keywords"]) == (0.988, "", "Oui", "fumée (100.0%)")


@pytest.mark.parametrize("query, hits", [
    ("file_2", 1), ("FILE", 7), ("text 3", 1), ("50%", 6), ("t_xt 1", 1), ("back\\slash", 7), ("\\x", 0), ("zzz", 0), ("é", 0),
])
def test_history_search(spark, tmp_path, query, hits):
    path = str(tmp_path / "history")
    h.append_history(h.history_rows(predictions(spark, ROWS), "r1", F.col("at"), ["n"]), path)
    h.append_history(h.history_rows(predictions(spark, ROWS[:1]), "r2", datetime(2023, 5, 5), ["n"]), path)
    assert h.search_predictions(h.read_history(spark, path), query).count() == hits


def test_empty_history(spark, tmp_path):
    path = str(tmp_path / "history")
    h.append_history(h.history_rows(predictions(spark, ROWS), "r1", F.col("at"), ["n"]).limit(0), path)
    stored = spark.createDataFrame([], h.HISTORY_SCHEMA)
    assert h.recent_predictions(stored).count() == 0 and h.search_predictions(stored, "x").count() == 0
