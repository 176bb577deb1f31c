"""Incident-shaped tables derived from the generic test tables, whole tables at a time."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from faultscope.sources.tables import read_texts

DEVICE_PHRASES = [
    "MRI", "CT unit", "x-ray", "ultrasound", "ventilator", "anesthesia", "infusion pump", "defibrillator",
    "pacemaker", "dialysis", "endoscope", "ECG monitor", "wheelchair",
]
TROUBLE_PHRASES = [
    "fire seen", "short circuit", "overheating", "injuries reported", "décès constaté", "panne totale",
    "stopped twice", "low risk", "no defect", "arrêt net", "fumée noire", "severe cardiac event", "injur",
    "brûlure", "x_fire", "Death",
]
EQUIPMENT = [
    "Défibrillateur", "Ventilateur", "Pompe à perfusion", "Scanner", "IRM", "Autoclave", "Moniteur patient",
    "Rayons X", "Incubateur néonatal", "Machine de dialyse", "Bistouri électrique", "Aspirateur chirurgical",
    "Échographe", "Pousse-seringue", "Brancard",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW_IDS = {"documents": "doc_id", "pages": "page_id"}


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return read_texts(spark, f"{sf_dir}/{name}.parquet", ROW_IDS[name])


def pick(words: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(number, F.lit(len(words))).cast("int"))


def device_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with one or two device phrases."""
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.concat_ws(" ", "p_name", pick(DEVICE_PHRASES, F.col("p_partkey")), F.lit("near"),
                    pick(DEVICE_PHRASES, F.col("p_size"))).alias("event_text"),
        F.col("p_brand").alias("brand_name"),
    )


def trouble_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", F.concat_ws(" ", "p_name", pick(TROUBLE_PHRASES, F.col("p_partkey"))).alias("event_text"))


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event per order: its parts are the devices, its line remarks the narratives."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    remark = F.when(F.col("l_returnflag") == "N", "").otherwise(
        F.concat_ws(" ", F.lit("line"), "l_linenumber", F.lit("of"), "p_type", F.lit("returned"), "l_returnflag"))
    per_order = (
        lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
        .groupBy("l_orderkey").agg(
            F.collect_list(F.struct(
                F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("p_brand")).alias("brand_name"),
                F.col("p_name").alias("generic_name"))).alias("device"),
            F.transform(F.sort_array(F.collect_list(remark)), lambda t: F.struct(t.alias("text"))).alias("mdr_text"),
        )
    )
    return orders.join(per_order, orders["o_orderkey"] == per_order["l_orderkey"], "left").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("date_received"),
        F.col("o_orderstatus").alias("event_type"), "device", "mdr_text")


def dated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated incidents; partial orders have no severity."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("date_dt"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("event_type"),
        F.col("o_orderpriority").alias("TypeDetecte"))


def labelled_documents(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", F.col("text").alias("event_text"), F.col("source").alias("event_type"), "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id", how)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in [0, 1] made of their length; many share a score."""
    docs = labelled_documents(spark, sf_dir)
    score = F.least(F.lit(1.0), F.floor(F.col("n_chars") / 50).cast("double") / 64)
    return docs.select("doc_id", "label", score.alias("proba")).withColumn("pred", (F.col("proba") >= 0.5).cast("int"))


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as predictions, each with its own second."""
    turns = table(spark, sf_dir, "conversations")
    chars = F.char_length("text")
    first = F.get(F.split(F.col("text"), " "), F.lit(0))
    return turns.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", "input").otherwise("doc").alias("source"),
        F.when(F.col("role") != "user", F.concat_ws("_", F.lit("Case"), "conv_id", "turn")).alias("file_name"),
        F.col("text").alias("input_text"), F.col("text").alias("cleaned_text"),
        F.lit("TFIDF").alias("model_type"),
        F.when(chars >= 200, "Critique").otherwise("Pas critique").alias("label"),
        (F.pmod(chars, F.lit(1000)) / 1000).cast("double").alias("proba"),
        F.when(F.col("turn") > 0, "Autre").alias("detected_type"),
        F.lit("fr").alias("src_lang"),
        (F.col("turn") == 1).cast("int").alias("translated"),
        F.when(F.col("turn") < 2, F.array(F.struct(first.alias("word"), F.lit(62.5).alias("pct")),
                                          F.struct(F.lit("été").alias("word"), F.lit(37.5).alias("pct")))).alias("top_keywords"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn")).alias("at"),
    )


@F.pandas_udf(T.BinaryType())
def docx_bytes(texts: pd.Series) -> pd.Series:
    """Minimal word-processor files, one paragraph per line."""

    def build(text: str) -> bytes:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as package:
            package.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    return texts.map(build)


def uploaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every supported kind as ``(name, content)``."""
    pages = texts(spark, sf_dir, "pages").select(
        F.concat_ws("", F.lit("page_"), "page_id", F.lit(".HTML")).alias("name"), F.col("html").cast("binary").alias("content"))
    props = table(spark, sf_dir, "events").select(
        F.concat_ws("", F.lit("event_"), "event_id", F.lit(".json")).alias("name"), F.col("props").cast("binary").alias("content"))
    lines = F.concat_ws("\n", F.lit("line,flag,qty"), F.array_sort(F.collect_list(
        F.concat_ws(",", "l_linenumber", F.concat(F.lit('"'), F.col("l_returnflag"), F.lit(' ok"')), "l_quantity"))))
    sheets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("body")).select(
        F.concat_ws("", F.lit("order_"), "l_orderkey", F.lit(".csv")).alias("name"), F.col("body").cast("binary").alias("content"))
    letters = table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", F.lit("turn"), "conv_id", F.concat("turn", F.lit(".docx"))).alias("name"), docx_bytes("text").alias("content"))
    notes = table(spark, sf_dir, "documents").select(
        F.concat_ws("", F.lit("note_"), "doc_id", F.lit(".txt")).alias("name"),
        F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE"))).alias("content"))
    scans = table(spark, sf_dir, "benchmark").select(
        F.concat_ws("", F.lit("scan_"), "item_id", F.lit(".png")).alias("name"), F.col("text").cast("binary").alias("content"))
    files = pages.union(props).union(sheets).union(letters).union(notes).union(scans)
    # a fixed number of partitions, as small results of the grouping would else end up in one
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
