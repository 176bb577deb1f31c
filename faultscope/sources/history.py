"""The prediction history: an append-only Parquet table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from faultscope.functions.dates import iso_utc
from faultscope.functions.keywords import keywords_from_json, keywords_to_json, keywords_to_text
from faultscope.functions.text import ensure_str

# Stored columns; ``ts_date`` and ``run`` are partitions.
HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("cleaned_text", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("proba", T.DoubleType()),
    T.StructField("detected_type", T.StringType()),
    T.StructField("src_lang", T.StringType()),
    T.StructField("translated", T.IntegerType()),
    T.StructField("top_keywords", T.StringType()),
    T.StructField("ts_date", T.DateType()),
    T.StructField("run", T.StringType()),
])
LISTED = [
    "id", "ts", "source", "file_name", "model_type", "label", "proba", "detected_type", "src_lang", "translated",
    "top_keywords",
]


def history_rows(predictions: DataFrame, run: str, ts: datetime | Column, row_key: list[str]) -> DataFrame:
    """Predictions in stored form: id from run and row key, UTC second time stamp, keywords as JSON.

    The same run always gives the same ids, so that a repeated job writes the same rows."""
    stamp = ts if isinstance(ts, Column) else F.lit(ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return predictions.select(
        F.xxhash64(F.lit(run), *row_key).alias("id"),
        iso_utc(stamp).alias("ts"),
        "source", "file_name", "input_text", "cleaned_text", "model_type", "label",
        F.col("proba").cast("double").alias("proba"),
        "detected_type", "src_lang",
        F.col("translated").cast("int").alias("translated"),
        keywords_to_json(F.col("top_keywords")).alias("top_keywords"),
        F.to_date(F.substring(iso_utc(stamp), 1, 10)).alias("ts_date"),  # the date of the stored text
        F.lit(run).alias("run"),
    )


def append_history(rows: DataFrame, path: str) -> None:
    """Adds rows of ``history_rows``. Partitions are (date, run): a run that is repeated after a
    failure replaces its own rows and nobody else's."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("ts_date", "run").parquet(path))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def recent_predictions(history: DataFrame, limit: int = 200) -> DataFrame:
    """The latest rows, ties by id. Rows per date, which come from partition values and file
    footers, tell the earliest date needed, so older partitions are not read."""
    per_date = history.groupBy("ts_date").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("ts_date")).collect()
    since, rows = None, 0
    for day in per_date:
        since, rows = day["ts_date"], rows + day["n"]
        if rows >= limit:
            break
    if since is not None:
        history = history.filter(F.col("ts_date") >= F.lit(since))
    return _listed(history.orderBy(F.desc("ts"), F.asc("id")).limit(limit))


def search_predictions(history: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """The latest rows whose file name or text holds the query, ignoring ASCII case. ``%`` and
    ``_`` in the query match anything; a backslash is a plain character."""
    pattern = "%" + _ascii_lower(query).replace("\\", "\\\\") + "%"

    def holds(c: str) -> Column:
        return F.translate(ensure_str(F.col(c)), _UPPER, _UPPER.lower()).like(pattern)

    found = history.filter(holds("file_name") | holds("input_text"))
    return _listed(found.orderBy(F.desc("ts"), F.asc("id")).limit(limit))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ascii_lower(text: str) -> str:
    return "".join(c.lower() if c in _UPPER else c for c in text)


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select(*LISTED[:-1], keywords_from_json(F.col("top_keywords")).alias("top_keywords"))


def history_view(listed: DataFrame) -> DataFrame:
    """The list as shown: three decimals, blanks for missing values, first five keywords."""
    return listed.select(
        "id", "ts", "source",
        ensure_str(F.col("file_name")).alias("file_name"),
        "model_type", "label",
        F.round("proba", 3).alias("proba"),
        ensure_str(F.col("detected_type")).alias("detected_type"),
        ensure_str(F.col("src_lang")).alias("src_lang"),
        F.when(F.col("translated") == 1, "Oui").otherwise("Non").alias("translated"),
        keywords_to_text(F.col("top_keywords")).alias("top_keywords"),
    )
