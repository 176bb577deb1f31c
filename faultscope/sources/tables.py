"""Tables in and out: event archives, CSV with explicit nulls, reports, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from faultscope.session import path_exists

# Texts that mean a missing value in a CSV cell.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

EVENT_SCHEMA = T.StructType([
    T.StructField("date_received", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("device", T.ArrayType(T.StructType([
        T.StructField("brand_name", T.StringType()),
        T.StructField("generic_name", T.StringType()),
    ]))),
    T.StructField("mdr_text", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
])
RAW_SCHEMA = T.StructType([
    T.StructField(c, T.StringType()) for c in ("date_received", "event_type", "brand_name", "generic_name", "event_text")
])
PROCESSED_SCHEMA = T.StructType([
    T.StructField("event_text", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("date_received", T.StringType()),
])
METRICS_SCHEMA = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("n_samples", T.LongType()),
])


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Nested events, one JSON object per line. Broken lines keep their text in ``_corrupt_record``."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(marked).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_event_archive(events: DataFrame, path: str) -> None:
    """One JSON object per line; an older archive is replaced."""
    events.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """UTF-8 CSV with a header whose quoted cells may hold line breaks and doubled quotes.

    Everything is read as text and listed null tokens become null; a schema, if given, selects
    and casts columns by name, with null for what does not parse. Files with line breaks in
    cells cannot be split, so write large inputs to Parquet once."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8",
                         nullValue="", emptyValue="", inferSchema=False)
    cells = [F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    df = raw.select(*cells)
    if schema is None:
        return df
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])


def write_csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """UTF-8 CSV with a header and doubled quotes. Without ``overwrite`` existing output stays.
    Cells are written as they are, outer blanks included."""
    (df.write.mode("overwrite" if overwrite else "ignore")
       .csv(path, header=True, quote='"', escape='"', quoteAll=True, encoding="UTF-8", emptyValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))


def write_table(df: DataFrame, path: str, force: bool = True) -> None:
    """The working format. Without ``force`` an existing table is left alone."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A Parquet or CSV table by its name, None when it does not exist or has no rows. A table that is there
    and cannot be read is an error."""
    if not path_exists(spark, path):
        return None
    df = read_csv(spark, path, schema) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return None if df.isEmpty() else df


def read_texts(spark: SparkSession, path: str, row_id: str) -> DataFrame:
    """A Parquet table for work that is heavy per row. A table in fewer pieces than half the cores
    (a small file, say) is spread by ``row_id`` first; larger ones are read as they are."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, row_id) if df.rdd.getNumPartitions() <= cores // 2 else df


def load_main_dataset(
    spark: SparkSession, processed: list[str], raw: list[str], required: bool = False
) -> DataFrame:
    """The first processed table with rows, else the first raw one, else an empty processed table.

    ``required`` raises when there is nothing."""
    for path in [*processed, *raw]:
        df = read_table(spark, path)
        if df is not None:
            return df
    if required:
        raise FileNotFoundError(f"no table with rows among {[*processed, *raw]}")
    return spark.createDataFrame([], PROCESSED_SCHEMA)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path, multiLine=True)


def write_text_document(spark: SparkSession, text: str, path: str) -> None:
    """A small document, such as a report formatted on the driver, through the cluster's storage."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Byte-exact MD5 per file, for files that fit one row; content checksums of any size are
    ``quality.fingerprint``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.md5("content").alias("file_md5"))
