"""Structured Streaming jobs. Each returns a started query; stop or await it as usual."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultscope.plans.scoring import Embedder, Translator, score_documents
from faultscope.sources.history import append_history, history_rows


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream. Time stamps without a zone become UTC instants,
    which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    df = reader.parquet(path)
    zoneless = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def score_stream(
    texts: DataFrame, model: PipelineModel, name: str, text: str, ts: str, history_path: str, checkpoint: str,
    translator: Translator | None = None, max_chars: int | None = None, source: str = "input",
    embedder: Embedder | None = None, keyword_model: PipelineModel | None = None, **trigger,
) -> StreamingQuery:
    """Scores incoming texts with keywords and appends them to the history, exactly once.

    Every row gives one history row, also where names repeat: rows carry a number of their own through
    the one pass that scores them. ``ts`` is the row's own time stamp, and a run is named by query and batch, so a batch repeated
    after a failure replaces what it had written and other streams' rows stay."""

    def append(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        numbered = batch.select(
            F.monotonically_increasing_id().alias("stream_row"), F.col(name).alias("stream_name"),
            F.col(text).alias("stream_text"), F.col(ts).alias("stream_ts"))
        rows = score_documents(
            numbered, model, "stream_name", "stream_text", source, translator=translator, max_chars=max_chars,
            keep=("stream_row", "stream_ts"), embedder=embedder, keyword_model=keyword_model)
        append_history(history_rows(rows, f"stream-{query}-{batch_id:08d}", F.col("stream_ts"), ["stream_row"]), history_path)

    return texts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def dedup_stream(events: DataFrame, keys: list[str], ts: str, delay: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each key once however often it is delivered; keys are forgotten after ``delay``."""
    unique = events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def daily_counts(events: DataFrame, ts: str, groups: list[str], delay: str = "1 day") -> DataFrame:
    """Running counts per day."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("day"), *groups).agg(
        F.count(F.lit(1)).alias("incidents")).select(F.to_date("day.start").alias("day"), *groups, "incidents")


def monthly_counts(events: DataFrame, ts: str, groups: list[str]) -> DataFrame:
    """Running counts per month. The state is one row per month and group."""
    month = F.to_date(F.date_trunc("month", ts)).alias("month")
    return events.groupBy(month, *groups).agg(F.count(F.lit(1)).alias("incidents"))


def publish_counts(counts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the latest full result of a running count in one table (complete mode): counts are
    few, and windows that are still open are included."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(replace).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
