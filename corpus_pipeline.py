"""A training corpus from raw documents: each stage keeps what the next one works on.

Toxic documents go; of each class of near duplicates the document of the smallest id stays; personal
data are replaced; documents are sampled to balanced sources, languages and topics; the rest is packed
into token sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.llm import mixing, near_dedup, packing, pii, toxicity
from faultscope.llm.common import table
from faultscope.llm.queries import vocabulary
from faultscope.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Labels are joined to the raw documents."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(toxicity.score_column(F.col("text"), model, spark) < 0.5)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class; of repeated rows of it, one. A null id is in no class."""
    kept = near_dedup.near_duplicates(docs).where("doc_id = class_id").select("doc_id").distinct()
    known = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_class),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Learned scores, sampled similarities and tokens cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
