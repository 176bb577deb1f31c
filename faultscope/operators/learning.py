"""Severity classifiers as Spark ML models: TF-IDF or embeddings, logistic regression or forest."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from faultscope.functions.text import decision_label
from faultscope.operators import forest
from faultscope.operators.term_table import TermTable, fit_term_table, strongest_terms
from faultscope.session import path_exists

# Logistic regression runs a job per iteration, so a small training set is kept in few tasks.
ROWS_PER_TASK = 10_000


@dataclass(frozen=True)
class Preset:
    """Training settings; the defaults are those of the plain training run."""

    classifier: str = "logreg"
    ngrams: tuple[int, int] = (1, 2)
    min_df: int = 1
    max_features: int | None = 50_000
    C: float = 1.0
    max_iter: int = 200
    trees: int = 300
    max_depth: int = 30
    seed: int = 42


MINIMAL = Preset()
FULL = Preset(min_df=2, max_features=20_000, max_iter=2000)
FULL_FOREST = Preset(classifier="rf", min_df=2, max_features=20_000)
FOREST = Preset(classifier="rf", max_features=20_000)
WHOLE_VOCABULARY = Preset(max_features=None, max_iter=2000)


def classifier(preset: Preset, n_rows: int, features: str = "features", label: str = "label"):
    """An unfitted classifier. The penalty is the one of ``C`` on a summed loss, spread over rows."""
    if preset.classifier == "logreg":
        return LogisticRegression(
            featuresCol=features, labelCol=label, regParam=1.0 / (preset.C * n_rows), elasticNetParam=0.0,
            standardization=False, maxIter=preset.max_iter,
        )
    if preset.classifier == "rf":
        return RandomForestClassifier(
            featuresCol=features, labelCol=label, numTrees=preset.trees, maxDepth=preset.max_depth,
            featureSubsetStrategy="sqrt", seed=preset.seed,
        )
    raise ValueError(f"unknown classifier {preset.classifier!r}")


def train_text_classifier(
    train: DataFrame, text: str, label: str, row_id: str, preset: Preset = MINIMAL, cleaned: bool = False
) -> PipelineModel:
    """A fitted model of two stages, texts to vectors (``TermTable``) and these to ``probability``; see ``score_texts``
    for use. The model holds its n-grams and its vocabulary; the latter never passes through the driver."""
    n_rows = train.count()
    table = fit_term_table(train, text, row_id, n_rows, preset.ngrams, preset.min_df, preset.max_features, cleaned)
    prepared = table.weigh(train, text, cleaned).select("features", F.col(label).cast("double").alias(label))
    return PipelineModel([table, _fit(classifier(preset, n_rows, label=label), prepared, n_rows)])


def _fit(estimator, prepared: DataFrame, n_rows: int):
    """Fits on persisted features, spread over the cores, or over fewer tasks if the work per
    iteration is small. Features that already come in more pieces keep them. They are kept on disk, as both
    classifiers make their own form of them and hold that in memory."""
    cores = prepared.sparkSession.sparkContext.defaultParallelism
    tasks = -(-n_rows // ROWS_PER_TASK) if isinstance(estimator, LogisticRegression) else cores
    if n_rows < cores * ROWS_PER_TASK:
        prepared = prepared.repartition(tasks)
    prepared = prepared.persist(StorageLevel.DISK_ONLY)
    try:
        return forest.fit(estimator, prepared, n_rows) if isinstance(estimator, RandomForestClassifier) else estimator.fit(prepared)
    finally:
        prepared.unpersist()


def explain_texts(df: DataFrame, model: PipelineModel, text: str, k: int = 15, cleaned: bool = False) -> DataFrame:
    """Adds ``top_keywords`` under the model's vocabulary, without a score."""
    weighed = model.stages[0].weigh(df, text, cleaned)
    return weighed.withColumn("top_keywords", strongest_terms(F.col("weighted_terms"), k)).select(*df.columns, "top_keywords")


def score_texts(
    df: DataFrame, model: PipelineModel, text: str, threshold: float = 0.5, cleaned: bool = False, keywords: int | None = None,
) -> DataFrame:
    """Adds ``proba`` of class 1, ``pred`` and the label shown to users; with ``keywords`` also that many
    ``top_keywords`` of the same text: its heaviest terms and their share. Texts are cut as in training.
    One pass without a shuffle while the vocabulary is of a size to share."""
    table = model.stages[0]
    scored = PipelineModel(model.stages[1:]).transform(table.weigh(df, text, cleaned))
    listed = [] if keywords is None else [strongest_terms(F.col("weighted_terms"), keywords).alias("top_keywords")]
    return _with_decision(scored.withColumn("proba", vector_to_array("probability")[1]), threshold).select(
        *df.columns, "proba", "pred", "label_text", *listed)


def _with_decision(df: DataFrame, threshold: float) -> DataFrame:
    return df.withColumn("pred", (F.col("proba") >= threshold).cast("int")).withColumn(
        "label_text", decision_label(F.col("proba"), threshold))


def embed_texts(df: DataFrame, text: str, embedder: Callable[[list[str]], "object"], batch: int = 16) -> DataFrame:
    """Adds ``embedding`` by a caller's model: a function from texts to a (texts x size) array.

    It runs in Arrow batches, ``batch`` texts at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for chunk in chunks:
            texts = chunk.fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder(texts[i:i + batch])]
            yield pd.Series([[float(x) for x in v] for v in vectors])

    return df.withColumn("embedding", embed(F.col(text)))


def train_embedding_classifier(train: DataFrame, embedding: str, label: str, preset: Preset = Preset(max_iter=2000)) -> PipelineModel:
    """Logistic regression on dense vectors."""
    n_rows = train.count()
    prepared = _dense(train, embedding).select("features", F.col(label).cast("double").alias(label))
    return PipelineModel([_fit(classifier(preset, n_rows, label=label), prepared, n_rows)])


def score_embeddings(df: DataFrame, model: PipelineModel, embedding: str, threshold: float = 0.5) -> DataFrame:
    scored = model.transform(_dense(df, embedding)).withColumn("proba", vector_to_array("probability")[1])
    return _with_decision(scored, threshold).select(*df.columns, "proba", "pred", "label_text")


def _dense(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))


def save_model(model: PipelineModel, path: str) -> None:
    """Writes a model in place of what is at ``path``, which may be this model itself."""
    spark = SparkSession.active()
    stages = [s.apart_from(path, spark) if isinstance(s, TermTable) else s for s in model.stages]
    PipelineModel(stages).write().overwrite().save(path)


def load_model(spark: SparkSession, path: str, fallback: str | None = None) -> PipelineModel:
    """The model saved last at a path; ``fallback`` is read where there is no such path. A model that is there but
    cannot be read is an error."""
    return PipelineModel.load(path if fallback is None or path_exists(spark, f"{path}/metadata") else fallback)
