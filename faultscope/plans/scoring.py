"""Score texts and documents and put the results into the history."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.functions.rules import OTHER_TYPE, device_type
from faultscope.functions.text import ANY_TEXT, NO_SPACE, clean_text, clip_text, ensure_str, guess_language
from faultscope.operators.learning import embed_texts, explain_texts, score_embeddings, score_texts
from faultscope.operators.prepare import drop_blank
from faultscope.session import materialize

Translator = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], "object"]
KEYWORDS = "array<struct<word:string,pct:double>>"
# Language choices offered to users.
LANGUAGE_CHOICES = {"Auto": None, "Français": "fr", "Anglais": "en"}


def translate_if_needed(
    df: DataFrame, text: str, choice: str = "Auto", force: bool = True, translator: Translator | None = None, batch: int = 16
) -> DataFrame:
    """Adds ``model_text``, ``src_lang`` and ``translated``.

    English texts, by choice or by guess, go through the translator when ``force`` is set; a
    failed or unchanged translation leaves the text as it was. Without a translator texts stay
    as they are. Others reach the translator as null, at most ``batch`` texts at a time."""
    whole = ensure_str(F.col(text))
    fixed = LANGUAGE_CHOICES[choice]
    source = guess_language(whole) if fixed is None else F.lit(fixed)
    blank = ~whole.rlike(NO_SPACE)
    df = df.withColumn("src_lang", F.when(blank, "fr").otherwise(source))
    if translator is None or not force:
        return df.withColumn("model_text", whole).withColumn("translated", F.lit(0))

    @F.pandas_udf("string")
    def translate(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for chunk in chunks:
            out = chunk.copy()
            asked = chunk.dropna()
            for i in range(0, len(asked), batch):
                part = asked.iloc[i:i + batch]
                try:
                    out.loc[part.index] = translator(part.tolist())
                except Exception:  # the original text is used instead
                    continue
            yield out

    asked = F.when((F.col("src_lang") == "en") & ~blank, whole)
    return df.withColumn("model_text", F.coalesce(translate(asked), whole)).withColumn(
        "translated", (F.col("model_text") != whole).cast("int"))


def explain(df: DataFrame, model: PipelineModel, text: str, row_id: str, k: int = 15) -> DataFrame:
    """Keyword table ``(row_id, rank, word, pct)`` of the texts under the model's vocabulary."""
    listed = materialize(explain_texts(df.select(row_id, text), model, text, k).select(row_id, "top_keywords"), "keywords")
    return listed.select(row_id, F.posexplode("top_keywords").alias("rank", "found")).select(
        row_id, (F.col("rank") + 1).alias("rank"), "found.word", "found.pct")


def _scored(
    df: DataFrame, model: PipelineModel, cleaned: str, threshold: float, k: int | None, embedder: Embedder | None,
    keyword_model: PipelineModel | None,
) -> DataFrame:
    """``proba``, ``label_text`` and ``top_keywords`` of cleaned texts, by a text model or, with an
    ``embedder``, by an embedding model; then keywords come from ``keyword_model`` if there is one."""
    if embedder is None:
        scored = score_texts(df, model, cleaned, threshold, cleaned=True, keywords=k)
        return scored if k is not None else scored.withColumn("top_keywords", F.lit(None).cast(KEYWORDS))
    if keyword_model is not None and k is not None:
        df = explain_texts(df, keyword_model, cleaned, k, cleaned=True)
    else:
        df = df.withColumn("top_keywords", F.lit(None).cast(KEYWORDS))
    return score_embeddings(embed_texts(df, cleaned, embedder), model, "embedding", threshold)


def predict(
    df: DataFrame, model: PipelineModel, text: str, row_id: str, k: int = 10, threshold: float = 0.5,
    return_keywords: bool = True, model_name: str = "tfidf", embedder: Embedder | None = None,
    keyword_model: PipelineModel | None = None,
) -> DataFrame:
    """``(row_id, label, proba, model, keywords)`` per row. With an ``embedder`` the model is one of
    ``train_embedding_classifier`` and keywords need a text model besides."""
    ready = df.select(F.col(row_id).alias("row_id"), clean_text(F.col(text)).alias("cleaned_text"))
    scored = _scored(ready, model, "cleaned_text", threshold, k if return_keywords else None, embedder, keyword_model)
    return scored.select(
        F.col("row_id").alias(row_id), F.col("label_text").alias("label"), "proba", F.lit(model_name).alias("model"),
        F.col("top_keywords").alias("keywords"))


def score_documents(
    documents: DataFrame, model: PipelineModel, name: str, text: str, source: str = "doc", choice: str = "Auto",
    force: bool = True, translator: Translator | None = None, max_chars: int | None = None, k: int = 15,
    threshold: float = 0.5, model_type: str = "TFIDF", compat_language: bool = False, keep: tuple[str, ...] = (),
    embedder: Embedder | None = None, keyword_model: PipelineModel | None = None,
) -> DataFrame:
    """Predictions ready for ``history_rows``: clean-up, translation policy, score, device type and
    keywords per document; documents without text drop out. Every row is scored by itself in one
    pass, so names may repeat. ``keep`` names columns to pass through.

    ``max_chars`` is the length analysed per document, None for the whole text.
    ``compat_language`` records an untranslated text as French under automatic choice.
    ``embedder`` and ``keyword_model`` are those of ``predict``."""
    # the first character that counts tells, before texts are clipped
    clipped = documents.where(F.col(text).cast("string").rlike(ANY_TEXT)).select(
        F.col(name).cast("string").alias("file_name"), clip_text(F.col(text), max_chars).alias("doc_text"), *keep)
    if max_chars is not None:
        clipped = drop_blank(clipped, "doc_text")
    ready = translate_if_needed(clipped, "doc_text", choice, force, translator)
    if translator is not None and force:
        ready = materialize(ready, "translated")  # texts are scored and explained, but translated once
    if compat_language and LANGUAGE_CHOICES[choice] is None:
        ready = ready.withColumn("src_lang", F.when(F.col("translated") == 1, "en").otherwise("fr"))
    ready = ready.withColumn("cleaned_text", clean_text(F.col("model_text")))
    return _scored(ready, model, "cleaned_text", threshold, k, embedder, keyword_model).select(
        F.lit(source).alias("source"),
        "file_name",
        F.col("model_text").alias("input_text"),
        "cleaned_text",
        F.lit(model_type).alias("model_type"),
        F.col("label_text").alias("label"),
        "proba",
        F.coalesce(device_type(F.col("doc_text"), "first"), F.lit(OTHER_TYPE)).alias("detected_type"),
        "src_lang", "translated", "top_keywords", *keep,
    )


def keyword_export(predictions: DataFrame) -> DataFrame:
    """One row per document and keyword, as offered for download. Lists are written first: unnested in one plan with
    their making, a text would be cut anew for each of its terms."""
    return materialize(predictions.select("file_name", "top_keywords"), "keywords").select("file_name", F.inline("top_keywords"))
