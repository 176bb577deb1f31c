"""Similar past cases by TF-IDF cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.functions.text import ensure_str
from faultscope.operators.case_index import build_index, drop_tables, search
from faultscope.session import broadcast_if_small, materialize, scratch_path


def similar_cases(
    history: DataFrame,
    queries: DataFrame,
    vocabulary: DataFrame | None = None,
    row_id: str = "doc_id",
    text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    k: int = 10,
    ngrams: tuple[int, int] = (1, 2),
) -> DataFrame:
    """``(query_id, rank, row_id, similarity)``: the k most similar history rows of every query.

    One search of an index that is made for it in the scratch folder; ``case_index.build_index`` keeps one for
    many searches. Term weights are those of the history itself or of a ``vocabulary`` (``term``, ``idf``).
    Queries without a known term get no rows; others always get k if the history is that long,
    filled with rows of similarity 0 in ``row_id`` order."""
    spark = history.sparkSession
    index = build_index(history, scratch_path(spark, "case-index"), row_id, text, ngrams, vocabulary)
    found = materialize(search(index, queries, query_id, query_text, k).cases, "similar-cases")
    drop_tables(spark, index)
    return found


def excerpt(c: Column, chars: int = 200) -> Column:
    whole = ensure_str(c)
    return F.when(F.char_length(whole) > chars, F.concat(F.substring(whole, 1, chars), F.lit("…"))).otherwise(whole)


def similar_case_view(cases: DataFrame, history: DataFrame, row_id: str, query_id: str, text: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """The cases as shown: similarity in percent, date, detected type, and a short excerpt.

    The cases are few per query, so they go to the history rows and not the other way round."""
    side, _ = broadcast_if_small(materialize(cases, "similar-cases"), max_broadcast)
    date = next((ensure_str(F.col(c)) for c in ("date_received", "date_dt") if c in history.columns), F.lit(""))
    kind = ensure_str(F.col("TypeDetecte")) if "TypeDetecte" in history.columns else F.lit("")
    return history.join(side, row_id).select(
        query_id, "rank", row_id,
        F.round(100 * F.col("similarity"), 1).alias("similarity_pct"),
        date.alias("date"), kind.alias("detected_type"), excerpt(F.col(text)).alias("excerpt"),
    )
