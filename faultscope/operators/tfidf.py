"""Term counts, vocabulary, TF-IDF weights and keyword shares as plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.functions.terms import hashed_terms, listed_terms
from faultscope.functions.text import clean_text, word_ngrams, words
from faultscope.session import broadcast_if_small, materialize

# Sides up to this many narrow rows are broadcast; beyond it, that many of the most frequent terms are.
BROADCAST_TERMS = 1_000_000


def add_grams(df: DataFrame, text: str, ngrams: tuple[int, int] = (1, 2), cleaned: bool = False) -> DataFrame:
    """Adds ``grams``: all n-grams of the cleaned text, in order, with repeats."""
    clean = F.col(text) if cleaned else clean_text(F.col(text))
    # Words are a column of their own, so that they are split once and not once per use.
    return df.withColumn("tokens", words(clean)).withColumn("grams", word_ngrams(F.col("tokens"), *ngrams)).drop("tokens")


def _in_order(df: DataFrame, grams: str) -> DataFrame:
    """Adds the sorted grams and where each run of equal ones starts. Both are columns of their own, so that
    texts are cleaned and sorted once and not once for each gram."""
    g = F.col("_sorted")
    positions = F.when(F.size(g) > 0, F.sequence(F.lit(0), F.size(g) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(positions, lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))
    return df.withColumn("_sorted", F.sort_array(grams)).withColumn("_starts", starts)


def _runs() -> Column:
    g, s = F.col("_sorted"), F.col("_starts")
    return F.transform(s, lambda at, j: F.struct(
        F.get(g, at).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(g)) - at).alias("tf")))


def add_runs(df: DataFrame, grams: str = "grams") -> DataFrame:
    """Adds ``runs``: the distinct grams of a row with their counts, as an array of ``term`` and ``tf``. Counted inside
    the row: sorted grams fall into runs, and a run's length is the count."""
    return _in_order(df, grams).withColumn("runs", _runs()).drop("_sorted", "_starts")


def count_terms(df: DataFrame, row_id: str, grams: str = "grams") -> DataFrame:
    """Postings ``(row_id, term, tf)``. No shuffle; each document emits every term once."""
    return _in_order(df.select(row_id, grams), grams).select(row_id, F.inline(_runs()))


def text_postings(df: DataFrame, text: str, row_id: str, ngrams: tuple[int, int] = (1, 2), cleaned: bool = False) -> DataFrame:
    """``(row_id, hash, term, tf)``: the postings of ``count_terms``, cut and counted in Arrow batches."""
    return df.select(row_id, listed_terms(text, ngrams, cleaned).alias("t")).select(row_id, F.inline("t"))


def hash_postings(df: DataFrame, text: str, row_id: str, ngrams: tuple[int, int] = (1, 2)) -> DataFrame:
    """``(row_id, hash, tf)``: the postings of ``text_postings`` without their terms."""
    arrays = df.select(row_id, hashed_terms(text, ngrams).alias("h"))
    return arrays.select(row_id, F.inline(F.arrays_zip(F.col("h.terms").alias("hash"), F.col("h.tfs").alias("tf"))))


def fit_vocabulary(
    postings: DataFrame, n_docs: int, min_df: int = 1, max_features: int | None = None, label: str = "vocabulary", key: str = "term"
) -> DataFrame:
    """``(term, df, cf, idf)`` of the training documents as a written table, for another ``key`` under its name.

    ``idf = ln((1 + n) / (1 + df)) + 1``. ``max_features`` keeps the terms with the highest total
    count, ties by term: a histogram of log-scaled counts (a few hundred bins) first drops the
    bulk of rare terms, so that the final sort only sees about as many terms as it keeps."""
    stats = postings.groupBy(key).agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf")
    ).filter(F.col("df") >= min_df)
    if max_features is not None:
        stats = materialize(stats, f"{label}-terms")
        size = F.floor(F.log2(F.col("cf").cast("double")) * 8)
        bins = stats.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
        smallest, kept = 0, 0
        for row in bins:
            smallest, kept = row["size"], kept + row["n"]
            if kept >= max_features:
                break
        stats = stats.filter(size >= smallest).orderBy(F.desc("cf"), F.asc(key)).limit(max_features)
    idf = F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return materialize(stats.withColumn("idf", idf), label)


def frequent_from(terms: DataFrame, most: int) -> int | None:
    """The least ``df`` that at most ``most`` terms reach, by a histogram of log-scaled frequencies; None if there is none."""
    size = F.floor(F.log2(F.col("df").cast("double")) * 8)
    bins = terms.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("least")).orderBy(F.desc("size")).collect()
    least, n = None, 0
    for row in bins:
        n += row["n"]
        if n > most or row["least"] is None:
            break
        least = row["least"]
    return least


def split_terms(postings: DataFrame, terms: DataFrame, max_broadcast: int = BROADCAST_TERMS, key: str = "term") -> list[DataFrame]:
    """The inner join on ``key``, as parts. Of a large table the most frequent terms are broadcast and only postings of
    the others are exchanged, of which none can be in many documents: it has fewer than all ``max_broadcast`` common ones."""
    side, small = broadcast_if_small(terms, max_broadcast)
    if small:
        return [postings.join(side, key)]
    least = frequent_from(terms, max_broadcast)
    if least is None:
        return [postings.join(terms, key)]
    common = F.broadcast(terms.where(F.col("df") >= least))
    return [postings.join(common, key), postings.join(common.select(key), key, "left_anti").join(terms.where(F.col("df") < least), key)]


def join_terms(postings: DataFrame, terms: DataFrame, spread: Column | None = None, max_broadcast: int = BROADCAST_TERMS, key: str = "term") -> DataFrame:
    """Inner join on ``key``; postings of unknown terms drop out. ``spread`` is no longer needed."""
    return reduce(DataFrame.unionByName, split_terms(postings, terms, max_broadcast, key))


def weigh(postings: DataFrame, vocabulary: DataFrame, row_id: str, normalise: bool = True, key: str = "term") -> DataFrame:
    """``(row_id, term, weight)`` with ``tf * idf``, scaled to unit length per document."""
    raw = join_terms(postings, vocabulary.select(key, "df", "idf"), key=key).select(
        row_id, "term", (F.col("tf") * F.col("idf")).alias("weight"))
    if not normalise:
        return raw
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(row_id)))
    return raw.withColumn("weight", F.col("weight") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def document_norms(postings: DataFrame, vocabulary: DataFrame, row_id: str, key: str = "term") -> DataFrame:
    """Terms known to the vocabulary and Euclidean length per document that has any. Postings of frequent
    terms are summed up where they are."""
    weight = F.col("tf") * F.col("idf")
    parts = [
        p.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"), F.sum(weight * weight).alias("squares"))
        for p in split_terms(postings, vocabulary.select(key, "df", "idf"), key=key)]
    return reduce(DataFrame.unionByName, parts).groupBy(row_id).agg(F.sum("n").alias("n_terms"), F.sqrt(F.sum("squares")).alias("norm"))


def top_keywords(postings: DataFrame, vocabulary: DataFrame, row_id: str, k: int = 15, key: str = "term") -> DataFrame:
    """``(row_id, rank, word, pct)``: the k heaviest terms of a document and their share of the
    weight of those k, in percent to one place. The document length cancels in the share."""
    return rank_weights(weigh(postings, vocabulary, row_id, normalise=False, key=key), row_id, k)


def rank_weights(weights: DataFrame, row_id: str, k: int) -> DataFrame:
    """``top_keywords`` of ``(row_id, term, weight)``. The filter on the rank keeps k rows per document before anything is shuffled."""
    by_weight = Window.partitionBy(row_id).orderBy(F.desc("ranked"), F.asc("term"))
    top = (
        weights
        .withColumn("ranked", F.round("weight", 9))  # equal weights stay equal whatever the summation
        .withColumn("rank", F.row_number().over(by_weight)).filter(F.col("rank") <= k)
    )
    total = F.sum("weight").over(Window.partitionBy(row_id))
    share = F.round(100 * F.col("weight") / F.when(total == 0, F.lit(1.0)).otherwise(total), 1)
    return top.select(row_id, "rank", F.col("term").alias("word"), share.alias("pct"))


def keyword_lists(keywords: DataFrame, row_id: str) -> DataFrame:
    """One row per document with its ordered keyword list; at most k entries each."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word", "pct")))
    return keywords.groupBy(row_id).agg(
        F.transform(ordered, lambda k: F.struct(k["word"].alias("word"), k["pct"].alias("pct"))).alias("top_keywords"))
