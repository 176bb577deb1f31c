"""The heaviest terms of whole texts, without a row for each of their terms.

Texts are dealt to chunks. A chunk sends its distinct term hashes, sorted and with the number of its texts that have them,
as one binary row to each shard of the hashes; a shard adds up what all chunks sent and answers each in the order in which it
asked. A term of every text is sent once by each chunk, so no shard sees a hot key; chunks and shards grow in
number with the texts, not in size. Strings are made only of terms that reach the weight of a text's k-th."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.functions.terms import counted, given_text, gram_hashes, words_of
from faultscope.operators.tfidf import rank_weights
from faultscope.session import materialize

#: Bytes of text in a chunk on average; beyond ``MOST_CHUNKS`` they grow, as binary rows are chunks times shards.
CHUNK, MOST_CHUNKS = 4 << 20, 1 << 14
LEAST = 64
_SIGN = np.uint64(1 << 63)
_REQUEST = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("dfs", pa.binary())])
_BEST = pa.schema([("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _term(words: list[bytes], at: int, ngrams: tuple[int, int]) -> bytes:
    """The term at a place of ``gram_hashes``."""
    for n in range(ngrams[0], ngrams[1] + 1):
        if at <= len(words) - n:
            return b" ".join(words[at:at + n])
        at -= max(0, len(words) - n + 1)
    raise IndexError(at)


def _places(words: list[bytes], ngrams: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of a text, ascending, a place of each in ``gram_hashes``, and their counts."""
    grams = gram_hashes(words, *ngrams)
    order = np.argsort(grams)
    own = grams[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
    return own[first], order[first], np.diff(first, append=len(own))


def _strongest(words: list[bytes], ngrams: tuple[int, int], at: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, bytes]]:
    """The k heaviest terms by their index, ties by term."""
    if len(weights) <= k:
        return [(i, _term(words, at[i], ngrams)) for i in range(len(weights))]
    least = np.partition(weights, -k)[-k]
    over, ties = np.flatnonzero(weights > least).tolist(), np.flatnonzero(weights == least).tolist()
    found = [(i, _term(words, at[i], ngrams)) for i in over]
    tied = heapq.nsmallest(k - len(over), ((_term(words, j, ngrams), i) for i, j in zip(ties, at[ties].tolist(), strict=True)))
    return found + [(i, term) for term, i in tied]


def text_keywords(df: DataFrame, text: str, row_id: str, k: int = 15, ngrams: tuple[int, int] = (1, 2)) -> DataFrame:
    """``(row_id, rank, word, pct)``: what ``top_keywords`` gives for the postings of ``df`` and their whole vocabulary.

    A term's frequency is the number of rows that have it. Rows of equal id, also of a null one, are ranked together; texts
    that are null or without terms give no row."""
    kept = materialize(df.select(F.col(row_id).alias("row_id"), given_text(text, False).alias("text"), F.monotonically_increasing_id().alias("row")), "texts")
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n_docs, n_chunks = size["n"], max(LEAST, min(MOST_CHUNKS, math.ceil(size["b"] / CHUNK)))
    bits = math.ceil(math.log2(max(LEAST, n_chunks / 16)))
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    # The row's own number deals it, so that neither equal ids nor equal texts meet in one chunk.
    dealt = kept.select("row_id", "text", F.pmod(F.xxhash64("row"), F.lit(n_chunks)).cast("int").alias("chunk")).groupBy("chunk")

    def ask(chunk: pa.Table) -> pa.Table:
        _, hashes, _ = counted(chunk["text"].cast(pa.binary()).to_pylist(), ngrams, False)
        own, counts = np.unique(hashes.view(np.uint64) ^ _SIGN, return_counts=True)
        counts, number = counts.astype("<u4"), chunk["chunk"][0].as_py()
        cuts = np.append(np.searchsorted(own, edges), len(own))
        return _table([(s, number, own[a:b].tobytes(), counts[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a], _REQUEST)

    def answer(shard: pa.Table) -> pa.Table:
        asked = [np.frombuffer(h, np.uint64) for h in shard["hashes"].to_pylist()]
        every, counts = np.concatenate(asked), np.concatenate([np.frombuffer(c, "<u4") for c in shard["counts"].to_pylist()])
        order = np.argsort(every)
        sorted_ = every[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        dfs = np.empty(len(every), np.int64)
        dfs[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), first), np.diff(first, append=len(every)))
        told = np.split(dfs, np.cumsum([len(a) for a in asked])[:-1])
        return _table(list(zip(shard["chunk"].to_pylist(), shard["shard"].to_pylist(), [d.tobytes() for d in told], strict=True)), _ANSWER)

    def rank(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        cut = [words_of(t) for t in chunk["text"].cast(pa.binary()).to_pylist()]
        found = [_places(words, ngrams) for words in cut]
        hashes = np.concatenate([np.empty(0, np.int64), *(f[0] for f in found)])
        own, which = np.unique(hashes, return_inverse=True)
        dfs = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(d, np.int64) for d in answers.sort_by("shard")["dfs"].to_pylist())])
        if len(own) != len(dfs):
            raise RuntimeError(f"{len(dfs)} answers to {len(own)} terms")
        mine, rows, best, end = dfs[which], [], [], 0
        idf = np.log((1.0 + n_docs) / (1.0 + mine)) + 1.0
        for i, (words, (_, at, tfs)) in enumerate(zip(cut, found, strict=True)):
            start, end = end, end + len(at)
            top = _strongest(words, ngrams, at, np.round(tfs * idf[start:end], 9), k)
            rows += [i] * len(top)
            best += [(term.decode(), int(tfs[j]), int(mine[start + j])) for j, term in top]
        return _table(best, _BEST).add_column(0, "row_id", chunk["row_id"].take(pa.array(rows, pa.int64())))

    answers = (
        dealt.applyInArrow(ask, "shard int, chunk int, hashes binary, counts binary")
        .groupBy("shard").applyInArrow(answer, "chunk int, shard int, dfs binary"))
    result = T.StructType([kept.schema["row_id"]]).add("term", "string").add("tf", "long").add("df", "long")
    best = dealt.cogroup(answers.groupBy("chunk")).applyInArrow(rank, result)
    idf = F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    weights = best.select("row_id", "term", (F.col("tf") * idf).alias("weight"))
    return rank_weights(weights, "row_id", k).withColumnRenamed("row_id", row_id)
