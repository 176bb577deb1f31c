"""A kept matrix of past cases, searched in place.

An index is a folder. It holds segments of cases, each as two tables bucketed by case id: ``matrix`` (the hashed terms
of a case and their counts) and ``norms`` (what its length is made of), the term frequencies of all cases, and a
manifest for each version. New cases make a new segment; frequencies and lengths change by what they add, no text
is read again, and the tables of earlier versions stay as they are until ``compact`` writes one segment.

With N cases, df of them with a term, idf = ln((1 + N) / (1 + df)) + 1 = L + a, where L = ln(1 + N) and a = 1 - ln(1 + df).
A squared length is L^2 s0 + 2 L s1 + s2 with the sums s0, s1, s2 of tf^2, tf^2 a and tf^2 a^2. New cases change L for
all, which costs nothing, and a for the terms they have, which is a join of these terms with the matrix.

A search sends weighted queries to the tasks that read the matrix. Nothing of the history is exchanged, and
a task returns k cases for each query. Terms are 64-bit hashes: among n terms two agree with a chance of n^2 / 2^65."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.functions.terms import hashed_terms, term_hash
from faultscope.operators.ranking import top_per_group
from faultscope.operators.tfidf import BROADCAST_TERMS, split_terms
from faultscope.session import broadcast_if_small, materialize

#: How terms are hashed (``functions.terms``); an index of another kind is not read.
HASHING = "words-blake2b"
#: Query terms that reach every worker at once; more queries are searched in several passes.
MOST_ENTRIES = 4_000_000
#: Queries that share a bound, and (case, query) sums that a worker holds at once.
BLOCK, HELD_SUMS = 16, 1 << 21


@dataclass(frozen=True)
class CaseIndex:
    path: str
    row_id: str
    kind: str
    ngrams: tuple[int, int]
    buckets: int
    fixed: bool
    version: int = 0
    n_cases: int = 0
    frequencies: str = ""
    segments: tuple[tuple[str, str], ...] = ()
    hashing: str = "xxhash64"

    @property
    def level(self) -> float:
        """L of the docstring above; weights of a fixed vocabulary have it inside."""
        return 0.0 if self.fixed else math.log(1 + self.n_cases)


class Search(NamedTuple):
    """``cases`` are the found rows; ``report`` has one row: ``n_pairs`` of a case and a block of queries with a
    common term, and ``n_skipped`` of these by their bound."""

    cases: DataFrame
    report: DataFrame


def term_arrays(df: DataFrame, row_id: str, text: str, ngrams: tuple[int, int]) -> DataFrame:
    """``row_id``, ``terms`` (hashes, ascending) and ``tfs`` of every row, made inside the row."""
    hashed = hashed_terms(text, ngrams).alias("h")
    return df.select(row_id, hashed).select(row_id, "h.terms", "h.tfs")


# ---- tables of an index

def _write(index: CaseIndex, df: DataFrame, label: str) -> str:
    """A bucketed table in the index folder; its name is its folder."""
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    spread = df.repartition(index.buckets, index.row_id) if label == "matrix" else df
    spread.write.format("parquet").bucketBy(index.buckets, index.row_id).option("path", f"{index.path}/{name}").saveAsTable(name)
    return name


def _table(spark: SparkSession, index: CaseIndex, name: str) -> DataFrame:
    """A table of the index, told to this session's catalog if it does not know it."""
    if not spark.catalog.tableExists(name):
        columns = "terms array<bigint>, tfs array<int>" if name.startswith("matrix") else "s0 double, s1 double, s2 double"
        spark.sql(f"CREATE TABLE {name} (`{index.row_id}` {index.kind}, {columns}) USING parquet "
                  f"CLUSTERED BY (`{index.row_id}`) INTO {index.buckets} BUCKETS LOCATION '{index.path}/{name}'")
    return spark.table(name)


def _frequencies(spark: SparkSession, index: CaseIndex) -> DataFrame:
    return spark.read.schema("term bigint, df bigint, a double").parquet(f"{index.path}/{index.frequencies}")


def _commit(spark: SparkSession, index: CaseIndex) -> CaseIndex:
    """The manifest comes last: a reader sees a whole version or the one before."""
    row = spark.createDataFrame([(json.dumps(asdict(index)),)], "manifest string")
    row.coalesce(1).write.text(f"{index.path}/manifest-{index.version:09d}")
    return index


def load_index(spark: SparkSession, path: str) -> CaseIndex:
    """The last complete version of an index."""
    told = spark.read.text(f"{path}/manifest-*").select("value", F.input_file_name().alias("file")).orderBy(F.desc("file")).first()
    kept = json.loads(told["value"])
    if kept.get("hashing") != HASHING:
        raise ValueError(f"the index at {path} has terms of another hash; build it anew")
    return CaseIndex(**kept | {"path": path, "ngrams": tuple(kept["ngrams"]), "segments": tuple(map(tuple, kept["segments"]))})


def _sums(matrix: DataFrame, row_id: str, terms: DataFrame) -> DataFrame:
    """Per case the sums of tf^2 times ``x0``, ``x1``, ``x2`` of its terms (``term``, ``df`` and these). Frequent terms go to the
    cases and are summed up there; beyond the limit narrow postings go to the terms."""
    postings = matrix.select(row_id, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").cast("array<double>").alias("tf"))))
    parts = [
        p.groupBy(row_id).agg(*[F.sum(F.col("tf") * F.col("tf") * F.col(f"x{i}")).alias(f"d{i}") for i in range(3)])
        for p in split_terms(postings, terms)]
    return reduce(DataFrame.unionByName, parts).groupBy(row_id).agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(3)])


def _lengths(matrix: DataFrame, index: CaseIndex, terms: DataFrame) -> DataFrame:
    """``norms`` of all cases of a segment, also of those without a known term."""
    sums = _sums(matrix, index.row_id, terms.select("term", "df", F.lit(1.0).alias("x0"), F.col("a").alias("x1"), (F.col("a") * F.col("a")).alias("x2")))
    return matrix.select(index.row_id).join(sums, index.row_id, "left").select(index.row_id, *[F.coalesce(f"d{i}", F.lit(0.0)).alias(f"s{i}") for i in range(3)])


def _count(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build_index(
    history: DataFrame, path: str, row_id: str = "doc_id", text: str = "text", ngrams: tuple[int, int] = (1, 2),
    vocabulary: DataFrame | None = None, buckets: int | None = None,
) -> CaseIndex:
    """Writes an index of ``history`` (unique ``row_id``, null texts count as empty) into an empty folder.

    Term frequencies are those of the cases and grow with them, or, with a ``vocabulary`` (``term``, ``idf``), its own,
    for good. ``buckets`` is the number of files of a segment, by default the session's shuffle partitions."""
    spark = history.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = CaseIndex(path, row_id, history.schema[row_id].dataType.simpleString(), tuple(ngrams), n, vocabulary is not None, hashing=HASHING)
    name = _write(index, term_arrays(history, row_id, text, ngrams), "matrix")
    if vocabulary is None:
        frequencies = _count(_table(spark, index, name)).withColumn("a", 1 - F.log(1.0 + F.col("df")))
    else:
        frequencies = vocabulary.select(term_hash("term").alias("term"), F.lit(None).cast("bigint").alias("df"), F.col("idf").cast("double").alias("a"))
    return _with_segment(spark, index, name, frequencies, ())


def _with_segment(spark: SparkSession, index: CaseIndex, name: str, frequencies: DataFrame, earlier: tuple) -> CaseIndex:
    """The next version: ``name`` is the matrix of new cases, ``earlier`` are the other segments with their new lengths."""
    told = f"frequencies_{uuid.uuid4().hex[:12]}"
    frequencies.write.parquet(f"{index.path}/{told}")
    matrix = _table(spark, index, name)
    grown = replace(index, frequencies=told, version=index.version + 1, n_cases=index.n_cases + matrix.count())
    norms = _write(grown, _lengths(matrix, grown, _frequencies(spark, grown)), "norms")
    return _commit(spark, replace(grown, segments=(*earlier, (name, norms))))


def drop_tables(spark: SparkSession, index: CaseIndex) -> None:
    """Takes the index out of the session's catalog; its files stay."""
    for pair in index.segments:
        for name in pair:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def append_cases(spark: SparkSession, index: CaseIndex, more: DataFrame, text: str = "text") -> CaseIndex:
    """The index with further cases, as if it had been built with them. Their ids must be new."""
    name = _write(index, term_arrays(more, index.row_id, text, index.ngrams), "matrix")
    before = _frequencies(spark, index)
    if index.fixed:
        return _with_segment(spark, index, name, before, index.segments)
    added = materialize(_count(_table(spark, index, name)), "added-terms")
    total = before.select("term", "df").unionByName(added).groupBy("term").agg(F.sum("df").alias("df")).withColumn("a", 1 - F.log(1.0 + F.col("df")))
    old, new = F.col("a"), 1 - F.log(1.0 + F.col("df") + F.col("more"))
    changed = before.join(added.withColumnRenamed("df", "more"), "term").select(
        "term", (F.col("df") + F.col("more")).alias("df"), F.lit(0.0).alias("x0"), (new - old).alias("x1"), (new * new - old * old).alias("x2"))
    changed = materialize(changed, "changed-terms")
    earlier = []
    for kept, norms in index.segments:
        moved = _sums(_table(spark, index, kept), index.row_id, changed)
        now = _table(spark, index, norms).join(moved, index.row_id, "left").select(
            index.row_id, *[(F.col(f"s{i}") + F.coalesce(f"d{i}", F.lit(0.0))).alias(f"s{i}") for i in range(3)])
        earlier.append((kept, _write(index, now, "norms")))
    return _with_segment(spark, index, name, total, tuple(earlier))


def compact(spark: SparkSession, index: CaseIndex) -> CaseIndex:
    """One segment in place of many, with the same cases, counts and lengths."""
    if len(index.segments) < 2:
        return index
    parts = [[_table(spark, index, name) for name in pair] for pair in index.segments]
    matrix, norms = (parts[0][k] for k in (0, 1))
    for m, n in parts[1:]:
        matrix, norms = matrix.unionByName(m), norms.unionByName(n)
    pair = (_write(index, matrix, "matrix"), _write(index, norms.repartition(index.buckets, index.row_id), "norms"))
    return _commit(spark, replace(index, version=index.version + 1, segments=(pair,)))


# ---- search

@dataclass
class QueryBlock:
    """Weighted queries by term: for each known term its idf, the queries that have it with their weights, and
    the blocks of ``BLOCK`` queries that have it with the largest weight among them."""

    ids: pa.Array
    terms: np.ndarray
    idf: np.ndarray
    of_term: tuple[np.ndarray, np.ndarray, np.ndarray]
    blocks: tuple[np.ndarray, np.ndarray, np.ndarray]
    k: int

    @classmethod
    def of(cls, rows: pa.Table, k: int) -> QueryBlock:
        lists = rows["entries"].combine_chunks()
        query = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
        term, idf, weight = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("term", "idf", "weight"))
        order = np.lexsort((query, term))
        term, query, weight, idf = term[order], query[order], weight[order], idf[order]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        starts = np.append(first, len(term))
        block = query // BLOCK
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
        most = np.maximum.reduceat(weight, new)
        return cls(rows["id"].combine_chunks(), term[first], idf[first], (starts, query, weight), (np.searchsorted(new, starts), block[new], most), k)

    def __len__(self) -> int:
        return len(self.ids)


def _spread(at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of terms ``at``: which entry, and which place of the term's list."""
    sizes = starts[at + 1] - starts[at]
    entry = np.repeat(np.arange(len(at)), sizes)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[at][entry]


class Best:
    """The k best cases of every query so far; similarities are whole billionths, so that ties are ties."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.least = k, np.ones(n_queries, dtype=np.int64)
        self.query, self.score, self.case = np.empty(0, np.int64), np.empty(0, np.int64), None

    def add(self, query: np.ndarray, score: np.ndarray, case: np.ndarray) -> None:
        query, score = np.concatenate((self.query, query)), np.concatenate((self.score, score))
        case = case if self.case is None else np.concatenate((self.case, case))
        order = np.lexsort((case, -score, query))
        query, score, case = query[order], score[order], case[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        self.query, self.score, self.case = query[kept], score[kept], case[kept]


def scored(block: QueryBlock, best: Best, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, norm: np.ndarray) -> tuple[int, int]:
    """Adds a batch of cases to the best ones; returns how many (case, block of queries) pairs met and were skipped.

    What a case can score with any query of a block is at most the sum over its terms of its weight times the
    largest weight in the block. Pairs whose bound is below all kth scores of the block are not summed up."""
    at = np.searchsorted(block.terms, terms)
    known = at < len(block.terms)
    known[known] = block.terms[at[known]] == terms[known]
    case = np.repeat(np.arange(len(ids)), np.diff(offsets))[known]
    at = at[known]
    weight = tfs[known] * block.idf[at] / norm[case]
    n_queries, n_blocks = len(block), -(-len(block) // BLOCK)
    edges = np.searchsorted(case, np.arange(len(ids) + 1))
    cost = np.concatenate(([0], np.cumsum(np.diff(block.of_term[0])[at])))[edges]
    met = skipped = begin = 0
    while begin < len(ids):
        end = int(np.searchsorted(cost, cost[begin] + HELD_SUMS, side="right")) - 1
        end = min(max(end, begin + 1), begin + max(1, HELD_SUMS // n_queries), len(ids))
        a, b = edges[begin], edges[end]
        own, own_at, own_weight, n = case[a:b] - begin, at[a:b], weight[a:b], end - begin
        entry, place = _spread(own_at, block.blocks[0])
        pair = own[entry] * n_blocks + block.blocks[1][place]
        bound = np.bincount(pair, weights=own_weight[entry] * block.blocks[2][place], minlength=n * n_blocks)
        least = np.minimum.reduceat(best.least, np.arange(0, n_queries, BLOCK))
        open_ = bound * (1 + 1e-9) * 1e9 + 1 >= np.tile(least, n)
        touched = bound > 0
        met, skipped = met + int(touched.sum()), skipped + int((touched & ~open_).sum())
        useful = (open_ & touched).reshape(n, n_blocks)
        some = useful.any(axis=1)[own]
        own, own_at, own_weight = own[some], own_at[some], own_weight[some]
        entry, place = _spread(own_at, block.of_term[0])
        query = block.of_term[1][place]
        kept = useful[own[entry], query // BLOCK]
        entry, place, query = entry[kept], place[kept], query[kept]
        sums = np.bincount(own[entry] * n_queries + query, weights=own_weight[entry] * block.of_term[2][place], minlength=n * n_queries)
        score = np.floor(sums * 1e9 + 0.5).astype(np.int64).reshape(n, n_queries)
        row, query = np.nonzero(score >= best.least)
        if len(row):
            best.add(query, score[row, query], ids[begin + row])
        begin = end
    return met, skipped


def _weighted(index: CaseIndex, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """One row for each query with a known term: ``id`` and ``entries`` of term, idf and unit-length weight."""
    spark = queries.sparkSession
    # Written first: unnested in one plan with their making, texts would be cut anew for each of their terms.
    arrays = materialize(term_arrays(queries, query_id, text, index.ngrams).withColumnRenamed(query_id, "id"), "asked-texts")
    asked = materialize(arrays.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("id", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")), "asked-terms")
    side, _ = broadcast_if_small(asked, BROADCAST_TERMS)
    idf = F.col("a") + F.lit(index.level)
    known = _frequencies(spark, index).join(side, "term").select("id", "term", idf.alias("idf"), (F.col("tf") * idf).alias("weight"))
    lists = known.groupBy("id").agg(F.collect_list(F.struct("term", "idf", "weight")).alias("entries"))
    length = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda total, e: total + e["weight"] * e["weight"]))
    one = F.sort_array(F.transform("entries", lambda e: F.struct(e["term"].alias("term"), e["idf"].alias("idf"), (e["weight"] / F.col("length")).alias("weight"))))
    return materialize(lists.withColumn("length", length).where("length > 0").select("id", one.alias("entries")), "weighted-queries")


def history_side(spark: SparkSession, index: CaseIndex) -> DataFrame | None:
    """Cases with their terms, counts and lengths. Both tables of a segment are bucketed alike, so the join moves no row."""
    out = None
    level = F.lit(index.level)
    for kept, norms in index.segments:
        norm = F.sqrt(level * level * F.col("s0") + 2 * level * F.col("s1") + F.col("s2"))
        own = _table(spark, index, kept).join(_table(spark, index, norms).hint("shuffle_hash"), index.row_id).select(index.row_id, "terms", "tfs", norm.alias("norm")).where("norm > 0")
        out = own if out is None else out.unionByName(own)
    return out


def search(
    index: CaseIndex, queries: DataFrame, query_id: str = "item_id", text: str = "text", k: int = 10, most_entries: int = MOST_ENTRIES,
) -> Search:
    """``(query_id, rank, row_id, similarity)``: the k most similar cases of every query.

    Similarities are rounded to nine places; ties go to the smaller ``row_id``. Queries without a known term
    (null texts too) get no rows; others always get k if the history is that long, filled with cases of similarity 0 in
    ``row_id`` order. Query ids must be unique and not null."""
    spark = queries.sparkSession
    weighted = _weighted(index, queries, query_id, text)
    size = weighted.agg(F.coalesce(F.sum(F.size("entries")), F.lit(0)).alias("n")).first()["n"]
    lots = max(1, -(-size // most_entries))
    kind, found = queries.schema[query_id].dataType.simpleString(), None
    schema = f"`{query_id}` {kind}, `{index.row_id}` {index.kind}, similarity double, n_pairs bigint, n_skipped bigint"
    cases = history_side(spark, index)
    for lot in range(lots if size and cases is not None else 0):
        rows = weighted.where(F.pmod(F.xxhash64("id"), F.lit(lots)) == lot).orderBy("id").toArrow()
        if not rows.num_rows:
            continue
        part = cases.mapInArrow(_searcher(spark.sparkContext.broadcast(QueryBlock.of(rows, k)), query_id, index.row_id), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    found = materialize(found, "similar-cases")
    hits = found.where(F.col(query_id).isNotNull()).select(query_id, index.row_id, "similarity")
    best = top_per_group(hits, [query_id], [F.desc("similarity"), F.asc(index.row_id)], k)
    every = None
    for kept, _ in index.segments:
        ids = _table(spark, index, kept).select(index.row_id)
        every = ids if every is None else every.unionByName(ids)
    known = weighted.select(F.col("id").alias(query_id))
    filled = best if every is None else _filled(best, known, every, index.row_id, query_id, k)
    report = found.where(F.col(query_id).isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pairs", "n_skipped")])
    return Search(filled.select(query_id, "rank", index.row_id, "similarity"), report)


def _searcher(shared, query_id: str, row_id: str):
    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n_pairs, n_skipped = shared.value, 0, 0
        best, kind = Best(len(block), block.k), pa.int64()
        for b in batches:
            kind = b[row_id].type
            terms, tfs = b["terms"], b["tfs"]
            ids = b[row_id].to_numpy(zero_copy_only=False)
            ids = ids if ids.dtype != object else ids.astype(str)
            more = scored(block, best, ids, terms.offsets.to_numpy() - terms.offsets[0].as_py(), terms.flatten().to_numpy(), tfs.flatten().to_numpy(), b["norm"].to_numpy())
            n_pairs, n_skipped = n_pairs + more[0], n_skipped + more[1]
        n = len(best.query)
        none = pa.nulls(n, pa.int64())
        cases = pa.array([] if best.case is None else best.case.tolist(), kind)
        yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(best.query)), cases, pa.array(best.score / 1e9), none, none], [query_id, row_id, "similarity", "n_pairs", "n_skipped"])
        counts = [pa.nulls(1, block.ids.type), pa.nulls(1, kind), pa.nulls(1, pa.float64()), pa.array([n_pairs]), pa.array([n_skipped])]
        yield pa.RecordBatch.from_arrays(counts, [query_id, row_id, "similarity", "n_pairs", "n_skipped"])

    return best_of


def _filled(best: DataFrame, known: DataFrame, history: DataFrame, row_id: str, query_id: str, k: int) -> DataFrame:
    """Queries with fewer than k hits get the first cases that are no hits, at similarity 0."""
    best = materialize(best.select(query_id, "rank", row_id, "similarity"), "similar-hits")
    short = known.join(best, query_id, "left").groupBy(query_id).agg(F.collect_list(row_id).alias("hits")).where(F.size("hits") < k)
    first = [r[0] for r in history.orderBy(row_id).limit(2 * k).collect()]  # k of them at least are no hits
    kind = history.schema[row_id].dataType.simpleString()
    spare = F.array_except(F.array(*[F.lit(v) for v in first]).cast(f"array<{kind}>"), "hits")
    padding = short.select(
        query_id, F.size("hits").alias("n_hits"), F.posexplode(F.slice(spare, F.lit(1), F.lit(k) - F.size("hits"))).alias("at", row_id),
    ).select(query_id, (F.col("n_hits") + F.col("at") + 1).alias("rank"), row_id, F.lit(0.0).alias("similarity"))
    return best.unionByName(padding)
