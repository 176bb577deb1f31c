"""TF-IDF vectors from a vocabulary that is a written table.

A ``TermTable`` is a stage of a Spark ML pipeline. It holds the folder of its table (``term``, ``hash``, ``idf``,
``index``) and how texts are cut into terms, so a saved model brings its own cleaning and n-grams. An
index is a term's place in the order of 64-bit hashes of the table; terms are counted in their rows and looked up by hash. A table of
measured size goes to every worker as two sorted arrays, and rows stay where they are. Beyond that size the counts are
joined with the table and put together again by row."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window, types as T
from pyspark.sql import functions as F

from faultscope.functions.terms import counted, given_text, lots, listed_terms, term_hash
from faultscope.operators.tfidf import fit_vocabulary, text_postings
from faultscope.session import materialize, scratch_path

#: Terms that reach every worker at once, at 24 bytes and the term each.
MOST_SHARED = 8_000_000
SCHEMA = "term string, hash bigint, idf double, `index` int"
_SHIFT, _BUCKETS = 54, 1 << 10


class SharedTerms(NamedTuple):
    """Terms in the order of their hashes."""

    hashes: np.ndarray
    idf: np.ndarray
    index: np.ndarray
    terms: pa.Array


_SHARED: dict[tuple[str, str], Broadcast] = {}


def number_terms(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (``term``, ``idf``) with ``hash`` and ``index``, without gathering terms anywhere: sizes of ranges
    of hashes give each range its first index."""
    hashed = vocabulary.select("term", F.xxhash64("term").alias("hash"), "idf").withColumn("range", F.shiftright("hash", _SHIFT) + _BUCKETS // 2)
    sizes = {r["range"]: r["n"] for r in hashed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = np.cumsum([0, *(sizes.get(k, 0) for k in range(_BUCKETS - 1))]).tolist()
    start = F.get(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), F.col("range").cast("int"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("hash", "term"))
    return hashed.select("term", "hash", "idf", (start + place - 1).cast("int").alias("index"))


def unit_vectors(size: int, offsets: np.ndarray, index: np.ndarray, weight: np.ndarray) -> pa.Array:
    """Sparse vectors of length 1 from ascending indices (-1: none) and their weights; without any, a zero vector."""
    known = index >= 0
    kept = np.concatenate(([0], np.cumsum(known)))[offsets]
    row, values = np.repeat(np.arange(len(offsets) - 1), np.diff(kept)), weight[known]
    length = np.sqrt(np.bincount(row, weights=values * values, minlength=len(offsets) - 1))
    lists = [pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(x)) for x in (index[known].astype(np.int32), values / np.where(length > 0, length, 1.0)[row])]
    n = len(offsets) - 1
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], names=["type", "size", "indices", "values"])


class TermTable(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Texts to unit-length TF-IDF vectors; terms that the table does not have drop out."""

    table = Param(Params._dummy(), "table", "folder of the vocabulary", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of terms", TypeConverters.toInt)
    shortest = Param(Params._dummy(), "shortest", "words of the shortest terms", TypeConverters.toInt)
    longest = Param(Params._dummy(), "longest", "words of the longest terms", TypeConverters.toInt)

    def __init__(self, table: str = "", size: int = 0, ngrams: tuple[int, int] = (1, 2), inputCol: str = "text", outputCol: str = "features"):
        super().__init__()
        self._set(table=table, size=size, shortest=ngrams[0], longest=ngrams[1], inputCol=inputCol, outputCol=outputCol)

    @property
    def ngrams(self) -> tuple[int, int]:
        return self.getOrDefault(self.shortest), self.getOrDefault(self.longest)

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.getOrDefault(self.table))

    def apart_from(self, path: str, spark: SparkSession) -> TermTable:
        """This stage with its table outside ``path``, which is about to be written anew."""
        if not self.getOrDefault(self.table).startswith(path.rstrip("/") + "/"):
            return self
        copy = scratch_path(spark, "term-table")
        self.terms(spark).write.parquet(copy)
        return self.copy({self.table: copy})

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.weigh(df, self.getInputCol()).drop("weighted_terms")

    def weigh(self, df: DataFrame, text: str, cleaned: bool = False, most_shared: int = MOST_SHARED) -> DataFrame:
        """Adds the vector and ``weighted_terms``: the known terms of a text with their weights, by index.

        ``cleaned`` says that texts have been through ``clean_text``. Rows keep their number and columns."""
        if self.getOrDefault(self.size) <= most_shared:
            return self._looked_up(df, text, cleaned)
        return self._joined(df.withColumn("_terms", listed_terms(text, self.ngrams, cleaned))).drop("_terms")

    def _looked_up(self, df: DataFrame, text: str, cleaned: bool) -> DataFrame:
        shared, size, ngrams = self._shared(df.sparkSession), max(1, self.getOrDefault(self.size)), self.ngrams

        @F.arrow_udf(T.StructType([T.StructField("features", VectorUDT()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]))
        def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = shared.value
            for texts in lots(batches):
                offsets, wanted, tfs = counted(texts, ngrams, cleaned)
                at = np.minimum(np.searchsorted(own.hashes, wanted), max(0, len(own.hashes) - 1))
                known = own.hashes[at] == wanted if len(own.hashes) else np.zeros(len(wanted), bool)
                row, at, tfs = np.repeat(np.arange(len(texts)), np.diff(offsets))[known], at[known], tfs[known]
                order = np.lexsort((own.index[at], row))
                at, weight = at[order], (tfs[order] * own.idf[at[order]])
                offsets = np.searchsorted(row, np.arange(len(texts) + 1))
                told = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (own.terms.take(pa.array(at)), pa.array(weight))]
                yield pa.StructArray.from_arrays([unit_vectors(size, offsets, own.index[at], weight), *told], names=["features", "terms", "weights"])

        looked = df.withColumn("_weighed", weighed(given_text(text, cleaned)))
        zipped = F.arrays_zip(F.col("_weighed.terms").alias("term"), F.col("_weighed.weights").alias("weight"))
        return looked.withColumns({self.getOutputCol(): F.col("_weighed.features"), "weighted_terms": zipped}).drop("_weighed")

    def _joined(self, hashed: DataFrame) -> DataFrame:
        size = max(1, self.getOrDefault(self.size))

        @F.arrow_udf(VectorUDT())
        def vectors(index: pa.Array, weight: pa.Array) -> pa.Array:
            return unit_vectors(size, index.offsets.to_numpy() - index.offsets[0].as_py(), index.flatten().to_numpy(), weight.flatten().to_numpy())

        numbered = materialize(hashed.withColumn("_row", F.monotonically_increasing_id()), "counted-texts")
        postings = numbered.select("_row", F.explode("_terms").alias("t")).select("_row", "t.hash", "t.tf")
        known = postings.join(self._hashed(hashed.sparkSession), "hash").select("_row", F.struct("index", "term", (F.col("tf") * F.col("idf")).alias("weight")).alias("t"))
        lists = known.groupBy("_row").agg(F.sort_array(F.collect_list("t")).alias("_known"))
        empty = F.array().cast("array<struct<index:int,term:string,weight:double>>")
        listed = numbered.join(lists, "_row", "left").withColumn("_known", F.coalesce("_known", empty))
        listed = listed.withColumn(self.getOutputCol(), vectors(F.col("_known.index"), F.col("_known.weight")))
        return listed.withColumn("weighted_terms", F.transform("_known", lambda t: F.struct(t["term"].alias("term"), t["weight"].alias("weight")))).drop("_row", "_known")

    def _hashed(self, spark: SparkSession) -> DataFrame:
        """The table with the hashes that texts are looked up by; its own number the terms."""
        return self.terms(spark).withColumn("hash", term_hash("term"))

    def _shared(self, spark: SparkSession) -> Broadcast:
        """Hashes and weights in the order of the index; their number is known and bounded by the caller."""
        key = (spark.sparkContext.applicationId, self.getOrDefault(self.table))
        if key not in _SHARED:
            told = self._hashed(spark).select("hash", "idf", "index", "term").toArrow().combine_chunks()
            order = np.argsort(told["hash"].to_numpy(), kind="stable")
            hashes, idf, index = (told[c].to_numpy()[order] for c in ("hash", "idf", "index"))
            _SHARED[key] = spark.sparkContext.broadcast(SharedTerms(hashes, idf, index.astype(np.int64), told["term"].take(pa.array(order)).combine_chunks()))
        return _SHARED[key]

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Settings and vocabulary go to one folder."""

    def __init__(self, instance: TermTable):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        told = f"terms-{uuid.uuid4().hex[:12]}"  # never the folder that a worker of an earlier save has read
        self.instance.terms(spark).write.parquet(f"{path}/{told}")
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, {"terms": told})


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TermTable:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance._set(table=f"{path}/{metadata['terms']}")


def fit_term_table(
    train: DataFrame, text: str, row_id: str, n_rows: int, ngrams: tuple[int, int] = (1, 2), min_df: int = 1, max_features: int | None = None, cleaned: bool = False,
) -> TermTable:
    """The table of the terms of the training rows, all of them unless limited by ``min_df`` or ``max_features``."""
    vocabulary = fit_vocabulary(text_postings(train, text, row_id, ngrams, cleaned), n_rows, min_df, max_features)
    path = scratch_path(train.sparkSession, "term-table")
    number_terms(vocabulary).write.parquet(path)
    table = TermTable(path, 0, ngrams, text)
    return table._set(size=table.terms(train.sparkSession).count())


def strongest_terms(weighted: Column, k: int) -> Column:
    """The k heaviest of ``weighted_terms`` as ``word`` and share of the weight of those k in percent, ties by
    term; null without any."""
    # equal weights stay equal whatever the summation
    ranked = F.slice(F.sort_array(F.transform(weighted, lambda t: F.struct((-F.round(t["weight"], 9)).alias("key"), t["term"].alias("word"), t["weight"].alias("weight")))), 1, k)

    def shares(top: Column) -> Column:
        total = F.aggregate(top, F.lit(0.0), lambda a, t: a + t["weight"])
        return F.get(F.transform(F.array(total), lambda s: F.transform(top, lambda t: F.struct(t["word"].alias("word"), F.round(100 * t["weight"] / s, 1).alias("pct")))), F.lit(0))

    return F.when(F.size(weighted) > 0, F.get(F.transform(F.array(ranked), shares), F.lit(0)))
