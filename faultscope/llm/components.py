"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.session import materialize


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").distinct()


def _stars(pairs: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``: then each ``v`` is the least id of its component."""
    ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("n")).union(pairs.select(F.col("v").alias("id"), F.lit(0).alias("n")))
    return ends.groupBy("id").agg(F.sum("n").alias("out"), F.count(F.lit(1)).alias("n")).where("out > 1 OR out = 1 AND n > 1").isEmpty()


def component_of(links: DataFrame) -> DataFrame:
    """``links`` has ids ``u`` and ``v``; the result has each linked ``node`` but the smallest of its
    component, with that smallest id as ``root``. Repeated links and links of an id to itself are
    harmless. Every step is an aggregation and a join on narrow rows; no list of neighbours is built."""
    now = materialize(_linked(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "links")
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(_linked(large), "large-star")
        small = large.join(_least_neighbour(large), "u")
        now = materialize(_linked(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
