import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultscope.operators import ranking as rk


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_top_per_group_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
                                  (F.col("id") * 37 % 101).alias("v"))
    got = {(r["g"], r["rank"]): r["id"] for r in rk.top_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 5).collect()}
    rows = [(r["g"], r["v"], r["id"]) for r in df.collect()]
    want = {}
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:5]
        want.update({(g, i + 1): r[2] for i, r in enumerate(best)})
    assert got == want


@pytest.mark.parametrize("n, share", [(1000, 0.2), (7, 0.2), (1, 0.2), (10, 0.25)])
def test_plain_split_is_exact(spark, n, share):
    df = spark.range(n)
    got = sorted(r["id"] for r in rk.split_rows(df, "id", test_size=share, seed=7).filter("is_test").collect())
    want = sorted(sorted(range(n), key=lambda i: key(7, i))[: math.ceil(n * share)])
    assert got == want


def test_stratified_split(spark):
    df = spark.range(1001).select("id", F.when(F.col("id") < 333, 0).when(F.col("id") < 340, 1).otherwise(2).alias("label"))
    split = rk.split_rows(df, "id", "label")
    counts = {r["label"]: r["n"] for r in split.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == rk.test_seats({0: 333, 1: 7, 2: 661}, 0.2)
    assert sum(counts.values()) == 201 and counts[1] in (1, 2)
    got = {r["id"] for r in split.filter("is_test AND label = 0").collect()}
    assert got == set(sorted(range(333), key=lambda i: key(42, i))[: counts[0]])


def test_split_without_enough_classes(spark):
    one = spark.range(10).withColumn("label", F.lit(1))
    assert rk.split_rows(one, "id", "label").filter("is_test").count() == 2
    rare = spark.range(10).withColumn("label", (F.col("id") == 0).cast("int"))
    assert rk.split_rows(rare, "id", "label", min_per_class=2).filter("is_test").count() == 2


@given(st.dictionaries(st.integers(0, 5), st.integers(1, 10_000), min_size=2, max_size=5))
def test_seats_add_up(per_class):
    seats = rk.test_seats(per_class, 0.2)
    n = sum(per_class.values())
    assert sum(seats.values()) == -(-n // 5)
    assert all(abs(seats[c] - 0.2 * per_class[c]) < len(per_class) for c in per_class)


def test_sample(spark):
    df = spark.range(5000)
    got = sorted(r["id"] for r in rk.sample_rows(df, "id", 321).collect())
    assert got == sorted(sorted(range(5000), key=lambda i: key(42, i))[:321])
    assert rk.sample_rows(df, "id", 5000).count() == 5000


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5)), min_size=1, max_size=120), st.booleans())
def test_running_totals(spark, pairs, descending):
    sums = {}
    for k, v in pairs:
        sums[k] = sums.get(k, 0) + v
    df = spark.createDataFrame([(float(k), v) for k, v in sums.items()], "k double, v bigint")
    got = {r["k"]: (r["v_so_far"], r["next_v"]) for r in rk.running_totals(df, "k", ["v"], descending, slices=7).collect()}
    order = sorted(sums, reverse=descending)
    total, want = 0, {}
    for i, k in enumerate(order):
        total += sums[k]
        want[float(k)] = (total, sums[order[i + 1]] if i + 1 < len(order) else None)
    assert got == want


@pytest.mark.parametrize("most_ranked", [0, 1, 40])
def test_radix_selection_cuts_until_few_keys_are_left(spark, most_ranked):
    """Keys that share many first digits take several rounds; the result is that of a sort."""
    rows = [(g, f"{'abcd' * n}{i:04x}") for g, n in (("x", 0), ("y", 1), ("z", 3)) for i in range(0, 400, 7)] + [("y", "ff"), (None, "aa"), (None, "ab")]
    df = spark.createDataFrame(rows, "g string, k string")
    takes = {"x": 5, "y": 58, "z": 17, None: 1, "w": 3}
    if most_ranked == 0:
        most_ranked, takes = 1, {"x": 1000, "y": 0, "z": 1}
    got = df.where(rk.smallest_keys(df, F.col("k"), takes, "g", most_ranked)).collect()
    want = [(g, k) for g, n in takes.items() for k in sorted(b for a, b in rows if a == g)[:n]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
