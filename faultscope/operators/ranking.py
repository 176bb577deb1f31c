"""Firsts, top-k, exact splits and running totals that hold up under hot keys.

None of these gathers a whole group in one task: groups are cut down by partial aggregation,
by salts, or by a histogram of the sort key before any window sees them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``; nulls are equal to each other.

    An aggregation, so each map task sends at most one row per key, however hot the key is.
    ``order`` should end in a unique column to make the choice repeatable."""
    others = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *others)).alias("first")
    return df.groupBy(*keys).agg(first).select(*[
        F.col(c) if c in keys else F.col(f"first.{c}") for c in df.columns
    ])


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], most: int, salts: int = 64) -> DataFrame:
    """At most ``most`` rows per group by ``order``, with their ``rank``.

    Two rounds: the first keeps the best of every (group, salt), so no task sees more than a
    share of a hot group, the second ranks the few that are left. The salt is the same for all
    rows of a task, so that the limit Spark puts before the first shuffle keeps only ``most`` rows
    per group and task. Which salt a row gets does not matter for the result."""
    inner = Window.partitionBy(*groups, "salt").orderBy(*order)
    outer = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("salt", F.spark_partition_id() % salts)
        .withColumn("rank", F.row_number().over(inner)).filter(F.col("rank") <= most)
        .withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= most)
        .drop("salt")
    )


def shuffle_key(row_id: Column, seed: int) -> Column:
    """A repeatable pseudo-random hex key of a row, the same in every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))


#: Keys that are ranked at once, for each group; larger bins are cut by further digits.
MOST_RANKED, DIGITS = 100_000, 4


def smallest_keys(df: DataFrame, key: Column, n_take: dict, group: str | None = None, most_ranked: int = MOST_RANKED) -> Column:
    """A condition that holds for the ``n_take[g]`` smallest hex keys of each group ``g``.

    Radix selection: a histogram over the next four hex digits (65 536 bins) of the keys that share the digits
    so far tells the bin the cut falls into, until that bin has at most ``most_ranked`` keys; only these are ranked. The
    rows themselves are neither shuffled nor joined, they are compared with a literal. Keys must
    be unique, and groups few, such as classes. Without a group use the key None."""
    by = F.lit(None).cast("string") if group is None else F.col(group)
    keyed = df.select(by.alias("g"), key.alias("key"))
    rests = {g: n for g, n in n_take.items() if n > 0}
    if not rests:
        return F.lit(False)
    takes = list(rests)

    def of_group(values: dict, c: Column = F.col("g")) -> Column:
        return F.coalesce(*[F.when(c.eqNullSafe(F.lit(g)), F.lit(v)) for g, v in values.items()], F.lit(None))

    so_far = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut, digits, largest = keyed, 0, most_ranked + 1
    while largest > most_ranked and digits < 64:
        digits += DIGITS
        bins = (
            cut.groupBy("g", F.substring("key", 1, digits).alias("bin")).agg(F.count(F.lit(1)).alias("n_bin"))
            .withColumn("n_upto", F.sum("n_bin").over(so_far))
            .withColumn("n_take", of_group(rests))
            .filter((F.col("n_upto") >= F.col("n_take")) & (F.col("n_upto") - F.col("n_bin") < F.col("n_take")))
            .collect()
        )
        rests = {r["g"]: r["n_take"] - (r["n_upto"] - r["n_bin"]) for r in bins}
        in_cut = F.substring("key", 1, digits) == of_group({r["g"]: r["bin"] for r in bins})
        cut = keyed.filter(F.coalesce(in_cut, F.lit(False)))
        largest = max((r["n_bin"] for r in bins if r["n_bin"] > 1), default=0)
    last = (
        cut.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("key")))
        .filter(F.col("rank") == of_group(rests))
        .collect()
    )
    last_key = of_group({r["g"]: r["key"] for r in last}, by)
    beyond = [by.eqNullSafe(F.lit(g)) for g in takes if g not in rests]  # more wanted than there are
    return F.coalesce(key <= last_key, reduce(lambda a, b: a | b, beyond, F.lit(False)))


def split_rows(
    df: DataFrame, row_id: str, label: str | None = None, test_size: float = 0.2, seed: int = 42, min_per_class: int = 1
) -> DataFrame:
    """Adds ``is_test``: an exact, repeatable share of ``ceil(test_size * n)`` test rows.

    With a label the share is kept per class: train seats are handed out by largest remainder.
    Stratification is dropped when there is only one class or one class has fewer than
    ``min_per_class`` rows. ``row_id`` must be unique."""
    if label is None:
        per_class = {None: df.count()}
    else:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
        per_class = {r[label]: r["n"] for r in counts}
        if len(per_class) < 2 or min(per_class.values()) < min_per_class:
            label, per_class = None, {None: sum(per_class.values())}
    key = shuffle_key(F.col(row_id), seed)
    return df.withColumn("is_test", smallest_keys(df, key, test_seats(per_class, test_size), label))


def _ceil_share(n: int, share: float) -> int:
    return -int(-round(n * share, 9) // 1)


def test_seats(per_class: dict, test_size: float) -> dict:
    """Test rows per class when train seats go by largest remainder, ties by class order."""
    n_rows = sum(per_class.values())
    n_train = n_rows - _ceil_share(n_rows, test_size)
    exact = {c: n_train * n / n_rows for c, n in per_class.items()}
    train = {c: int(x) for c, x in exact.items()}
    by_remainder = sorted(per_class, key=lambda c: (train[c] - exact[c], str(c)))
    for c in by_remainder[: n_train - sum(train.values())]:
        train[c] += 1
    return {c: n - train[c] for c, n in per_class.items()}


def sample_rows(df: DataFrame, row_id: str, most: int = 4000, seed: int = 42) -> DataFrame:
    """A repeatable random sample of exactly ``most`` whole rows, or all rows if there are fewer."""
    if df.count() <= most:
        return df
    return df.filter(smallest_keys(df, shuffle_key(F.col(row_id), seed), {None: most}))


def running_totals(df: DataFrame, order: str, values: list[str], descending: bool = True, slices: int = 256) -> DataFrame:
    """Adds ``<value>_so_far`` running totals over one global order, and the next row's values
    as ``next_<value>``, without a single-task window.

    ``order`` must be distinct numbers (aggregate ties first). Quantiles of it cut the table into
    slices of about equal size; totals of the slices (at most ``slices`` rows) give every slice
    its offset, and windows only run inside slices."""
    probabilities = [i / slices for i in range(1, slices)]
    cuts = sorted(set(df.approxQuantile(order, probabilities, 0.25 / slices))) if slices > 1 else []
    bounds = [float("-inf"), *cuts, float("inf")]
    sliced = Bucketizer(splits=bounds, inputCol=order, outputCol="slice").transform(df) if len(bounds) > 2 else \
        df.withColumn("slice", F.lit(0.0))
    direction = F.desc if descending else F.asc
    edge = F.max_by if descending else F.min_by
    earlier = Window.orderBy(direction("slice")).rowsBetween(Window.unboundedPreceding, -1)
    following = Window.orderBy(direction("slice"))
    offsets = sliced.groupBy("slice").agg(
        *[F.sum(v).alias(f"sum_{v}") for v in values],
        *[edge(v, order).alias(f"first_{v}") for v in values],
    ).select(
        "slice",
        *[F.coalesce(F.sum(f"sum_{v}").over(earlier), F.lit(0)).alias(f"before_{v}") for v in values],
        *[F.lead(f"first_{v}").over(following).alias(f"after_{v}") for v in values],
    )
    inside = Window.partitionBy("slice").orderBy(direction(order))
    return sliced.join(F.broadcast(offsets), "slice").select(
        *df.columns,
        *[(F.col(f"before_{v}") + F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias(f"{v}_so_far")
          for v in values],
        *[F.coalesce(F.lead(v).over(inside), F.col(f"after_{v}")).alias(f"next_{v}") for v in values],
    )
