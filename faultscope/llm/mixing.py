"""Mixing documents to target token weights by iterative proportional fitting. DataFrame functions only.

Tokens are summed into cells of source, language and topic. Raking scales the cells to the target
share of each source, then of each language, then of each topic, over and over. A cell's ratio is its
raked over its own tokens; a document is kept with the probability ratio / largest ratio, so expected
tokens meet all three marginals and no probability exceeds 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.session import broadcast_if_small, materialize

MARGINS = ("source", "lang", "topic")
#: Topics by the first that has one of its marks in the text; all others are general.
TOPICS = (
    ("legal", ("license", "License", "copyright", "Copyright", "rights reserved")),
    ("technical", ("http://", "https://", "password", "token =", "@")),
    ("tabular", (" | ", "\t")),
)
NONE = "(none)"


def topic_of(text: Column) -> Column:
    out = F.lit("general")
    for name, marks in reversed(TOPICS):
        found = F.lit(False)
        for mark in marks:
            found = found | text.contains(mark)
        out = F.when(found, name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words, that is runs without white space, as tokens."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def described(docs: DataFrame, text: str, source: str, lang: str, extra: list[Column]) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    label = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE)).alias(f"mix_{m}") for c, m in ((source, "source"), (lang, "lang"))]
    return docs.select(*extra, *label, topic_of(whole).alias("mix_topic"), token_count(whole).alias("mix_tokens"))


def target_shares(cells: DataFrame, margin: str, temperature: float) -> DataFrame:
    """Target of each value: its share of tokens to the power ``temperature``, made to sum to 1."""
    powers = cells.groupBy(f"mix_{margin}").agg(F.pow(F.sum("mix_cell"), F.lit(temperature)).alias("p"))
    norm = powers.agg(F.sum("p").alias("norm")).first()["norm"]
    return powers.select(f"mix_{margin}", (F.col("p") / F.lit(norm)).alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int) -> DataFrame:
    """``cells`` with ``mix_weight``: the share of all tokens that each cell should have.

    ``targets`` has a table of ``mix_<margin>`` and ``target`` for each margin. Weights begin as the
    cells' own tokens. Lineage is cut after each margin, as a step reads the weights twice and plans of
    several steps would double with each."""
    now = cells.withColumn("mix_weight", F.col("mix_cell").cast("double"))
    for _ in range(sweeps):
        for margin in MARGINS:
            key = f"mix_{margin}"
            factor = now.groupBy(key).agg(F.sum("mix_weight").alias("have")).join(targets[margin], key)
            factor = factor.select(key, (F.col("target") / F.col("have")).alias("factor"))
            now = now.join(factor, key).withColumn("mix_weight", F.col("mix_weight") * F.col("factor")).drop("factor")
            now = materialize(now, "raked")
    return now


def calibrated(described_docs: DataFrame, temperature: float, sweeps: int, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per cell its tokens, raked share and keeping probability."""
    keys = [f"mix_{m}" for m in MARGINS]
    cells = materialize(described_docs.groupBy(*keys).agg(F.sum("mix_tokens").alias("mix_cell")).where("mix_cell > 0"), "cells")
    shares = {m: materialize((targets or {}).get(m) or target_shares(cells, m, temperature), f"target-{m}") for m in MARGINS}
    done = raked(cells, shares, sweeps).withColumn("mix_ratio", F.col("mix_weight") / F.col("mix_cell"))
    top = done.agg(F.max("mix_ratio").alias("top")).first()["top"]
    return materialize(done.select(*keys, "mix_weight", (F.col("mix_ratio") / F.lit(top)).alias("mix_probability")), "calibrated")


def lot(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(NONE))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def sampled(
    docs: DataFrame, temperature: float = 0.9, sweeps: int = 8, seed: str = "mix", targets: dict[str, DataFrame] | None = None,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
) -> DataFrame:
    """Each row's id, cell, ``n_tokens``, the cell's raked ``weight``, ``probability``, and ``kept``.

    Null source or language is the value ``(none)``; null texts are empty. Documents without words
    weigh nothing: they belong to no cell unless others there have words; without one, weight 0 and
    probability 1. Rows of equal id share one lot, as do null ids. An empty table gives no rows."""
    id_ = F.col(f"`{doc_id}`").cast("long").alias("doc_id")
    rows = described(docs, text, source, lang, [id_])
    cells, _ = broadcast_if_small(calibrated(rows, temperature, sweeps, targets), 1_000_000)
    return rows.join(cells, [f"mix_{m}" for m in MARGINS], "left").select(
        "doc_id", *[F.col(f"mix_{m}").alias(m) for m in MARGINS], F.col("mix_tokens").alias("n_tokens"), F.coalesce("mix_weight", F.lit(0.0)).alias("weight"),
        (p := F.coalesce("mix_probability", F.lit(1.0))).alias("probability"), (lot(F.col("doc_id"), seed) < p).alias("kept"))


def mixed(docs: DataFrame, temperature: float = 0.9, sweeps: int = 8, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """The kept rows of ``docs`` with all their columns; see ``sampled``."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("mix_row")
    rows = described(docs, text, source, lang, [row, F.col(f"`{doc_id}`").alias("mix_id")])
    cells, _ = broadcast_if_small(calibrated(described(docs, text, source, lang, []), temperature, sweeps), 1_000_000)
    kept = rows.join(cells, [f"mix_{m}" for m in MARGINS], "left").where(lot(F.col("mix_id"), seed) < F.coalesce("mix_probability", F.lit(1.0)))
    return kept.select(*[F.col("mix_row")[c].alias(c) for c in names])
