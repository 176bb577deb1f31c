"""Dataset gate, quality report and fingerprints."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.operators.trends import value_counts

REQUIRED_COLUMNS = ["event_text", "label"]


def row_digest(df: DataFrame, algorithm: str = "sha2") -> Column:
    """A digest of all columns of a row in which nulls equal each other and differ from text."""
    cells = [
        F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns
    ]
    whole = F.concat_ws("\x1f", *cells)
    return F.sha2(whole, 256) if algorithm == "sha2" else F.md5(whole)


def quality_counts(df: DataFrame) -> DataFrame:
    """Rows, columns, full-row duplicates beyond the first, and nulls per column, in one pass.

    Duplicates are counted over digests, so wide rows are not shuffled."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}") for c in df.columns]
    return df.withColumn("row_digest", row_digest(df)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_cols"),
        (F.count(F.lit(1)) - F.count_distinct("row_digest")).alias("dup_rows"),
        *nulls,
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, null as a class of its own."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def quality_report(df: DataFrame, label: str = "label", event_type: str = "event_type") -> DataFrame:
    """The whole report as (section, item, n) rows."""
    counts = quality_counts(df)
    plain = {"n_rows": "rows", "n_cols": "cols", "dup_rows": "dup_rows"}
    cells = [
        F.struct(
            F.lit(plain.get(c, "nulls_by_col")).alias("section"),
            F.lit(None if c in plain else c.removeprefix("nulls_")).cast("string").alias("item"),
            F.col(f"`{c}`").cast("bigint").alias("n"),
        )
        for c in counts.columns
    ]
    report = counts.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    if label in df.columns:
        classes = class_balance(df, label)
        report = report.unionByName(
            classes.select(F.lit("class_balance").alias("section"), F.col(label).cast("string").alias("item"), "n"))
    if event_type in df.columns:
        top = value_counts(df, event_type, 10, nulls="drop")
        report = report.unionByName(
            top.select(F.lit("top_event_type").alias("section"), F.col("value").alias("item"), "n"))
    return report


def report_to_json(report: DataFrame, file_md5: str | None = None) -> str:
    """The report document; the report has a few dozen rows."""
    doc: dict = {}
    for row in report.collect():
        if row["section"] in ("rows", "cols", "dup_rows"):
            doc[row["section"]] = row["n"]
        else:
            doc.setdefault(row["section"], {})[row["item"] if row["item"] is not None else "nan"] = row["n"]
    if file_md5:
        doc["file_md5"] = file_md5
    return json.dumps(doc, indent=2, ensure_ascii=False)


def report_to_markdown(report_json: str) -> str:
    """A table of the single figures, then one table for each section of counts."""
    doc = json.loads(report_json)
    tables = {section: value for section, value in doc.items() if isinstance(value, dict)}
    single = {section: value for section, value in doc.items() if section not in tables}
    blocks = [_markdown_table("section", single)]
    blocks += [f"## {section}\n\n" + _markdown_table("item", counts) for section, counts in tables.items()]
    return "\n\n".join(blocks) + "\n"


def _markdown_table(head: str, values: dict) -> str:
    rows = [(head, "value"), ("---", "---:"), *values.items()]
    return "\n".join(f"| {str(name).replace('|', '&#124;')} | {value} |" for name, value in rows)


def fingerprint(df: DataFrame) -> DataFrame:
    """A checksum of the content that does not depend on row or file order: the row count and
    the sum of 60 bits of every row's MD5."""
    bits = F.conv(F.substring(row_digest(df, "md5"), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(bits.alias("bits")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("bits").cast("string").alias("checksum")
    )


def missing_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))


def length_stats(df: DataFrame, text: str = "event_text", label: str = "label") -> DataFrame:
    """Rows, text lengths (exact, linearly interpolated, whole characters) and mean label."""
    lengths = df.select(F.char_length(text).alias("len"), F.col(label).alias("label")).groupBy("len").agg(*_sums())
    return lengths.agg(*_stats())


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"), F.count("label").alias("label_n")]


def _stats() -> list[Column]:
    """Over rows that stand for ``n`` texts of one length each."""
    percentile = F.percentile("len", F.array(F.lit(0.5), F.lit(0.95)), F.col("n"))
    return [
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.min("len").alias("len_min"),
        percentile[0].cast("int").alias("len_p50"),
        percentile[1].cast("int").alias("len_p95"),
        F.max("len").alias("len_max"),
        F.try_divide(F.sum("label_sum"), F.sum("label_n")).alias("label_ratio"),
    ]


def dataset_gate(df: DataFrame, text: str = "event_text", label: str = "label") -> DataFrame:
    """One verdict row: ``passed``, the failed checks in order, and the statistics.

    Checks: required columns (from the schema), no null text, labels 0 or 1 only. Duplicate
    texts are counted but do not fail the gate."""
    absent = missing_columns(df, [text, label])
    if absent:
        failed = F.array(F.lit("missing columns: " + ", ".join(absent)))
        unknown = {"null_texts": "bigint", "bad_labels": "bigint", "dup_texts": "bigint", "n_rows": "bigint",
                   "len_min": "int", "len_p50": "int", "len_p95": "int", "len_max": "int", "label_ratio": "double"}
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(False).alias("passed"), failed.alias("failed_checks"),
            *[F.col(c) if c == "n_rows" else F.lit(None).cast(t).alias(c) for c, t in unknown.items()])
    bad = F.col("label").isNull() | ~F.col("label").isin(0, 1)
    measured = df.select(
        F.char_length(text).alias("len"), F.col(label).alias("label"),
        F.coalesce(F.sha2(F.col(text), 256), F.lit("-")).alias("digest"),
    )
    # One row per distinct text, then one per length: what the last aggregate sees is small.
    texts = measured.groupBy("digest").agg(F.first("len").alias("len"), F.count_if(bad).alias("bad"), *_sums())
    lengths = texts.groupBy("len").agg(
        F.sum("bad").alias("bad"), (F.sum("n") - F.count(F.lit(1))).alias("dup"),
        *[F.sum(c).alias(c) for c in ("n", "label_sum", "label_n")])
    measured = lengths.agg(
        F.coalesce(F.sum(F.when(F.col("len").isNull(), F.col("n"))), F.lit(0)).alias("null_texts"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_labels"), F.coalesce(F.sum("dup"), F.lit(0)).alias("dup_texts"),
        *_stats(),
    )
    checks = F.array_compact(F.array(
        F.when(F.col("null_texts") > 0, "null text"), F.when(F.col("bad_labels") > 0, "non-binary label"),
    ))
    return measured.select((F.size(checks) == 0).alias("passed"), checks.alias("failed_checks"), *measured.columns)
