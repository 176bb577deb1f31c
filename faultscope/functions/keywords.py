"""Keyword lists: arrays of (word, pct) and their JSON text ``[["word", 12.5], ...]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORDS_TYPE = "array<struct<word:string,pct:double>>"


def keywords_to_json(kw: Column) -> Column:
    """JSON text of a keyword list; null becomes the empty list. Non-ASCII letters are kept."""
    def cell(k: Column) -> Column:
        quoted = F.regexp_replace(F.to_json(F.array(k["word"])), r"^\[|\]$", "")
        return F.concat(F.lit("["), quoted, F.lit(", "), k["pct"].cast("string"), F.lit("]"))

    body = F.array_join(F.transform(F.coalesce(kw, F.array().cast(KEYWORDS_TYPE)), cell), ", ")
    return F.concat(F.lit("["), body, F.lit("]"))


def keywords_from_json(text: Column) -> Column:
    """Keyword list of a JSON text; null or broken text becomes the empty list."""
    pairs = F.from_json(text, "array<array<string>>")
    parsed = F.transform(
        pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("word"), F.get(p, F.lit(1)).try_cast("double").alias("pct"))
    )
    return F.coalesce(parsed, F.array().cast(KEYWORDS_TYPE))


def keywords_to_text(kw: Column, most: int = 5) -> Column:
    """``word (12.5%)`` of the first few, joined by commas."""
    shown = F.slice(F.coalesce(kw, F.array().cast(KEYWORDS_TYPE)), 1, most)
    return F.array_join(
        F.transform(shown, lambda k: F.concat(k["word"], F.lit(" ("), k["pct"].cast("string"), F.lit("%)"))), ", "
    )
