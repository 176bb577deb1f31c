"""Collect, prepare, validate: nested events to the labelled table and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from faultscope.operators.prepare import (
    cap_per_keyword, dedup_first, flatten_events, processed_table, search_events,
)
from faultscope.operators.quality import quality_report, report_to_json, report_to_markdown
from faultscope.session import broadcast_if_small, materialize
from faultscope.sources.tables import RAW_SCHEMA, write_table, write_text_document

# Search phrases and limits of the standard collection.
KEYWORDS = [
    "mri", "magnetic resonance", "ct", "computed tomography", "x-ray", "radiography", "fluoroscopy", "scanner",
    "irm", "tomodensitometry",
]
START, END = "2018-01-01", "2025-12-31"
MAX_RECORDS, PAGE = 5000, 100


def collect_incidents(
    events: DataFrame, arrival: str, keywords: list[str] = KEYWORDS, start: str = START, end: str = END,
    max_records: int = MAX_RECORDS, page: int = PAGE,
) -> DataFrame:
    """The raw table: events per keyword up to the collection limit, flattened, each incident
    once. An event found by several keywords arrives with the first of them.

    Searching and capping only move keywords and arrival numbers (``arrival`` must be unique). At
    most the cap per keyword is left of those, and the events themselves are picked by joining
    these few, so they are not shuffled before that."""
    found = search_events(events, keywords, start, end).select("keyword", "keyword_pos", arrival)
    wanted = materialize(cap_per_keyword(found, arrival, max_records, page), "collected")
    side, _ = broadcast_if_small(wanted, len(keywords) * (max_records + page))
    flat = flatten_events(events.join(side, arrival), extra=["keyword_pos", arrival])
    return dedup_first(flat, ["keyword_pos", arrival]).select(*RAW_SCHEMA.names)


def prepare(raw: DataFrame, path: str, force: bool = True) -> DataFrame:
    """Writes the processed table (kept if it exists and ``force`` is off) and returns it."""
    write_table(processed_table(raw), path, force)
    return raw.sparkSession.read.parquet(path)


def write_quality_report(df: DataFrame, json_path: str, markdown_path: str, file_md5: str | None = None) -> str:
    doc = report_to_json(quality_report(df), file_md5)
    spark = df.sparkSession
    write_text_document(spark, doc, json_path)
    write_text_document(spark, report_to_markdown(doc), markdown_path)
    return doc
