"""Tables behind the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.functions.dates import add_parsed_date
from faultscope.functions.rules import add_detected_type, recommendation
from faultscope.operators.prepare import pick_text_column
from faultscope.operators.trends import ALL_TYPES, filter_severity, filter_type


def enrich(df: DataFrame) -> DataFrame:
    """Adds advice (for alert tables without it), detected type and parsed date. Write the result
    once; the dashboard queries then only read the columns they need."""
    text = pick_text_column(df)
    if "Alerte" in df.columns and "Recommandation" not in df.columns:
        df = df.withColumn("Recommandation", recommendation(F.col("Alerte")))
    return add_parsed_date(add_detected_type(df, text))


def selection(enriched: DataFrame, device_type: str = ALL_TYPES, severities: list[str] | None = None) -> DataFrame:
    return filter_severity(filter_type(enriched, device_type), severities)
