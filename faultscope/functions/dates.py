"""Dates that never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted spellings besides eight digits, each with the shape that asks for it.
# Only a matching shape is parsed: a failed parse costs far more than a failed match.
_CLOCK = r"\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
_FRACTION = "[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"
DATE_FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}-\d{2}-\d{2} " + _CLOCK, f"yyyy-MM-dd HH:mm[:ss]{_FRACTION}"),
    (r"\d{4}-\d{2}-\d{2}T" + _CLOCK + r"(Z|[+-]\d{2}:\d{2})?", f"yyyy-MM-dd'T'HH:mm[:ss]{_FRACTION}[XXX]"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{4}\.\d{1,2}\.\d{1,2}", "yyyy.M.d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"[A-Z][a-z]{3,} \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM yyyy"),
    (r"\d{1,2} [A-Z][a-z]{3,} \d{4}", "d MMMM yyyy"),
    (r"\d{4}-\d{2}", "yyyy-MM"),
    (r"\d{4}", "yyyy"),
]
# Range of a nanosecond timestamp, outside of which a date counts as missing.
EARLIEST, LATEST = "1677-09-22 00:00:00", "2262-04-11 00:00:00"


def parse_date(c: Column) -> Column:
    """Eight digits as ``yyyyMMdd``, else the first format that fits, else null."""
    text = F.trim(c.cast("string"))
    shaped = [(r"\d{8}", "yyyyMMdd"), *DATE_FORMATS]
    parsed = F.coalesce(*[F.when(text.rlike(f"^(?:{shape})$"), F.try_to_timestamp(text, F.lit(f))) for shape, f in shaped])
    return F.when(parsed.between(F.lit(EARLIEST).cast("timestamp"), F.lit(LATEST).cast("timestamp")), parsed)


def add_parsed_date(df: DataFrame) -> DataFrame:
    """``date_dt`` from ``date_received``, else from ``Date``, else null."""
    for name in ("date_received", "Date"):
        if name in df.columns:
            return df.withColumn("date_dt", parse_date(F.col(name)))
    return df.withColumn("date_dt", F.lit(None).cast("timestamp"))


def month_of(ts: Column) -> Column:
    return F.to_date(F.date_trunc("month", ts))


def iso_utc(ts: Column) -> Column:
    """Second-precise UTC text with a ``Z``, whatever the session time zone is."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
