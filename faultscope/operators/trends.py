"""Dashboard tables: filters, counts, monthly trend and forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.functions.dates import month_of

ALL_TYPES = "Tous"
NO_DATE = "—"


def filter_type(df: DataFrame, chosen: str = ALL_TYPES, column: str = "TypeDetecte") -> DataFrame:
    return df if chosen == ALL_TYPES else df.filter(F.col(column) == chosen)


def filter_severity(df: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """By ``event_type``, else by ``Alerte``. None means every value on offer, which leaves out
    nulls; an empty list means no filter."""
    column = next((c for c in ("event_type", "Alerte") if c in df.columns), None)
    if column is None or chosen == []:
        return df
    return df.filter(F.col(column).isNotNull() if chosen is None else F.col(column).isin(chosen))


def with_date(df: DataFrame, date: str = "date_dt") -> DataFrame:
    return df.filter(F.col(date).isNotNull())


def kpis(df: DataFrame, date: str = "date_dt", groups: list[str] = []) -> DataFrame:
    """Report count and the latest date as ISO text, a dash when there is none."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.coalesce(F.date_format(F.max(date), "yyyy-MM-dd"), F.lit(NO_DATE)).alias("last_date"),
    )


def monthly_counts(df: DataFrame, date: str = "date_dt", groups: list[str] = []) -> DataFrame:
    """Incidents per month; months without any are absent."""
    return with_date(df, date).groupBy(*groups, month_of(F.col(date)).alias("month")).agg(
        F.count(F.lit(1)).alias("incidents"))


def value_counts(df: DataFrame, column: str, top: int | None = None, nulls: str = "nan") -> DataFrame:
    """Rows per value, most frequent first, ties by value. ``nulls="nan"`` counts missing values
    under that name, ``nulls="drop"`` leaves them out."""
    if nulls not in ("nan", "drop"):
        raise ValueError(f"nulls must be 'nan' or 'drop', not {nulls!r}")
    value = F.col(column).cast("string")
    kept = df.select(F.coalesce(value, F.lit("nan")).alias("value")) if nulls == "nan" else \
        df.select(value.alias("value")).filter(F.col("value").isNotNull())
    ordered = kept.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value"))
    return ordered if top is None else ordered.limit(top)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct().orderBy(column)


def preview(df: DataFrame, order: list[str], rows: int = 1000) -> DataFrame:
    """The first rows to show; the limit is what a preview is."""
    return df.orderBy(*order).limit(rows)


def forecast(
    counts: DataFrame, groups: list[str] = [], horizon: int = 3, min_months: int = 6, fill_gaps: bool = False
) -> DataFrame:
    """Least-squares line through monthly counts, continued for ``horizon`` months, never below 0.

    The x axis is the position of a month among those present; ``fill_gaps`` counts missing
    months as zero instead. Series shorter than ``min_months`` get no forecast. The input is one
    row per month and group, so the windows here are over small data."""
    if fill_gaps:
        span = counts.groupBy(*groups).agg(F.min("month").alias("a"), F.max("month").alias("b"))
        grid = span.select(*groups, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
        counts = grid.join(counts, [*groups, "month"], "left").fillna(0, ["incidents"])
    order = Window.partitionBy(*groups).orderBy("month")
    fitted = (
        counts.withColumn("x", (F.row_number().over(order) - 1).cast("double"))
        .groupBy(*groups).agg(
            F.regr_slope(F.col("incidents").cast("double"), F.col("x")).alias("slope"),
            F.regr_intercept(F.col("incidents").cast("double"), F.col("x")).alias("intercept"),
            F.max("month").alias("last_month"),
            F.count(F.lit(1)).alias("n_months"),
        ).filter(F.col("n_months") >= min_months)
    )
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    x = F.col("n_months") + F.col("step") - 1
    return fitted.select("*", step).select(
        *groups,
        F.add_months("last_month", F.col("step")).alias("month"),
        F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * x).alias("incidents"),
    )
