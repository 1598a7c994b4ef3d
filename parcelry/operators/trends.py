"""Monthly price trend, linear forecast and the series drawn from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from parcelry.functions.dates import look_back_start, month_label, month_start, to_timestamp, trend_class
from parcelry.operators.listings import in_district, in_range, only_relevant
from parcelry.operators.quantiles import exact_medians

# Least rows and months for an analysis, months forecast.
MIN_ROWS = 10
MIN_MONTHS = 3
HORIZON = 6


@dataclass(frozen=True)
class TrendFilter:
    """What to analyse; falsy members do not filter. ``as_of`` stands in for the current time."""

    as_of: str
    district: str | None = None
    area_min: float | None = None
    area_max: float | None = None
    lookback_months: int = 12


def trend_rows(df: DataFrame, chosen: TrendFilter) -> DataFrame:
    """Relevant, priced, dated listings inside the look-back window, with their month."""
    rows = only_relevant(in_range(in_district(df, chosen.district), "area_sqm", chosen.area_min, chosen.area_max))
    day = to_timestamp("delivery_day")
    return (
        rows.where(F.col("price_huf").isNotNull() & (day >= look_back_start(chosen.as_of, chosen.lookback_months)))
        .withColumn("month", month_start(day))
    )


def monthly_means(rows: DataFrame) -> DataFrame:
    """Everything per month except the medians: one partial aggregate, a handful of rows."""
    return rows.groupBy("month").agg(
        F.avg("price_huf").alias("avg_price"),
        F.count("price_huf").alias("count"),
        F.avg("price_per_sqm").alias("avg_price_per_sqm"),
        F.avg("area_sqm").alias("avg_area"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def monthly_statistics(rows: DataFrame) -> DataFrame:
    """Per month: mean and median prices, count, mean area and a label."""
    medians = exact_medians(rows, ["month"], {"price_huf": "median_price", "price_per_sqm": "median_price_per_sqm"})
    return (
        monthly_means(rows)
        .join(medians, "month", "left")
        .select(
            "month",
            month_label("month").alias("year_month"),
            "avg_price",
            "median_price",
            "count",
            "avg_price_per_sqm",
            "median_price_per_sqm",
            "avg_area",
        )
    )


def indexed_months(months: DataFrame) -> DataFrame:
    """Ordinal position of each month; the input has one row per month, so one partition is enough."""
    return months.withColumn("month_index", F.row_number().over(Window.orderBy("month")) - 1)


def trend_line(months: DataFrame) -> DataFrame:
    """Least squares through the monthly means, the last observed month and the sufficiency counts."""
    return indexed_months(months).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("count"),
        F.count(F.lit(1)).alias("months_analyzed"),
        F.regr_slope("avg_price_per_sqm", "month_index").alias("slope"),
        F.regr_intercept("avg_price_per_sqm", "month_index").alias("intercept"),
        F.max("month").alias("last_month"),
        F.max_by("avg_price_per_sqm", "month").alias("current_price"),
    )


def _sufficient():
    return (F.col("count") >= MIN_ROWS) & (F.col("months_analyzed") >= MIN_MONTHS)


def trend_status(df: DataFrame, chosen: TrendFilter) -> DataFrame:
    """Whether the selection supports an analysis: ``ok``, ``few_rows`` or ``few_months``."""
    line = trend_line(monthly_means(trend_rows(df, chosen)))
    return line.select(
        F.when(F.col("count") < MIN_ROWS, "few_rows")
        .when(F.col("months_analyzed") < MIN_MONTHS, "few_months")
        .otherwise("ok")
        .alias("status"),
        "count",
        F.col("months_analyzed").alias("months"),
    )


def forecast(df: DataFrame, chosen: TrendFilter) -> DataFrame:
    """The next months with their predicted mean price per square metre; empty when data is short."""
    line = trend_line(monthly_means(trend_rows(df, chosen))).where(_sufficient())
    step = F.col("step")
    return line.select("*", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("step")).select(
        step.cast("int").alias("step"),
        F.date_format(F.add_months(F.col("last_month").cast("date"), step), "yyyy-MM").alias("year_month"),
        (F.col("intercept") + F.col("slope") * (F.col("months_analyzed") - 1 + step)).alias("prediction"),
    )


def trend_summary(df: DataFrame, chosen: TrendFilter) -> DataFrame:
    """Current level, level after the horizon, change and its class; empty when data is short."""
    line = trend_line(monthly_means(trend_rows(df, chosen))).where(_sufficient())
    ahead = F.col("intercept") + F.col("slope") * (F.col("months_analyzed") - 1 + HORIZON)
    scored = line.withColumn("predicted", ahead).withColumn("change", F.col("predicted") - F.col("current_price"))
    percent = F.try_divide(F.col("change"), F.col("current_price")) * 100
    label, colour = trend_class(percent)
    return scored.select(
        "count",
        "months_analyzed",
        F.col("current_price").alias("current_avg_price_per_sqm"),
        F.col("predicted").alias("predicted_6m_price_per_sqm"),
        F.col("change").alias("change_6m_absolute"),
        percent.alias("change_6m_percent"),
        label.alias("trend_label"),
        colour.alias("trend_color"),
        F.col("slope").alias("monthly_slope"),
    )


def chart_series(df: DataFrame, chosen: TrendFilter) -> DataFrame:
    """Two aligned series over observed and forecast months; the forecast starts at the last observation."""
    months = indexed_months(monthly_means(trend_rows(df, chosen)))
    observed = months.select(
        F.col("month_index").cast("int").alias("position"),
        month_label("month").alias("year_month"),
        F.col("avg_price_per_sqm").alias("history"),
        F.when(
            F.col("month_index") == F.max("month_index").over(Window.partitionBy()), F.col("avg_price_per_sqm")
        ).alias("forecast"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_months"),
        F.sum("n_rows").over(Window.partitionBy()).alias("_rows"),
    ).where((F.col("_months") >= MIN_MONTHS) & (F.col("_rows") >= MIN_ROWS))
    line = trend_line(monthly_means(trend_rows(df, chosen))).where(_sufficient())
    ahead = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("step")).select(
        (F.col("months_analyzed") - 1 + F.col("step")).cast("int").alias("position"),
        F.date_format(F.add_months(F.col("last_month").cast("date"), F.col("step")), "yyyy-MM").alias("year_month"),
        F.lit(None).cast("double").alias("history"),
        (F.col("intercept") + F.col("slope") * (F.col("months_analyzed") - 1 + F.col("step"))).alias("forecast"),
    )
    return observed.drop("_months", "_rows").unionByName(ahead)
