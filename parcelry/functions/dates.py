"""Date, trend and percentage expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

from parcelry.functions.text import as_col


def to_timestamp(value: str | Column) -> Column:
    """Coercing parse to wall-clock time: anything unreadable is null instead of an error."""
    return as_col(value).try_cast("timestamp_ntz")


def month_start(value: str | Column) -> Column:
    return F.date_trunc("month", as_col(value))


def month_label(value: str | Column) -> Column:
    return F.date_format(as_col(value), "yyyy-MM")


def _time_of_day(value: Column) -> Column:
    return F.hour(value) * 3600 + F.minute(value) * 60 + F.extract(F.lit("SECOND"), value)


def whole_days_between(end: Column, start: Column) -> Column:
    """Floor of the elapsed wall-clock time in days; negative spans floor downwards, unlike ``datediff``."""
    unfinished = F.when(_time_of_day(end) < _time_of_day(start), 1).otherwise(0)
    return F.datediff(end, start) - unfinished


def look_back_start(as_of: str, months: int) -> Column:
    """A month of look-back is thirty days."""
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(30 * months))


def date_parts(value: str | Column, missing: tuple[int, int, int, int] = (2025, 1, 1, 0)) -> list[Column]:
    """Year, month, quarter and weekday (Monday 0), with fixed fills for a missing date."""
    value = as_col(value)
    parts = (F.year(value), F.month(value), F.quarter(value), F.weekday(value))
    return [F.coalesce(part, F.lit(fill)).cast("int") for part, fill in zip(parts, missing)]


def temporal_to_string(schema: StructType) -> list[Column]:
    """Select list that renders every date or time column as text and keeps the rest."""
    return [
        F.col(f.name).cast("string").alias(f.name)
        if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))
        else F.col(f.name)
        for f in schema.fields
    ]


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage, zero when there is nothing to divide by."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


# Trend band in percent and the labels and colours shown for it.
STAGNATION_BAND = 2
TREND_LABELS = {"flat": ("Stagnálás", "warning"), "up": ("Drágulás", "danger"), "down": ("Olcsósodás", "success")}


def trend_class(change_percent: Column) -> tuple[Column, Column]:
    """Label and colour for a relative change."""
    def pick(position: int) -> Column:
        return (
            F.when(F.abs(change_percent) < STAGNATION_BAND, TREND_LABELS["flat"][position])
            .when(change_percent > 0, TREND_LABELS["up"][position])
            .otherwise(TREND_LABELS["down"][position])
        )

    return pick(0), pick(1)
