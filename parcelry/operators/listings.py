"""Listing filters, search, ordering and console questions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.functions.dates import month_start, to_timestamp
from parcelry.operators import console

LISTING_VIEW = "relevant_data"
# Columns of a district listing, in order.
DISTRICT_LISTING_COLUMNS = (
    "article_id",
    "title",
    "price_huf",
    "rooms",
    "area_sqm",
    "price_per_sqm",
    "description",
    "link",
    "district",
    "building_type",
    "property_category",
)


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def project_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*existing(df, wanted))


def rename_existing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def in_district(df: DataFrame, district: str | None) -> DataFrame:
    return df.where(F.col("district") == district) if district else df


def in_range(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Closed range; zero and None mean no bound."""
    if low:
        df = df.where(F.col(column) >= low)
    if high:
        df = df.where(F.col(column) <= high)
    return df


def only_relevant(df: DataFrame) -> DataFrame:
    return df.where(F.col("relevant")) if "relevant" in df.columns else df


def search(
    df: DataFrame,
    term: str | None = None,
    min_millions: float | None = None,
    max_millions: float | None = None,
    rooms: str | None = None,
) -> DataFrame:
    """Text search over title, description and price plus price and room filters.

    A missing price counts as zero, so it passes only without a minimum; room choice ``"4"`` means
    four or more.
    """
    if term:
        needle = F.lit(term.lower())
        hits = [F.contains(F.lower(F.col(c)), needle) for c in existing(df, ("title", "description"))]
        if "price_huf" in df.columns:
            shown = F.col("price_huf").try_cast("decimal(20,0)").cast("string")
            whole = F.col("price_huf") == F.floor("price_huf")
            price = F.when(whole, shown).otherwise(F.col("price_huf").cast("string"))
            hits.append((F.col("price_huf") != 0) & F.contains(price, needle))
        found = F.lit(False)
        for hit in hits:
            found = found | F.coalesce(hit, F.lit(False))
        df = df.where(found)
    if min_millions:
        df = df.where(F.col("price_huf") >= min_millions * 1_000_000)
    if max_millions:
        df = df.where(F.coalesce(F.col("price_huf"), F.lit(0.0)) <= max_millions * 1_000_000)
    if rooms:
        df = df.where(F.col("rooms") >= 4) if rooms == "4" else df.where(F.col("rooms") == float(rooms))
    return df


def district_listing(df: DataFrame, district: str) -> DataFrame:
    return project_existing(in_district(df, district), DISTRICT_LISTING_COLUMNS)


def is_active(as_of: str) -> Column:
    """No end date, or one that has not passed on the day of ``as_of``."""
    end = F.col("valid_till").try_cast("date")
    return F.col("valid_till").isNull() | (end >= F.lit(as_of).cast("timestamp").cast("date"))


def posted_on(day: str) -> Column:
    return F.col("valid_from").try_cast("date") == F.lit(day).cast("date")


def posted_in_month(day: str) -> Column:
    return month_start(to_timestamp("valid_from")) == month_start(F.lit(day).cast("timestamp"))


# Console questions over the registered view; the two dated ones take the reporting day.
CONSOLE = {
    "count_by_district": "SELECT district, COUNT(*) AS count FROM relevant_data GROUP BY district ORDER BY count DESC",
    "active_count": "SELECT COUNT(*) AS active FROM relevant_data "
    "WHERE valid_till IS NULL OR TRY_CAST(valid_till AS DATE) >= DATE '{day}'",
    "average_price": "SELECT AVG(price_huf) AS avg_price FROM relevant_data WHERE district = '{district}'",
    "most_expensive": "SELECT * FROM relevant_data ORDER BY price_huf DESC, article_id LIMIT 1",
    "newest": "SELECT * FROM relevant_data ORDER BY TRY_CAST(valid_from AS DATE) DESC NULLS LAST, article_id LIMIT 1",
    "oldest": "SELECT * FROM relevant_data ORDER BY TRY_CAST(valid_from AS DATE) ASC NULLS LAST, article_id LIMIT 1",
    "posted_on_day": "SELECT COUNT(*) AS posted FROM relevant_data WHERE TRY_CAST(valid_from AS DATE) = DATE '{day}'",
    "posted_in_month": "SELECT COUNT(*) AS posted FROM relevant_data "
    "WHERE DATE_TRUNC('month', TRY_CAST(valid_from AS DATE)) = DATE_TRUNC('month', DATE '{day}')",
}


def console_text(name: str, **values: str) -> str:
    quoted = {key: value.replace("'", "''") for key, value in values.items()}
    return CONSOLE[name].format(**quoted)


def run_console(spark: SparkSession, listings: DataFrame, text: str) -> DataFrame:
    """Run one query over the listings."""
    return console.run_console(spark, {LISTING_VIEW: listings}, text)


def clean_generated_sql(text: str) -> str:
    """Drop code fences around a generated query."""
    return re.sub(r"```(sql)?", "", text).strip()
