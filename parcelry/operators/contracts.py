"""Table and row contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelry.operators.dedup import duplicate_summary
from parcelry.operators.listings import missing_columns
from parcelry.schema import AREA_RANGE, PRICE_RANGE, REQUIRED_COLUMNS, TRAINING_PRICE_BAND


class ContractError(ValueError):
    """A table breaks a hard rule."""


def check_table(df: DataFrame, key: str = "article_id") -> dict[str, int]:
    """Raise on missing columns or null keys; report duplicate keys without raising."""
    missing = missing_columns(df, REQUIRED_COLUMNS)
    if missing:
        raise ContractError(f"missing columns: {missing}")
    summary = duplicate_summary(df, key).first().asDict()
    if summary["null_keys"]:
        raise ContractError(f"{summary['null_keys']} rows without {key}")
    return summary


def violations(df: DataFrame, key: str = "article_id") -> Column:
    """Names of the broken row rules, as an array that is empty for a sound row."""
    rules = {f"{key} missing": F.col(key).isNull()}
    for column, (low, high) in {"price_huf": PRICE_RANGE, "area_sqm": AREA_RANGE}.items():
        if column in df.columns:
            number = F.col(column).try_cast("double")
            unreadable = F.col(column).isNotNull() & number.isNull()
            rules[f"{column} not a number"] = unreadable
            rules[f"{column} out of range"] = ~F.isnan(number) & ~number.between(low, high)
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def with_violations(df: DataFrame, key: str = "article_id") -> DataFrame:
    return df.withColumn("violations", violations(df, key))


def split_by_contract(df: DataFrame, key: str = "article_id") -> tuple[DataFrame, DataFrame]:
    """Sound rows, and rejects with their violations."""
    checked = with_violations(df, key)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def violation_counts(df: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows per broken rule."""
    return (
        with_violations(df, key)
        .select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def price_band(df: DataFrame, band: tuple[float, float] = TRAINING_PRICE_BAND) -> DataFrame:
    """Known price and area above zero, price inside the band."""
    return df.where(
        F.col("price_huf").between(*band) & (F.col("price_huf") > 0) & (F.col("area_sqm") > 0)
    )
