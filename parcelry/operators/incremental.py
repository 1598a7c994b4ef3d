"""Change detection against stored checksums, shared by the batch and streaming forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from parcelry.functions.text import row_checksum
from parcelry.operators.dedup import last_per_key

# The fields whose change makes a listing count as changed.
CHECKSUM_FIELDS = ("description", "title", "price_huf", "area_sqm", "district")


def with_checksum(df: DataFrame, fields: Sequence[str] = CHECKSUM_FIELDS, delimiter: str = "") -> DataFrame:
    """Adds ``checksum`` over the listed columns that exist, in the given order."""
    kinds = dict(df.dtypes)
    return df.withColumn("checksum", row_checksum([(f, kinds[f]) for f in fields if f in kinds], delimiter))


def classify_changes(current: DataFrame, state: DataFrame, key: str = "article_id") -> DataFrame:
    """``current`` (one row per key, with ``checksum``) plus ``change``: new, changed or unchanged."""
    known = state.select(F.col(key), F.col("checksum").alias("_known"))
    joined = current.join(known, key, "left")
    change = (
        F.when(F.col("_known").isNull(), F.lit("new"))
        .when(F.col("_known") != F.col("checksum"), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return joined.withColumn("change", change).drop("_known")


def new_and_changed(
    current: DataFrame, state: DataFrame, key: str = "article_id", force: bool = False
) -> DataFrame:
    """The rows to process; ``force`` takes them all."""
    classified = classify_changes(current, state, key)
    return classified if force else classified.where(F.col("change") != "unchanged")


def change_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("change").agg(F.count(F.lit(1)).alias("n_rows"))


def merge_state(state: DataFrame, current: DataFrame, as_of: str, key: str = "article_id") -> DataFrame:
    """State after a run: every key seen, with its latest checksum."""
    seen = current.select(key, "checksum", F.to_timestamp(F.lit(as_of)).alias("updated_at"))
    generations = state.select(key, "checksum", "updated_at").withColumn("_new", F.lit(0))
    return last_per_key(
        generations.unionByName(seen.withColumn("_new", F.lit(1))), [key], ["_new", "updated_at", "checksum"]
    ).drop("_new")


def state_statistics(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count(F.lit(1)).alias("total_articles_tracked"), F.max("updated_at").alias("last_processing_date")
    )
