"""One row per key, exclusion of seen keys, keyed upsert of two layers, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

FILE_ORDER = ("_metadata.file_path", "_metadata.row_index")


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``row_number() = 1``: Spark keeps one row per key and map partition before the shuffle.

    (WindowGroupLimit in the plan.) A key that holds a third of all rows therefore sends one row
    per input partition, not its whole group, to the task that owns it.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], exclude: DataFrame | None = None) -> DataFrame:
    """Earliest row of each key under ``order``, leaving out keys present in ``exclude``."""
    kept = without_keys(df, exclude, keys) if exclude is not None else df
    return _one_per_key(kept, keys, [F.col(c).asc() for c in order])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _one_per_key(df, keys, [F.col(c).desc() for c in order])


def first_in_file_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First row as stored: file path, then row position. ``df`` must be a direct file scan."""
    path, row = FILE_ORDER
    tagged = df.withColumn("_path", F.col(path)).withColumn("_row", F.col(row))
    return _one_per_key(tagged, keys, [F.col("_path"), F.col("_row")]).drop("_path", "_row")


def with_keys(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is listed.

    The listing is made distinct first: that combines on the map side and its hash partitioning is
    the one the join needs, so a key repeated in the listing costs no extra shuffle.
    """
    return df.join(ids.select(*keys).distinct(), list(keys), "left_semi")


def without_keys(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Existing rows replaced by incoming ones of the same key; the result has one row per key.

    Incoming wins over existing; inside one side the last row under ``order`` wins.
    """
    generations = existing.withColumn("_generation", F.lit(0)).unionByName(
        incoming.withColumn("_generation", F.lit(1)), allowMissingColumns=True
    )
    return last_per_key(generations, keys, ["_generation", *order]).drop("_generation")


def upsert_layers(
    relevant: DataFrame,
    irrelevant: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flag: str = "relevant",
) -> DataFrame:
    """Both layers after merging ``incoming``, told apart by ``flag``.

    One keyed merge over both layers, so a key whose verdict flips leaves its former layer.
    """
    existing = relevant.withColumn(flag, F.lit(True)).unionByName(
        irrelevant.withColumn(flag, F.lit(False)), allowMissingColumns=True
    )
    return upsert(existing, incoming, keys, order)


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; absent columns become null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, surplus rows and null keys in one row.

    Counting per key first keeps the work spread even if one key holds most rows.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    present = F.count(key)
    nulls = F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0))
    groups = F.count(F.lit(1))
    return per_key.agg(
        total.alias("total_rows"),
        present.alias("distinct_keys"),
        (total - groups).alias("duplicate_rows"),
        nulls.alias("null_keys"),
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def _processed_flags(core: DataFrame, relevant: DataFrame, irrelevant: DataFrame, key: str) -> DataFrame:
    """One row per key with a membership flag for each of the three inputs (a single shuffle)."""
    sides = [
        frame.select(F.col(key), *[F.lit(i == j).alias(name) for j, name in enumerate(("core", "rel", "irr"))])
        for i, frame in enumerate((core, relevant, irrelevant))
    ]
    return union_all(*sides).groupBy(key).agg(*[F.bool_or(n).alias(n) for n in ("core", "rel", "irr")])


def coverage(core: DataFrame, relevant: DataFrame, irrelevant: DataFrame, key: str) -> DataFrame:
    """How much of the core table has a verdict, as one row."""
    flags = _processed_flags(core, relevant, irrelevant, key)
    processed = F.col("rel") | F.col("irr")
    missing = F.count_if(F.col("core") & ~processed)
    keys = F.count_if(F.col("core"))
    return flags.agg(
        keys.alias("core_keys"),
        F.count_if("rel").alias("relevant_keys"),
        F.count_if("irr").alias("irrelevant_keys"),
        F.count_if(processed).alias("processed_keys"),
        missing.alias("missing_keys"),
        F.when(keys > 0, F.round(missing * 100.0 / keys, 1)).otherwise(0.0).alias("missing_percent"),
    )


def missing_keys(core: DataFrame, relevant: DataFrame, irrelevant: DataFrame, key: str) -> DataFrame:
    """Keys without any verdict."""
    flags = _processed_flags(core, relevant, irrelevant, key)
    return flags.where("core and not rel and not irr").select(key)
