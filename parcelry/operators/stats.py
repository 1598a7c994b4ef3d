"""Aggregates over the layers: district statistics, counts, run summary, profiles, throughput."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from parcelry.functions.dates import share_percent, to_timestamp, whole_days_between
from parcelry.functions.text import duration, grouped_number, rate


class NotEnoughColumns(ValueError):
    """The table lacks the columns that district statistics need."""


def _share(match: Column) -> Column:
    """Percentage of all rows of the group, where null does not match."""
    return F.avg(F.when(match, 1.0).otherwise(0.0)) * 100


def district_statistics(df: DataFrame, district: str = "district") -> DataFrame:
    """Per district: count, price, size, floor, time on market and category shares.

    Aggregates are added for the columns present. All of them are partial aggregates, so a district
    with most of the rows costs one buffer per input partition.
    """
    columns = set(df.columns)

    def number(name: str) -> Column:
        return F.col(name).try_cast("double")

    counted = "url" if "url" in columns else "article_id"
    aggregates: list[Column] = []
    if counted in columns:
        aggregates.append(F.count(counted).alias("hirdetesek_szama"))
    if "price_huf" in columns:
        price = number("price_huf")
        aggregates += [
            F.avg(price).alias("atlagar"),
            F.min(price).alias("min_ar"),
            F.max(price).alias("max_ar"),
            F.stddev_samp(price).alias("ar_szoras"),
        ]
    for column, name in (("area_sqm", "atlag_nm"), ("rooms", "atlag_szobaszam"), ("floor", "atlag_emelet")):
        if column in columns:
            aggregates.append(F.avg(number(column)).alias(name))
    if "price_per_sqm" in columns:
        unit_price = number("price_per_sqm")
        aggregates += [F.avg(unit_price).alias("atlag_ar_per_nm"), F.stddev_samp(unit_price).alias("nm_ar_szoras")]
    if {"valid_from", "valid_till"} <= columns:
        days = whole_days_between(to_timestamp("valid_till"), to_timestamp("valid_from"))
        aggregates.append(F.avg(days).alias("atlag_piacido"))
    if "building_type" in columns:
        aggregates.append(_share(F.col("building_type") == "tegla").alias("tegla_arany"))
        aggregates.append(_share(F.col("building_type") == "panel").alias("panel_arany"))
    if "property_category" in columns:
        aggregates.append(_share(F.col("property_category") == "lakas").alias("lakas_arany"))
    if "has_terrace" in columns:
        aggregates.append(_share(F.col("has_terrace")).alias("terasz_arany"))
    if district not in columns:
        raise NotEnoughColumns(f"no column {district}")
    if len(aggregates) <= 1:
        raise NotEnoughColumns("nothing to aggregate besides the count")
    return df.where(F.col(district).isNotNull()).groupBy(district).agg(*aggregates).orderBy(district)


# Decimals, unit and heading of every district statistic.
STATISTIC_FORMATS = {
    "atlagar": (0, " Ft"),
    "min_ar": (0, " Ft"),
    "max_ar": (0, " Ft"),
    "ar_szoras": (0, " Ft"),
    "atlag_nm": (1, " m²"),
    "atlag_szobaszam": (1, ""),
    "atlag_emelet": (1, ""),
    "atlag_ar_per_nm": (0, " Ft/m²"),
    "nm_ar_szoras": (0, " Ft/m²"),
    "atlag_piacido": (0, " nap"),
    "tegla_arany": (1, "%"),
    "panel_arany": (1, "%"),
    "lakas_arany": (1, "%"),
    "terasz_arany": (1, "%"),
}
STATISTIC_HEADINGS = {
    "district": "Kerület",
    "hirdetesek_szama": "Hirdetések száma",
    "atlagar": "Átlagár",
    "min_ar": "Min. ár",
    "max_ar": "Max. ár",
    "ar_szoras": "Ár szórás",
    "atlag_nm": "Átlagos méret",
    "atlag_szobaszam": "Átlagos szobaszám",
    "atlag_emelet": "Átlagos emelet",
    "atlag_ar_per_nm": "Átlagos nm-ár",
    "nm_ar_szoras": "Nm-ár szórás",
    "atlag_piacido": "Átlagos piaci idő",
    "tegla_arany": "Tégla arány",
    "panel_arany": "Panel arány",
    "lakas_arany": "Lakás arány",
    "terasz_arany": "Terasz/erkély arány",
}


def formatted_statistics(statistics: DataFrame, headings: bool = True) -> DataFrame:
    """District statistics as display text, under display headings unless told otherwise."""
    shown = statistics.select(
        *[
            grouped_number(c, *STATISTIC_FORMATS[c]).alias(c) if c in STATISTIC_FORMATS else F.col(c)
            for c in statistics.columns
        ]
    )
    return shown.withColumnsRenamed(STATISTIC_HEADINGS) if headings else shown


def counts_by(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per non-null value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def counts_for_all(dimension: DataFrame, df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Counts for every member of the dimension, zero where nothing matches.

    The counts are aggregated first; whether one side is small enough to broadcast is left to AQE.
    """
    counts = counts_by(df, column, name)
    return dimension.join(counts, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def layer_counts(df: DataFrame, flag: str = "relevant") -> DataFrame:
    return df.agg(
        F.count_if(F.col(flag)).alias("relevant_count"),
        F.count_if(~F.col(flag)).alias("irrelevant_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def run_counts(stage: str = "filtered_by", flag: str = "relevant") -> dict[str, Column]:
    """Totals of a classification run, by deciding stage."""
    return {
        "processed": F.count(F.lit(1)),
        "relevant_total": F.count_if(F.col(flag)),
        "irrelevant_total": F.count_if(~F.col(flag)),
        "rule_irrelevant": F.count_if((F.col(stage) == "worker") & ~F.col(flag)),
        "model_decided": F.count_if(F.col(stage) == "llm"),
    }


def run_summary(decisions: DataFrame, stage: str = "filtered_by", flag: str = "relevant") -> DataFrame:
    """Totals of a run with the share that the model had to decide, by a pass over its decisions."""
    return with_model_share(decisions.agg(*[c.alias(n) for n, c in run_counts(stage, flag).items()]))


def with_model_share(totals: DataFrame) -> DataFrame:
    return totals.withColumn("model_share_percent", share_percent(F.col("model_decided"), F.col("processed")))


def observed(decisions: DataFrame, stage: str = "filtered_by", flag: str = "relevant") -> tuple[DataFrame, Observation]:
    """The decisions, and what counts them while they are written or otherwise used for the first time.

    Rows of tasks that run again after a loss are counted again; take ``run_summary`` of the written
    rows where that matters.
    """
    seen = Observation(f"run {uuid.uuid4().hex}")
    return decisions.observe(seen, *[c.alias(n) for n, c in run_counts(stage, flag).items()]), seen


def observed_stream(decisions: DataFrame, name: str, stage: str = "filtered_by", flag: str = "relevant") -> DataFrame:
    """A stream of decisions whose progress reports carry the totals of each micro-batch under ``name``."""
    return decisions.observe(name, *[c.alias(n) for n, c in run_counts(stage, flag).items()])


def summary_of(spark: SparkSession, totals: dict) -> DataFrame:
    """``run_summary`` of totals that were observed."""
    names = list(run_counts())
    return with_model_share(spark.createDataFrame([tuple(totals[n] for n in names)], ", ".join(f"{n} long" for n in names)))


def cache_statistics(lookups: DataFrame, hit: str = "cache_hit") -> DataFrame:
    """Hits, misses and hit rate of a batch of cache look-ups."""
    hits, total = F.count_if(F.col(hit)), F.count(F.lit(1))
    return lookups.agg(
        hits.alias("hits"), (total - hits).alias("misses"), share_percent(hits, total).alias("hit_rate")
    )


def live_cache_entries(cache: DataFrame, as_of: str, ttl_hours: int = 48) -> DataFrame:
    alive = F.col("created_at") > F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))
    return cache.agg(F.count_if(alive).alias("cached_items"))


def throughput(
    runs: DataFrame, processed: Column, total: Column, elapsed: Column, progress: Column | None = None
) -> DataFrame:
    """Rate, remaining and total time per run, plus display texts.

    Nothing is estimated until something was processed and progress passed one percent.
    """
    progress = progress if progress is not None else processed * 100.0 / total
    per_second = F.when((processed > 0) & (progress > 1.0) & (elapsed > 0), processed / elapsed)
    eta = F.when(per_second > 0, (total - processed) / per_second)
    return (
        runs.withColumn("elapsed_seconds", elapsed)
        .withColumn("items_per_second", per_second)
        .withColumn("eta_seconds", eta)
        .withColumn("estimated_total_seconds", F.col("elapsed_seconds") + F.col("eta_seconds"))
        .withColumn("eta_text", duration("eta_seconds"))
        .withColumn("rate_text", rate("items_per_second"))
    )


def whole_group_throughput(log: DataFrame, run: str, ts: str, done: Column) -> DataFrame:
    """Throughput of each run in an event log: counts and first/last time per run, then the estimate."""
    moment = F.col(ts).cast("timestamp")
    runs = log.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(done).alias("processed_items"),
        ((F.unix_micros(F.max(moment)) - F.unix_micros(F.min(moment))) / 1e6).alias("span"),
    )
    return throughput(runs, F.col("processed_items"), F.col("total_items"), F.col("span")).drop("span")
