"""Queries over listings: statistics, trends, search, dedup, contracts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry.functions.dates import month_label
from parcelry.operators import console, contracts, dedup, listings as ops, stats, trends
from parcelry.operators.listings import LISTING_VIEW
from parcelry.plans.bindings import AS_OF, LISTINGS_SQL, TIE_BREAK, listings, table
from parcelry.plans.registry import Registry, rounded
from parcelry.sources.tables import in_batches, profile

registry = Registry()
query = registry.query

STATISTIC_INPUTS = (
    "article_id",
    "price_huf",
    "area_sqm",
    "rooms",
    "floor",
    "price_per_sqm",
    "valid_from",
    "valid_till",
    "building_type",
    "property_category",
    "has_terrace",
    "district",
)
ALL_SHARES = ("tegla_arany", "panel_arany", "lakas_arany", "terasz_arany")

STATISTICS_SQL = f"""WITH {LISTINGS_SQL}, stats AS (
  SELECT district, count(article_id) AS hirdetesek_szama,
         avg(price_huf) AS atlagar, min(price_huf) AS min_ar, max(price_huf) AS max_ar,
         stddev_samp(price_huf) AS ar_szoras, avg(area_sqm) AS atlag_nm, avg(rooms) AS atlag_szobaszam,
         avg(floor) AS atlag_emelet, avg(price_per_sqm) AS atlag_ar_per_nm,
         stddev_samp(price_per_sqm) AS nm_ar_szoras,
         avg(floor((epoch_us(valid_till) - epoch_us(valid_from)) / 86400000000.0)) AS atlag_piacido,
         avg(CASE WHEN building_type = 'tegla' THEN 1::DOUBLE ELSE 0 END) * 100 AS tegla_arany,
         avg(CASE WHEN building_type = 'panel' THEN 1::DOUBLE ELSE 0 END) * 100 AS panel_arany,
         avg(CASE WHEN property_category = 'lakas' THEN 1::DOUBLE ELSE 0 END) * 100 AS lakas_arany,
         avg(CASE WHEN has_terrace THEN 1::DOUBLE ELSE 0 END) * 100 AS terasz_arany
  FROM listings WHERE district IS NOT NULL GROUP BY district)
"""


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.district_statistics(listings(spark, sf_dir, STATISTIC_INPUTS))


@query(
    STATISTICS_SQL
    + """SELECT district, hirdetesek_szama, round(atlagar, 2) AS atlagar, min_ar, max_ar, round(ar_szoras, 2) AS ar_szoras,
       round(atlag_nm, 6) AS atlag_nm, round(atlag_szobaszam, 6) AS atlag_szobaszam,
       round(atlag_emelet, 6) AS atlag_emelet, round(atlag_ar_per_nm, 2) AS atlag_ar_per_nm,
       round(nm_ar_szoras, 2) AS nm_ar_szoras, round(atlag_piacido, 6) AS atlag_piacido,
       round(tegla_arany, 6) AS tegla_arany, round(panel_arany, 6) AS panel_arany,
       round(lakas_arany, 6) AS lakas_arany, round(terasz_arany, 6) AS terasz_arany
FROM stats ORDER BY district"""
)
def district_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = ("atlagar", "ar_szoras", "atlag_ar_per_nm", "nm_ar_szoras")
    means = ("atlag_nm", "atlag_szobaszam", "atlag_emelet", "atlag_piacido", *ALL_SHARES)
    return rounded(rounded(_statistics(spark, sf_dir), 2, *money), 6, *means)


def _shown(column: str, decimals: int, unit: str) -> str:
    return f"coalesce(format('{{:,.{decimals}f}}', {column}) || '{unit}', 'N/A')"


@query(
    STATISTICS_SQL
    + "SELECT district AS \"Kerület\", hirdetesek_szama AS \"Hirdetések száma\", "
    + ", ".join(
        f'{_shown(column, decimals, unit)} AS "{stats.STATISTIC_HEADINGS[column]}"'
        for column, (decimals, unit) in stats.STATISTIC_FORMATS.items()
    )
    + " FROM stats"
)
def formatted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.formatted_statistics(_statistics(spark, sf_dir))


@query(f"WITH {LISTINGS_SQL} SELECT district, count(*) AS count FROM listings GROUP BY district ORDER BY count DESC")
def district_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_console(spark, listings(spark, sf_dir, ["article_id", "district"]), ops.console_text("count_by_district"))


@query(
    f"""WITH {LISTINGS_SQL}
SELECT n_name AS district, count(article_id) AS listing_count
FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) LEFT JOIN listings ON n_name = district
GROUP BY n_name"""
)
def district_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are districts as well, without a listing."""
    districts = table(spark, sf_dir, "nation").select("n_name").union(table(spark, sf_dir, "region").select("r_name"))
    rows = listings(spark, sf_dir, ["article_id", "district"])
    return stats.counts_for_all(districts.toDF("district"), rows, "district", "listing_count")


@query(
    f"""WITH {LISTINGS_SQL}
SELECT count(*) FILTER (relevant) AS relevant_count, count(*) FILTER (NOT relevant) AS irrelevant_count,
       count(*) AS total_count FROM listings"""
)
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.layer_counts(listings(spark, sf_dir, ["relevant"]))


# ---- Trends ---------------------------------------------------------------------------------

TREND = trends.TrendFilter(as_of=AS_OF, area_min=5, area_max=45, lookback_months=24)
TREND_INPUTS = ("price_huf", "price_per_sqm", "area_sqm", "delivery_day", "relevant")
TREND_SQL = f"""WITH {LISTINGS_SQL}, chosen AS (
  SELECT date_trunc('month', delivery_day) AS month, * FROM listings
  WHERE area_sqm >= 5 AND area_sqm <= 45 AND relevant AND price_huf IS NOT NULL
    AND delivery_day >= TIMESTAMP '{AS_OF}' - INTERVAL 720 DAY
), months AS (
  SELECT month, avg(price_huf) AS avg_price, median(price_huf) AS median_price, count(price_huf) AS n,
         avg(price_per_sqm) AS avg_price_per_sqm, median(price_per_sqm) AS median_price_per_sqm,
         avg(area_sqm) AS avg_area, row_number() OVER (ORDER BY month) - 1 AS month_index
  FROM chosen GROUP BY month
), line AS (
  SELECT sum(n) AS n_rows, count(*) AS n_months, regr_slope(avg_price_per_sqm, month_index) AS slope,
         regr_intercept(avg_price_per_sqm, month_index) AS intercept, max(month) AS last_month,
         arg_max(avg_price_per_sqm, month) AS current_price FROM months
)
"""


def _trend_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir, TREND_INPUTS)


@query(
    TREND_SQL
    + """SELECT strftime(month, '%Y-%m') AS year_month, round(avg_price, 2) AS avg_price, median_price, n AS count,
       round(avg_price_per_sqm, 2) AS avg_price_per_sqm, median_price_per_sqm, round(avg_area, 6) AS avg_area
FROM months ORDER BY month"""
)
def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = trends.monthly_statistics(trends.trend_rows(_trend_listings(spark, sf_dir), TREND))
    return rounded(rounded(months.drop("month"), 2, "avg_price", "avg_price_per_sqm"), 6, "avg_area").orderBy("year_month")


@query(
    TREND_SQL
    + """SELECT CAST(step AS INTEGER) AS step, strftime(last_month + to_months(CAST(step AS INTEGER)), '%Y-%m') AS year_month,
       round(intercept + slope * (n_months - 1 + step), 2) AS prediction
FROM line, range(1, 7) AS r(step)"""
)
def trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trends.forecast(_trend_listings(spark, sf_dir), TREND), 2, "prediction")


@query(
    TREND_SQL
    + """, scored AS (SELECT *, intercept + slope * (n_months - 1 + 6) AS predicted FROM line)
SELECT CAST(n_rows AS BIGINT) AS count, n_months AS months_analyzed, round(current_price, 2) AS current_avg_price_per_sqm,
       round(predicted, 2) AS predicted_6m_price_per_sqm, round(predicted - current_price, 2) AS change_6m_absolute,
       round((predicted - current_price) / current_price * 100, 6) AS change_6m_percent,
       CASE WHEN abs((predicted - current_price) / current_price * 100) < 2 THEN 'Stagnálás'
            WHEN predicted > current_price THEN 'Drágulás' ELSE 'Olcsósodás' END AS trend_label,
       CASE WHEN abs((predicted - current_price) / current_price * 100) < 2 THEN 'warning'
            WHEN predicted > current_price THEN 'danger' ELSE 'success' END AS trend_color,
       round(slope, 4) AS monthly_slope FROM scored"""
)
def trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = trends.trend_summary(_trend_listings(spark, sf_dir), TREND)
    money = ("current_avg_price_per_sqm", "predicted_6m_price_per_sqm", "change_6m_absolute")
    return rounded(rounded(rounded(summary, 2, *money), 6, "change_6m_percent"), 4, "monthly_slope")


GUARDS = {
    "all": trends.TrendFilter(as_of=AS_OF),
    "one_district": trends.TrendFilter(as_of=AS_OF, district="NATION_3"),
    "two_months": trends.TrendFilter(as_of="2001-11-10", lookback_months=1),
    "nothing": trends.TrendFilter(as_of="2031-11-30"),
}


def _guard_sql(name: str, chosen: trends.TrendFilter) -> str:
    district = f"AND district = '{chosen.district}'" if chosen.district else ""
    return f"""SELECT '{name}' AS selection, count(*) AS count, count(DISTINCT date_trunc('month', delivery_day)) AS months
  FROM listings WHERE relevant AND price_huf IS NOT NULL {district}
  AND delivery_day >= TIMESTAMP '{chosen.as_of}' - INTERVAL {30 * chosen.lookback_months} DAY"""


@query(
    f"WITH {LISTINGS_SQL}, guards AS ("
    + " UNION ALL ".join(_guard_sql(name, chosen) for name, chosen in GUARDS.items())
    + """) SELECT selection, CASE WHEN count < 10 THEN 'few_rows' WHEN months < 3 THEN 'few_months' ELSE 'ok' END AS status,
       count, months FROM guards"""
)
def trend_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, [*TREND_INPUTS, "district"])
    checks = [trends.trend_status(rows, c).select(F.lit(n).alias("selection"), "*") for n, c in GUARDS.items()]
    return dedup.union_all(*checks)


@query(
    TREND_SQL
    + """SELECT CAST(month_index AS INTEGER) AS position, strftime(month, '%Y-%m') AS year_month,
       round(avg_price_per_sqm, 2) AS history,
       CASE WHEN month = last_month THEN round(avg_price_per_sqm, 2) END AS forecast FROM months, line
UNION ALL
SELECT CAST(n_months - 1 + step AS INTEGER), strftime(last_month + to_months(CAST(step AS INTEGER)), '%Y-%m'),
       NULL, round(intercept + slope * (n_months - 1 + step), 2) FROM line, range(1, 7) AS r(step)"""
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trends.chart_series(_trend_listings(spark, sf_dir), TREND), 2, "history", "forecast")


# ---- Search and console ---------------------------------------------------------------------


@query(
    f"""WITH {LISTINGS_SQL}
SELECT article_id, title, price_huf, rooms FROM listings
WHERE (contains(lower(title), 'ring') OR contains(CAST(CAST(price_huf AS BIGINT) AS VARCHAR), 'ring'))
  AND price_huf >= 20000000 AND price_huf <= 60000000 AND rooms >= 4"""
)
def filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["article_id", "title", "price_huf", "rooms"])
    return ops.search(rows, term="RING", min_millions=20, max_millions=60, rooms="4")


@query(
    f"""WITH {LISTINGS_SQL}
SELECT article_id, title, price_huf, rooms FROM listings
WHERE (contains(lower(title), '777') OR contains(CAST(CAST(price_huf AS BIGINT) AS VARCHAR), '777')) AND rooms = 3"""
)
def price_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["article_id", "title", "price_huf", "rooms"])
    return ops.search(rows, term="777", rooms="3")


@query(
    f"""WITH {LISTINGS_SQL} SELECT article_id, title, price_huf, rooms, area_sqm, price_per_sqm, district, building_type,
       property_category FROM listings WHERE district = 'NATION_7'"""
)
def listings_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [c for c in ops.DISTRICT_LISTING_COLUMNS if c not in ("description", "link")]
    return ops.district_listing(listings(spark, sf_dir, wanted), "NATION_7")


ACTIVE_DAY = "2000-06-15"


@query(
    f"""WITH {LISTINGS_SQL} SELECT count(*) AS active FROM listings
WHERE valid_till IS NULL OR CAST(valid_till AS DATE) >= DATE '{ACTIVE_DAY}'"""
)
def active_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["article_id", "valid_till"])
    return ops.run_console(spark, rows, ops.console_text("active_count", day=ACTIVE_DAY))


@query(
    f"""WITH {LISTINGS_SQL} SELECT district, count(*) AS active FROM listings
WHERE valid_till IS NULL OR CAST(valid_till AS DATE) >= DATE '{ACTIVE_DAY}' GROUP BY district"""
)
def active_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["district", "valid_till"])
    return stats.counts_by(rows.where(ops.is_active(ACTIVE_DAY)), "district", "active")


@query(
    f"""WITH {LISTINGS_SQL} SELECT strftime(valid_from, '%Y-%m') AS posted_month, count(*) AS posted FROM listings
WHERE date_trunc('month', valid_from) = DATE '1998-03-01' GROUP BY 1"""
)
def posted_in_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["valid_from"]).where(ops.posted_in_month("1998-03-15"))
    return rows.groupBy(month_label("valid_from").alias("posted_month")).agg(F.count(F.lit(1)).alias("posted"))


@query(f"WITH {LISTINGS_SQL} SELECT count(*) AS posted FROM listings WHERE CAST(valid_from AS DATE) = DATE '1998-03-15'")
def posted_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["article_id", "valid_from"])
    return ops.run_console(spark, rows, ops.console_text("posted_on_day", day="1998-03-15"))


@query(
    f"""WITH {LISTINGS_SQL} SELECT article_id, price_huf, area_sqm FROM listings
ORDER BY price_huf DESC, article_id LIMIT 1"""
)
def most_expensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["article_id", "price_huf", "area_sqm"])
    return ops.run_console(spark, rows, ops.console_text("most_expensive"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["article_id", "valid_from"])
    return rows.withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd"))


@query(
    f"""WITH {LISTINGS_SQL} SELECT DISTINCT article_id, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM listings
ORDER BY valid_from DESC, article_id LIMIT 1"""
)
def newest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_console(spark, _dated(spark, sf_dir), ops.console_text("newest"))


@query(
    f"""WITH {LISTINGS_SQL} SELECT DISTINCT article_id, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM listings
ORDER BY valid_from, article_id LIMIT 1"""
)
def oldest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_console(spark, _dated(spark, sf_dir), ops.console_text("oldest"))


@query(f"WITH {LISTINGS_SQL} SELECT round(avg(price_huf), 2) AS avg_price FROM listings WHERE district = 'NATION_6'")
def average_price_in_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["district", "price_huf"])
    return rounded(ops.run_console(spark, rows, ops.console_text("average_price", district="NATION_6")), 2, "avg_price")


def _ask(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A question over the listings and the districts."""
    rows = listings(spark, sf_dir, ["article_id", "district", "building_type", "price_huf", "area_sqm", "relevant"])
    districts = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    views = {LISTING_VIEW: rows, "districts": districts.selectExpr("n_name as district", "r_name as region")}
    return console.run_console(spark, views, text)


#: Questions that Spark and the checking database read alike.
WINDOW_QUESTION = """SELECT district, price_huf, article_id, place FROM (
  SELECT district, price_huf, article_id, rank() OVER (PARTITION BY district ORDER BY price_huf DESC, article_id) AS place FROM relevant_data) ranked
WHERE place <= 3"""
SET_QUESTION = """SELECT district FROM relevant_data WHERE relevant GROUP BY district HAVING count(*) > 0
INTERSECT SELECT district FROM districts WHERE region <> 'ASIA'
UNION SELECT region FROM districts EXCEPT SELECT 'EUROPE'"""
COMMON_QUESTION = """WITH sums AS (SELECT district, building_type, count(*) AS n, sum(price_huf) AS total FROM relevant_data GROUP BY district, building_type),
shares AS (SELECT region, sum(n) AS n, sum(total) AS total FROM sums JOIN districts USING (district) GROUP BY region)
SELECT region, CAST(n AS BIGINT) AS n_rows, round(total / n, 2) AS mean_price FROM shares"""
SUBQUERY_QUESTION = """SELECT district, count(*) AS dear FROM relevant_data AS r
WHERE price_huf > (SELECT avg(price_huf) FROM relevant_data) AND district IN (SELECT district FROM districts WHERE region LIKE 'A%')
  AND EXISTS (SELECT 1 FROM districts AS d WHERE d.district = r.district) GROUP BY district"""
_VIEWS_SQL = f"""WITH {LISTINGS_SQL}, relevant_data AS (SELECT * FROM listings), districts AS (
  SELECT n_name AS district, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey) """


@query(f"{_VIEWS_SQL} {WINDOW_QUESTION}")
def console_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, WINDOW_QUESTION)


@query(f"{_VIEWS_SQL} {SET_QUESTION}")
def console_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, SET_QUESTION)


@query(f"{_VIEWS_SQL} SELECT * FROM ({COMMON_QUESTION}) answer")
def console_common_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, COMMON_QUESTION)


@query(f"{_VIEWS_SQL} {SUBQUERY_QUESTION}")
def console_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, SUBQUERY_QUESTION)


@query(
    f"""WITH {LISTINGS_SQL}, ranked AS (
  SELECT district, building_type, avg(price_per_sqm) AS p, grouping_id(district, building_type) AS g
  FROM listings GROUP BY CUBE (district, building_type))
SELECT district, building_type, round(p, 2) AS avg_price_per_sqm, CAST(g AS BIGINT) AS grouping FROM ranked"""
)
def console_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, ["district", "building_type", "price_per_sqm"])
    return ops.run_console(
        spark,
        rows,
        """WITH ranked AS (
             SELECT district, building_type, avg(price_per_sqm) AS p, grouping_id(district, building_type) AS g
             FROM relevant_data GROUP BY CUBE (district, building_type))
           SELECT district, building_type, round(p, 2) AS avg_price_per_sqm, g AS grouping FROM ranked;""",
    )


# ---- Dedup, upsert, coverage ----------------------------------------------------------------

KEYED = ("article_id", "price_huf", "area_sqm", "relevant", *TIE_BREAK[:3])
_ORDER_SQL = "delivery_day {d} {n}, part_id {d}, supplier_id {d}, price_huf {d}"
FIRST_ORDER_SQL = _ORDER_SQL.format(d="ASC", n="NULLS FIRST")
LAST_ORDER_SQL = _ORDER_SQL.format(d="DESC", n="NULLS LAST")


@query(
    f"""WITH {LISTINGS_SQL}, seen AS (SELECT DISTINCT article_id FROM listings WHERE part_id % 10 = 0)
SELECT article_id, price_huf, part_id FROM listings WHERE article_id NOT IN (SELECT article_id FROM seen)
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY {FIRST_ORDER_SQL}) = 1"""
)
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, KEYED)
    seen = rows.where(F.col("part_id") % 10 == 0)
    return dedup.first_per_key(rows, ["article_id"], TIE_BREAK, exclude=seen).select("article_id", "price_huf", "part_id")


@query(
    f"""WITH {LISTINGS_SQL} SELECT article_id, price_huf, part_id FROM listings
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY {LAST_ORDER_SQL}) = 1"""
)
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, KEYED)
    return dedup.last_per_key(rows, ["article_id"], TIE_BREAK).select("article_id", "price_huf", "part_id")


@query(
    f"""WITH {LISTINGS_SQL}, generations AS (
  SELECT article_id, relevant, price_huf, delivery_day, part_id, supplier_id, 0 AS generation FROM listings
  UNION ALL
  SELECT article_id, NOT relevant, price_huf + 1, delivery_day, part_id, supplier_id, 1 FROM listings WHERE part_id % 5 = 0
), latest AS (
  SELECT * FROM generations
  QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY generation DESC, {LAST_ORDER_SQL}) = 1)
SELECT article_id, relevant, price_huf FROM latest"""
)
def upsert_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, KEYED)
    incoming = (
        rows.where(F.col("part_id") % 5 == 0)
        .withColumn("relevant", ~F.col("relevant"))
        .withColumn("price_huf", F.col("price_huf") + 1)
    )
    relevant, irrelevant = rows.where("relevant").drop("relevant"), rows.where("not relevant").drop("relevant")
    merged = dedup.upsert_layers(relevant, irrelevant, incoming, ["article_id"], TIE_BREAK)
    return merged.select("article_id", "relevant", "price_huf")


@query(
    f"""WITH {LISTINGS_SQL}, core AS (SELECT DISTINCT article_id FROM listings),
rel AS (SELECT DISTINCT article_id FROM listings WHERE relevant AND part_id % 4 <> 0),
irr AS (SELECT DISTINCT article_id FROM listings WHERE NOT relevant AND part_id % 4 <> 0),
processed AS (SELECT * FROM rel UNION SELECT * FROM irr)
SELECT (SELECT count(*) FROM core) AS core_keys, (SELECT count(*) FROM rel) AS relevant_keys,
       (SELECT count(*) FROM irr) AS irrelevant_keys, (SELECT count(*) FROM processed) AS processed_keys,
       (SELECT count(*) FROM (SELECT * FROM core EXCEPT SELECT * FROM processed)) AS missing_keys,
       round((SELECT count(*) FROM (SELECT * FROM core EXCEPT SELECT * FROM processed)) * 100.0::DOUBLE
             / (SELECT count(*) FROM core), 1) AS missing_percent"""
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.coverage(*_layers(spark, sf_dir), "article_id")


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    core = listings(spark, sf_dir, ["article_id", "relevant", "part_id"])
    done = core.where(F.col("part_id") % 4 != 0)
    return core, done.where("relevant"), done.where("not relevant")


@query(
    f"""WITH {LISTINGS_SQL} SELECT DISTINCT article_id FROM listings EXCEPT
SELECT article_id FROM listings WHERE part_id % 4 <> 0"""
)
def missing_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.missing_keys(*_layers(spark, sf_dir), "article_id")


@query(f"WITH {LISTINGS_SQL} SELECT DISTINCT building_type FROM listings WHERE building_type IS NOT NULL")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.distinct_values(listings(spark, sf_dir, ["building_type"]), "building_type")


@query(
    f"""WITH {LISTINGS_SQL} SELECT count(*) AS total_rows, count(DISTINCT article_id) AS distinct_keys,
       count(*) - count(DISTINCT article_id) AS duplicate_rows, count(*) FILTER (article_id IS NULL) AS null_keys FROM listings"""
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_summary(listings(spark, sf_dir, ["article_id"]), "article_id")


@query(
    f"WITH {LISTINGS_SQL} SELECT article_id, count(*) AS occurrences FROM listings GROUP BY article_id HAVING count(*) > 1"
)
def repeated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated_keys(listings(spark, sf_dir, ["article_id"]), "article_id")


def _totals(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "quantity": [pc.sum(batch.column("l_quantity")).as_py()]})


@query(
    """SELECT count(*) AS n_rows, sum(l_quantity) AS quantity, true AS bounded FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-06-01' AND l_discount > 0.02"""
)
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that a function takes batch by batch over a pruned scan."""
    late = (F.col("l_shipdate") >= F.lit("1995-06-01").cast("timestamp")) & (F.col("l_discount") > 0.02)
    columns = ["l_quantity", "l_shipdate", "l_discount"]
    found = in_batches(spark, f"{sf_dir}/lineitem.parquet", _totals, "n long, quantity double", columns, late, 1_000)
    return found.agg(F.sum("n").alias("n_rows"), F.sum("quantity").alias("quantity"), (F.max("n") <= 1_000).alias("bounded"))


@query("SELECT count(*) AS total_rows, CAST(11 AS INTEGER) AS num_columns FROM lineitem")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, f"{sf_dir}/lineitem.parquet").select("total_rows", "num_columns")


@query(
    f"""WITH {LISTINGS_SQL} SELECT 'area_sqm out of range' AS rule, count(*) AS n_rows FROM listings
WHERE area_sqm < 10 OR area_sqm > 1000"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violation_counts(listings(spark, sf_dir, ["article_id", "price_huf", "area_sqm"]))


@query(
    f"""WITH {LISTINGS_SQL} SELECT relevant, count(*) AS n_rows, min(price_huf) AS lowest, max(price_huf) AS highest
FROM listings WHERE price_huf BETWEEN 15000000 AND 300000000 AND area_sqm > 0 GROUP BY relevant"""
)
def price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contracts.price_band(listings(spark, sf_dir, ["relevant", "price_huf", "area_sqm"]))
    return rows.groupBy("relevant").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("price_huf").alias("lowest"), F.max("price_huf").alias("highest")
    )


# ---- Run log --------------------------------------------------------------------------------

_DURATION_SQL = """CASE WHEN eta IS NULL OR eta = 0 THEN '' WHEN eta < 60 THEN CAST(floor(eta) AS BIGINT) || 's'
  WHEN eta < 3600 THEN CAST(floor(eta / 60) AS BIGINT) || 'm ' || (CAST(floor(eta) AS BIGINT) % 60) || 's'
  ELSE CAST(floor(eta / 3600) AS BIGINT) || 'h ' || CAST(floor((CAST(floor(eta) AS BIGINT) % 3600) / 60) AS BIGINT) || 'm' END"""


@query(
    f"""WITH runs AS (
  SELECT user_id, count(*) AS total_items, count(*) FILTER (event_type <> 'error') AS processed_items,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS elapsed FROM events GROUP BY user_id
), rates AS (
  SELECT *, CASE WHEN processed_items > 0 AND processed_items * 100.0 / total_items > 1 AND elapsed > 0
                 THEN processed_items / elapsed END AS per_second FROM runs
), estimates AS (SELECT *, CASE WHEN per_second > 0 THEN (total_items - processed_items) / per_second END AS eta FROM rates)
SELECT user_id, total_items, processed_items, round(elapsed, 3) AS elapsed_seconds,
       round(per_second, 9) AS items_per_second, round(eta, 3) AS eta_seconds,
       round(elapsed + eta, 3) AS estimated_total_seconds, {_DURATION_SQL} AS eta_text,
       CASE WHEN per_second < 1 THEN printf('%.1f', per_second * 60) || ' elem/perc'
            WHEN per_second >= 1 THEN printf('%.2f', per_second) || ' elem/sec' END AS rate_text
FROM estimates"""
)
def eta_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events")
    runs = stats.whole_group_throughput(log, "user_id", "ts", F.col("event_type") != "error")
    return rounded(rounded(runs, 3, "elapsed_seconds", "eta_seconds", "estimated_total_seconds"), 9, "items_per_second")
