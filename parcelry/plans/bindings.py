"""Listing-shaped views over the benchmark tables, in Spark and in the checking SQL.

A listing is an order line: its key repeats, its district is the customer's nation, its prices are
whole forints.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.session import spread

# Reporting moment for listings and for the event log.
AS_OF = "2001-11-30"
EVENTS_AS_OF = "2024-01-31"

# Columns that break ties between rows of one key.
TIE_BREAK = ("delivery_day", "part_id", "supplier_id", "price_huf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores: every query on them does heavy work per text."""
    return spread(table(spark, sf_dir, "documents"))


def _area_price() -> tuple[Column, Column]:
    return F.col("l_quantity"), F.round(F.col("l_extendedprice") * 1000)


# Which joined table each listing column comes from.
_NEEDS = {
    "district": ("orders", "customer", "nation"),
    "valid_from": ("orders",),
    "rooms": ("part",),
    "building_type": ("part",),
    "title": ("part",),
}


# Order-line columns behind each listing column.
_LINE_COLUMNS = {
    "article_id": ("l_orderkey", "l_linenumber"),
    "title": (),
    "price_huf": ("l_extendedprice",),
    "area_sqm": ("l_quantity",),
    "price_per_sqm": ("l_extendedprice", "l_quantity"),
    "rooms": (),
    "floor": ("l_tax",),
    "district": (),
    "delivery_day": ("l_shipdate",),
    "valid_from": (),
    "valid_till": ("l_linenumber", "l_shipdate"),
    "building_type": (),
    "property_category": ("l_linestatus",),
    "has_terrace": ("l_linenumber", "l_returnflag"),
    "relevant": ("l_returnflag",),
    "part_id": (),
    "supplier_id": ("l_suppkey",),
}


def listings(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """The requested listing columns; only the tables they come from are joined.

    Every order line has exactly one order, customer, nation and part, so leaving a join out keeps
    the rows.
    """
    area, price = _area_price()
    formulas = {
        "article_id": (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"),
        "title": F.col("p_name"),
        "price_huf": price,
        "area_sqm": area,
        "price_per_sqm": F.round(price / area),
        "rooms": F.when(F.col("l_orderkey") % 17 != 0, F.col("p_size").cast("double")),
        "floor": F.when(F.col("l_orderkey") % 13 != 0, F.round(F.col("l_tax") * 100).cast("int")),
        "district": F.col("n_name"),
        "delivery_day": F.when(F.col("l_orderkey") % 19 != 0, F.col("l_shipdate")),
        "valid_from": F.col("o_orderdate"),
        "valid_till": F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")),
        "building_type": F.when(F.col("p_type") == "SMALL", "panel")
        .when(F.col("p_type") == "LARGE", "Tégla ")
        .when(F.col("p_type") == "MEDIUM", "tegla")
        .when(F.col("p_type") != "PROMO", "egyeb"),
        "property_category": F.when(F.col("l_linestatus") == "O", "lakas").otherwise("haz"),
        "has_terrace": F.when(F.col("l_linenumber") != 3, F.col("l_returnflag") == "R"),
        "relevant": F.col("l_returnflag") != "A",
        "part_id": F.col("l_partkey"),
        "supplier_id": F.col("l_suppkey"),
    }
    needed = {t for c in columns for t in _NEEDS.get(c, ())}
    rows = table(spark, sf_dir, "lineitem")
    if needed:
        # Only the columns in use travel when the scan has to be redistributed.
        used = {t for c in columns for t in _LINE_COLUMNS[c]} | {"l_orderkey", "l_partkey"}
        rows = spread(rows.select(*sorted(used)))
    if "part" in needed:
        part = table(spark, sf_dir, "part")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if "orders" in needed:
        orders = table(spark, sf_dir, "orders")
        if "customer" in needed:
            # A nation table has one row per country; the customers join it before the orders do.
            nation = table(spark, sf_dir, "nation")
            customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*[formulas[c].alias(c) for c in columns])


LISTINGS_SQL = """listings AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS article_id,
         p_name AS title,
         round(l_extendedprice * 1000) AS price_huf,
         l_quantity AS area_sqm,
         round(round(l_extendedprice * 1000) / l_quantity) AS price_per_sqm,
         CASE WHEN l_orderkey % 17 <> 0 THEN CAST(p_size AS DOUBLE) END AS rooms,
         CASE WHEN l_orderkey % 13 <> 0 THEN CAST(round(l_tax * 100) AS INTEGER) END AS floor,
         n_name AS district,
         CASE WHEN l_orderkey % 19 <> 0 THEN l_shipdate END AS delivery_day,
         o_orderdate AS valid_from,
         CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS valid_till,
         CASE p_type WHEN 'SMALL' THEN 'panel' WHEN 'LARGE' THEN 'Tégla ' WHEN 'MEDIUM' THEN 'tegla'
                     WHEN 'PROMO' THEN NULL ELSE 'egyeb' END AS building_type,
         CASE WHEN l_linestatus = 'O' THEN 'lakas' ELSE 'haz' END AS property_category,
         CASE WHEN l_linenumber <> 3 THEN l_returnflag = 'R' END AS has_terrace,
         l_returnflag <> 'A' AS relevant,
         l_partkey AS part_id, l_suppkey AS supplier_id
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""

# Phrases appended to the documents so that every rule has something to decide.
PHRASES = (
    "",
    " Tulajdoni hányad eladó.",
    " Az ingatlan haszonélvezettel terhelt.",
    " Nincs haszonélvezet, a ház tehermentes.",
    " Osztatlan közös tulajdon, 475/1000 rész.",
    " Osztatlan közös kertrész.",
    " Bérleti jog átadó.",
    " Önkormányzati ingatlan, de teljes tulajdon lehetséges.",
    " Kisebbre cserélhető lakás, a haszonélvezet törölve.",
    " Haszonélvezet bejegyezve. Ez egy hosszabb mondat, amely messzire viszi a szöveget. Nincs lift.",
    " Ingatlancserét nem kérek, családi ház a közelben.",
    " Csak készpénzes vevőknek.",
    " Ingatlancsere érdekel.",
)


def article_columns() -> list[Column]:
    """Listing columns computed from a document row."""
    doc = F.col("doc_id")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (doc % len(PHRASES) + 1).cast("int"))
    description = (
        F.when(doc % 23 == 0, F.lit(None))
        .when(doc % 29 == 0, F.lit(" Röviden. "))
        .otherwise(F.concat("text", phrase))
    )
    return [
        doc.cast("string").alias("article_id"),
        F.when(doc % 31 != 0, F.concat(F.lit("Eladó ("), "lang", F.lit(") "), "source")).alias("title"),
        description.alias("description"),
        F.when(doc % 37 == 0, -1.0).otherwise(F.col("n_chars") * 1000.0).alias("price_huf"),
        (doc % 120 + 5).cast("double").alias("area_sqm"),
        F.col("lang").alias("district"),
    ]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings with text: some titles and descriptions missing, some very short."""
    return documents(spark, sf_dir).select(*article_columns())


_PHRASE_SQL = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))
ARTICLES_SQL = f"""articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS article_id,
         CASE WHEN doc_id % 31 <> 0 THEN 'Eladó (' || lang || ') ' || source END AS title,
         CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN ' Röviden. '
              ELSE text || CASE doc_id % {len(PHRASES)} {_PHRASE_SQL} END END AS description,
         CASE WHEN doc_id % 37 = 0 THEN -1.0 ELSE n_chars * 1000.0 END AS price_huf,
         CAST(doc_id % 120 + 5 AS DOUBLE) AS area_sqm,
         lang AS district
  FROM documents
)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples for the nearest-example classifier."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"))
    return documents(spark, sf_dir).select("doc_id", F.col("text").alias("description")).join(labels, "doc_id")


# Model answers of every sound and broken shape, one per document, chosen by its number.
ANSWERS = (
    '{"relevant": true, "reason": "sound", "floor": 3, "street": "Kossuth Lajos utca", "building_type": "tegla", "property_category": "lakas", "has_terrace": true}',
    'Here you are: {"relevant": false, "reason": "share", "floor": "5", "street": "  "} Done.',
    '{"relevant": true, "reason": "bad enum", "building_type": "tégla"}',
    '{"relevant": true, "reason": "too high", "floor": 99}',
    '{"relevant": "yes", "reason": "word", "floor": "x"}',
    '{"relevant": true}',
    '{"reason": "no flag"}',
    "no object at all",
    '{"relevant": true, "reason": "cut',
    '{"relevant": true, "reason": "cut"',
    '{"relevant": "maybe", "reason": "word", "has_terrace": "no"}',
    '```json\\n{"relevant": false, "reason": "fenced", "property_category": "haz", "has_terrace": false}\\n```',
    '{"relevant": false, "reason": "half floor", "floor": 2.5}',
    '{"relevant": 1, "reason": "number", "floor": -5, "has_terrace": 0}',
    '{"relevant": null, "reason": "null flag", "floor": null}',
    '{"relevant": true, "reason": "first"} {"relevant": false}',
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per document; the reason carries the language so that answers differ."""
    doc = F.col("doc_id")
    chosen = F.element_at(
        F.array(*[F.lit(a.replace("\\n", "\n")) for a in ANSWERS]), (doc % len(ANSWERS) + 1).cast("int")
    )
    return documents(spark, sf_dir).select(
        "doc_id", F.regexp_replace(chosen, '"reason": "', F.concat(F.lit('"reason": "'), "lang", F.lit(" "))).alias("answer")
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\\n", "' || chr(10) || '") + "'"


_ANSWER_SQL = "\n".join(f"    WHEN {i} THEN {_sql_text(a)}" for i, a in enumerate(ANSWERS))
ANSWERS_SQL = f"""answers AS (
  SELECT doc_id, replace(CASE doc_id % {len(ANSWERS)}
{_ANSWER_SQL} END, '"reason": "', '"reason": "' || lang || ' ') AS answer
  FROM documents
)"""
