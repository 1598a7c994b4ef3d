"""Types and fixed value ranges of the listing data model."""

from __future__ import annotations

from pyspark.sql import types as T

LISTING = T.StructType(
    [
        T.StructField("article_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("price_huf", T.DoubleType()),
        T.StructField("price_eur", T.DoubleType()),
        T.StructField("area_sqm", T.DoubleType()),
        T.StructField("price_per_sqm", T.DoubleType()),
        T.StructField("rooms", T.DoubleType()),
        T.StructField("district", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("delivery_day", T.StringType()),
        T.StructField("valid_from", T.StringType()),
        T.StructField("valid_till", T.StringType()),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("relevant", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("floor", T.IntegerType()),
        T.StructField("street", T.StringType()),
        T.StructField("building_type", T.StringType()),
        T.StructField("property_category", T.StringType()),
        T.StructField("has_terrace", T.BooleanType()),
    ]
)

CHECKSUM_STATE = T.StructType(
    [
        T.StructField("article_id", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

VERDICT_CACHE = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("verdict", VERDICT),
        T.StructField("created_at", T.TimestampType()),
    ]
)

DECISION_LOG = T.StructType(
    [
        T.StructField("article_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("relevant", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("article_id", T.StringType()),
        T.StructField("description_preview", T.StringType()),
        T.StructField("llm_relevant", T.BooleanType()),
        T.StructField("llm_reason", T.StringType()),
        T.StructField("filtered_by", T.StringType()),
        T.StructField("human_feedback", T.StringType()),
    ]
)

# Column contract, numeric ranges, enumerations, price band.
REQUIRED_COLUMNS = ("article_id", "description")
PRICE_RANGE = (0, 10_000_000_000)
AREA_RANGE = (10, 1000)
FLOOR_RANGE = (-5, 50)
BUILDING_TYPES = ("tegla", "panel", "egyeb")
PROPERTY_CATEGORIES = ("lakas", "haz")
TRAINING_PRICE_BAND = (15_000_000, 300_000_000)
