"""Decision log, feedback, GeoJSON and map XML readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parcelry.schema import DECISION_LOG, FEEDBACK

POINT = "array<double>"


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, DECISION_LOG)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed queue, as parquet or CSV by suffix."""
    return read_csv(spark, path, FEEDBACK) if path.endswith(".csv") else spark.read.schema(FEEDBACK).parquet(path)


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Features of a collection (``properties``, ``geometry``) and the property names found."""
    collection = spark.read.json(path, multiLine=True)
    features = collection.select(F.explode("features").alias("feature")).select("feature.*")
    return features, features.schema["properties"].dataType.names


NODE = "_id string, _lat double, _lon double"
WAY = "_id string, nd array<struct<_ref:string>>"
RELATION = "_id string, member array<struct<_type:string,_ref:string,_role:string>>, tag array<struct<_k:string,_v:string>>"


def read_map_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``relations``, ``ways`` and ``nodes`` of a map extract, as boundary assembly wants them."""
    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    named = F.filter("tag", lambda t: t["_k"] == "name")
    relations = rows("relation", RELATION).select(
        F.col("_id").alias("relation_id"),
        F.try_element_at(named, F.lit(1))["_v"].alias("name"),
        F.transform(
            "member",
            lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")),
        ).alias("members"),
    )
    ways = rows("way", WAY).select(F.col("_id").alias("way_id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"))
    nodes = rows("node", NODE).select(
        F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat")
    )
    return relations, ways, nodes
