"""Boundaries: assembling ordered coordinates and joining them with listing counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelry.operators.stats import counts_by

# Property names that may hold a district name, and geometries drawn.
NAME_FIELDS = ("name", "nev", "kerulet", "kerület", "admin_leve")
AREA_GEOMETRIES = ("Polygon", "MultiPolygon")


def ordered_sequence(rows: DataFrame, keys: Sequence[str], position: str, value: Column) -> DataFrame:
    """``items`` of each key ordered by position.

    For keys whose length the data model bounds (the nodes of a way, the turns of a conversation).
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("position"), value.alias("value"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias("items"))


def assemble_boundaries(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """One feature per relation from its outer ways.

    ``relations(relation_id, name, members array<struct<type,ref,role>>)``,
    ``ways(way_id, refs array<string>)``, ``nodes(node_id, lon, lat)``. Nodes that are not listed are
    dropped, ways are not stitched. One ring makes a Polygon, several a MultiPolygon of one ring each.
    """
    members = relations.select("relation_id", "name", F.posexplode("members").alias("ring", "member"))
    outer = members.where((F.col("member.type") == "way") & (F.col("member.role") == "outer")).select(
        "relation_id", "name", "ring", F.col("member.ref").alias("way_id")
    )
    refs = outer.join(ways.select("way_id", F.posexplode("refs").alias("position", "node_id")), "way_id")
    points = refs.join(nodes, "node_id")
    rings = ordered_sequence(points, ["relation_id", "name", "ring"], "position", F.array("lon", "lat"))
    shapes = ordered_sequence(rings, ["relation_id", "name"], "ring", F.col("items"))
    return shapes.select(
        "relation_id",
        "name",
        F.when(F.size("items") == 1, "Polygon").otherwise("MultiPolygon").alias("geometry_type"),
        F.col("items").alias("rings"),
    )


def feature_json(boundaries: DataFrame) -> DataFrame:
    """One GeoJSON feature per row in column ``value``; a MultiPolygon nests one level deeper."""
    properties = F.struct("name").alias("properties")
    polygon = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            properties,
            F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"),
        )
    )
    several = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            properties,
            F.struct(
                F.lit("MultiPolygon").alias("type"),
                F.transform("rings", lambda ring: F.array(ring)).alias("coordinates"),
            ).alias("geometry"),
        )
    )
    return boundaries.select(F.when(F.col("geometry_type") == "Polygon", polygon).otherwise(several).alias("value"))


def only_areas(features: DataFrame) -> DataFrame:
    return features.where(F.col("geometry.type").isin(*AREA_GEOMETRIES))


def feature_name(properties: Sequence[str]) -> Column:
    """The first known name property, else the first property of all."""
    known = [p for p in properties if p.lower() in NAME_FIELDS]
    chosen = known or list(properties)[:1]
    return F.coalesce(*[F.col(f"properties.`{p}`").cast("string") for p in chosen], F.lit("Ismeretlen"))


def features_with_counts(features: DataFrame, listings: DataFrame, name: Column, column: str = "district") -> DataFrame:
    """Boundary features with listing count (zero if none) and popup text."""
    counts = counts_by(listings, column, "listing_count").withColumnRenamed(column, "area_name")
    return (
        features.withColumn("area_name", name)
        .join(counts, "area_name", "left")
        .withColumn("listing_count", F.coalesce("listing_count", F.lit(0)))
        .withColumn("popup", F.concat(F.lit("<b>"), "area_name", F.lit("</b><br>Hirdetések száma: "), "listing_count"))
    )
