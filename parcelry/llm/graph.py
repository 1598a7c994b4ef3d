"""Connected components of an edge table, by rounds of star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelry.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected ``edges`` (u, v: long): a row (node, label) for each node, where label
    is the smallest node of its component.

    In every round each node's larger neighbours, then its smaller ones, are linked to the smallest
    node that it sees. Both are joins with a partial minimum, so that a node with very many links
    is spread over tasks; rounds end when the stars no longer change. Loops and repeated edges are
    allowed; an empty table gives no row.
    """
    links = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = shape(links)
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lowest, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").select(
            F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")
        )
        links = cut_lineage(small.where("u <> v").distinct())
        former, state = state, shape(links)
        if state == former:
            break
    members = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return members.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def shape(links: DataFrame) -> tuple:
    """Row count and hash sums; equal for equal edge sets."""
    return tuple(
        links.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("v", "u")),
        ).first()
    )
