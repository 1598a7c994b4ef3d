"""Range partitioning into shards of near equal bytes, by sampled splitters.

Rows are ordered by the hash of their group (equal texts) and then by that of their key, so a group
lies together. A sample in which a row's chance is in proportion to its size gives the splitters of
many small ranges: the quantiles of the sample. A splitter falls between groups unless a group is so
large that several quantiles lie inside it; such an overfull range is subdivided at these quantiles
by key. The ranges' exact sizes are then added up and neighbouring ranges dealt to shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelry.llm.common import map_columns, quoted, working_name
from parcelry.session import cut_lineage


def splitters(sample: np.ndarray, count: int) -> np.ndarray:
    """At most ``count - 1`` ascending (group, key) splitters from a sample of such pairs.

    A quantile alone in its group moves to the group's start; of several, the first does.
    """
    if not len(sample) or count < 2:
        return np.zeros((0, 2), np.int64)
    ordered = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    chosen = ordered[np.unique(np.arange(1, count) * len(ordered) // count)]
    first = np.append(True, chosen[1:, 0] != chosen[:-1, 0])
    chosen[first, 1] = np.iinfo(np.int64).min
    return np.unique(chosen, axis=0)


def range_of(group: np.ndarray, key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of splitters at or before each (group, key)."""
    low = np.searchsorted(bounds[:, 0], group, side="left")
    high = np.searchsorted(bounds[:, 0], group, side="right")
    found = low.copy()
    for i in np.flatnonzero(high > low):
        found[i] = low[i] + np.searchsorted(bounds[low[i] : high[i], 1], key[i], side="right")
    return found


def by_bytes(
    df: DataFrame, key: str, group: Column, size: Column, shards: int, ranges_per_shard: int = 100,
    rows_per_range: int = 500_000, sampled_per_range: int = 16,
) -> DataFrame:
    """``df`` with columns shard (0 to ``shards`` - 1), slot (gapless from 0 in the shard) and size.

    ``size`` is a positive long; null counts as 0. Null groups form one group, null keys one key. Rows
    that agree in group and key stay together, however many. The sample holds about
    ``sampled_per_range`` keys for each range and is all that reaches the driver; ranges are
    ``ranges_per_shard`` for each shard, or more so that none has many more than ``rows_per_range``
    rows. An empty table gives no row. Columns of ``df`` named shard, slot or size are replaced.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot", "size")]
    g, k, r, first, tie = working_name(df, "_group", "_key", "_range", "_first", "_tie")
    content = F.xxhash64(*[quoted(c) for c in kept])
    keyed = df.select(
        *map(quoted, kept), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.xxhash64(group).alias(g), F.xxhash64(key).alias(k),
        content.alias(tie),
    )
    total, rows = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    ranges = max(shards * ranges_per_shard, math.ceil(rows / rows_per_range))
    wanted = ranges * sampled_per_range
    chance = F.col("size") * F.lit(wanted / max(total or 0, 1))
    drawn = F.pmod(F.xxhash64(F.lit(17), g, k, tie), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance
    sample = np.array([tuple(row) for row in keyed.where(drawn).select(g, k).collect()], np.int64).reshape(-1, 2)
    bounds = splitters(sample, ranges)

    def run(batches: Iterator[pa.RecordBatch], *at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in batches:
            found = range_of(*(batch.column(i).to_numpy() for i in at), bounds)
            yield batch, pa.array(found.astype(np.int32))

    ranged = map_columns(keyed, run, [g, k], r, "int")
    counted = ranged.groupBy(r).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy(r).collect()
    dealt, before, held = [], 0, [0] * shards
    for number, size_of, rows_of in counted:
        shard = min(shards - 1, int((before + size_of / 2) * shards / max(total, 1)))
        dealt.append((number, shard, held[shard]))
        before, held[shard] = before + size_of, held[shard] + rows_of
    table = spark.createDataFrame(dealt, f"`{r}` int, shard int, `{first}` long")
    place = F.row_number().over(Window.partitionBy(r).orderBy(g, k, tie)) - 1
    placed = ranged.withColumn("slot", place.cast("long"))
    return placed.join(F.broadcast(table), r).select(*map(quoted, kept), "size", "shard", (F.col(first) + F.col("slot")).alias("slot"))


def narrow_by_bytes(df: DataFrame, key: str, group: Column, size: Column, shards: int, **columns: Column) -> DataFrame:
    """Like ``by_bytes`` for the key, group hash and the given columns alone, which are stored first,
    so that the texts are read once."""
    narrow = df.select(key, F.xxhash64(group).alias("group_hash"), size.alias("size"), *[c.alias(n) for n, c in columns.items()])
    stored = cut_lineage(narrow)
    return by_bytes(stored, key, F.col("group_hash"), F.col("size"), shards)
