"""Change detection and first-seen filtering over a stream of listing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from parcelry.operators.dedup import last_per_key
from parcelry.operators.incremental import new_and_changed, with_checksum
from parcelry.schema import CHECKSUM_STATE
from parcelry.sources.tables import read_table

BATCHED_STATE = StructType([*CHECKSUM_STATE.fields, StructField("batch", LongType())])


def listing_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def state_before(spark: SparkSession, path: str, batch: int, seed: DataFrame | None = None) -> DataFrame:
    """Latest checksum per key from the batches before ``batch``, on top of an optional seed.

    State is kept as one folder per batch; the filter prunes folders, and ``max_by`` combines on the
    map side.
    """
    stored = read_table(spark, path, BATCHED_STATE).where(F.col("batch") < batch)
    columns = [f.name for f in CHECKSUM_STATE.fields]
    if seed is not None:
        stored = stored.unionByName(seed.select(*columns, F.lit(-1).cast("bigint").alias("batch")))
    return stored.groupBy("article_id").agg(
        F.max_by("checksum", "batch").alias("checksum"), F.max_by("updated_at", "batch").alias("updated_at")
    )


def detect_changes(
    stream: DataFrame,
    state_path: str,
    output: str,
    checkpoint: str,
    as_of: str,
    seed: DataFrame | None = None,
    order: tuple[str, ...] = ("checksum",),
) -> StreamingQuery:
    """Write new and changed rows of every micro-batch and remember their checksums.

    Each batch runs the batch operators. It reads only state of earlier batches and writes only its
    own folders, so a batch retried after a failure gives the same result again.
    """
    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = last_per_key(with_checksum(batch), ["article_id"], list(order)).persist()
        try:
            fresh = new_and_changed(current, state_before(spark, state_path, number, seed))
            fresh.write.mode("overwrite").parquet(f"{output}/batch={number}")
            seen = current.select("article_id", "checksum", F.to_timestamp(F.lit(as_of)).alias("updated_at"))
            seen.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        finally:
            current.unpersist()

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_seen(stream: DataFrame, key: str = "article_id", event_time: str | None = None, within: str = "1 day") -> DataFrame:
    """First row of each key over the life of the stream.

    With an event time, a key is forgotten once the watermark, which stays ``within`` behind the newest
    event, has passed its first row by ``within``; it then counts as new. That bounds the state to the keys
    of twice that time. Rows older than the watermark are dropped.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keys that a query over ``first_seen`` keeps as state after its last batch."""
    return spark.read.format("statestore").load(checkpoint).select("key.*")
