"""Table scans: safe reads, projection, file positions, freshness and profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parcelry.operators.listings import LISTING_VIEW, existing

# Expansion from file to memory, least rows per chunk, memory per chunk in megabytes.
MEMORY_FACTOR = 5
LEAST_CHUNK = 1000
CHUNK_MEGABYTES = 500
MEGABYTE = 1024 * 1024


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_table(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """The table at ``path``, or an empty one when it is missing or its footer cannot be read.

    With ``strict`` an unreadable table raises: what is merged into it would else replace it. Values
    that do not fit their column read as null.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        found = spark.read.parquet(path)  # reads a footer only
    except Exception as problem:
        if not strict and (isinstance(problem, AnalysisException) or "CANNOT_READ" in str(problem) or "Parquet" in str(problem)):
            return spark.createDataFrame([], schema)
        raise
    columns = [
        F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    extra = [F.col(c) for c in found.columns if c not in schema.names]
    return found.select(*columns, *extra)


def scan(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: Column | Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Projected, filtered scan. A Column predicate reaches the file reader; a function is applied as is."""
    df = spark.read.parquet(path)
    if callable(where) and not isinstance(where, Column):
        df = df.transform(where)
    elif where is not None:
        df = df.where(where)
    return df.select(*existing(df, columns)) if columns else df


def in_batches(
    spark: SparkSession,
    path: str,
    run: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
    schema: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    batch_rows: int = 10_000,
) -> DataFrame:
    """What ``run`` makes of a scan, a batch of at most ``batch_rows`` rows at a time.

    Files are split at their row groups and read by as many tasks; the projection and what the predicate
    can rule out by the groups' statistics never leave the reader. Every row is in exactly one batch;
    ``run`` is called on the workers and sees one batch at a time, whatever the size of a file.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                yield from run(batch.slice(start, batch_rows))

    return scan(spark, path, columns, where).mapInArrow(each, schema)


def row_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (exclusive) of each file, by stored position."""
    position = F.col("_metadata.row_index")
    return spark.read.parquet(path).where((position >= start) & (position < stop))


def register_view(df: DataFrame, name: str = LISTING_VIEW) -> None:
    df.createOrReplaceTempView(name)


def prior_verdicts(relevant: DataFrame, irrelevant: DataFrame) -> DataFrame:
    """Both layers with the verdict they stand for; reasons share one column."""
    reason = {"reason_to_relevance": "reason"}
    return (
        relevant.withColumnsRenamed(reason if "reason" not in relevant.columns else {})
        .withColumn("relevant", F.lit(True))
        .unionByName(
            irrelevant.withColumnsRenamed(reason).withColumn("relevant", F.lit(False)), allowMissingColumns=True
        )
    )


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Files of a table with size and modification time, from metadata columns."""
    return (
        spark.read.parquet(path)
        .select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        .groupBy("file_path")
        .agg(F.max("file_size").alias("file_size"), F.max("file_modification_time").alias("modified"))
    )


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows, columns, size, estimated memory and a row count per chunk, as one row."""
    df = spark.read.parquet(path)
    per_file = df.groupBy("_metadata.file_path").agg(
        F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes")
    )
    size = F.col("bytes") / MEGABYTE
    memory = size * MEMORY_FACTOR
    return per_file.agg(F.sum("n").alias("total_rows"), F.sum("bytes").alias("bytes")).select(
        "total_rows",
        F.lit(len(df.columns)).alias("num_columns"),
        F.round(size, 2).alias("file_size_mb"),
        F.round(memory, 2).alias("estimated_memory_mb"),
        F.greatest(F.lit(LEAST_CHUNK), F.floor(CHUNK_MEGABYTES / memory * F.col("total_rows")))
        .cast("bigint")
        .alias("recommended_chunk_size"),
        F.lit(float(MEMORY_FACTOR)).alias("compression_ratio"),
    )


def schema_and_sample(df: DataFrame, rows: int = 3) -> tuple[list[tuple[str, str]], DataFrame]:
    return df.dtypes, df.limit(rows)


def freshness(spark: SparkSession, source: str, local: str) -> dict:
    """Whether the source snapshot is newer than the local one, from file listings alone."""
    def newest(path: str) -> tuple[bool, int, int]:
        if not path_exists(spark, path):
            return False, 0, 0
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
        modified = size = 0
        while files.hasNext():
            status = files.next()
            if not status.getPath().getName().startswith(("_", ".")):
                modified, size = max(modified, status.getModificationTime()), size + status.getLen()
        return True, modified, size

    there, source_time, source_size = newest(source)
    here, local_time, local_size = newest(local)
    if not there:
        raise FileNotFoundError(source)
    return {
        "source_modified_ms": source_time,
        "source_size_mb": round(source_size / MEGABYTE, 2),
        "local_exists": here,
        "local_modified_ms": local_time if here else None,
        "local_size_mb": round(local_size / MEGABYTE, 2) if here else None,
        "is_newer": not here or source_time > local_time,
    }
