"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.session import ensure_checkpoint_dir

#: White space of the word rule: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written under the shared folder and read again, and its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def drop_stored(spark: SparkSession, *paths: str | None) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more."""
    for path in paths:
        if path is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind, which else stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def worker_state(key: str, make: Callable[[], object]):
    """One object kept in the Python worker across tasks (a table built by rule, a loaded tokenizer).

    Workers outlive a stage, so only the object asked for last is held and its memory is bounded by that.
    """
    holder = sys.modules.setdefault("_parcelry_worker", types.ModuleType("_parcelry_worker"))
    if getattr(holder, "key", None) != key:
        holder.key = holder.value = None
        pa.default_memory_pool().release_unused()
        holder.value = make()
        holder.key = key
    return holder.value


#: Bits of a 64-bit code that say its place in a bitmap, which has one size for any number of codes.
BITMAP_BITS = 27


def bitmap_of(codes: DataFrame) -> np.ndarray:
    """The bits at the places of ``code``. It only ever lets too much through ``within``."""
    at = codes.select(F.shiftrightunsigned("code", 64 - BITMAP_BITS).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def within(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, a longer row alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def words_of(text: str | None) -> list[bytes]:
    """Words of the word rule as UTF-8 bytes; ``bytes.split`` cuts at exactly these six characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def working_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for internal use that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + re.sub("`", "``", name) + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there and wherever the
    optimizer moves the expression. Inside lambdas a column may else be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_columns(df: DataFrame, run: Callable, inputs: list[str], name: str, kind: str) -> DataFrame:
    """``df`` with one more column: ``run`` of the Arrow batches of rows yields (batch, array) pairs.

    ``run`` is given an iterator over batches and the places of ``inputs``. Columns keep any name that
    they have, which ``mapInArrow`` itself does not allow for.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    places = [df.columns.index(c) for c in inputs]
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, df.schema))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in run(batches, *places):
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*plain, "found"])

    return df.toDF(*plain).mapInArrow(batches_of, f"{fields}, found {kind}").toDF(*df.columns, name)
