"""Writers. Replacing a table that is being read goes through a new version folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parcelry.functions.dates import temporal_to_string
from parcelry.operators.dedup import upsert, upsert_layers
from parcelry.operators.incremental import merge_state
from parcelry.operators.relevance import feedback_entries
from parcelry.operators.relevance import split_layers as split_rows
from parcelry.schema import CHECKSUM_STATE, FEEDBACK
from parcelry.sources.tables import read_table

FLAG = "relevant"


class InvalidTable(ValueError):
    """A staged table failed its check and was not promoted."""


class Conflict(RuntimeError):
    """Another writer committed a version in the meantime."""


class VersionedTable:
    """Parquet in folders of their own and a commit file for each version; readers take the newest version.

    A job can so read the current version while writing the next, and a failed write leaves the
    former version in place. A commit puts a written file under its number, which only one writer can;
    one that started from an older version has to start again. (This needs a file system whose rename leaves
    an existing file alone, or a local one.)
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, strict: bool = True):
        self.spark, self.path, self.schema, self.strict = spark, path.rstrip("/"), schema, strict

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _commit_file(self, number: int) -> str:
        return f"{self.path}/_versions/{number:012d}"

    def _folder(self, number: int) -> str:
        """Folder of the rows of a version, as its commit file names it."""
        fs, at = self._fs(self._commit_file(number))
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commits(self) -> list[tuple[int, int]]:
        """Number and time (milliseconds) of the versions, oldest first."""
        fs, root = self._fs(f"{self.path}/_versions")
        if not fs.exists(root):
            return []
        names = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(root)]
        return sorted((int(name), moment) for name, moment in names if name.isdigit())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return [number for number, _ in self._commits()]

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one that has not expired."""
        number = version or (self.versions() or [0])[-1]
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return read_table(self.spark, f"{self.path}/{self._folder(number)}", self.schema, self.strict)

    def _commit(self, number: int, folder: str) -> None:
        """Make ``folder`` version ``number``; only one writer ever can, and no reader sees a commit file without its name."""
        (fs, at), (_, draft) = self._fs(self._commit_file(number)), self._fs(f"{self.path}/_versions/draft-{folder}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(folder.encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                # A local rename would replace what is there; a hard link does not.
                os.link(draft.toUri().getPath(), at.toUri().getPath())
            elif fs.exists(at) or not fs.rename(draft, at):
                raise Conflict(f"version {number} exists")
        except FileExistsError as problem:
            raise Conflict(f"version {number} exists") from problem
        finally:
            fs.delete(draft, False)
        if self._folder(number) != folder:
            raise Conflict(f"version {number} is another writer's")

    def replace(self, df: DataFrame, check: Callable[[DataFrame], bool] | None = None, base: int | None = None) -> int:
        """Write ``df`` as the next version; commit it only if it can be read back and passes ``check``.

        With ``base``, the version that ``df`` was made from (0: none), a newer one is a ``Conflict``; without,
        whatever others have committed is replaced.
        """
        folder = f"rows-{uuid.uuid4().hex}"
        target = f"{self.path}/{folder}"
        df.write.parquet(target)
        written = self.spark.read.parquet(target)
        written.select(F.bit_xor(F.xxhash64(*written.columns))).first()  # reads every column
        if check is not None and not check(written):
            raise InvalidTable(target)
        while True:
            newest = (self.versions() or [0])[-1]
            if base is not None and newest != base:
                raise Conflict(f"version {newest} came after {base}")
            try:
                self._commit(newest + 1, folder)
                return newest + 1
            except Conflict:
                if base is not None:
                    raise

    def update(self, change: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], bool] | None = None, attempts: int = 10) -> int:
        """Commit what ``change`` makes of the newest version, starting again when another writer was faster."""
        for attempt in range(attempts):
            base = (self.versions() or [0])[-1]
            try:
                return self.replace(change(self.read(base)), check, base)
            except Conflict:
                if attempt + 1 == attempts:
                    raise
        raise ValueError("no attempt allowed")

    def expire(self, older_than_ms: int, keep: int = 2) -> list[int]:
        """Delete versions committed more than ``older_than_ms`` ago, but for the last ``keep``, and folders as
        old that no version names (what failed and outrun writers left). Returns the numbers deleted."""
        now = self.spark._jvm.System.currentTimeMillis()
        commits = self._commits()
        old = [number for number, moment in commits[: max(0, len(commits) - keep)] if now - moment > older_than_ms]
        for number in old:
            folder = self._folder(number)
            for path in (self._commit_file(number), f"{self.path}/{folder}"):
                fs, at = self._fs(path)
                fs.delete(at, True)
        named = {self._folder(number) for number in self.versions()}
        fs, root = self._fs(self.path)
        for status in fs.listStatus(root) if fs.exists(root) else []:
            name = status.getPath().getName()
            if name.startswith("rows-") and name not in named and now - status.getModificationTime() > older_than_ms:
                fs.delete(status.getPath(), True)
        return old

    def reset(self) -> int:
        return self.replace(self.spark.createDataFrame([], self.schema))


def write_layers(decided: DataFrame, relevant_path: str, irrelevant_path: str) -> None:
    """Split write; the rows are computed once and spill to disk rather than being recomputed."""
    rows = decided.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        relevant, irrelevant = split_rows(rows)
        relevant.write.mode("overwrite").parquet(relevant_path)
        irrelevant.write.mode("overwrite").parquet(irrelevant_path)
    finally:
        rows.unpersist()


def merge_layers(
    relevant: VersionedTable, irrelevant: VersionedTable, decided: DataFrame, key: str = "article_id",
    order: tuple[str, ...] = ("reason",),
) -> None:
    """Upsert decisions into both layers; a key whose verdict flipped moves over."""
    former = irrelevant.read()
    if "reason_to_relevance" in former.columns:
        own = [F.col("reason")] if "reason" in former.columns else []
        former = former.withColumn("reason", F.coalesce("reason_to_relevance", *own)).drop("reason_to_relevance")
    merged = upsert_layers(relevant.read(), former, decided, [key], order, FLAG).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept, dropped = split_rows(merged)
        relevant.replace(kept)
        irrelevant.replace(dropped)
    finally:
        merged.unpersist()


def merge_table(table: VersionedTable, incoming: DataFrame, key: str, order: tuple[str, ...]) -> int:
    """Upsert ``incoming``; rows that other writers merge meanwhile are kept."""
    return table.update(lambda stored: upsert(stored, incoming, [key], order))


def save_state(table: VersionedTable, current: DataFrame, as_of: str, key: str = "article_id") -> int:
    """Merge the checksums of a run into the stored state."""
    return table.update(lambda stored: merge_state(stored, current, as_of, key))


def state_table(spark: SparkSession, path: str) -> VersionedTable:
    """Checksum state; one that cannot be read starts over."""
    return VersionedTable(spark, path, CHECKSUM_STATE, strict=False)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV folder; each part has the header, so no row is taken for one."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def append_feedback(spark: SparkSession, decided: DataFrame, path: str, key: str = "article_id") -> None:
    """Queue rows that are not in the queue yet."""
    queued = read_table(spark, path, FEEDBACK, strict=True)
    feedback_entries(decided, queued, key).write.mode("append").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines with times as text and nulls kept."""
    rows = df.select(*temporal_to_string(df.schema))
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    rows.select(record).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, from a ``value`` column."""
    features.select("value").write.mode("overwrite").text(path)
