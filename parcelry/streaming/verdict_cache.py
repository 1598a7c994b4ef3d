"""Verdict cache as keyed streaming state whose values expire by themselves."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

# Fixed value: life of a cached verdict.
TTL_HOURS = 48
HOUR_MS = 3_600_000
#: Groups of keys by hash. A group is called for once in a batch, a key costs no call of its own but to look it up and to
#: store it. A checkpoint belongs to its number of groups, which is also the most tasks that can share the work.
GROUPS = 1024
OUTPUT = "cache_key string, answer string, cache_hit boolean"
#: The store keeps values on local disk beside their checkpoint, so state may outgrow memory. Without batches
#: for timers alone a run over what is available comes to an end; values expire with the next batch.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class VerdictCache(StatefulProcessor):
    """Answers of the keys of a group from their stored verdicts; the state store drops a verdict when its life is over."""

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.verdicts = handle.getMapState("verdict", "cache_key string", "answer string", ttlDurationMs=self.life_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            # Only the answers of one frame are held; what a frame stores the next one reads.
            known, hits, answers = {}, [], []
            for cache_key, answer in zip(frame["cache_key"], frame["answer"]):
                if cache_key not in known:
                    held_ = self.verdicts.getValue((cache_key,))
                    known[cache_key] = held_[0] if held_ is not None else None
                hits.append(known[cache_key] is not None)
                if known[cache_key] is None and answer is not None:
                    known[cache_key] = answer
                    self.verdicts.updateValue((cache_key,), (answer,))
                answers.append(known[cache_key])
            yield pd.DataFrame({"cache_key": frame["cache_key"], "answer": answers, "cache_hit": hits})

    def close(self) -> None:
        pass


def cached_answers(stream: DataFrame, life_ms: int = TTL_HOURS * HOUR_MS, groups: int = GROUPS) -> DataFrame:
    """``stream(cache_key, answer)`` with repeats answered from state until the first answer expires.

    A row without an answer is a look-up and stores nothing. A stored answer keeps the life that it began
    with. All rows of one micro-batch see the same moment. Rows of a group of keys arrive as batches of
    an iterator, so a group or a key with very many rows is never held whole. Start the query under ``settings``.
    """
    group = F.pmod(F.xxhash64("cache_key"), F.lit(groups)).cast("int").alias("key_group")
    rows = stream.select(group, "cache_key", "answer").groupBy("key_group")
    return rows.transformWithStateInPandas(VerdictCache(life_ms), OUTPUT, "append", "processingTime")


@contextmanager
def settings(spark: SparkSession):
    """The session as the cache needs it; a query keeps what holds when it starts."""
    former = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in former.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def serve(stream: DataFrame, output: str, checkpoint: str, life_ms: int = TTL_HOURS * HOUR_MS, **trigger) -> StreamingQuery:
    """Write ``cached_answers`` to ``output``: all that is there by default, or by the given trigger.

    A query started again with its checkpoint goes on with the verdicts that it held.
    """
    with settings(stream.sparkSession):
        writer = cached_answers(stream, life_ms).writeStream.format("parquet").option("path", output)
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows (cache_key, answer) that a query keeps as state after its last batch, expired ones included until they are dropped."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "verdict").load()
    return state.selectExpr("user_map_key.cache_key", "user_map_value.value.answer")
