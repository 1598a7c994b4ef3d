"""Token ids in files of 64-bit words, by Simple-8b coding.

The upper four bits of a word are a selector, the lower sixty hold as many ids as fit at one width:

    selector   0   1   2   3   4   5  6  7   8   9  10  11  12  13
    ids       60  30  20  15  12  10  8  7   6   5   4   3   2   1
    bits       1   2   3   4   5   6  7  8  10  12  15  20  30  60

Selector 15 is the escape for an id of more than 60 bits: the word holds its place in a list of wide
ids beside the words. Ids are coded in blocks of 1024 that start on a word of their own; the word at
which each block starts is stored, so that blocks are coded and decoded side by side.

A file is Parquet with a row for each run of whole documents (``record``): the shard (in key order),
the ids before it in the shard, its documents with their lengths, words, block starts and wide ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry.llm.common import shuffle_width, slices, working_name
from parcelry.llm.encoding import encoder

# Fixed values of the coding.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60], np.uint64)
ESCAPE = 15
BLOCK = 1024

RECORD = (
    "shard int, record long, first long, keys array<{key}>, lengths array<long>, n_ids long, words binary, "
    "block_starts binary, wide binary"
)


#: Bits of each number below 2**16, one at least.
SHORT_WIDTHS = np.maximum(np.frexp(np.arange(1 << 16))[1], 1).astype(np.uint8)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, one at least, 61 for any that needs the escape."""
    found = SHORT_WIDTHS[ids & np.uint64(0xFFFF)]
    for shift in (16, 32, 48):
        over = np.flatnonzero(ids >= np.uint64(1 << shift))
        if not len(over):
            break
        found[over] = SHORT_WIDTHS[(ids[over] >> np.uint64(shift)) & np.uint64(0xFFFF)] + shift
    return np.minimum(found, 61)


def alike(chosen: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.uint64]]:
    """Words of one selector that hold as many ids: their places, how many, and bits of an id."""
    kind = chosen.astype(np.uint16) * np.uint16(64) + count.astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        if len(at):
            yield at, int(count[at[0]]), BITS[chosen[at[0]]]


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word at which each block starts, and the wide ids, of unsigned 64-bit ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = np.ones((blocks, BLOCK + 60), np.uint8)
    flat = np.ones(blocks * BLOCK, np.uint8)
    flat[:n] = widths(ids)
    width[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # The most ids that fit one word from each place; places behind the block's end hold nothing.
    # What fits a selector of more ids fits those of fewer ids too, so that the fitting ones need only be counted.
    fitting = np.zeros((blocks, BLOCK), np.uint8)
    most, taken = np.zeros((blocks, BLOCK), np.uint8), 0
    for choice in range(13, -1, -1):
        while taken < COUNTS[choice]:
            np.maximum(most, width[:, taken : taken + BLOCK], out=most)
            taken += 1
        fits = most <= np.uint8(BITS[choice])
        if not fits.any():
            break
        fitting += fits
    selector = np.where(fitting > 0, np.uint8(14) - fitting, np.uint8(ESCAPE))
    filled = np.full(blocks, BLOCK)
    filled[-1] = n - (blocks - 1) * BLOCK
    begins = np.zeros((blocks, BLOCK), bool)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        begins[row, at] = True
        at = at + COUNTS[selector[row, at]]
        going = at < filled[row]
        row, at = row[going], at[going]
    starts = np.flatnonzero(begins)
    chosen = selector.reshape(-1)[starts]
    block_starts = np.concatenate([[0], np.cumsum(begins.sum(axis=1))[:-1]]).astype(np.int64)
    block_end = (starts // BLOCK) * BLOCK + filled[starts // BLOCK]
    count = np.minimum(COUNTS[chosen], block_end - starts)
    words = chosen.astype(np.uint64) << np.uint64(60)
    escaped = chosen == ESCAPE
    wide = ids[starts[escaped]]
    words[escaped] |= np.arange(len(wide), dtype=np.uint64)
    count[escaped] = 0
    for at, held, bits in alike(chosen, count):
        first, found = starts[at], words[at]
        for j in range(held):
            found |= ids[first + j] << (bits * np.uint64(j))
        words[at] = found
    return words, block_starts, wide


def decode_ids(words: np.ndarray, block_starts: np.ndarray, wide: np.ndarray, n: int) -> np.ndarray:
    """The ids, all blocks at once."""
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[chosen]
    block = np.repeat(np.arange(len(block_starts)), np.diff(np.append(block_starts, len(words))))
    ends = np.cumsum(count)
    before = (ends - count)[block_starts]
    in_block = ends - count - before[block]
    filled = np.minimum(n - block * BLOCK, BLOCK)
    count = np.minimum(count, filled - in_block)
    begins = np.cumsum(count) - count
    ids = np.empty(n, np.uint64)
    for at, held, bits in alike(chosen, count):
        first, found = begins[at], words[at]
        for j in range(held):
            ids[first + j] = (found >> (bits * np.uint64(j))) & ((np.uint64(1) << bits) - np.uint64(1))
    escaped = begins[chosen == ESCAPE]
    ids[escaped] = wide[ids[escaped].astype(np.int64)]
    return ids


def write_token_files(
    df: DataFrame, path: str, key: str, text: str, tokenizer: str, end_id: int, spaced: bool = True,
    record_bytes: int = 4 << 20,
) -> None:
    """Encode whole texts, append ``end_id`` to each and write the ids in ascending order of ``key``.

    The key ranges are the shards; rows of one key (nulls come first) are ordered by their text. A
    record ends with the document that brings its texts to ``record_bytes``, so a very long text
    makes one long record. A null or empty text is the end id alone; an empty table writes no record.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    (tie,) = working_name(df, "tie")
    chosen = df.select(key, text, F.xxhash64(text).alias(tie))
    ordered = chosen.repartitionByRange(shuffle_width(spark), key, tie).sortWithinPartitions(key, tie, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer, spaced).encode, np.array([end_id], np.uint32)
        shard, record, first = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, text, record_bytes):
            found = encode(batch.column(1))
            lengths = [len(ids) + 1 for ids in found]
            ids = np.concatenate([part for each in found for part in (each, end)])
            words, block_starts, wide = encode_ids(ids)
            values = [
                [shard], [record], [first], [batch.column(0).to_pylist()], [lengths], [len(ids)],
                [words.astype("<u8").tobytes()], [block_starts.astype("<i8").tobytes()], [wide.astype("<u8").tobytes()],
            ]
            kinds = [
                pa.int32(), pa.int64(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int64()), pa.int64(),
                pa.binary(), pa.binary(), pa.binary(),
            ]
            names = "shard record first keys lengths n_ids words block_starts wide".split()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)
            record, first = record + 1, first + len(ids)

    ordered.mapInArrow(run, RECORD.format(key=kind)).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Documents of the files at ``path``: key, start (ids of all documents before it), n_tokens and
    ids (binary, little-endian unsigned 32-bit).

    Starts come from the ids of each shard, summed in shard order; that is a row per file.
    """
    records = spark.read.parquet(path)
    kind = records.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = [np.frombuffer(row[c], t) for c, t in (("words", "<u8"), ("block_starts", "<i8"), ("wide", "<u8"))]
                ids = decode_ids(*parts, row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                columns = [
                    pa.array(row["keys"], batch.schema.field("keys").type.value_type),
                    pa.array(np.full(len(ends), row["shard"]), pa.int32()),
                    pa.array(row["first"] + starts, pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "shard", "at", "n_tokens", "ids"])

    documents = records.mapInArrow(run, f"key {kind}, shard int, at long, n_tokens long, ids binary")
    sums = records.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before, total = [], 0
    for shard, n in sums:
        before.append((shard, total))
        total += n
    offsets = spark.createDataFrame(before, "shard int, before long")
    return documents.join(F.broadcast(offsets), "shard").select(
        F.col("key").alias(key), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids"
    )
