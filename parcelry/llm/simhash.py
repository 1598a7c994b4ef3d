"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. The binary Golay code of
length 23 is perfect: every 23-bit word lies within three bits of exactly one of 4096 codewords, so
a segment decodes to a 12-bit index, and a segment one bit off decodes to one of the (at most six)
indices of the words around it. With three differing bits or fewer,

- either every segment has one: the first two, each one bit off, show it;
- or a segment has none and another has one at most.

So each fingerprint is stored under its index pairs of all three segment pairs, and asks under the
indices of the words around it: both segments of the first pair, one segment at a time of the others.
Pairs that meet under a key are verified by their differing bits.

A key's stored fingerprints are first represented by a few pivots. Askers link to pivots in one
join; where a key has more fingerprints than pivots, a second join links only what is not yet in one
component. So no group of copies is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from parcelry.llm.common import map_columns, quoted, slices, worker_state, working_name
from parcelry.llm.graph import connected_components
from parcelry.session import cut_lineage

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
PIVOTS = 8
KEY_ROWS = 2048


def nearest_codeword() -> np.ndarray:
    """Index of the codeword within three bits of each 23-bit word."""
    indices = np.arange(4096, dtype=np.uint32)
    codes = np.zeros(4096, np.uint32)
    for bit in range(12):
        if GENERATOR >> bit & 1:
            codes ^= indices << np.uint32(bit)
    table = np.zeros(1 << 23, np.uint16)
    for weight in range(4):
        for places in combinations(range(23), weight):
            table[codes ^ np.uint32(sum(1 << p for p in places))] = indices
    return table


def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of the words' shingles, repeats included (fewer words: the whole sequence; none: 0)."""
    if not words:
        return 0
    size = min(shingle, len(words))
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    total, ones = len(words) - size + 1, np.zeros(64, np.int64)
    hashes = map(digest, map(b" ".join, zip(*(words[i:] for i in range(size)))))
    for start in range(0, total, 1 << 16):
        part = np.fromiter(hashes, np.uint64, min(total - start, 1 << 16))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; ``bytes.lower`` changes nothing else."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def with_fingerprint(df: DataFrame, text: str, name: str, shingle: int = 3) -> DataFrame:
    """``df`` with the fingerprint of ``text`` (A-Z in lower case; null: as empty) as signed long ``name``."""
    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in slices(batches, at):
            found = np.array([fingerprint(lower_words(t), shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield batch, pa.array(found.view(np.int64))

    return map_columns(df, run, [text], name, "long")


def distinct_rows(numbers: np.ndarray) -> np.ndarray:
    """True at the first of equal values in each row."""
    order = np.argsort(numbers, axis=1, kind="stable")
    ordered = np.take_along_axis(numbers, order, 1)
    first = np.ones(numbers.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    out = np.empty_like(first)
    np.put_along_axis(out, order, first, 1)
    return out


def keys_of(fingerprints: np.ndarray, table: np.ndarray, asking: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each key under which the fingerprints are stored, or ask."""
    own, around = [], []
    for shift, width in SEGMENTS:
        segment = ((fingerprints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        own.append(table[segment].astype(np.int32))
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
        around.append(table[segment[:, None] ^ flips].astype(np.int32) if asking else None)
    rows, keys = [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        if not asking:
            rows.append(np.arange(len(fingerprints)))
            keys.append((number << 24) | (own[a] << 12) | own[b])
            continue
        if number == 0:
            for row, (left, right) in enumerate(zip(around[a], around[b])):
                found = ((np.unique(left) << 12)[:, None] | np.unique(right)).ravel()
                rows.append(np.full(len(found), row))
                keys.append(found)
            continue
        found = np.concatenate([(own[a] << 12)[:, None] | around[b], (around[a] << 12) | own[b][:, None]], axis=1)
        found |= number << 24
        row, column = np.nonzero(distinct_rows(found))
        rows.append(row)
        keys.append(found[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(fingerprints: DataFrame, asking: bool) -> DataFrame:
    """Rows (key, fp) for the distinct ``fp`` of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_state("golay", nearest_codeword)
        for batch in batches:
            for start in range(0, batch.num_rows, KEY_ROWS):
                held = batch.column(0).slice(start, KEY_ROWS).to_numpy().view(np.uint64)
                row, key = keys_of(held, table, asking)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(held[row].view(np.int64))], names=["key", "fp"])

    return fingerprints.select("fp").mapInArrow(run, "key int, fp long")


def linked_classes(fingerprints: DataFrame, most: int = 3) -> DataFrame:
    """Rows (node, label) for the fingerprints (distinct ``fp``) that link to another one: label is
    the smallest fingerprint that can be reached over links of ``most`` differing bits or fewer.

    ``most`` is at most 3, the reach of the keys. Exact: no pair within the distance is missed.
    """
    if not 0 <= most <= 3:
        raise ValueError("fingerprints can be linked at 0 to 3 differing bits")
    asking, stored = golay_keys(fingerprints, True), golay_keys(fingerprints, False)
    lot = F.pmod(F.xxhash64("fp"), F.lit(PIVOTS))
    pivots = F.array_compact(F.array(*[F.min(F.when(lot == i, F.col("fp"))) for i in range(PIVOTS)]))
    held = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n"), pivots.alias("pivots"))
    near = F.filter("pivots", lambda p: (p != F.col("fp")) & (F.bit_count(p.bitwiseXOR(F.col("fp"))) <= most))
    crowded = F.col("n") > F.size("pivots")
    a, h = asking.alias("a"), held.alias("h")
    near_any = F.exists("h.pivots", lambda p: (p != F.col("a.fp")) & (F.bit_count(p.bitwiseXOR(F.col("a.fp"))) <= most))
    met = a.join(h, (F.col("a.key") == F.col("h.key")) & ((F.col("h.n") > F.size("h.pivots")) | near_any))
    met = cut_lineage(met.select("a.key", "fp", "n", "pivots").select("key", "fp", crowded.alias("crowded"), near.alias("near")))
    links = met.select(F.col("fp").alias("u"), F.explode("near").alias("v")).distinct()
    labels = connected_components(links)
    asked = met.where("crowded").select("key", "fp")
    if asked.isEmpty():
        return labels
    known = cut_lineage(labels)

    def labelled(rows: DataFrame) -> DataFrame:
        joined = rows.join(known, rows["fp"] == known["node"], "left")
        return joined.select("key", "fp", F.coalesce("label", "fp").alias("label"))

    x, y = labelled(asked).alias("x"), labelled(stored).alias("y")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= most
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & close)
    rest = cut_lineage(rest.select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).distinct())
    if rest.isEmpty():
        return known
    return connected_components(known.select(F.col("node").alias("u"), F.col("label").alias("v")).unionAll(rest))


def components(df: DataFrame, key: str, text: str, shingle: int = 3, most: int = 3) -> DataFrame:
    """Rows (key, fingerprint, component_id): the fingerprint of each row of ``df`` as signed long and
    the smallest key that can be reached over links of ``most`` differing bits.

    Null and empty texts have fingerprint 0 and link like any other. Keys may repeat. Null keys count
    as larger than all others; a component of nothing but null keys has a null id.
    """
    rows = cut_lineage(with_fingerprint(df.select(F.col(key).alias("doc"), F.col(text).alias("content")), "content", "fp", shingle).select("doc", "fp"))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc").alias("first")))
    labels = linked_classes(classes, most)
    named = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    resolved = cut_lineage(named.join(lowest, "label").select("fp", "component_id"))
    return rows.join(resolved, "fp").select(F.col("doc").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, key: str, text: str, shingle: int = 3, most: int = 3) -> DataFrame:
    """One row of ``df`` for each component, with its columns: the smallest key (nulls last), among equal
    keys the row with the smallest hash of all its columns. An empty table gives an empty one."""
    fp, label, order, tie = working_name(df, "_fp", "_label", "_order", "_tie")
    marked = with_fingerprint(df, text, fp, shingle).withColumn(tie, F.xxhash64(*[quoted(c) for c in df.columns]))
    by = [quoted(key).asc_nulls_last(), F.col(tie)]
    first = marked.withColumn(order, F.row_number().over(Window.partitionBy(fp).orderBy(*by))).where(F.col(order) == 1)
    first = cut_lineage(first)
    labels = linked_classes(first.select(F.col(fp).alias("fp")), most).select(F.col("node").alias(fp), F.col("label").alias(label))
    grouped = first.join(labels, fp, "left").withColumn(label, F.coalesce(label, fp))
    lowest = grouped.withColumn(order, F.row_number().over(Window.partitionBy(label).orderBy(*by))).where(F.col(order) == 1)
    return lowest.select(*[quoted(c) for c in df.columns])
