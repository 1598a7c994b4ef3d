"""Long passages that documents share, found by recompression.

Recompression names runs of one symbol and, round after round, pairs of neighbouring symbols whose
coins (a bit of their name) are heads and tails. A name is a hash of what it stands for, so every
task gives equal runs and pairs the same name and equal passages are parsed alike, except near their
ends. Each symbol also carries the stretch of words that its being there depends on.

A window of words has as its anchor a symbol whose stretch lies inside it: of the highest round that
has one, the one with the smallest name. The anchor depends on the window's words alone, so equal
windows have equal anchors wherever they occur. Neighbouring windows with one anchor make an
occurrence: its anchor's name, a hash of its words (its span), the document and where in it the
windows start. Then

- a name seen in one document only has no shared window; a bitmap of the others' names spares the
  occurrences of most such names every further step;
- of occurrences with one name and span all but those in the smallest document are covered whole;
- those in the smallest document, where the name has other spans as well, are compared with the first
  occurrences of these by the 128-bit hashes of their windows.

Texts are parsed once. They are grouped into blocks of documents, to which what is asked of or known about
their windows is sent by row (the tag, a 64-bit hash of document and text) and place; nothing is parsed again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from parcelry.llm.common import bitmap_of, drop_stored, shuffle_width, slices, stored, within, words_of

RUNS_EVERY = 6
BASE1, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
LAST = np.iinfo(np.int64).max


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values."""
    x = values ^ np.uint64(salt * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rounds_for(window: int) -> int:
    """Rounds until symbols stand for about a ninth of a window; a round leaves three of four symbols."""
    return max(1, round(math.log(max(window, 12) / 9) / math.log(4 / 3)))


def rounds(words: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, name) of the symbols of each of ``count`` rounds, the words themselves first: symbol i depends
    on the words from ``first[i]`` up to ``last[i]``, exclusive. Zeros in ``words`` separate documents
    and never become part of a symbol."""
    name = words.copy()
    first = np.arange(len(words), dtype=np.int64)
    last = first + 1
    yield first, last, name
    for number in range(count):
        if len(name) < 2:
            return
        if number % RUNS_EVERY == 0:
            begins = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (name[1:] == 0)))
            ends = np.append(begins[1:], len(name)) - 1
            length = (ends - begins + 1).astype(np.uint64)
            name = np.where(length > 1, mix(name[begins] + mix(length, 2 * number + 1), 1), name[begins])
            first, last = first[np.maximum(begins - 1, 0)], last[np.minimum(ends + 1, len(last) - 1)]
        heads = (mix(name, 2 * number + 2) >> np.uint64(63)).astype(bool)
        words_here = name != 0
        left = np.append(heads[:-1] & ~heads[1:] & words_here[:-1] & words_here[1:], False)
        right = np.append(False, left[:-1])
        pair = mix(name[:-1] * np.uint64(BASE1) + mix(name[1:], 3), 5)
        joined, until = name.copy(), last.copy()
        at = np.flatnonzero(left)
        joined[at] = pair[at]
        until[at] = last[at + 1]
        since = first.copy()
        alone = ~left & ~right & words_here
        after = np.flatnonzero(alone & heads)
        until[after] = last[np.minimum(after + 1, len(last) - 1)]
        before = np.flatnonzero(alone & ~heads)
        since[before] = first[np.maximum(before - 1, 0)]
        stays = ~right
        first, last, name = since[stays], until[stays], joined[stays]
        yield first, last, name


def anchors(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor (name with round, first word of its stretch) of the window at each of ``starts``, ascending."""
    found, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    levels = []
    for number, (first, last, name) in enumerate(rounds(words, rounds_for(window))):
        fits = (last - first <= (window + 1) // 2) & (name != 0)
        if not fits.any():
            break
        levels.append((first[fits], last[fits], name[fits]))
    waiting = np.arange(len(starts))
    for number in range(len(levels) - 1, -1, -1):
        if not len(waiting):
            break
        first, last, name = levels[number]
        p = starts[waiting]
        low, high = np.searchsorted(first, p, "left"), np.searchsorted(last, p + window, "right")
        has = low < high
        mine, low, high = waiting[has], low[has], high[has]
        best, smallest = low.copy(), name[low] if len(low) else np.zeros(0, np.uint64)
        going, step = np.flatnonzero(high - low > 1), 1
        while len(going):
            other = low[going] + step
            better = name[other] < smallest[going]
            best[going[better]], smallest[going[better]] = other[better], name[other[better]]
            step += 1
            going = going[high[going] - low[going] > step]
        found[mine], place[mine] = mix(smallest, 100 + number), first[best]
        waiting = waiting[~has]
    return found, place


def powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    if count > 1:
        out[1:] = base
    return np.multiply.accumulate(out)


class Stretches:
    """Hashes of stretches of words, from sums of words times powers of an odd base modulo 2**64."""

    def __init__(self, words: np.ndarray):
        self.sums, self.back = [], []
        for base, values in ((BASE1, words), (BASE2, mix(words, 77))):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(words)), dtype=np.uint64)]))
            self.back.append(powers(pow(base, -1, 1 << 64), len(words) + 1))

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]


class Hashes(dict):
    """64-bit hash of each word met, never 0."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) or 1
        return found


class Texts:
    """Words of some documents and their hashes, zeros before, between and after the documents."""

    def __init__(self, texts: list[str | None], hashes: Hashes):
        self.split = [words_of(t) for t in texts]
        parts, zero = [], np.zeros(1, np.uint64)
        for words in self.split:
            parts += [zero, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))]
        self.words = np.concatenate([*parts, zero])
        self.lengths = np.array([len(w) for w in self.split], np.int64)
        self.begins = np.cumsum(self.lengths + 1) - self.lengths


class Block(Texts):
    """Words, occurrences and hashes of some documents."""

    def __init__(self, texts: list[str | None], window: int, hashes: Hashes):
        super().__init__(texts, hashes)
        windows = np.maximum(self.lengths - window + 1, 0)
        starts = np.repeat(self.begins, windows) + counted_up(windows)
        names, places = anchors(self.words, starts, window)
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (names[1:] != names[:-1]) | (places[1:] != places[:-1])
        at = np.flatnonzero(new)
        self.low = starts[at]
        self.high = starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts
        self.name = names[at]
        self.owner = np.searchsorted(self.begins, self.low, side="right") - 1
        stretches = Stretches(self.words)
        span = mix(stretches.of(self.low, self.high + window, 0) + mix((places[at] - self.low).astype(np.uint64), 9))
        self.span = mix(span + (self.high - self.low).astype(np.uint64))


def counted_up(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, exclusive, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def rows_by_tag(tags: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct tag, in the order of tags, and the place of each wanted tag among them (all occur)."""
    known, first = np.unique(tags, return_index=True)
    return first, np.searchsorted(known, wanted)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def unsigned(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def remove_shared(df: DataFrame, key: str, text: str, window: int = 50, block_bytes: int = 4 << 20) -> DataFrame:
    """Rows (key, n_words, n_removed, kept): ``kept`` is the words of the text, joined by one space,
    without those covered by a window of ``window`` words that also starts in a row with a smaller key.

    ``key`` is a long; a null key counts as larger than all others and nothing is smaller than an equal
    key, so rows of one key leave each other alone. Null and empty texts have no words; a text shorter
    than the window loses none. Repeats inside a document alone are kept. Rows are spread by key and
    text, so that very many rows of one key, or without one, are not held together.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(shuffle_width(spark), -(-total // block_bytes))
    block_of = F.pmod("tag", F.lit(blocks)).alias("block")
    docs = docs.withColumn("doc", F.coalesce("key", F.lit(int(LAST)))).withColumn("tag", F.xxhash64("doc", "text"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches, "text"):
            held = Block(batch.column(0).to_pylist(), window, hashes)
            doc, tag = (batch.column(i).to_numpy()[held.owner] for i in (1, 2))
            start, more = held.low - held.begins[held.owner], held.high - held.low
            columns = [signed(held.name), signed(held.span), pa.array(doc), pa.array(tag), *[pa.array(x.astype(np.int32)) for x in (start, more)]]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "span", "doc", "tag", "start", "more"])

    kinds = "name long, span long, doc long, tag long, start int, more int"
    found = docs.select("text", "doc", "tag").mapInArrow(occurrences, kinds)
    seen, seen_path = stored(found, "occurrences")
    names = seen.groupBy("name").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    bitmap = spark.sparkContext.broadcast(bitmap_of(names.select(F.col("name").alias("code"))))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(within(bitmap.value, unsigned(batch.column(0)))))

    repeated, repeated_path = stored(seen.mapInArrow(often, kinds), "repeated")
    drop_stored(spark, seen_path)
    variants = repeated.groupBy("name", "span").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    by_name = variants.groupBy("name").agg(F.count(F.lit(1)).alias("spans"), F.min("low").alias("lowest"), F.max("high").alias("highest"))
    shared = variants.join(by_name.where("lowest < highest"), "name").select("name", "span", "low", "spans")
    shared, _ = stored(shared, "shared")
    met = repeated.join(shared, ["name", "span"])
    whole = met.where("doc > low").select(block_of, "tag", "start", "more")

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        """Hashes of the windows of the asked occurrences, with the row's document and tag and the window's place."""
        tag, place, more = (right[c].to_numpy() for c in ("tag", "start", "more"))
        order = np.lexsort((place, tag))
        tag, place, more = tag[order], place[order].astype(np.int64), more[order].astype(np.int64)
        new = np.ones(len(tag), bool)
        new[1:] = (tag[1:] != tag[:-1]) | (place[1:] != place[:-1])
        rows, row = rows_by_tag(left["tag"].to_numpy(), tag[new])
        asked_rows, row = np.unique(row, return_inverse=True)
        rows = rows[asked_rows]
        held, count = Texts(left["text"].take(pa.array(rows)).to_pylist(), Hashes()), more[new] + 1
        owner, place = np.repeat(row, count), np.repeat(place[new], count) + counted_up(count)
        start, stretches = held.begins[owner] + place, Stretches(held.words)
        of_row = [pa.array(left[c].to_numpy()[rows][owner]) for c in ("doc", "tag")]
        hashes = [signed(stretches.of(start, start + window, i)) for i in (0, 1)]
        return pa.table([*of_row, pa.array(place.astype(np.int32)), *hashes], names=["low", "tag", "start", "h1", "h2"])

    asked = met.where("doc = low and spans > 1").select(block_of, "tag", "start", "more")
    texts = docs.withColumn("block", block_of).select("key", "text", "doc", "tag", "block")
    hashed = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(windows, "low long, tag long, start int, h1 long, h2 long")
    # A row for each span that has a window; copies of a span are not among them.
    earliest = hashed.withColumn("from", F.min("low").over(Window.partitionBy("h1", "h2"))).where(F.col("from") < F.col("low"))
    single = earliest.select(block_of, "tag", "start", F.lit(0).alias("more"))

    def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a block without the words of windows that a smaller document has."""
        first, row = rows_by_tag(left["tag"].to_numpy(), right["tag"].to_numpy())
        _, copy_of = rows_by_tag(left["tag"].to_numpy(), left["tag"].to_numpy())
        split = [words_of(t) for t in left["text"].take(pa.array(first)).to_pylist()]
        ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        begins = np.append(0, ends[:-1])[: len(split)]
        edge = np.zeros(int(ends[-1] if len(ends) else 0) + 1, np.int64)
        start = begins[row] + right["start"].to_numpy()
        np.add.at(edge, start, 1)
        np.add.at(edge, start + right["more"].to_numpy() + window, -1)
        stays = np.cumsum(edge) <= 0
        kept = [b" ".join(words if (m := stays[b:e]).all() else compress(words, m.tolist())) for words, b, e in zip(split, begins, ends)]
        lengths, gone = ends - begins, np.append(0, np.cumsum(~stays))
        columns = [
            left["key"].combine_chunks(),
            pa.array(lengths[copy_of]),
            pa.array((gone[ends] - gone[begins])[copy_of]),
            pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()).take(pa.array(copy_of)),
        ]
        return pa.table(columns, names=["key", "n_words", "n_removed", "kept"])

    result = texts.groupBy("block").cogroup(whole.unionAll(single).groupBy("block")).applyInArrow(
        cleaned, "key long, n_words long, n_removed long, kept string"
    )
    return result.withColumnRenamed("key", key)
