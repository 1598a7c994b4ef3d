"""Passages of benchmark items in documents, by CGK embedding and bit-sampling LSH.

Items and texts are words without case and surrounding punctuation. A long item is cut into segments of
24 to 47 words, as walks on longer ones come apart too often; if a passage is within the edit limit of the
item, one of its segments at least is within its own share of that limit. For every segment length, each
window of that many words is looked at. A window within the limit of a segment must take most of its words
from the segments of its length, which rules out nearly all windows without loss. The others and the
segments are embedded by the CGK random walk: a walk along the words emits the current word at every step
and moves on or stays by a random bit of (step, word), which turns few edits into few differing steps. Each
repetition walks with other bits and samples a few steps as its key; there are as many repetitions as the
recall asks for at the segment's length. Whatever shares a key is verified by the exact edit distance,
over words, between the whole item and the best matching passages around it.

Items are held by every task in blocks of a bounded size; more items mean more passes over the
documents, each of which starts from stored rows, not larger blocks.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import map_columns, quoted, slices, stored, worker_state, working_name

EDGES = string.punctuation + "«»„“”‘’‚…–—¿¡"
#: What ``str.split`` cuts at, as bytes and beyond ASCII.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f "
AROUND = EDGES + SPACES
WHITE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))
OTHER_SPACES = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Chance that a repetition finds a segment at its edit limit, measured for words dropped (the worst of dropped, put
# in and replaced ones) with two sampled steps: about 0.53 * exp(-0.0275 * words) from 5 to 47 words. It differs between
# passages, so that fewer are found than at an equal chance; this much less makes up for it.
SHORT, FADE = 0.48, 0.03


@dataclass(frozen=True)
class Search:
    """Edit limit as a share of the item's words, recall of the walks at that limit, steps sampled for a key, words of a
    segment (longer items have several), the fewest words of an item that is searched for, and the bytes of items
    in a block."""

    max_edits: float = 0.2
    recall: float = 0.98
    sampled: int = 2
    segment: int = 24
    min_words: int = 5
    block_bytes: int = 8 << 20

    def repetitions(self, words: int) -> int:
        """Walks for a segment. The chance is for two steps; that all of more agree is taken as a power of it."""
        chance = (SHORT * math.exp(-FADE * words)) ** (self.sampled / 2)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - chance))


def word_hash(word: str) -> int:
    """64-bit hash of a word without case, surrounding punctuation and white space; 0 for none left."""
    plain = word.lower().strip(AROUND)
    return (xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) or 1) if plain else 0


class WordHashes(dict):
    """Hash of each word met."""

    def __missing__(self, word: str) -> int:
        found = word_hash(word)
        if len(self) > 400_000:
            self.clear()
        self[word] = found
        return found


def hashed(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = text.split() if text else []
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return found[found != 0]


def hashed_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of all texts; which of them each word is, those without a hash left out;
    and how many words each text has."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    other = pc.match_substring_regex(texts, OTHER_SPACES)
    if pc.any(other).as_py():
        texts = pc.if_else(other, pc.replace_substring_regex(pc.if_else(other, texts, ""), OTHER_SPACES, " "), texts)
    content = b"\n".join([*texts.cast(pa.binary()).to_pylist(), b""])
    white = WHITE[np.frombuffer(content, np.uint8)]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    ends = np.cumsum(pc.binary_length(texts).to_numpy() + 1, dtype=np.int64)
    # A word has the white space behind it, which its hash leaves out.
    offsets = np.append(starts, len(content)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(content)).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(word_hash, names), np.uint64, len(names))
    which = coded.indices.to_numpy()
    kept = (hashes != 0)[which]
    before = np.concatenate([[0], np.cumsum(kept)])[np.searchsorted(starts, ends)]
    return hashes, which[kept], np.diff(before, prepend=0)


class Items:
    """Items of one block, cut into segments, and these by length with their keys of every repetition."""

    def __init__(self, items: list[tuple], search: Search):
        hashes = WordHashes()
        self.search = search
        self.words = [hashed(text, hashes) for _, text in items]
        self.ids = [key for key, _ in items]
        #: Item and first word of each segment.
        self.item, self.offset = [], []
        lengths: dict[int, list[int]] = {}
        for number, words in enumerate(self.words):
            if len(words) < max(1, search.min_words):
                continue
            parts = max(1, len(words) // search.segment)
            edges = np.arange(parts + 1) * len(words) // parts
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                lengths.setdefault(high - low, []).append(len(self.item))
                self.item.append(number)
                self.offset.append(low)
        self.item, self.offset = np.array(self.item, np.int64), np.array(self.offset, np.int64)
        self.lengths = dict(sorted(lengths.items()))
        self.longest = max(self.lengths, default=0)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[self.words[n] for n in set(self.item.tolist())]]))
        self.times, self.keys, self.plans = {}, {}, {}
        for length, numbers in self.lengths.items():
            table = np.stack([self.words[self.item[n]][self.offset[n] : self.offset[n] + length] for n in numbers])
            times = np.zeros(len(self.vocabulary) + 1, np.int16)
            for row in table:
                places, counts = np.unique(np.searchsorted(self.vocabulary, row), return_counts=True)
                times[places] = np.maximum(times[places], counts)
            self.times[length] = times
            self.plans[length] = self.plan(length)
            held = []
            for key in self.embedded(table, length).T:
                order = np.argsort(key, kind="stable")
                held.append((key[order], np.array(numbers)[order]))
            self.keys[length] = held

    def plan(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Salt of each step and repetition, and whether the repetition samples the step."""
        random = np.random.default_rng(1_000 + length)
        steps, repetitions = 2 * length, self.search.repetitions(length)
        salts = random.integers(1, 2**63, (steps, repetitions), dtype=np.uint64)
        sampled = np.zeros(salts.shape, bool)
        for repetition in range(repetitions):
            sampled[random.choice(steps, min(self.search.sampled, steps), replace=False), repetition] = True
        return salts, sampled

    def embedded(self, windows: np.ndarray, length: int) -> np.ndarray:
        """Key of each window (a row of words) in each repetition (columns), all walked side by side."""
        padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
        rows = np.arange(len(windows))[:, None]
        at = np.zeros((len(windows), self.plans[length][0].shape[1]), np.int64)
        key = np.zeros(at.shape, np.uint64)
        for step, (salts, sampled) in enumerate(zip(*self.plans[length])):
            word = padded[rows, at]
            if sampled.any():
                key[:, sampled] = (key[:, sampled] ^ word[:, sampled]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1)
            mixed = (word ^ salts) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            at += ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, length, out=at)
        return key

    def shared(self, place: np.ndarray, starts: np.ndarray, length: int, need: int) -> np.ndarray:
        """Starts of the windows that take ``need`` words from segments of the length, each word no more
        often than any of these has it."""
        ordered = np.sort(place[starts[:, None] + np.arange(length)], axis=1)
        column = np.arange(length)
        changed = np.ones(ordered.shape, bool)
        changed[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        copy = column - np.maximum.accumulate(np.where(changed, column, 0), axis=1)
        return starts[(copy < self.times[length][ordered]).sum(axis=1) >= need]

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or its size for other words."""
        place = np.searchsorted(self.vocabulary, words)
        place[place == len(self.vocabulary)] = 0
        place[self.vocabulary[place] != words] = len(self.vocabulary)
        return place

    def inside(self, place: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """How many words of each window any segment of the length has; counted where windows are."""
        first = np.flatnonzero(np.diff(starts, prepend=-length - 1) > length)
        last = np.append(first[1:], len(starts)) - 1
        sizes = starts[last] + length - starts[first]
        shift = starts[first] - np.cumsum(sizes) + sizes
        found = (self.times[length] > 0)[place[np.arange(sizes.sum()) + np.repeat(shift, sizes)]]
        counted = np.concatenate([[0], np.cumsum(found, dtype=np.int32)])
        at = starts - np.repeat(shift, last - first + 1)
        return counted[at + length] - counted[at]

    def candidates(self, words: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window start, segment) of windows that share a key; ``words`` holds the texts, with ``longest``
        zeros before, between and behind them, and ``place`` the words' places in the vocabulary."""
        others = np.concatenate([[0], np.cumsum(place == len(self.vocabulary), dtype=np.int32)])
        size = len(words) - self.longest
        most, few = -1, None
        for length, held in self.keys.items():
            spare = int(self.search.max_edits * length)
            need = length - spare
            # A longer window with no more words to spare begins where a shorter one does.
            if spare == most:
                few = few[others[few + length] - others[few] <= spare]
            else:
                most, few = spare, np.flatnonzero(others[length : length + size] - others[:size] <= spare)
            starts = few
            if len(starts):
                starts = starts[self.inside(place, starts, length) >= need]
            starts = [self.shared(place, starts[low : low + 4096], length, need) for low in range(0, len(starts), 4096)]
            starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            for low in range(0, len(starts), 2048):
                part = starts[low : low + 2048]
                windows = words[part[:, None] + np.arange(length)]
                for (keys, numbers), key in zip(held, self.embedded(windows, length).T):
                    first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    count = last - first
                    if count.any():
                        each = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                        yield np.repeat(part, count), numbers[each]


def best_passage(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the passage of ``words`` nearest to ``item``, the first of equals."""
    columns = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(item, 1):
        below = np.empty_like(row)
        below[0] = i
        below[1:] = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        row = np.minimum.accumulate(below - columns) + columns
    end = int(row.argmin())
    return int(row[end]), end


class Finder:
    """Matches of one block of items in texts."""

    def __init__(self, items: list[tuple], search: Search):
        self.items, self.search = Items(items, search), search

    def find(self, texts: pa.Array | list[str | None]) -> list[list[tuple]]:
        """For each text its (item, start, words, distance), for every item passages that do not overlap."""
        found: list[list[tuple]] = [[] for _ in range(len(texts))]
        if not self.items.lengths or not found:
            return found
        hashes, which, lengths = hashed_texts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        gap = self.items.longest
        begins = gap + np.cumsum(lengths + gap) - lengths - gap
        at = np.arange(len(which)) + np.repeat(gap * np.arange(1, len(lengths) + 1), lengths)
        words = np.zeros(len(which) + gap * (len(lengths) + 1), np.uint64)
        words[at] = hashes[which]
        place = np.full(len(words), len(self.items.vocabulary))
        place[at] = self.items.places(hashes)[which]
        docs = [words[b : b + n] for b, n in zip(begins.tolist(), lengths.tolist())]
        pairs = [np.stack(p, axis=1) for p in self.items.candidates(words, place)]
        if not pairs:
            return found
        pairs = np.unique(np.concatenate(pairs), axis=0)
        # A window may begin before its text, as the passage may lack words there.
        owner = np.searchsorted(begins + lengths, pairs[:, 0], side="right")
        item = self.items.item[pairs[:, 1]]
        # Where the whole item would begin, had the passage no word more or less before the segment.
        start = pairs[:, 0] - begins[owner] - self.items.offset[pairs[:, 1]]
        order = np.lexsort((start, item, owner))
        owner, item, start = owner[order], item[order], start[order]
        limits = np.array([int(self.search.max_edits * len(w)) for w in self.items.words], np.int64)
        sizes = np.array([len(w) for w in self.items.words], np.int64)
        # Starts whose surroundings meet are looked at together.
        new = np.ones(len(start), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > (sizes + 3 * limits)[item[1:]])
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(start)) - 1
        for doc, number, low, high in zip(owner[firsts].tolist(), item[firsts].tolist(), start[firsts].tolist(), start[lasts].tolist()):
            limit, size = int(limits[number]), int(sizes[number])
            low, high = max(0, low - limit), min(len(docs[doc]), high + size + 2 * limit)
            for start_, words_, distance in passages(self.items.words[number], docs[doc][low:high], limit):
                found[doc].append((self.items.ids[number], low + start_, words_, distance))
        return [sorted(f, key=lambda m: (m[1], str(m[0]))) for f in found]


def passages(item: np.ndarray, words: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """(start, words, edit distance) of passages within the limit that do not overlap: the nearest, then those
    in what is left before and behind it."""
    waiting = [(0, len(words))]
    while waiting:
        low, high = waiting.pop()
        if high - low < max(1, len(item) - limit):
            continue
        distance, end = best_passage(item, words[low:high])
        if distance > limit:
            continue
        _, back = best_passage(item[::-1], words[low : low + end][::-1])
        yield low + end - back, back, distance
        waiting += [(low, low + end - back), (low + end, high)]


def item_blocks(items: DataFrame, key: str, text: str, search: Search) -> Iterator[list[tuple]]:
    """Items in blocks of about ``block_bytes``; a longer item is a block of its own."""
    rows = items.select(quoted(key).alias("key"), quoted(text).alias("text")).where("key is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = math.ceil(total / search.block_bytes)
    for block in range(blocks):
        chosen = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        yield [tuple(r) for r in chosen.orderBy("key", "text").collect()]


def with_matches(
    df: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str, name: str = "matches", search: Search = Search()
) -> DataFrame:
    """The rows of ``df`` with ``name``: an array of (item, start, words, distance) of the items found in
    ``text``, places and lengths in words with anything but punctuation.

    Null and empty texts have no match; items that are null, have a null key or fewer than
    ``min_words`` words are not searched for (any may be; below five words no edit is allowed); equal items are
    all reported; an item's passages do not overlap; rows may repeat. A column of ``df`` called ``name``
    is replaced. Without items every array is empty.
    """
    kept = [c for c in df.columns if c.lower() != name.lower()]
    kind = items.schema[item_key].dataType.simpleString()
    out = f"array<struct<item:{kind}, start:long, words:long, distance:long>>"
    result = df.select(*[quoted(c) for c in kept]).withColumn(name, F.array().cast(out))
    for number, block in enumerate(item_blocks(items, item_key, item_text, search)):
        # From stored rows, else all blocks would be searched for, and held, side by side.
        result = one_block(stored(result, "searched")[0] if number else result, text, block, name, out, kind, search)
    return result


def one_block(df: DataFrame, text: str, block: list[tuple], name: str, out: str, kind: str, search: Search) -> DataFrame:
    (found,) = working_name(df, "_found")
    sent = df.sparkSession.sparkContext.broadcast(block)
    label = f"finder {id(sent)} {hash(tuple(map(str, block[:1000])))} {search}"

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        finder = worker_state(label, lambda: Finder(sent.value, search))
        key = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        matched = pa.list_(pa.struct([("item", key)] + [(c, pa.int64()) for c in ("start", "words", "distance")]))
        for batch in slices(batches, at, 8 << 20):
            rows = [[dict(zip(("item", "start", "words", "distance"), m)) for m in ms] for ms in finder.find(batch.column(at))]
            yield batch, pa.array(rows, matched)

    joined = map_columns(df, run, [text], found, out)
    return joined.withColumn(name, F.concat(quoted(name), found)).drop(found)
