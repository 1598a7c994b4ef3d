"""Scores of texts under a probabilistic suffix tree over words.

A state of the tree is a context of up to ``depth`` words. A context is a candidate if it occurs
``min_count`` times in the training texts, whatever their size, and is kept if its next-word distribution
diverges enough from that of its suffix. Next-word distributions are smoothed: what discounting takes
from the counted words (those seen ``min_count`` times after the context) is spread by the suffix'
distribution, down to the root, which is the add-one unigram distribution over all words. A token is
scored in the state of the longest suffix of the words before it.

Texts are read once and written as blocks: their distinct words, and their tokens as places of those. The
words of all blocks are counted and numbered with Spark, frequent ones first, and the blocks written again with
these numbers. All that the tree knows of a context and of the longer ones that end in it comes from the tokens
after it, so every token is sent once, with the words before it, to the group of the word before it: there
contexts are weighed shortest first, each text's tokens scored under them, and only sums for each text go back.
A word that more than ``light`` tokens follow would make one group too large. Its own next words are then counted
and weighed with Spark aggregates, its tokens go to the groups of the contexts of two words (three, ...) that it
ends, and each group asks for what it needs of the heavy contexts. Contexts are told apart by their words,
heavy ones by 64-bit codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.llm.common import ASCII_UPPER, SPACES, bitmap_of, drop_stored, shuffle_files_freed, slices, stored, within

END = b""
#: A-Z in lower case, and a space for all white space of the word rule.
PLAIN = bytes.maketrans(ASCII_UPPER.encode() + SPACES.encode(), ASCII_UPPER.lower().encode() + b" " * len(SPACES))
#: Factor of the codes of contexts.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


@dataclass(frozen=True)
class Tree:
    """How often a context and a counted next word must occur (a count, and a share of the training
    tokens if that is to count too), longest context, discount, and the gain in nats for each counted word
    that a context must bring over its suffix."""

    min_context: float = 0.0
    discount: float = 0.75
    min_gain: float = 2.0
    min_count: int = 2
    depth: int = 4

    def least(self, total: int) -> float:
        return max(2.0, self.min_count, self.min_context * total)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts (none: empty), A-Z in lower case, the tokens, one text after the other and an end after
    each, as places of these, and how many each text has."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().translate(PLAIN)
    buffers = [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(content)]
    parts = pc.split_pattern(pa.Array.from_buffers(pa.large_binary(), len(texts), buffers), " ")
    found = parts.flatten().dictionary_encode()
    words, ids = found.dictionary.cast(pa.binary()), found.indices.to_numpy()
    end = words.index(pa.scalar(END, pa.binary())).as_py()
    there = ids != end
    if end < 0:
        words, end = pa.concat_arrays([words, pa.array([END], pa.binary())]), len(words)
    lengths = np.add.reduceat(there.astype(np.int64), np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()) + 1
    held, no_end = np.full(lengths.sum(), end, np.int32), np.ones(lengths.sum(), bool)
    no_end[np.cumsum(lengths) - 1] = False
    held[no_end] = ids[there]
    return words, held, lengths


def code_of(numbers: np.ndarray) -> np.ndarray:
    """Mixed 64-bit codes of the numbers of words."""
    x = numbers.astype(np.uint64) + FACTOR
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(depth: int) -> list[np.uint64]:
    """What the code of the first, second, ... word before a token is multiplied by in the code of a context."""
    return [np.uint64(pow(int(FACTOR), j, 1 << 64)) for j in range(1, depth + 1)]


def packed(numbers: np.ndarray) -> bytes:
    """The numbers, compressed byte by byte of their width: those of small ones take next to nothing."""
    if not len(numbers):
        return b""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(content: bytes, kind: type) -> np.ndarray:
    if not content:
        return np.zeros(0, kind)
    n, width = int.from_bytes(content[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(content[8:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(rising: np.ndarray) -> np.ndarray:
    """What to add to each number to have the next; ``cumsum`` takes it back."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def blocks_of(docs: DataFrame, block_bytes: int = 24 << 20) -> DataFrame:
    """Rows (block, keys, train, n_tokens, words, n, seen, ids) from (key, train, text): texts of about ``block_bytes``
    together, their distinct words, how often each occurs in training texts and at all, and the tokens of the
    texts, one text after the other and an end after each, as places in ``words``."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", block_bytes):
            each = [tokens_of(x["text"]) for x in slices(iter([batch]), "text")]
            found = pa.chunked_array([pa.DictionaryArray.from_arrays(held, words) for words, held, _ in each]).unify_dictionaries()
            words, lengths = found.chunk(0).dictionary, np.concatenate([x for *_, x in each])
            held = np.concatenate([x.indices.to_numpy() for x in found.chunks]).view(np.uint32)
            learnt = np.repeat(batch["train"].to_numpy(zero_copy_only=False), lengths)
            counts = [np.bincount(x, minlength=len(words)) for x in (held[learnt], held)]
            lists = [batch["key"], batch["train"], pa.array(lengths), words, *map(pa.array, counts)]
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([packed(held)], pa.binary())], names=names)
            block += 1

    names = ["block", "keys", "train", "n_tokens", "words", "n", "seen", "ids"]
    lists = f"keys array<{kind}>, train array<boolean>, n_tokens array<long>, words array<binary>, n array<long>, seen array<long>"
    return docs.select("key", "train", "text").mapInArrow(run, f"block long, {lists}, ids binary")


def block_words(blocks: DataFrame) -> DataFrame:
    """Rows (block, place, word, n, seen)."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("words", "n", "seen")).alias("place", "x"))
    return rows.select("block", "place", F.col("x.words").alias("word"), F.col("x.n").alias("n"), F.col("x.seen").alias("seen"))


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): words and ends of the texts, added up by block."""
    all_ = docs.select(F.lit(None).cast("long").alias("key"), F.lit(True).alias("train"), "text")
    return block_words(blocks_of(all_)).select("word", "n")


def numbered(vocabulary: DataFrame) -> tuple[DataFrame, str]:
    """The words with a number each, smaller for one that occurs twice as often, as a table, and its path."""
    rarity = 63 - F.floor(F.log2(F.col("c") + 1))
    number = F.shiftleft(rarity.cast("long"), 54) + F.monotonically_increasing_id()
    # In order within a task, so that counts by number hardly change.
    return stored(vocabulary.sortWithinPartitions(F.desc("c")).withColumn("number", number), "vocabulary")


def coded(blocks: DataFrame, vocabulary: DataFrame, total: int, distinct: int, least: float) -> tuple[DataFrame, str]:
    """Rows (block, keys, train, n_tokens, n_known, base, numbers, counts, ids, end) as a table, and its path.

    ``numbers`` has the numbers of the block's words that occur ``least`` times in training, rising, ``counts`` how
    often they do, and ``ids`` their places, from 1, for each token (0: a rarer word); ``end`` is the place of the end."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {name: left[name].combine_chunks() for name in ("words", "ids")}
        words = row["words"].flatten()
        c, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = right["place"].to_numpy()
        c[at], number[at] = right["c"].to_numpy(), right["number"].to_numpy()
        ids = unpacked(row["ids"][0].as_py(), np.uint32)
        starts = np.cumsum([0, *left["n_tokens"].combine_chunks().flatten().to_pylist()])[:-1]
        known = np.add.reduceat((c > 0)[ids].astype(np.int64), starts)
        base = np.add.reduceat(np.log10((c + 1) / (total + distinct + 1))[ids], starts)
        often = np.flatnonzero(c >= least)
        often = often[np.argsort(number[often])]
        place = np.zeros(len(words), np.uint32)
        place[often] = np.arange(1, len(often) + 1)
        end = place[words.index(pa.scalar(END, pa.binary())).as_py()]
        lists = [pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in (known, base)]
        blobs = [pa.array([packed(x)], pa.binary()) for x in (steps(number[often]), steps(c[often]), place[ids])]
        return pa.table([left["block"], left["keys"], left["train"], left["n_tokens"], *lists, *blobs, pa.array([int(end)])], names=names)

    names = ["block", "keys", "train", "n_tokens", "n_known", "base", "numbers", "counts", "ids", "end"]
    known = block_words(blocks).select("block", "place", "word").join(vocabulary.select("word", "c", "number").hint("shuffle_hash"), "word")
    both = blocks.drop("n", "seen").groupBy("block").cogroup(known.select(F.col("block").alias("of"), "place", "c", "number").groupBy("of"))
    kinds = [f"{name} {blocks.schema[name].dataType.simpleString()}" for name in names[:4]]
    kinds += ["n_known array<long>", "base array<double>", "numbers binary", "counts binary", "ids binary", "end long"]
    return stored(both.applyInArrow(run, ", ".join(kinds)), "blocks")


class Tokens:
    """The tokens of some texts of a coded block: their words' places (0: rare), text, whether that is learnt from, and
    the words before each, nearest first, as far as none is rare (0 from there on)."""

    def __init__(self, block: int, numbers: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> None:
        self.block, self.numbers, self.counts, self.codes = block, numbers, counts, codes

    def hold(self, ids: np.ndarray, lengths: np.ndarray, train: np.ndarray, first: int, end: int, depth: int) -> None:
        self.ids, self.train = ids, np.repeat(train, lengths)
        self.doc = np.repeat(np.arange(first, first + len(lengths), dtype=np.int32), lengths)
        place = np.arange(len(ids), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        self.before, there = [], np.ones(len(ids), bool)
        for j in range(1, depth + 1):
            word = np.zeros(len(ids), np.uint32)
            word[j:] = ids[:-j]
            word[place < j] = 0
            word[place == j - 1] = end
            there = there & (word > 0)
            word[~there] = 0
            self.before.append(word)

    def contexts(self, heavy: np.ndarray | None = None) -> Iterator[tuple]:
        """For each length the tokens with such a context, of those whose shorter contexts are ``heavy`` if that is given,
        the codes of the context and of its suffix, and whether the context is heavy."""
        at = np.flatnonzero(self.before[0])
        context, firsts = np.zeros(len(at), np.uint64), FACTOR * self.codes
        weighty = None if heavy is None else np.isin(firsts, heavy)
        for j, (word, power) in enumerate(zip(self.before, powers(len(self.before)))):
            word = word[at]
            there = word > 0
            at, word, suffix = at[there], word[there], context[there]
            context = suffix + power * self.codes[word] if j else firsts[word]
            if heavy is None:
                yield at, context, suffix, None
            else:
                is_heavy = np.isin(context, heavy) if j else weighty[word]
                yield at, context, suffix, is_heavy
                at, context = at[is_heavy], context[is_heavy]


TOKENS = ["block", "train", "n_tokens", "numbers", "counts", "ids", "end"]


def pieces(batches: Iterator[pa.RecordBatch], depth: int, most: int = 1 << 20) -> Iterator[Tokens]:
    """The tokens of coded blocks, so many texts at a time as have ``most`` tokens, or one that has more."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            numbers = np.cumsum(unpacked(row["numbers"], np.int64))
            tokens = Tokens(row["block"], numbers, np.cumsum(unpacked(row["counts"], np.int64)), np.concatenate([np.zeros(1, np.uint64), code_of(numbers)]))
            ids, lengths, train = unpacked(row["ids"], np.uint32), np.array(row["n_tokens"]), np.array(row["train"], bool)
            ends, first = np.cumsum([0, *lengths]), 0
            while first < len(lengths):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
                tokens.hold(ids[ends[first] : ends[last]], lengths[first:last], train[first:last], first, row["end"], depth)
                yield tokens
                first = last


def heavy_contexts(blocks: DataFrame, vocabulary: DataFrame, depth: int, least: float, light: int) -> np.ndarray:
    """Codes of the contexts that more than ``light`` tokens follow. There are at most ``depth`` for each ``light`` tokens."""
    words = vocabulary.where((F.col("seen") > light) & (F.col("c") >= least)).select("number").toArrow()
    found = [FACTOR * code_of(words["number"].to_numpy())]
    for length in range(2, depth + 1):
        if not len(found[-1]):
            break
        known = np.concatenate(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tokens in pieces(batches, length):
                *_, (_, context, _, _) = tokens.contexts(known)
                codes, n = np.unique(context, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])

        sums = blocks.select(*TOKENS).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        found.append(sums.where(F.col("n") > light).toArrow()["code"].to_numpy().astype(np.int64).view(np.uint64))
    return np.concatenate(found)


@dataclass
class Level:
    """Kept contexts of one length: their codes, the mass left to the suffix, and counted next words
    (context place * width + word) with their discounted shares."""

    width: int
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0))
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def place(self, contexts: np.ndarray) -> np.ndarray:
        """Place of each context, -1 where it is not kept."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)

    def probability(self, contexts: np.ndarray, words: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Probability of each word (-1: not frequent) after its context, given that after the suffix."""
        at = self.place(contexts)
        kept = at >= 0
        out = suffix.copy()
        out[kept] *= self.left[at[kept]]
        asked = kept & (words >= 0)
        if len(self.codes) and asked.any():
            code = at[asked] * self.width + words[asked]
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out[asked] += np.where(self.codes[found] == code, self.shares[found], 0.0)
        return out


def counted(blocks: DataFrame, length: int, frequent: np.ndarray, heavy: np.ndarray | None = None) -> DataFrame:
    """Rows (context, word, suffix, n), added up by block: how often each word follows each context of ``length``
    words, or each of the ``heavy`` ones, in training, and with a null word how often the context occurs.

    ``frequent`` is the bitmap of the runs of ``length`` words (a context and the word after it, by the
    codes of the level below) that are frequent; others need no row."""
    sent = blocks.sparkSession.sparkContext.broadcast(frequent)
    names = ["context", "word", "suffix", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in pieces(batches, length):
            *_, (at, context, suffix, is_heavy) = tokens.contexts(heavy)
            there = tokens.train[at] if is_heavy is None else tokens.train[at] & is_heavy
            at, context, suffix = at[there], context[there], suffix[there]
            if length > 1:
                # The context is the run of the word before the token and the context of that.
                run = (context * INVERSE - tokens.codes[tokens.before[0][at]]) ^ tokens.codes[tokens.before[0][at]]
                there = within(sent.value, run)
                at, context, suffix = at[there], context[there], suffix[there]
            known, n = np.unique(context, return_counts=True)
            none = pa.nulls(len(known), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), none, none, pa.array(n)], names=names)
            word = tokens.codes[tokens.ids[at]]
            there = np.flatnonzero((tokens.ids[at] > 0) & within(sent.value, suffix ^ word))
            _, first, n = np.unique((context ^ word)[there], return_index=True, return_counts=True)
            there = there[first]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[there].view(np.int64)) for x in (context, word, suffix)], pa.array(n)], names=names)

    return blocks.select(*TOKENS).mapInArrow(run, "context long, word long, suffix long, n long")


def weighed(tree: Tree, counts: DataFrame, below: DataFrame) -> DataFrame:
    """Rows (context, word, share, left, p, kept) of the counted words of a level.

    ``below`` has the probability of each counted word after the suffix (context, word, p). ``share`` is the
    word's discounted share, ``left`` the mass that the context leaves to its suffix and p the probability
    of the word after the context, which is that after the suffix if the context is not kept."""
    followed, n = F.col("word").isNotNull(), F.col("n")
    sums = counts.groupBy("context").agg(
        F.sum(F.when(~followed, n)).alias("all"), F.sum(F.when(followed, n)).alias("seen"), F.count("word").alias("entries")
    )
    sums = sums.where("entries > 0").withColumn("left", 1 - (F.col("seen") - tree.discount * F.col("entries")) / F.col("all"))
    lower = below.select(F.col("context").alias("suffix"), "word", F.col("p").alias("under"))
    rows = counts.where(followed).join(lower, ["suffix", "word"]).join(sums, "context")
    rows = rows.withColumn("share", (n - tree.discount) / F.col("all")).withColumn("mixed", F.col("share") + F.col("left") * F.col("under"))
    rows, path = stored(rows.select("context", "word", "n", "all", "seen", "entries", "left", "under", "share", "mixed"), "entries")
    counted_gain = F.sum(n * F.log(F.col("mixed") / F.col("under")))
    rest = (F.first("all") - F.first("seen")) * F.log(F.first("left"))
    good = rows.groupBy("context").agg((counted_gain + rest > tree.min_gain * F.first("entries")).alias("kept"))
    p = F.when(F.col("kept"), F.col("mixed")).otherwise(F.col("under"))
    level, _ = stored(rows.join(good, "context").select("context", "word", "share", "left", p.alias("p"), "kept"), "level")
    drop_stored(counts.sparkSession, path)
    return level


def grow(
    blocks: DataFrame, vocabulary: DataFrame, total: int, distinct: int, tree: Tree, heavy: np.ndarray | None = None
) -> list[DataFrame]:
    """The levels above the root, of all contexts or of the ``heavy`` ones, as ``weighed`` describes them."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = code_of(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), batch.column(1)], names=["code", "c"])

    least = tree.least(total)
    words = vocabulary.where(F.col("c") >= least).select("number", "c").mapInArrow(number, "code long, c long")
    root = (F.col("c") + 1) / F.lit(float(total + distinct + 1))
    below, _ = stored(words.select(F.lit(0).cast("long").alias("context"), F.col("code").alias("word"), root.alias("p")), "root")
    frequent, levels = bitmap_of(below.select(F.col("word").alias("code"))), []
    for length in range(1, tree.depth + 1):
        if not frequent.any():
            break
        rows = counted(blocks, length, frequent, heavy).groupBy("context", "word", "suffix").agg(F.sum("n").alias("n"))
        counts, path = stored(rows.where(F.col("n") >= least), "counts")
        below = weighed(tree, counts, below)
        drop_stored(blocks.sparkSession, path)
        levels.append(below)
        if length < tree.depth:
            frequent = bitmap_of(below.select(F.col("context").bitwiseXOR(F.col("word")).alias("code")))
    return levels


def states(level: DataFrame) -> DataFrame:
    """Rows (code, value): of a kept context the mass that it leaves, of its counted words their probability."""
    kept = level.where("kept")
    contexts = kept.groupBy(F.col("context").alias("code")).agg(F.first("left").alias("value"))
    return contexts.union(kept.select(F.col("context").bitwiseXOR(F.col("word")), "p"))


def all_states(spark: SparkSession, levels: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "code long, value double")
    for level in levels:
        out = out.union(states(level))
    return stored(out, "states")[0]


def learn(spark: SparkSession, docs: DataFrame, vocabulary: DataFrame, total: int, distinct: int, tree: Tree) -> tuple:
    """Frequent words and the levels of one and two words, gathered to look into a small model."""
    vocabulary, _ = numbered(vocabulary)
    blocks, _ = stored(blocks_of(docs.select(F.lit(None).cast("long").alias("key"), F.lit(True).alias("train"), "text")), "texts")
    blocks, _ = coded(blocks, vocabulary, total, distinct, tree.least(total))
    frequent = vocabulary.where(F.col("c") >= tree.least(total)).orderBy("word").toArrow()
    words = frequent["word"].to_pylist()
    width = max(1, len(words))
    codes = code_of(frequent["number"].to_numpy())
    number = {c: i for i, c in enumerate(codes.view(np.int64).tolist())}
    place = {c: i for i, c in enumerate((FACTOR * codes).view(np.int64).tolist())}
    gathered = []
    for table in grow(blocks, vocabulary, total, distinct, tree)[:2]:
        rows = table.toArrow().to_pydict()
        named = [place[c] for c in rows["context"]]
        left = {k: x for k, x, is_kept in zip(named, rows["left"], rows["kept"]) if is_kept}
        kept = np.array(sorted(left), np.int64)
        runs = np.array([k * width + number[w] for k, w in zip(named, rows["word"])], np.int64)
        after = FACTOR * (np.array(rows["context"], np.int64).view(np.uint64) + np.array(rows["word"], np.int64).view(np.uint64))
        place = dict(zip(after.view(np.int64).tolist(), runs.tolist()))
        mine = np.array(rows["kept"], bool)
        entries = np.searchsorted(kept, np.array(named, np.int64)[mine]) * width + runs[mine] % width
        order = np.argsort(entries)
        gathered.append(Level(width, kept, np.array([left[k] for k in kept.tolist()]), entries[order], np.array(rows["share"])[mine][order]))
    return words, *gathered, *[Level(width)] * (2 - len(gathered))


def group_of(tokens: Tokens, heavy: np.ndarray, groups: int) -> np.ndarray:
    """The group of each token: that of its shortest context that is not heavy, of the token too if there is none."""
    to = np.zeros(len(tokens.ids), np.uint64)
    for at, context, _, is_heavy in tokens.contexts(heavy):
        to[at] = np.where(is_heavy, context ^ tokens.codes[tokens.ids[at]], context)
    return (code_of(to) % np.uint64(groups)).astype(np.int32)


def sent_tokens(blocks: DataFrame, depth: int, heavy: np.ndarray, groups: int) -> DataFrame:
    """Rows (part, block, words, counts, docs, columns), one for each group and block: the tokens that follow a frequent
    word.

    ``columns`` has the tokens and the words before them as places in ``words``, ``docs`` twice the place of each
    token's text in its block, and one if it is learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, of_block in groupby(pieces(batches, depth), lambda x: x.block):
            held = []
            for tokens in of_block:
                at = np.flatnonzero(tokens.before[0])
                part = group_of(tokens, heavy, groups)[at]
                at = at[np.argsort(part, kind="stable")]
                columns = [x[at] for x in (tokens.ids, *tokens.before, 2 * tokens.doc + tokens.train)]
                held.append((np.cumsum([0, *np.bincount(part, minlength=groups)]), columns))
            for k in range(groups):
                *columns, docs = [np.concatenate(x) for x in zip(*[[x[ends[k] : ends[k + 1]] for x in each] for ends, each in held])]
                if not len(docs):
                    continue
                there = np.zeros(len(tokens.codes), bool)
                for x in columns:
                    there[x] = True
                there[0] = False
                place, used = np.cumsum(there, dtype=np.uint32), np.flatnonzero(there) - 1
                place[~there] = 0
                blobs = [packed(steps(x)) for x in (tokens.numbers[used], tokens.counts[used], docs.astype(np.int64))]
                cells = [k, block, *blobs, [packed(place[x]) for x in columns]]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
    names = ["part", "block", "words", "counts", "docs", "columns"]
    return blocks.select(*TOKENS).mapInArrow(run, "part long, block long, words binary, counts binary, docs binary, columns array<binary>")


def heavy_answers(blocks: DataFrame, known_states: DataFrame, depth: int, heavy: np.ndarray, groups: int) -> DataFrame:
    """Rows (part, code, value): the states of heavy contexts that each group may need. A bitmap rules out most codes
    that are no state; it has a fixed size and only ever lets too much through."""
    sent = blocks.sparkSession.sparkContext.broadcast(bitmap_of(known_states))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in pieces(batches, depth):
            part = group_of(tokens, heavy, groups)
            for at, context, _, is_heavy in tokens.contexts(heavy):
                at, context = at[is_heavy], context[is_heavy]
                after = tokens.ids[at] > 0
                codes = np.concatenate([context, context[after] ^ tokens.codes[tokens.ids[at[after]]]])
                parts = np.concatenate([part[at], part[at[after]]])
                asked = within(sent.value, codes)
                codes, parts = codes[asked], parts[asked]
                order = np.lexsort((codes, parts))
                codes, parts = codes[order], parts[order]
                new = np.ones(len(codes), bool)
                new[1:] = (np.diff(codes) != 0) | (np.diff(parts) != 0)
                yield pa.RecordBatch.from_arrays([pa.array(parts[new], pa.int64()), pa.array(codes[new].view(np.int64))], names=["part", "code"])

    return blocks.select(*TOKENS).mapInArrow(run, "part long, code long").distinct().join(known_states, "code")


class Group:
    """The tokens of a group, block after block and text after text, and their probabilities, from those under the root
    (1 for a rare word) on."""

    def __init__(self, rows: list[dict], size: int) -> None:
        numbers = [np.cumsum(unpacked(r["words"], np.int64)) for r in rows]
        self.numbers, first = np.unique(np.concatenate(numbers), return_index=True)
        c = np.concatenate([np.cumsum(unpacked(r["counts"], np.int64)) for r in rows])[first]
        places = [np.concatenate([[0], np.searchsorted(self.numbers, x) + 1]).astype(np.uint32) for x in numbers]
        columns = zip(*[[place[unpacked(x, np.uint32)] for x in r["columns"]] for r, place in zip(rows, places)])
        self.words, *self.before = [np.concatenate(x) for x in columns]
        docs = [np.cumsum(unpacked(r["docs"], np.int64)) for r in rows]
        firsts = [np.flatnonzero(np.diff(x // 2, prepend=-1)) for x in docs]
        self.block = np.repeat([r["block"] for r in rows], [len(x) for x in firsts])
        self.doc = np.concatenate([x[at] // 2 for x, at in zip(docs, firsts)])
        self.starts = np.concatenate([at + n for at, n in zip(firsts, np.cumsum([0, *map(len, docs)]))])
        self.train = np.concatenate([x % 2 == 1 for x in docs])
        self.root = np.concatenate([[1.0], (c + 1) / size])
        self.p = self.root[self.words]

    def weigh(self, tree: Tree, least: float, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Take the tokens ``at`` from their contexts' suffixes to their contexts (places from 0), where these are kept;
        whether each context has a counted word."""
        n_contexts, width = int(context.max()) + 1, len(self.root)
        learnt = self.train[at]
        total = np.bincount(context[learnt], minlength=n_contexts)
        followed = np.flatnonzero(self.words[at])
        runs, run = np.unique((context * width + self.words[at])[followed], return_inverse=True)
        n, of, under = np.bincount(run, learnt[followed], len(runs)), runs // width, np.ones(len(runs))
        under[run] = self.p[at[followed]]
        often = n >= least
        entries = np.bincount(of[often], minlength=n_contexts)
        if not often.any():
            return entries > 0
        seen = np.bincount(of[often], n[often], n_contexts)
        left = np.where(entries > 0, 1 - (seen - tree.discount * entries) / np.maximum(total, 1), 1.0)
        share = np.where(often, (n - tree.discount) / np.maximum(total[of], 1), 0.0)
        terms = n[often] * np.log((share[often] + left[of[often]] * under[often]) / under[often])
        gain = np.bincount(of[often], terms, n_contexts) + (total - seen) * np.log(left)
        kept = (entries > 0) & (gain > tree.min_gain * entries)
        self.p[at] *= np.where(kept, left, 1.0)[context]
        self.p[at[followed]] += np.where(kept[of], share, 0.0)[run]
        return entries > 0

    def climb(self, tree: Tree, least: float, heavy: np.ndarray, codes: np.ndarray, values: np.ndarray, most: int = 1 << 19) -> None:
        """All levels of the tree; ``values`` are those of the states of heavy contexts, by rising ``codes``.

        Contexts that end in different words have nothing in common, so about ``most`` tokens are taken at a time."""
        order = np.argsort(self.before[0], kind="stable")
        ends = np.cumsum(np.bincount(self.before[0], minlength=len(self.root)))
        chunk = ends // most
        cuts = [0, *ends[np.flatnonzero(np.diff(chunk, append=chunk[-1] + 1))].tolist()]
        of_words = np.concatenate([np.zeros(1, np.uint64), code_of(self.numbers)])
        for start, end in zip(cuts, cuts[1:]):
            self.climb_from(order[start:end], tree, least, heavy, of_words, codes, values)

    def climb_from(
        self, at: np.ndarray, tree: Tree, least: float, heavy: np.ndarray, of_words: np.ndarray, codes: np.ndarray, values: np.ndarray
    ) -> None:
        def answer(asked: np.ndarray) -> np.ndarray:
            if not len(codes):
                return np.full(len(asked), np.nan)
            found = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
            return np.where(codes[found] == asked, values[found], np.nan)

        context = np.zeros(len(at), np.int64)
        code, weighty = np.zeros(len(at) if len(heavy) else 0, np.uint64), np.ones(len(at), bool) & (len(heavy) > 0)
        for word, power in zip(self.before, powers(tree.depth)):
            there = word[at] > 0
            at, context, weighty = at[there], context[there], weighty[there]
            if not len(at):
                break
            known = context * len(self.root) + word[at]
            context = np.unique(known, return_inverse=True)[1]
            if len(heavy):
                code = code[there] + power * of_words[word[at]]
                weighty &= np.isin(code, heavy)
                of_state = answer(code[weighty])
                mine, after = at[weighty], answer(code[weighty] ^ of_words[self.words[at[weighty]]])
                after = np.where(self.words[mine] > 0, after, np.nan)
                deeper = np.where(np.isnan(after), of_state * self.p[mine], after)
                self.p[mine] = np.where(np.isnan(of_state), self.p[mine], deeper)
            light = np.flatnonzero(~weighty)
            stay = weighty.copy()
            if len(light):
                stay[light] = self.weigh(tree, least, at[light], context[light])[context[light]]
            at, context, weighty = at[stay], context[stay], weighty[stay]
            code = code[stay] if len(heavy) else code

    def gains(self) -> np.ndarray:
        """By text, how much more likely (log10) its tokens are than under the root."""
        return np.add.reduceat(np.log10(self.p) - np.log10(self.root)[self.words], self.starts)


def text_gains(tokens: DataFrame, answers: DataFrame, tree: Tree, least: float, size: int, heavy: np.ndarray) -> DataFrame:
    """Rows (block, doc, gain): what the tree's contexts add to the log10 probability of each text, by group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left.to_pylist(), size)
        codes, value = right["code"].to_numpy().view(np.uint64), right["value"].to_numpy()
        order = np.argsort(codes)
        group.climb(tree, least, heavy, codes[order], value[order])
        return pa.table([pa.array(group.block), pa.array(group.doc), pa.array(group.gains())], names=["block", "doc", "gain"])

    both = tokens.groupBy("part").cogroup(answers.groupBy("part"))
    return both.applyInArrow(run, "block long, doc long, gain double")


def score(
    df: DataFrame, key: str, text: str, train: Column, tree: Tree = Tree(),
    block_bytes: int = 24 << 20, light: int = 2_000_000, group: int = 2_000_000,
) -> DataFrame:
    """Rows (key, train, n_tokens, n_known, train_tokens, base_score, score) for the rows of ``df``.

    Tokens are the words of the text, A-Z in lower case, and an end. ``train`` says which rows are
    learnt from (null: not). n_known counts the tokens seen in training, ``base_score`` is the text's
    log10 probability under the root and ``score`` under the tree. A null or empty text is its end
    alone. Keys may repeat or be null. With nothing to learn from every token has probability one.

    Texts are held together by ``block_bytes``; groups have about ``group`` tokens, and ``light`` more at most.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    with shuffle_files_freed(spark):
        blocks, blocks_path = stored(blocks_of(docs, block_bytes), "texts")
        sums = block_words(blocks).groupBy("word").agg(F.sum("n").alias("c"), F.sum("seen").alias("seen"))
        vocabulary, vocabulary_path = numbered(sums)
        total, distinct, tokens = vocabulary.agg(
            F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("seen"), F.lit(0))
        ).first()
        # By size alone: each group sends back a sum for each of its texts.
        least, groups = tree.least(total), max(1, -(-tokens // group))
        blocks, _ = coded(blocks, vocabulary, total, distinct, least)
        drop_stored(spark, blocks_path)
        heavy = heavy_contexts(blocks, vocabulary, tree.depth, least, light)
        answers = spark.createDataFrame([], "part long, code long, value double")
        if len(heavy):
            known_states = all_states(spark, grow(blocks, vocabulary, total, distinct, tree, heavy))
            answers, _ = stored(heavy_answers(blocks, known_states, tree.depth, heavy, groups), "answers")
        drop_stored(spark, vocabulary_path)
    sent = sent_tokens(blocks, tree.depth, heavy, groups)
    gains = text_gains(sent, answers, tree, least, total + distinct + 1, heavy).groupBy("block", "doc").agg(F.sum("gain").alias("gain"))
    rows = blocks.select("block", F.posexplode(F.arrays_zip("keys", "train", "n_tokens", "n_known", "base")).alias("doc", "x"))
    rows = rows.withColumn("doc", F.col("doc").cast("long")).join(gains, ["block", "doc"], "left")
    score_ = F.col("x.base") + F.coalesce("gain", F.lit(0.0))
    result = rows.select(
        F.col("x.keys").alias("key"), "x.train", "x.n_tokens", "x.n_known", F.col("x.base").alias("base_score"), score_.alias("score"),
        F.lit(total).cast("long").alias("train_tokens"),
    )
    return result.withColumnRenamed("key", key)
