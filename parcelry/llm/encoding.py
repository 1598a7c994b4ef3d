"""Token ids of whole texts, by a public tokenizer that is loaded once in each worker.

Both tokenizers cut a text at white space, and between words and punctuation, before any merge. The ids
of a text so are the ids of its pieces, cut at some of these places, one after the other. A piece that a
worker knows is not encoded again; when these become too many, the half that was met most often stays.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parcelry.llm.common import worker_state

#: Unicode white space as the tokenizers' own patterns see it.
WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: A space that a byte-level tokenizer does not simply give to the word behind it.
LOOSE_SPACE = f"^ | $| [{WHITE}]|[{WHITE}] "
#: What a byte may be: part of a word, a mark that ends one, any visible ASCII character.
WORD, POINT, PLAIN = 1, 2, 4


def kinds() -> np.ndarray:
    found = np.zeros(256, np.uint8)
    for byte in range(33, 127):
        found[byte] = PLAIN | (WORD if chr(byte).isalnum() else POINT)
    return found


KINDS = kinds()


def cut_at_words(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pieces begin: at every space, at marks behind a word, before and behind a single line
    break between visible characters, and where a text begins. ``edges`` are the texts' begins and the end."""
    kind = KINDS[data]
    cut = data == 32
    cut[1:] |= ((kind[1:] & POINT) != 0) & ((kind[:-1] & WORD) != 0)
    own = edges[:-1][np.diff(edges) > 0]
    plain = (kind & PLAIN) != 0
    breaks = np.flatnonzero((data[1:-1] == 10) & plain[:-2] & plain[2:]) + 1
    inner = np.ones(len(data) + 1, bool)
    inner[edges] = False
    breaks = breaks[inner[breaks] & inner[breaks + 1]]
    cut[breaks] = cut[breaks + 1] = cut[own] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes arrays of texts as the library does with ``add_special_tokens=False``.

    ``spaced`` says that a space belongs to the word behind it (byte-level tokenizers) rather than
    being dropped. A text that has the string of a special token is encoded whole. ``max_pieces`` and
    ``max_chars`` bound the memory of known pieces.
    """

    def __init__(self, path: str, spaced: bool, max_pieces: int = 600_000, max_chars: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.max_pieces, self.max_chars = spaced, max_pieces, max_chars
        self.folded = self.ids("A") == self.ids("a")
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # In a byte-level vocabulary every character of a token stands for a byte.
        size = self.tokenizer.get_vocab_size() if spaced else 0
        self.bytes = np.fromiter((len(self.tokenizer.id_to_token(i) or "") for i in range(size)), np.int64, size)
        self.forget()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.used = 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        #: Of each piece by its number: where its ids start, how many they are, how often it was met.
        self.starts, self.sizes, self.times = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def thin(self) -> None:
        """Keep the pieces met most often, half as many and as long as may be known, and halve their counts."""
        names = list(self.number)
        kept = np.argsort(-self.times[: len(names)], kind="stable")[: self.max_pieces // 2]
        chars = np.cumsum([len(names[i]) for i in kept], dtype=np.int64)
        kept = kept[chars <= self.max_chars // 2]
        times = self.times[kept] // 2
        ids, sizes = self.ids_of(kept)
        self.number, self.chars, self.used = {}, 0, 0
        self.add([names[i] for i in kept], ids, sizes)
        self.times[: len(kept)], self.times[len(kept) :] = times, 0

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        low, total = len(self.number), len(ids)
        high = low + len(pieces)
        self.flat = grown(self.flat, self.used + total)
        self.starts, self.sizes, self.times = grown(self.starts, high), grown(self.sizes, high), grown(self.times, high)
        self.flat[self.used : self.used + total] = ids
        self.sizes[low:high] = sizes
        self.starts[low:high] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.number.update(zip(pieces, range(low, high)))
        self.chars += sum(map(len, pieces))

    def learn(self, fresh: list[str], together: int = 200, at_once: int = 8000) -> None:
        """Encode new pieces; of those that can stand in one text many are joined, and a token belongs to
        the piece that it starts in."""
        alone = [p for p in fresh if self.spaced and p[0] != " "]
        joined = [p for p in fresh if p[0] == " "] if self.spaced else fresh
        for at in range(0, len(alone), at_once):
            part = alone[at : at + at_once]
            found = [f.ids for f in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self.add(part, flat_ids(found), np.fromiter(map(len, found), np.int64, len(found)))
        for at in range(0, len(joined), at_once):
            pieces = joined[at : at + at_once]
            parts = [pieces[i : i + together] for i in range(0, len(pieces), together)]
            if self.spaced:
                found = self.tokenizer.encode_batch_fast(list(map("".join, parts)), add_special_tokens=False)
                ids = flat_ids([f.ids for f in found])
                ends = np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy(), dtype=np.int64)
                self.add(pieces, ids, np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), ends, side="right"), prepend=0))
            else:
                for part, found in zip(parts, self.tokenizer.encode_batch(list(map(" ".join, parts)), add_special_tokens=False)):
                    ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
                    begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
                    sizes = np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(part))
                    self.add(part, flat_ids([found.ids]), sizes)

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Number of each piece, new ones learnt first."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(found < 0).tolist()
        if fresh:
            # In the order in which they are learnt, which is that of their numbers.
            if self.spaced:
                fresh.sort(key=lambda i: names[i][0] == " ")
            found[fresh] = len(self.number) + np.arange(len(fresh))
            self.learn([names[i] for i in fresh])
        indices = coded.indices.to_numpy()
        self.times[found] += np.bincount(indices, minlength=len(found))
        return found[indices]

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        if not len(numbers):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        known = len(self.number)
        offsets = 4 * np.append(self.starts[:known], self.used)
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), known, [None, pa.py_buffer(offsets), pa.py_buffer(self.flat)])
        taken = held.take(pa.array(numbers))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(numbers) + 1] // 4
        ids = np.frombuffer(taken.buffers()[2], np.uint32) if ends[-1] else np.zeros(0, np.uint32)
        return ids[: ends[-1]], np.diff(ends)

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Texts that cannot be cut at spaces: with the string of a special token, or with loose spaces."""
        found = pa.array(np.zeros(len(texts), bool))
        lower = pc.utf8_lower(texts)
        for content in self.special:
            found = pc.or_(found, pc.match_substring(lower, content))
        if self.spaced:
            found = pc.or_(found, pc.match_substring_regex(texts, LOOSE_SPACE))
        return found.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        if len(self.number) > self.max_pieces or self.chars > self.max_chars:
            self.thin()
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.string()), "")
        alone = self.whole(texts)
        cut = pc.if_else(pa.array(alone), "", texts)
        cut = pc.ascii_lower(cut) if self.folded else cut
        edges = np.concatenate([[0], np.cumsum(pc.binary_length(cut).to_numpy(), dtype=np.int64)])
        content = pa.py_buffer(b"".join(cut.cast(pa.binary()).to_pylist()))
        begins = cut_at_words(np.frombuffer(content, np.uint8), edges) if len(content) else np.zeros(0, np.int64)
        offsets = pa.py_buffer(np.append(begins, edges[-1]).astype(np.int32))
        numbers = self.numbers(pa.StringArray.from_buffers(len(begins), offsets, content))
        flat, sizes = self.ids_of(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, edges[1:])]
        found = np.split(flat, ends[:-1])
        for i in np.flatnonzero(alone):
            found[i] = np.array(self.ids(texts[i].as_py()), np.uint32)
        return found


def flat_ids(parts: list[list[int]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *[np.array(ids, np.uint32) for ids in parts]])


def grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    more = np.zeros(max(size, 2 * len(array)), array.dtype)
    more[: len(array)] = array
    return more


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for this vocabulary."""
    return worker_state(f"encoder {path}", lambda: Encoder(path, spaced))
