"""Fill-in-middle examples: a text cut twice at unit boundaries and put together in another order.

A unit is a run of the letters A-Z and a-z, or any one other character. A text is divided into blocks of a fixed
number of UTF-8 bytes; a Fenwick tree over its blocks holds how many units and how many characters start in
each. A cut behind a number of units is found by descending the tree in steps that halve, which ends at the
block with the boundary and the characters before it; only that block is then looked into.

The cuts and the form of a row are drawn from the hash of its key, so a repeated run cuts alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parcelry.llm.common import map_columns, quoted, slices, working_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
RESULT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


@dataclass(frozen=True)
class Shares:
    """Percent of texts that are cut at all, percent of these with the suffix first, and bytes of a block."""

    cut: int = 90
    suffix_first: int = 20
    block: int = 256


class BlockTrees:
    """Fenwick trees over the blocks of some texts, one behind the other.

    ``data`` holds the texts' bytes, ``edges`` where each begins and, last, where all end. Node ``i`` of a
    text (from 1) is at ``base + i - 1`` and sums the blocks from ``i - lowest bit of i`` up to ``i``.
    """

    def __init__(self, data: np.ndarray, edges: np.ndarray, block: int):
        self.edges, self.block = edges, block
        letter = ((data | 0x20) - np.uint8(97)) < 26
        self.chars = (data & 0xC0) != 0x80
        self.units = self.chars.copy()
        self.units[1:] &= ~(letter[1:] & letter[:-1])
        lengths = np.diff(edges)
        self.units[edges[:-1][lengths > 0]] = True
        self.count = -(-lengths // block)
        self.base = np.cumsum(self.count) - self.count
        total = int(self.count.sum())
        place = np.arange(total) - np.repeat(self.base, self.count)
        starts = np.repeat(edges[:-1], self.count) + place * block
        # One more node, which no text owns, stands for "beyond the last block".
        self.unit_tree, self.char_tree = (self.tree(flags, starts, place + 1, total) for flags in (self.units, self.chars))

    def tree(self, flags: np.ndarray, starts: np.ndarray, node: np.ndarray, total: int) -> np.ndarray:
        sums = np.zeros(total + 1, np.int64)
        if total:
            sums[:total] = np.add.reduceat(flags, starts, dtype=np.int64)
        last = np.repeat(self.count, self.count)
        step = 1
        while step <= int(self.count.max(initial=0)):
            here = np.flatnonzero(((node & -node) == step) & (node + step <= last))
            np.add.at(sums, here + step, sums[here])
            step *= 2
        return sums

    def total_units(self) -> np.ndarray:
        """Units of each text: the nodes that together make up all its blocks."""
        found, at = np.zeros(len(self.count), np.int64), self.count.copy()
        while at.any():
            found += np.where(at > 0, self.unit_tree[np.where(at > 0, self.base + at - 1, -1)], 0)
            at -= at & -at
        return found

    def cuts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and character places, from the begin of each text, behind its first ``wanted`` units."""
        at, left, chars = np.zeros_like(wanted), wanted.copy(), np.zeros_like(wanted)
        step = 1 << int(self.count.max(initial=0)).bit_length()
        while step:
            inside = at + step <= self.count
            node = np.where(inside, self.base + at + step - 1, -1)
            whole = inside & (self.unit_tree[node] <= left)
            left -= np.where(whole, self.unit_tree[node], 0)
            chars += np.where(whole, self.char_tree[node], 0)
            at += np.where(whole, step, 0)
            step >>= 1
        places = np.minimum(at * self.block, np.diff(self.edges))
        for i in np.flatnonzero(at < self.count):
            low = self.edges[i] + at[i] * self.block
            high = min(low + self.block, self.edges[i + 1])
            inner = int(np.flatnonzero(self.units[low:high])[left[i]])
            chars[i] += np.count_nonzero(self.chars[low : low + inner])
            places[i] += inner
        return places, chars


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of some texts (null: none) one after the other, and where each begins."""
    plain = pc.fill_null(texts.cast(pa.binary()), b"")
    edges = np.concatenate([[0], np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64))])
    return np.frombuffer(b"".join(plain.to_pylist()), np.uint8), edges


def transformed(texts: pa.Array, draws: np.ndarray, shares: Shares) -> pa.Array:
    """``RESULT`` of each text, given its four draws (a row each)."""
    data, edges = bytes_of(texts)
    trees = BlockTrees(data, edges, shares.block)
    n = trees.total_units()
    first, second = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    (a, chars_a), (b, chars_b) = trees.cuts(np.minimum(first, second)), trees.cuts(np.maximum(first, second))
    forms, outputs, raw = [], [], data.tobytes()
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    for i in range(len(n)):
        text = raw[edges[i] : edges[i + 1]]
        if not text or draws[i, 2] % 100 >= shares.cut or any(m in text for m in marks):
            forms.append("plain")
            outputs.append(text)
            continue
        prefix, middle, suffix = text[: a[i]], text[a[i] : b[i]], text[b[i] :]
        if draws[i, 3] % 100 < shares.suffix_first:
            forms.append("spm")
            outputs.append(b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle]))
        else:
            forms.append("psm")
            outputs.append(b"".join([marks[0], prefix, marks[1], suffix, marks[2], middle]))
    plain = np.array(forms) == "plain"
    columns = [
        pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(chars_a, pa.int64(), mask=plain),
        pa.array(chars_b - chars_a, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def draws_of(key: Column, seed: int) -> Column:
    """Four draws from 0 to 2**32 - 1: the first eight-digit groups of the hex SHA-256 of ``seed:key`` (null: no digits)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(named.cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(df: DataFrame, key: str, text: str, name: str = "fim", seed: int = 1, shares: Shares = Shares()) -> DataFrame:
    """The rows of ``df`` with a struct ``name``: units n, form, characters of prefix and middle, and the output.

    The prefix ends behind the smaller of two drawn numbers of units, the middle behind the larger. Form
    ``psm`` is the marked prefix, suffix and middle, ``spm`` has the suffix first, ``plain`` is the text as it is: for
    the share of rows that is not cut, for empty texts and for texts that contain a mark themselves. A
    null text counts as empty and gives an empty output; a null key is drawn for like a key without
    digits; rows of one key are cut alike as far as their texts are equal. Whole texts are cut, however
    long. Other columns are kept, whatever their names; one called ``name`` is replaced.
    """
    kept = [c for c in df.columns if c.lower() != name.lower()]
    (draws,) = working_name(df.select(*[quoted(c) for c in kept]), "_draws")
    prepared = df.select(*[quoted(c) for c in kept], draws_of(quoted(key), seed).alias(draws))

    def run(batches: Iterator[pa.RecordBatch], of_text: int, of_draws: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in slices(batches, of_text):
            drawn = batch.column(of_draws).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            yield batch, transformed(batch.column(of_text), drawn, shares)

    return map_columns(prepared, run, [text, draws], name, RESULT).drop(draws)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No mark occurs in a text that was cut, and none can arise
    where a part meets a mark, so the marks found are those put in."""
    parts = F.split(output, MARK, -1)
    suffix_first = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    prefix_first = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    return F.when(form == "plain", output).when(form == "spm", suffix_first).otherwise(prefix_first)


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), counted AS (
  SELECT *, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn
), cut AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM counted
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""
