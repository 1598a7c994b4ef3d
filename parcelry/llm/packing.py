"""Vector bin packing of examples into training sequences.

Every piece of an example is a vector of tokens, segments (one) and loss-bearing tokens, and a
sequence has a limit on each. Among the open sequences with room in all three, a piece goes where
the dot product of piece and room, both as shares of the limits, is largest. A piece that fits none
is cut so that it fills the one with most room. Each task packs its own rows as they come, with a bounded
number of open sequences; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelry.llm.common import slices
from parcelry.llm.encoding import encoder


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how many sequences a task keeps open."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    open_sequences: int = 64


PIECE = "start long, length long, ids binary, example_tokens long, loss_tokens long, sequence_id long, segment int, offset long"


class Packer:
    """Packs examples (key, ids, loss flags) and hands out finished sequences as piece rows."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.next = limits, first_sequence
        self.most = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.room = np.zeros((limits.open_sequences, 3), np.int64)
        self.held: list[list] = [[] for _ in range(limits.open_sequences)]
        self.done: list[tuple] = []

    def add(self, examples: list[tuple]) -> None:
        """Pack a group of examples, the largest remainders first."""
        rest = []
        for key, ids, loss in examples:
            at, total = 0, len(ids)
            while total - at >= self.limits.tokens:
                size = self.cut(loss, at, total, np.array([self.limits.tokens, 1, self.limits.loss]))
                piece = self.piece(key, ids, loss, at, size)
                if size == self.limits.tokens:
                    self.close([piece])
                else:
                    rest.append(piece)
                at += size
            if at < total:
                rest.append(self.piece(key, ids, loss, at, total - at))
        rest.sort(key=lambda p: -(p[1] / self.most).sum())
        for piece in rest:
            self.place(piece)

    def piece(self, key, ids, loss, at: int, size: int) -> tuple:
        bearing = size if loss is None else int(np.count_nonzero(loss[at : at + size]))
        return (key, np.array([size, 1, bearing], np.int64), ids, loss, at)

    def cut(self, loss, at: int, total: int, room: np.ndarray) -> int:
        """Most tokens from ``at`` that the room takes."""
        size = int(min(total - at, room[0]))
        if loss is None:
            return min(size, int(room[2]))
        bearing = np.cumsum(loss[at : at + size] != 0)
        return int(np.searchsorted(bearing, room[2], side="right"))

    def place(self, piece: tuple) -> None:
        while piece is not None:
            key, vector, ids, loss, at = piece
            fits = (self.room >= vector).all(axis=1) & (self.room[:, 1] > 0)
            # The last segment of a sequence is for a piece that fills it, cut to size if need be.
            fits &= (self.room[:, 1] > 1) | (self.room[:, 0] == vector[0])
            if fits.any():
                score = np.where(fits, (self.room / self.most) @ (vector / self.most), -1.0)
                self.put(int(score.argmax()), piece)
                return
            empty = next((i for i, held in enumerate(self.held) if not held), None)
            if empty is not None:
                self.room[empty] = self.most
                if (vector <= self.room[empty]).all():
                    self.put(empty, piece)
                    return
                target = empty
            else:
                # Best one that the piece can fill; else the fullest gives up its last segment.
                fillable = (self.room[:, 1] > 0) & (self.room[:, 0] <= vector[0])
                if fillable.any():
                    target = int(np.where(fillable, self.room[:, 0], -1).argmax())
                else:
                    self.finish(int(np.where(self.room[:, 1] > 0, self.room[:, 0], self.limits.tokens + 1).argmin()))
                    continue
            size = self.cut(loss, at, at + int(vector[0]), self.room[target])
            if size <= 0 or self.room[target, 1] <= 0:
                self.finish(target)
                continue
            self.put(target, self.piece(key, ids, loss, at, size))
            self.finish(target)
            left = int(vector[0]) - size
            piece = self.piece(key, ids, loss, at + size, left) if left else None

    def put(self, target: int, piece: tuple) -> None:
        self.held[target].append(piece)
        self.room[target] -= piece[1]
        if not self.room[target, :2].all():
            self.finish(target)

    def finish(self, target: int) -> None:
        self.close(self.held[target])
        self.held[target], self.room[target] = [], 0

    def close(self, pieces: list[tuple]) -> None:
        if not pieces:
            return
        offset = 0
        for segment, (key, vector, ids, _, at) in enumerate(pieces):
            size = int(vector[0])
            content = ids[at : at + size].astype("<u4").tobytes()
            self.done.append((key, at, size, content, len(ids), int(vector[2]), self.next, segment, offset))
            offset += size
        self.next += 1

    def flush(self) -> None:
        """Refill what is still open, piece after piece, and cut the tail at powers of two."""
        pieces = [p for held in self.held for p in held]
        self.held = [[] for _ in self.held]
        self.room[:] = 0
        sequence, room = [], self.most.astype(np.int64)
        for key, vector, ids, loss, at in pieces:
            end = at + int(vector[0])
            while at < end:
                size = self.cut(loss, at, end, room) if room[1] > 0 else 0
                if size:
                    piece = self.piece(key, ids, loss, at, size)
                    sequence.append(piece)
                    room = room - piece[1]
                    at += size
                if at < end or room[0] == 0:
                    self.close(sequence)
                    sequence, room = [], self.most.astype(np.int64)
        left = sum(int(p[1][0]) for p in sequence)
        while left:
            want, part = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                key, vector, ids, loss, at = sequence.pop(0)
                size = min(want, int(vector[0]))
                part.append(self.piece(key, ids, loss, at, size))
                want -= size
                if size < vector[0]:
                    sequence.insert(0, self.piece(key, ids, loss, at + size, int(vector[0]) - size))
            self.close(part)

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pieces_schema(key_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("key", key_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
            ("example_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()),
            ("segment", pa.int32()), ("offset", pa.int64()),
        ]
    )


def packed(groups: Iterator[tuple[list[tuple], pa.DataType]], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Piece rows of the examples of one task."""
    from pyspark import TaskContext

    packer, kind = Packer(limits, TaskContext.get().partitionId() << 40), None
    for examples, kind in groups:
        packer.add(examples)
        yield from rows(packer, kind)
    packer.flush()
    if kind is not None:
        yield from rows(packer, kind)


def rows(packer: Packer, kind: pa.DataType, at_most: int = 4096) -> Iterator[pa.RecordBatch]:
    done, schema = packer.take(), pieces_schema(kind)
    for i in range(0, len(done), at_most):
        columns = zip(*done[i : i + at_most])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack_examples(df: DataFrame, key: str, ids: str, loss: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Pack examples that are already encoded.

    ``ids`` is binary, little-endian unsigned 32-bit; ``loss`` is binary with a byte for each token,
    not zero where the token bears loss (null or no column: all do; of another length: an error).
    Returns ``key`` and, for each piece, its start in the example, length, ids, the example's tokens,
    the piece's loss-bearing tokens, sequence, place among the sequence's pieces and offset there.
    Sequences are numbered by task and hold no more than the limits. A null or empty example has no
    token and so no piece. Keys may be null or repeat: rows are packed one by one.
    """
    chosen = df.select(key, ids, *([loss] if loss else []))
    kind = chosen.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            for batch in slices(batches, batch_ids):
                keys, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                flags = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(keys)
                examples = []
                for k, content, flag in zip(keys, contents, flags):
                    tokens = np.frombuffer(content or b"", "<u4")
                    mask = None if flag is None else np.frombuffer(flag, np.uint8)
                    if mask is not None and len(mask) != len(tokens):
                        raise ValueError(f"example {k!r}: {len(mask)} loss flags for {len(tokens)} tokens")
                    examples.append((k, tokens, mask))
                yield examples, batch.schema.field(0).type

        return packed(groups(), limits)

    batch_ids = ids
    return chosen.mapInArrow(run, f"key {kind}, {PIECE}").withColumnRenamed("key", key)


def pack_texts(
    df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, spaced: bool = False, limits: Limits = Limits()
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and pack them; every token bears loss.

    Returns the rows of ``pack_examples``. A null or empty text is the end id alone; a text longer
    than a sequence is cut into several pieces; repeated rows are packed as often as they occur.
    """
    chosen = df.select(key, text)
    kind = chosen.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer, spaced), np.array([end_id], np.uint32)

        def groups():
            for batch in slices(batches, text, 4 << 20):
                found = known.encode(batch.column(1))
                keys = batch.column(0).to_pylist()
                yield [(k, np.concatenate([i, end]), None) for k, i in zip(keys, found)], batch.schema.field(0).type
            known.forget()  # the worker outlives the task

        return packed(groups(), limits)

    return chosen.mapInArrow(run, f"key {kind}, {PIECE}").withColumnRenamed("key", key)
