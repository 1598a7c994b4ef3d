"""Language of texts by the nearest of several centroids for each language.

A text is a vector over hashed n-grams of one to three characters (letters in lower case, anything else a
gap; an n-gram lies in one word and may hold the gap before or behind it): the logarithm of its counts times the
inverse document frequency, over all training texts, of unit length. For each language the vectors of a bounded
sample of its training texts are clustered by cosine; a text gets the language of the centroid with the
largest cosine. A centroid's radius is a high quantile of the distances of its own texts; a text farther away is
marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelry.llm.common import map_columns, quoted, slices, worker_state, working_name

UNKNOWN = "und"
GAP = 32
RESULT = "struct<lang:string,score:double,rejected:boolean>"


@dataclass(frozen=True)
class Model:
    """Places of hashed n-grams (a power of two, as bits), training texts of a language that its centroids are fitted
    on (a bound; counts of n-grams are over all), centroids of a language, the least share of these texts
    that a centroid stands for, rounds of clustering, quantile of the distances that is a centroid's radius,
    and the largest size of all centroids."""

    bits: int = 14
    sample: int = 1000
    centroids: int = 4
    least_share: float = 0.05
    rounds: int = 8
    radius: float = 0.995
    most_bytes: int = 512 << 20

    @property
    def places(self) -> int:
        return 1 << self.bits


def letter_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, the gap if not."""
    return np.array([ord(low[0]) if (low := chr(i).lower()) and chr(i).isalpha() else GAP for i in range(0x110000)], np.uint32)


def pieces(texts: list[str | None], size: int = 1 << 18) -> Iterator[tuple[int, str, bool, bool]]:
    """(number of the text, up to ``size`` characters with one on either side, whether it is the text's begin and end)."""
    for number, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), size):
            yield number, text[max(at - 1, 0) : at + size + 1], at == 0, at + size >= len(text)


def counts_of(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams at each place, a row for each text, and which texts have a letter."""
    table = worker_state("letters", letter_table)
    out, lettered = np.zeros((len(texts), 1 << bits), np.float32), np.zeros(len(texts), bool)
    for number, piece, begins, ends in pieces(texts):
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = table[points].astype(np.uint64)
        # Every letter with its neighbours; those put around a piece only ever are neighbours.
        codes = np.concatenate([[np.uint64(GAP)] * begins, codes, [np.uint64(GAP)] * ends]).astype(np.uint64)
        if len(codes) < 3:
            continue
        before, here, after = codes[:-2], codes[1:-1], codes[2:]
        is_letter = here != GAP
        before, here, after = before[is_letter], here[is_letter], after[is_letter]
        lettered[number] |= len(here) > 0
        one = here * np.uint64(0x9E3779B97F4A7C15)
        pair = (one ^ (after + np.uint64(0x51))) * np.uint64(0xD6E8FEB86659FD93)
        first = (here ^ np.uint64(GAP << 32)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)
        triple = (pair ^ (before + np.uint64(0xA3))) * np.uint64(0xC2B2AE3D27D4EB4F)
        for grams in (one, pair, triple, first[before == GAP]):
            mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            out[number] += np.bincount((mixed >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return out, lettered


def vectors_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of counts (a row of zeros stays one)."""
    found = np.log1p(counts) * idf
    length = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return found / np.where(length > 0, length, 1)


def groups_of(batches: Iterator[pa.RecordBatch], column: int, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as each becomes a dense vector."""
    for batch in slices(batches, column):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def document_frequency(texts: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` each place has an n-gram, and how many have any; added up by task and then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(model.places, np.int64), 0
        for batch in groups_of(batches, 0):
            counts, lettered = counts_of(batch.column(0).to_pylist(), model.bits)
            held += (counts > 0).sum(axis=0)
            total += int(lettered.sum())
        if total:
            place = np.append(np.flatnonzero(held), -1)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(held[place[:-1]], total))], names=["place", "n"])

    # One row for each place at most, whatever the number of texts.
    rows = texts.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["place"].to_pylist(), rows["n"].to_pylist()))
    out = np.zeros(model.places, np.int64)
    for place, n in found.items():
        if place >= 0:
            out[place] = n
    return out, found.get(-1, 0)


def spherical_means(vectors: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors by cosine and their radii; ones that stand for few vectors are given up."""
    chosen = [vectors.mean(axis=0)]
    while len(chosen) < min(model.centroids, len(vectors)):
        near = (vectors @ np.stack(chosen).T).max(axis=1)
        chosen.append(vectors[np.argsort(near, kind="stable")[len(near) // 10]])  # far, yet no outlier
    centroids = unit(np.stack(chosen))
    for _ in range(model.rounds):
        owner = (vectors @ centroids.T).argmax(axis=1)
        held = np.bincount(owner, minlength=len(centroids))
        left = np.flatnonzero(held >= max(1, model.least_share * len(vectors)))
        centroids = unit(np.stack([vectors[owner == j].mean(axis=0) for j in left]))
    near = vectors @ centroids.T
    owner, radius = near.argmax(axis=1), np.zeros(len(centroids))
    for j in range(len(centroids)):
        mine = 1 - near[owner == j, j]
        radius[j] = np.quantile(mine, model.radius) if len(mine) else 0.0
    return centroids, radius


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class Fitted:
    """Weights of the places, and the centroids (rows) with their languages and radii."""

    bits: int
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    radii: np.ndarray

    def judge(self, texts: list[str | None]) -> list[dict]:
        counts, lettered = counts_of(texts, self.bits)
        if not self.languages:
            return [{"lang": UNKNOWN, "score": 0.0, "rejected": True}] * len(texts)
        near = vectors_of(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        out = []
        for i, j in enumerate(best.tolist()):
            score = min(1.0, max(0.0, float(near[i, j]))) if lettered[i] else 0.0
            lang = self.languages[j] if lettered[i] else UNKNOWN
            out.append({"lang": lang, "score": score, "rejected": not lettered[i] or 1 - score > self.radii[j]})
        return out


def fit(df: DataFrame, text: str, lang: str, key: str, model: Model = Model()) -> Fitted:
    """Weights and centroids from the rows of ``df`` with a language and a text.

    The weights are over all rows. The centroids of a language are fitted on about ``sample`` of its
    rows, chosen by the hash of key and text, and on all if there are no more. Languages are ordered by name, so
    that equal cosines go to the first. Centroids that are together larger than ``most_bytes`` (2,000 languages by
    default) are an error.
    """
    rows = df.select(quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"), F.xxhash64(quoted(key), quoted(text)).alias("h"))
    rows = rows.where("text is not null and lang is not null")
    most = model.most_bytes // (4 * model.places * model.centroids)
    per_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    if len(per_language) > most:
        raise ValueError(f"more than {most} languages: centroids would take more than {model.most_bytes} bytes")
    frequency, total = document_frequency(rows.select("text"), model)
    idf = (np.log((total + 1) / (frequency + 1)) + 1).astype(np.float32)
    shares = {k: min(1.0, model.sample / n) for k, n in per_language.items()}
    if not shares:
        return Fitted(model.bits, idf, [], np.zeros((0, model.places), np.float32), np.zeros(0))
    wanted: Column = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    chosen = rows.where(F.pmod(F.col("h"), F.lit(1 << 32)) < wanted * float(1 << 32))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Language, hash and the vector as places and weights."""
        for batch in groups_of(batches, 0):
            counts, lettered = counts_of(batch.column(0).to_pylist(), model.bits)
            found = [(i, np.flatnonzero(v).astype("<i4"), v) for i, v in enumerate(vectors_of(counts, idf)) if lettered[i]]
            at = pa.array([i for i, _, _ in found], pa.int64())
            columns = [
                batch.column(1).take(at), batch.column(2).take(at), pa.array([p.tobytes() for _, p, _ in found], pa.binary()),
                pa.array([v[p].astype("<f4").tobytes() for _, p, v in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "h", "places", "weights"])

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("weights", "ascending")])
        vectors = np.zeros((table.num_rows, model.places), np.float32)
        for i, (places, weights) in enumerate(zip(table["places"].to_pylist(), table["weights"].to_pylist())):
            vectors[i, np.frombuffer(places, "<i4")] = np.frombuffer(weights, "<f4")
        centroids, radii = spherical_means(vectors, model)
        content = pa.array([c.astype("<f4").tobytes() for c in centroids], pa.binary())
        return pa.table([pa.array([table["lang"][0].as_py()] * len(radii)), pa.array(range(len(radii)), pa.int32()), content, pa.array(radii)], names=["lang", "j", "centroid", "radius"])

    vectors = chosen.mapInArrow(sparse, "lang string, h long, places binary, weights binary")
    fitted = vectors.groupBy("lang").applyInArrow(cluster, "lang string, j int, centroid binary, radius double").collect()
    fitted.sort(key=lambda r: (r["lang"], r["j"]))
    centroids = [np.frombuffer(r["centroid"], "<f4") for r in fitted]
    stacked = np.stack(centroids) if centroids else np.zeros((0, model.places), np.float32)
    return Fitted(model.bits, idf, [r["lang"] for r in fitted], stacked, np.array([r["radius"] for r in fitted]))


def identify(df: DataFrame, text: str, fitted: Fitted, name: str = "language") -> DataFrame:
    """The rows of ``df`` with a struct ``name``: lang, score (cosine of the nearest centroid, 0 to 1) and rejected.

    The language of a text that is null or has no letter is ``und``, with score 0; so is that of every
    text if nothing was learnt. A text that is farther from its centroid than nearly all
    that the centroid was fitted on is rejected: its nearest language is still given. Whole texts are
    read, however long; rows may repeat; other columns are kept, one called ``name`` is replaced.
    """
    kept = [c for c in df.columns if c.lower() != name.lower()]
    rows = df.select(*[quoted(c) for c in kept])
    sent = df.sparkSession.sparkContext.broadcast(fitted)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in groups_of(batches, at):
            yield batch, pa.array(sent.value.judge(batch.column(at).to_pylist()), kind)

    return map_columns(rows, run, [text], name, RESULT)
