"""Fill-in-middle, centroid clustering and language identification against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelry.llm import centroid_clusters, fill_in_middle, language_id
from parcelry.llm.centroid_clusters import Means
from parcelry.llm.fill_in_middle import Shares

SF = "/root/testdata/sf0.01"
UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def cut_plainly(key, text, shares=Shares()):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNITS.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= shares.cut:
        return len(units), "plain", None, None, text
    if h[3] % 100 < shares.suffix_first:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 3, 256])
def test_cuts_equal_those_of_a_plain_scan(spark, block):
    texts = [None, "", "a", "  ", "abc", "é", "日本語 x", "a<P>b", "a<M", "<<S", "Ab1 cd\n\r\nEf", "\U0001f600x\U0001f600", "x" * 5000, "ab, " * 40_000, "ß" * 3000]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(None, "one two three"), (None, "one two three"), (0, "again a key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shares = Shares(block=block)
    made = fill_in_middle.fill_in_middle(df, "doc_id", "text", shares=shares).withColumn(
        "back", fill_in_middle.restored(F.col("fim.output"), F.col("fim.form"))
    )
    found = sorted(((r.doc_id, r.text, *r.fim, r.back) for r in made.collect()), key=repr)
    assert found == sorted(((k, t, *cut_plainly(k, t, shares), t or "") for k, t in rows), key=repr)
    assert {f[3] for f in found} == {"plain", "psm", "spm"}


def test_cuts_keep_columns_of_any_name_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "kept", 5, 6)], "key long, `a.text` string, _draws string, c0 int, FIM int")
    row = fill_in_middle.fill_in_middle(df, "key", "a.text").collect()[0]
    assert (row["_draws"], row["c0"], row["fim"]["n"]) == ("kept", 5, 3) and "FIM" not in row.asDict()
    assert fill_in_middle.fill_in_middle(df.limit(0), "key", "a.text").count() == 0


def means_plainly(rows, means):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == means.dims and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((key, [int(np.floor(float(np.float32(x)) * means.scale)) for x in vector]))
    named = lambda k: hashlib.sha256(f"{means.seed}:{'' if k is None else k}".encode()).hexdigest()
    centroids = [p for _, p in sorted(kept, key=lambda r: (named(r[0]), r[1]))[: means.clusters]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centroids))

    for _ in range(means.rounds):
        owners = [nearest(p)[1] for _, p in kept]
        for j in range(len(centroids)):
            mine = [p for (_, p), o in zip(kept, owners) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [nearest(p) for _, p in kept]
    total = sum(d for d, _ in final)
    within = lambda j: sum(d for d, i in final if i == j)
    hashed = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((k, j, d, within(j), total, hashed(j)) for (k, _), (d, j) in zip(kept, final)), key=repr)


def clusters_of(df, means):
    found = centroid_clusters.clustered(df, "vec_id", "embedding", means).collect()
    return sorted((tuple(r)[:6] for r in found), key=repr), sum(r.evaluated for r in found)


def test_clusters_equal_those_of_plain_rounds(spark):
    random, means = np.random.default_rng(3), Means(clusters=5, rounds=4, dims=3, scale=8)
    # Rounded points have many ties and repeats.
    points = [np.round(random.normal(c, 0.6, 3) * 4) / 4 for c in (0, 0, 2, 5) for _ in range(60)]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (900, None), (901, []), (902, [1.0, None, 2.0])]
    rows += [(903, [1.0, float("nan"), 2.0]), (904, [float("-inf"), 1.0, 2.0]), (905, [1.0, 2.0]), (906, [-3.0, -0.01, -9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found, evaluated = clusters_of(df, means)
    assert found == means_plainly(rows, means)
    assert evaluated < len(found) * means.clusters * (means.rounds + 1)


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("clash")).withColumn("cluster", F.lit(9))
    means = Means(clusters=16, rounds=3, dims=2)
    assert clusters_of(df, means)[0] == means_plainly(rows, means)
    assert clusters_of(df.limit(0), means) == ([], 0)
    with pytest.raises(Exception, match="too large"):
        clusters_of(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<float>"), means)


def test_bounds_hold_in_every_round_and_spare_distances():
    random = np.random.default_rng(5)
    points = random.integers(-60, 60, (400, 8)) + np.repeat(np.arange(4), 100)[:, None] * 40
    history = [points[random.choice(400, 6, replace=False)].astype(np.int64)]
    bounds, spared = centroid_clusters.Bounds.none(400, 6), []
    for _ in range(12):
        count = centroid_clusters.assign(points.astype(np.int64), bounds, history)
        exact = ((points[:, None].astype(np.int64) - history[-1][None]) ** 2).sum(axis=2)
        assert (bounds.cluster == exact.argmin(axis=1)).all()
        drift = centroid_clusters.drifts(history)
        assert (bounds.lower - drift[bounds.lower_round, np.arange(6)] <= np.sqrt(exact)).all()
        spared.append(int(count.sum()))
        moved = [points[bounds.cluster == j].sum(axis=0) // max(1, (bounds.cluster == j).sum()) for j in range(6)]
        history.append(np.array([m if (bounds.cluster == j).any() else history[-1][j] for j, m in enumerate(moved)], np.int64))
    assert spared[0] == 2400 and spared[-1] < 600
    # One bound over all displacement is never looser than one over summed moves.
    moves = sum(np.sqrt(((b - a) ** 2).sum(axis=1)) for a, b in zip(history, history[1:]))
    assert (centroid_clusters.drifts(history)[0] <= moves + 1e-6).all()


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    fitted = language_id.fit(docs.where(~held_out), "text", "lang", "doc_id")
    found = language_id.identify(docs, "text", fitted).select("doc_id", "lang", "language.*", held_out.alias("out")).toDF(
        "doc_id", "truth", "lang", "score", "rejected", "out"
    ).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    tested = [r for r in found if r.out]
    assert sum(r.truth == r.lang for r in tested) >= 0.99 * len(tested)
    assert sum(r.rejected for r in tested) <= 0.05 * len(tested)


def test_language_frequencies_cover_all_texts_and_only_the_sample_is_bounded(spark):
    rows = [(i, "la maison est belle", "fr") for i in range(300)] + [(1000 + i, "the house is nice", "en") for i in range(5)]
    df = spark.createDataFrame(rows, "k long, t string, l string").repartition(4)
    frequency, total = language_id.document_frequency(df.select("t"), language_id.Model(bits=10))
    assert total == 305 and frequency.max() == 305
    fitted = language_id.fit(df, "t", "l", "k", language_id.Model(bits=10, sample=20))
    assert set(fitted.languages) == {"en", "fr"}
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(df, "t", "l", "k", language_id.Model(bits=10, most_bytes=4 << 12))


def test_languages_of_odd_rows(spark):
    rows = [(1, "the house is nice", "en"), (2, "das Haus ist schön", "de"), (3, None, "en"), (4, "", None), (5, "12 3!", "de"), (6, "ein Haus", None)]
    rows += [(7, "das schöne Haus " * 40_000, None), (7, "THE NICE HOUSE", None), (None, "x", None), (8, "日本語日本語", None)]
    df = spark.createDataFrame(rows, "k long, t string, l string").withColumn("c0", F.lit(1)).withColumn("LANGUAGE", F.lit(2))
    fitted = language_id.fit(df, "t", "l", "k")
    found = [(r.k, (r.t or "")[:3], r.language.lang, r.language.rejected, r.c0) for r in language_id.identify(df, "t", fitted).collect()]
    by_text = {(k, t): (lang, rejected) for k, t, lang, rejected, _ in found}
    assert len(found) == len(rows) and all(f[4] == 1 for f in found)
    for key in ((3, ""), (4, ""), (5, "12 ")):
        assert by_text[key] == ("und", True)
    assert by_text[(6, "ein")][0] == by_text[(7, "das")][0] == "de" and by_text[(7, "THE")][0] == "en"
    assert by_text[(8, "日本語")][1]
    nothing = language_id.fit(df.limit(0), "t", "l", "k")
    assert {r.language.lang for r in language_id.identify(df, "t", nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), "t", fitted).count() == 0


def test_a_long_text_counts_like_its_parts():
    whole, _ = language_id.counts_of(["ab cd " * 100_000], 10)
    small, _ = language_id.counts_of(["ab cd " * 100], 10)
    assert np.abs(whole / 1000 - small).max() <= 0.02
