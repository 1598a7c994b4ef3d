import math
import random
import statistics
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelry.operators import console, contracts, dedup, features, geo, gram, incremental, listings, metrics, neighbours, pricing
from parcelry.operators import similarity, stats, trends
from parcelry.operators.quantiles import exact_medians
from tests.conftest import ROOT


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- Medians ----------------------------------------------------------------------------------


def test_medians_interpolate_and_ignore_partitioning(spark):
    random.seed(1)
    data = [("hot", random.choice([1.0, 2.0, 4.0, 10.0, 1e9])) for _ in range(3000)]
    data += [("wide", random.uniform(-1e6, 1e6)) for _ in range(2001)]
    data += [("four", v) for v in (1.0, 2.0, 4.0, 10.0)] + [("one", 7.0), ("gone", None)]
    data += [("skew", v) for v in [0.0] * 500 + [1e300, -1e300] + [0.001 * i for i in range(400)]]
    expected = {}
    for key in {k for k, _ in data} - {"gone"}:
        expected[key] = statistics.median([v for k, v in data if k == key])
    for parts in (1, 8):
        df = spark.createDataFrame(data, "g string, v double").repartition(parts)
        got = {r["g"]: r["m"] for r in exact_medians(df, ["g"], {"v": "m"}).collect()}
        assert got == pytest.approx(expected)


def test_median_of_the_whole_table_and_of_two_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (4.0, 6.0), (10.0, 9.0)], "a double, b double")
    assert tuple(exact_medians(df, [], {"a": "x", "b": "y"}).first()) == (3.0, 6.0)
    assert exact_medians(df.where("a > 100"), [], {"a": "x"}).first()["x"] is None


# ---- Dedup ------------------------------------------------------------------------------------


def test_one_row_per_key_with_a_hot_key(spark):
    data = [("hot", i, i % 7) for i in range(5000)] + [(f"k{i}", i, 0) for i in range(2500)]
    for parts in (1, 8):
        df = spark.createDataFrame(data, "k string, o int, v int").repartition(parts)
        first = {r["k"]: r["o"] for r in dedup.first_per_key(df, ["k"], ["o"]).collect()}
        last = {r["k"]: r["o"] for r in dedup.last_per_key(df, ["k"], ["o"]).collect()}
        assert len(first) == len(last) == 2501 and first["hot"] == 0 and last["hot"] == 4999


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = dedup.first_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_first_in_file_order(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 9), ("b", 1), ("a", 2)], "k string, v int").coalesce(1).write.parquet(path)
    assert rows(dedup.first_in_file_order(spark.read.parquet(path), ["k"])) == [("a", 9), ("b", 1)]


def test_upsert_moves_flipped_keys_and_is_idempotent(spark):
    relevant = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "k string, reason string, o int")
    irrelevant = spark.createDataFrame([("c", "old", 1)], "k string, reason string, o int")
    incoming = spark.createDataFrame(
        [("a", "new", 1, False), ("d", "x", 1, True), ("d", "y", 2, True)], "k string, reason string, o int, relevant boolean"
    )
    merged = dedup.upsert_layers(relevant, irrelevant, incoming, ["k"], ["o"])
    expected = [("a", "new", False), ("b", "old", True), ("c", "old", False), ("d", "y", True)]
    assert rows(merged.select("k", "reason", "relevant")) == expected
    again = dedup.upsert_layers(
        merged.where("relevant").drop("relevant"), merged.where("not relevant").drop("relevant"), incoming, ["k"], ["o"]
    )
    assert rows(again.select("k", "reason", "relevant")) == expected


def test_coverage_of_empty_layers(spark):
    core = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    none = core.where("k = 'z'")
    assert tuple(dedup.coverage(core, none, none, "k").first()) == (2, 0, 0, 0, 2, 100.0)
    assert dedup.coverage(none, none, none, "k").first()["missing_percent"] == 0.0


# ---- Contracts and statistics -----------------------------------------------------------------


def test_contract(spark):
    good = spark.createDataFrame([("a", "d"), ("a", None)], "article_id string, description string")
    assert contracts.check_table(good)["duplicate_rows"] == 1
    with pytest.raises(contracts.ContractError):
        contracts.check_table(good.drop("description"))
    with pytest.raises(contracts.ContractError):
        contracts.check_table(good.withColumn("article_id", F.lit(None).cast("string")))
    df = spark.createDataFrame(
        [("a", "5", 20.0), ("b", "x", 5.0), (None, "-1", None)], "article_id string, price_huf string, area_sqm double"
    )
    sound, rejects = contracts.split_by_contract(df)
    assert [r["article_id"] for r in sound.collect()] == ["a"]
    assert {tuple(r["violations"]) for r in rejects.collect()} == {
        ("price_huf not a number", "area_sqm out of range"),
        ("article_id missing", "price_huf out of range"),
    }


def test_district_statistics_edges(spark):
    df = spark.createDataFrame(
        [
            ("a", "5", "V", None, "2024-01-02 01:00:00", "2024-01-01 23:00:00"),
            ("b", "bad", "V", True, "2024-01-01", "2024-01-02 00:00:01"),
            ("c", "7", None, True, None, None),
            ("d", "8", "VI", False, "x", "2024-01-01"),
        ],
        "article_id string, price_huf string, district string, has_terrace boolean, valid_till string, valid_from string",
    )
    got = {r["district"]: r for r in stats.district_statistics(df).collect()}
    assert list(got) == ["V", "VI"]
    assert got["V"]["hirdetesek_szama"] == 2 and got["V"]["atlagar"] == 5.0 and got["V"]["ar_szoras"] is None
    assert got["V"]["terasz_arany"] == 50.0 and got["VI"]["atlag_piacido"] is None
    # Two hours overnight are zero days; one second short of a day backwards is minus two.
    assert got["V"]["atlag_piacido"] == (0 - 2) / 2
    with pytest.raises(stats.NotEnoughColumns):
        stats.district_statistics(df.drop("district"))
    with pytest.raises(stats.NotEnoughColumns):
        stats.district_statistics(df.select("article_id", "district"))


def test_counts_for_all_keeps_empty_members(spark):
    dimension = spark.createDataFrame([("x",), ("y",)], "d string")
    df = spark.createDataFrame([("x",), (None,)], "d string")
    assert rows(stats.counts_for_all(dimension, df, "d")) == [("x", 1), ("y", 0)]


# ---- Trends -----------------------------------------------------------------------------------


def test_forecast_follows_a_line(spark):
    data = [
        (1e6 + 10, 50.0, 1000.0 + 100 * month, f"2024-{month:02d}-15", True) for month in (1, 2, 3, 4) for _ in range(5)
    ]
    df = spark.createDataFrame(data, "price_huf double, area_sqm double, price_per_sqm double, delivery_day string, relevant boolean")
    chosen = trends.TrendFilter(as_of="2024-05-01")
    months = [(r["year_month"], round(r["prediction"], 6)) for r in trends.forecast(df, chosen).orderBy("step").collect()]
    assert months == [(f"2024-{m:02d}", 1000.0 + 100 * m) for m in range(5, 11)]
    summary = trends.trend_summary(df, chosen).first()
    assert summary["trend_label"] == "Drágulás" and summary["count"] == 20 and summary["months_analyzed"] == 4
    series = trends.chart_series(df, chosen).orderBy("position").collect()
    assert [r["history"] is None for r in series] == [False] * 4 + [True] * 6
    assert [r["forecast"] is None for r in series] == [True] * 3 + [False] * 7
    few = df.where("delivery_day < '2024-03-01'")
    assert trends.trend_status(few, chosen).first()["status"] == "few_months"
    assert trends.trend_status(few.limit(3), chosen).first()["status"] == "few_rows"
    assert trends.trend_status(df.where("false"), chosen).first()["status"] == "few_rows"
    assert trends.forecast(few, chosen).count() == trends.trend_summary(few, chosen).count() == 0


# ---- Search and console -----------------------------------------------------------------------


def test_search(spark):
    df = spark.createDataFrame(
        [("Szép LAKÁS", 45e6, 3.0), ("ház", None, 5.0), (None, 45.5e6, 4.0)], "title string, price_huf double, rooms double"
    )
    assert listings.search(df, "lakás").count() == 1
    assert listings.search(df, "4550").count() == 1
    assert listings.search(df, "").count() == listings.search(df).count() == 3
    assert listings.search(df, max_millions=45).count() == 2
    assert listings.search(df, min_millions=1).count() == 2
    assert listings.search(df, rooms="4").count() == 2 and listings.search(df, rooms="3").count() == 1


def test_console_runs_one_select_only(spark):
    df = spark.createDataFrame([("V", 1.0)], "district string, price_huf double")
    assert listings.run_console(spark, df, "-- note\nSELECT count(*) AS n FROM relevant_data;").first()["n"] == 1
    spark.createDataFrame([(1,)], "secret int").createOrReplaceTempView("other_table")
    refused = (
        "DROP VIEW relevant_data", "INSERT INTO x SELECT 1", "SET a=b", "", "WITH q AS (SELECT 1) INSERT INTO t SELECT * FROM q", "SELECT 1; SELECT 2",
        "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM parquet.`/tmp`", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM other_table",
        "SELECT java_method('java.util.UUID', 'randomUUID')", "SELECT district FROM relevant_data WHERE district IN (SELECT secret FROM other_table)",
        "SELECT (SELECT max(secret) FROM other_table) FROM relevant_data", "SELECT * FROM relevant_data UNION ALL SELECT secret, 1 FROM other_table",
        "SELECT district, (WITH other_table AS (SELECT 1 AS x) SELECT max(x) FROM other_table) FROM relevant_data JOIN other_table",
        "WITH a AS (SELECT * FROM other_table) SELECT * FROM a", "SELECT * FROM range(10)", "SHOW TABLES", "CACHE TABLE relevant_data", "EXPLAIN SELECT 1",
        "CREATE TABLE t AS SELECT * FROM relevant_data", "SELECT input_file_name() FROM relevant_data", "DESCRIBE relevant_data", "not sql",
        "SELECT sum(price_huf) OVER (ORDER BY reflect('a', 'b')) FROM relevant_data", "SELECT TRANSFORM(district) USING 'cat' FROM relevant_data",
        "SELECT default.f(1)",
    )
    for text in refused:
        with pytest.raises(console.NotASelect):
            listings.run_console(spark, df, text)
    accepted = (
        "SELECT DISTINCT district FROM relevant_data ORDER BY 1 LIMIT 3", "WITH a AS (SELECT district AS d FROM relevant_data) SELECT a.d FROM a CROSS JOIN a AS b",
        "SELECT d FROM VALUES ('V') AS t(d) JOIN relevant_data ON d = district", "SELECT CASE WHEN price_huf BETWEEN 0 AND 9 THEN upper(district) END FROM relevant_data",
        "SELECT part FROM relevant_data LATERAL VIEW explode(split(district, '')) x AS part", "SELECT count(*) FROM relevant_data GROUP BY ROLLUP (district) HAVING count(*) > 0",
        "SELECT row_number() OVER w FROM relevant_data WINDOW w AS (PARTITION BY district ORDER BY price_huf)", "SELECT extract(YEAR FROM DATE '2024-01-02')",
        "SELECT * FROM relevant_data PIVOT (sum(price_huf) FOR district IN ('V', 'VI'))", "(SELECT 1) MINUS (SELECT 2)",
    )
    for text in accepted:
        assert listings.run_console(spark, df, text).count() >= 1
    both = {"relevant_data": df, "Districts": spark.createDataFrame([("V", "b")], "district string, side string")}
    assert console.run_console(spark, both, "SELECT side FROM relevant_data JOIN districts USING (district)").first()["side"] == "b"
    assert listings.clean_generated_sql("```sql\nSELECT 1\n```") == "SELECT 1"
    assert "o''x" in listings.console_text("average_price", district="o'x")


# ---- Change detection -------------------------------------------------------------------------

FRAME = [("A1", "d1", "t", 50e6, 50.0, "V"), ("A2", "d2", "t", 60e6, 60.0, "VI"), ("A3", "d3", "t", 70e6, 70.0, "V")]
FRAME_SCHEMA = "article_id string, description string, title string, price_huf double, area_sqm double, district string"


def test_runs_find_new_then_nothing_then_one_change(spark):
    state = spark.createDataFrame([], "article_id string, checksum string, updated_at timestamp")
    frame = incremental.with_checksum(spark.createDataFrame(FRAME, FRAME_SCHEMA))
    assert incremental.new_and_changed(frame, state).count() == 3
    state = incremental.merge_state(state, frame, "2024-01-01")
    assert incremental.new_and_changed(frame, state).count() == 0
    assert incremental.new_and_changed(frame, state, force=True).count() == 3
    edited = incremental.with_checksum(
        spark.createDataFrame([("A1", "d1", "t", 55e6, 50.0, "V"), *FRAME[1:]], FRAME_SCHEMA)
    )
    changed = incremental.new_and_changed(edited, state)
    assert [(r["article_id"], r["change"]) for r in changed.collect()] == [("A1", "changed")]
    assert incremental.state_statistics(incremental.merge_state(state, edited, "2024-01-02")).first()[0] == 3
    assert incremental.new_and_changed(frame.where("false"), state).count() == 0


# ---- Nearest examples -------------------------------------------------------------------------

WORDS = "lakás ház telek panel tégla kert csere hányad jog bérlet szoba erkély".split()


def example_texts(n, seed):
    random.seed(seed)
    return [" ".join(random.choices(WORDS, k=random.randint(3, 14))) for _ in range(n)]


def reference_similarities(examples, texts):
    """Direct computation with plain dictionaries."""
    def grams(t):
        words = [w for w in t.split() if len(w) > 1]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    n = len(examples)
    counts, present = Counter(), Counter()
    for t, _ in examples:
        counts.update(grams(t))
        present.update(set(grams(t)))
    kept = [t for t in counts if present[t] >= 2 and present[t] / n <= 0.8]
    kept = sorted(kept, key=lambda t: (-counts[t], t))[:500]
    idf = {t: math.log((1 + n) / (1 + present[t])) + 1 for t in kept}

    def vector(t):
        raw = {g: c * idf[g] for g, c in Counter(grams(t)).items() if g in idf}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {g: v / size for g, v in raw.items()} if size else {}

    vectors = [(vector(t), label) for t, label in examples]
    result = {}
    for i, t in enumerate(texts):
        mine = vector(t)
        best = {True: 0.0, False: 0.0}
        for other, label in vectors:
            best[label] = max(best[label], sum(w * other.get(g, 0.0) for g, w in mine.items()))
        result[i] = (best[True], best[False])
    return result


def test_similarity_equals_direct_computation_for_any_size_of_cells(spark):
    examples = [(t, i % 3 != 0) for i, t in enumerate(example_texts(60, 5))]
    texts = example_texts(80, 6) + ["", "zzz yyy", *["lakás ház telek"] * 40]
    expected = reference_similarities(examples, texts)
    expected |= {i: (0.0, 0.0) for i in range(len(texts), len(texts) + 3)}
    df = spark.createDataFrame(list(enumerate(texts + [None] * 3)), "id int, t string")
    labelled = spark.createDataFrame(examples, "description string, relevant boolean")
    for size in (similarity.CELL_EXAMPLES, 4):
        classifier = similarity.ExampleClassifier.fit(labelled, cell_examples=size)
        assert len(classifier.cells.counts) == 2 if size > 4 else len(classifier.cells.counts) > 10
        rows = classifier.similarities(df, "id", "t").collect()
        got = {r["id"]: (r["relevant_sim"], r["irrelevant_sim"]) for r in rows}
        assert len(rows) == len(expected) and got.keys() == expected.keys()
        for key, pair in expected.items():
            assert got[key] == pytest.approx(pair, abs=1e-9)


def test_cells_split_into_parts_and_most_are_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GROUP_TEXTS", 7)
    monkeypatch.setattr(similarity, "GROUP_EXAMPLES", 3)
    random.seed(8)
    # Texts of eight vocabularies that share one word: nearest examples lie in cells of the own vocabulary.
    kinds = [[f"{chr(97 + k) * 2}{w}" for w in WORDS] for k in range(8)]
    text_of = lambda i: " ".join(["közös", *random.choices(kinds[i % 8], k=12)])
    examples = [(text_of(i), i // 8 % 2 == 0) for i in range(320)]
    texts = [text_of(i) for i in range(160)]
    expected = reference_similarities(examples, texts)
    labelled = spark.createDataFrame(examples, "description string, relevant boolean")
    classifier = similarity.ExampleClassifier.fit(labelled, cell_examples=5)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sims, further = classifier.found(df, "id", "t")
    got = {r["id"]: (r["relevant_sim"], r["irrelevant_sim"]) for r in sims.collect()}
    for key, pair in expected.items():
        assert got[key] == pytest.approx(pair, abs=1e-9)
    assert further.count() < 0.5 * len(texts) * len(classifier.cells.counts)


def test_terms_are_counted_without_a_row_for_each_occurrence(spark, monkeypatch):
    monkeypatch.setattr(similarity, "WORDS_COUNTED", 5, raising=False)
    texts = ["ab cd ab cd ab", "", None, "x", "cd ab", "ab", "ef", " ".join(["ab"] * 30)]
    total, df = Counter(), Counter()
    for text in texts:
        words = [w for w in (text or "").split() if len(w) > 1]
        found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        total.update(found)
        df.update(set(found))
    counted = similarity.term_totals(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t")
    assert {r["term"]: (r["total"], r["df"]) for r in counted.collect()} == {t: (total[t], df[t]) for t in total}
    assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_texts_and_parts_of_cells_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(similarity, "BLOCK_EXAMPLES", 9)
    examples = [(t, i % 3 != 0) for i, t in enumerate(example_texts(120, 5))]
    texts = example_texts(60, 6)
    # The second fit has cells that are larger than a part.
    for size in (4, 60):
        classifier = similarity.ExampleClassifier.fit(spark.createDataFrame(examples, "description string, relevant boolean"), cell_examples=size)
        sims = classifier.similarities(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t")
        got = {r["id"]: (r["relevant_sim"], r["irrelevant_sim"]) for r in sims.collect()}
        for key, pair in reference_similarities(examples, texts).items():
            assert got[key] == pytest.approx(pair, abs=1e-9)


def test_vectors_are_not_stored_for_every_cell_they_meet(spark):
    examples = [(t, i % 3 != 0) for i, t in enumerate(example_texts(400, 5))]
    classifier = similarity.ExampleClassifier.fit(spark.createDataFrame(examples, "description string, relevant boolean"), cell_examples=2)
    df = spark.createDataFrame(list(enumerate(example_texts(200, 6))), "id int, t string")
    stored = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))
    before = stored()
    sims, further = classifier.found(df, "id", "t")
    assert sims.count() == 200
    written, meetings = stored() - before, further.count()
    vectors = classifier.vectors.packed(df, "id", "t").agg(F.sum(F.octet_length("vector"))).first()[0]
    assert meetings > 2_000 and written < 5 * vectors


def test_packed_vectors_take_a_byte_for_a_term_and_come_back_as_weights():
    idf = np.linspace(1, 3, 500)
    counts = np.random.default_rng(1).poisson(0.3, (50, 500))
    counts[0], counts[1, 7], counts[2, 499], counts[3, 0] = 0, 255, 256, 2**40
    packed = similarity.pack(counts).to_pylist()
    assert packed[0] == b"" and all(len(v) < 64 + 1.1 * (row > 0).sum() for v, row in zip(packed[4:], counts[4:]))
    weights = counts * idf
    expected = np.divide(weights, np.linalg.norm(weights, axis=1, keepdims=True), out=np.zeros((50, 500)), where=weights > 0)
    assert np.allclose(similarity.unpack(packed, idf), expected, rtol=1e-14, atol=0)
    assert similarity.unpack([], idf).shape == (0, 500)


def test_copies_that_travel_grow_with_large_blocks_only(spark, monkeypatch):
    # Disk of the search: a text goes to each part of the examples, an example to each block of texts.
    assert similarity.BLOCK_TEXTS >= 100_000 and similarity.BLOCK_EXAMPLES >= 100_000
    monkeypatch.setattr(similarity, "EXAMPLES_UNPACKED", 7)
    monkeypatch.setattr(similarity, "LEAST_BLOCK", 30)
    examples, texts = [(t, i % 3 != 0) for i, t in enumerate(example_texts(90, 5))], example_texts(80, 6)
    classifier = similarity.ExampleClassifier.fit(spark.createDataFrame(examples, "description string, relevant boolean"), cell_examples=5)
    sims = classifier.similarities(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t")
    got = {r["id"]: (r["relevant_sim"], r["irrelevant_sim"]) for r in sims.collect()}
    for key, pair in reference_similarities(examples, texts).items():
        assert got[key] == pytest.approx(pair, abs=1e-9)


def test_similarity_of_an_empty_table_and_of_repeated_keys(spark):
    labelled = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(example_texts(40, 9))], "description string, relevant boolean")
    classifier = similarity.ExampleClassifier.fit(labelled)
    assert classifier.similarities(spark.createDataFrame([], "id int, t string"), "id", "t").collect() == []
    rows = classifier.similarities(spark.createDataFrame([(1, "lakás ház"), (1, "lakás ház"), (None, "telek")], "id int, t string"), "id", "t")
    assert sorted(r["id"] or 0 for r in rows.collect()) == [0, 1, 1]


def test_too_few_examples(spark):
    few = spark.createDataFrame([("a b", True)] * 20 + [("c d", False)] * 4, "description string, relevant boolean")
    assert similarity.ExampleClassifier.fit(few) is None


def test_decision_thresholds(spark):
    sims = spark.createDataFrame([(0.7, 0.2), (0.2, 0.36), (0.6, 0.1), (0.4, 0.4), (0.66, 0.9)], "relevant_sim double, irrelevant_sim double")
    decided = similarity.decide(sims)
    assert [r["relevant"] for r in decided.collect()] == [True, False, None, None, False]
    assert decided.first()["ml_reason"] == "ML: Releváns (sim=0.70)"
    assert similarity.decision_statistics(decided).first()["confidence_rate"] == 0.6


# ---- Neighbours -------------------------------------------------------------------------------


def reference_neighbours(train, queries, k):
    result = {}
    for key, place in queries:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(place, p)), 9), name, y) for name, p, y in train)[:k]
        exact = [y for d, _, y in near if d == 0]
        if exact:
            result[key] = sum(exact) / len(exact)
        else:
            weights = [1 / math.sqrt(d) for d, _, _ in near]
            result[key] = sum(w * y for w, (_, _, y) in zip(weights, near)) / sum(weights)
    return result


@pytest.mark.parametrize("width, spread", [(2, 6), (5, 20), (30, 1)])
def test_neighbours_equal_brute_force_however_space_is_cut(spark, width, spread, monkeypatch):
    random.seed(width)
    place = lambda: [float(random.randint(0, spread)) for _ in range(width)]
    train = [(f"k{i:04d}", place(), random.random()) for i in range(400)]
    train += [(f"h{i:04d}", [1.0] * width, float(i)) for i in range(200)]
    queries = [(f"q{i}", place()) for i in range(60)] + [("hot", [1.0] * width), ("far", [99.0] * width)]
    expected = reference_neighbours(train, queries, 10)
    points = spark.createDataFrame(train, "key string, features array<double>, label double")
    df = spark.createDataFrame(queries, "key string, features array<double>")
    for cell_points, most in ((4000, 5000), (30, 7)):
        # Small groups: cells are split into several parts of queries and of points.
        monkeypatch.setattr(neighbours, "GROUP_QUERIES", most)
        monkeypatch.setattr(neighbours, "GROUP_POINTS", most)
        model = neighbours.NeighbourModel.fit(points, 10, cell_points)
        assert model.n_points <= 400 + 10 and (cell_points > 400 or model.cuts.cells > 5)
        got = {r["key"]: r["prediction"] for r in model.predict(df).collect()}
        assert got == pytest.approx(expected)


def test_cells_asked_for_a_query_do_not_grow_with_the_points(spark):
    pairs = []
    for n in (1500, 6000):
        rows = np.random.default_rng(n).uniform(0, 1, (n, 2)).tolist()
        train = spark.createDataFrame([(f"k{i}", p, 1.0) for i, p in enumerate(rows)], "key string, features array<double>, label double")
        model = neighbours.NeighbourModel.fit(train, 5, 100)
        queries = spark.createDataFrame([(p,) for p in np.random.default_rng(1).uniform(0, 1, (200, 2)).tolist()], "features array<double>")
        pairs.append(model.found(queries)[1].count() / 200)
        assert model.cuts.cells >= n // 200
    assert max(pairs) < 4


def test_cuts_put_every_point_into_one_cell():
    points = np.random.default_rng(2).integers(0, 3, (500, 3)).astype(float)
    cuts = neighbours.Cuts.fit(points, 12)
    cells = cuts.cell_of(points)
    assert set(cells) == set(range(cuts.cells)) and cuts.cells == 12
    assert neighbours.Cuts.fit(np.ones((9, 2)), 4).cells == 1 and neighbours.Cuts.fit(np.zeros((0, 2)), 4).cells == 1


def test_queries_walk_the_cuts_together_to_the_cells_in_reach():
    points = np.random.default_rng(3).uniform(0, 9, (600, 4)).round(1)
    cuts = neighbours.Cuts.fit(points[:300], 40)
    own = cuts.cell_of(points)
    numbers, counts = np.unique(own, return_counts=True)
    low, high = (np.array([edge(points[own == c]) for c in numbers]) for edge in (lambda p: p.min(axis=0), lambda p: p.max(axis=0)))
    cells = neighbours.Cells(numbers, counts, low, high)
    queries, limits = points[::3] + 0.5, np.random.default_rng(4).uniform(0, 6, 200)
    row, place = cells.reached(cuts, queries, limits)
    expected = [(i, p) for i in range(200) for p in cells.within(queries[i], 5, limits[i]).tolist()]
    assert sorted(zip(row.tolist(), place.tolist())) == expected and 200 < len(expected) < 200 * len(numbers) / 2


def test_nearest_of_many_queries_with_equal_distances_and_limits():
    points = np.random.default_rng(5).integers(0, 3, (500, 3)).astype(float)
    queries, limits = points[:90], np.tile([np.inf, 1.0, 0.0], 30)
    found = [*neighbours.nearest(queries, points, np.arange(500)[::-1], 4, limits)]
    got = list(zip(*(np.concatenate(f).tolist() for f in zip(*found))))
    expected = []
    for i, (query, limit) in enumerate(zip(queries, limits)):
        near = sorted((d, -j) for j, d in enumerate(((points - query) ** 2).sum(axis=1).tolist()) if d <= limit)[:4]
        expected += [(i, -j, d) for d, j in near]
    assert got == expected


def test_fewer_points_than_neighbours(spark):
    model = neighbours.NeighbourModel.fit(
        spark.createDataFrame([("a", [0.0], 1.0), ("b", [3.0], 4.0)], "key string, features array<double>, label double"), cell_points=1
    )
    query = spark.createDataFrame([("q", [1.0])], "key string, features array<double>")
    assert model.predict(query).first()["prediction"] == pytest.approx((1 / 1 * 1 + 1 / 2 * 4) / 1.5)
    empty = neighbours.NeighbourModel.fit(spark.createDataFrame([], "key string, features array<double>, label double"))
    assert empty.predict(query).first()["prediction"] is None
    assert model.predict(query.limit(0)).count() == 0


# ---- Price models -----------------------------------------------------------------------------


def price_listings(spark, n=600):
    random.seed(3)
    data = []
    for i in range(n):
        area, rooms = random.uniform(30, 120), random.choice([None, 1.0, 2.0, 3.0])
        district = random.choice(["I", "II", "III", None])
        price = 2e7 + area * 8e5 + (2e7 if district == "II" else 0) + random.uniform(-1e6, 1e6)
        data.append((f"a{i}", price, area, rooms, random.choice([None, 1, 2]), district, "2024-03-05", random.choice(["Tégla ", "panel", None]), "lakas", random.choice([None, True]), True))
    return spark.createDataFrame(
        data,
        "article_id string, price_huf double, area_sqm double, rooms double, floor int, district string, "
        "delivery_day string, building_type string, property_category string, has_terrace boolean, relevant boolean",
    )


def test_features(spark):
    df = price_listings(spark)
    fitted = features.FeatureModel.fit(df)
    assert fitted.categories == {"district": ["II", "III", "unknown"], "building": ["tegla", "unknown"], "category": []}
    assert fitted.rooms_median == statistics.median([r["rooms"] for r in df.collect() if r["rooms"] is not None])
    strange = df.limit(1).withColumn("district", F.lit("XX")).withColumn("rooms", F.lit(None).cast("double"))
    values = dict(zip(fitted.feature_names(), fitted.vectors(strange, ["article_id"]).first()["features"]))
    assert values["rooms"] == fitted.rooms_median and values["delivery_dayofweek"] == 1.0 and values["delivery_month"] == 3.0
    assert not any(v for k, v in values.items() if k.startswith("district_"))


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_LEVELS", 2)
    with pytest.raises(ValueError):
        features.FeatureModel.fit(price_listings(spark, 100))


def test_split_ignores_partitioning(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    sides = [{r["key"] for r in pricing.split(df.repartition(n))[0].collect()} for n in (1, 8)]
    assert sides[0] == sides[1] and 1500 < len(sides[0]) < 1700


def test_ridge_equals_closed_form(spark):
    random.seed(4)
    data = [([random.random(), random.random() * 5], random.random()) for _ in range(50)]
    df = spark.createDataFrame([(str(i), x, y + x[0] * 2 - x[1]) for i, (x, y) in enumerate(data)], "key string, features array<double>, label double")
    model = pricing.fit_ridge(df, 1.0)
    x = np.array([r["features"] for r in df.collect()])
    y = np.array([r["label"] for r in df.collect()])
    centred = x - x.mean(axis=0)
    exact = np.linalg.solve(centred.T @ centred + np.eye(2), centred.T @ (y - y.mean()))
    assert model.coefficients.toArray() == pytest.approx(exact, rel=1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ exact, rel=1e-6)


def test_saved_models_are_read_by_another_process(spark, tmp_path):
    df = price_listings(spark, 120)
    data = pricing.PriceData.of(df)
    base = [lambda t: pricing.fit_forest(t, 2, 3), lambda t: pricing.fit_neighbours(t, 3)]
    stack = pricing.served(data.features, pricing.fit_stack(data.train, base, 1.0))
    pricing.save_model(str(tmp_path / "m"), stack, spark.range(1))
    df.write.parquet(str(tmp_path / "rows"))
    expected = {r.article_id: r.predicted_price for r in pricing.score(df, stack).collect()}
    script = (
        "import sys; from parcelry.session import local_session; from parcelry.operators import pricing; p = sys.argv[1]; s = local_session(2, 2)\n"
        "pricing.score(s.read.parquet(p + '/rows'), pricing.load_model(p + '/m')).write.parquet(p + '/scores')"
    )
    subprocess.run([sys.executable, "-c", script, str(tmp_path)], check=True, cwd=ROOT, timeout=180, capture_output=True)
    assert {r.article_id: r.predicted_price for r in spark.read.parquet(str(tmp_path / "scores")).collect()} == pytest.approx(expected)


@pytest.mark.parametrize("parts", [1, 7])
def test_ridge_from_sums_of_products_equals_the_closed_form(spark, parts):
    rnd = np.random.default_rng(parts)
    data = []
    for group, n in (("a", 3000), ("b", 5), (None, 40), ("flat", 3), ("one", 1)):
        x = rnd.normal(50, 9, (n, 3)) if group != "flat" else np.ones((n, 3))
        y = 17 + x @ [0.02, -0.01, 0.0] + rnd.normal(0, 0.1, n)
        data += [(group, p, float(v)) for p, v in zip(x.tolist(), y)]
    df = spark.createDataFrame([*data, ("a", None, 1.0), ("a", [1.0, 2.0, 3.0], None)], "g string, features array<double>, label double").repartition(parts)
    fitted = gram.solve_ridge(gram.gram_statistics(df, ["g"], "features", "label"), 2.0)
    got = {r.g: r for r in fitted.collect()}
    assert set(got) == {"a", "b", None, "flat", "one"}
    for group, row in got.items():
        x, y = (np.array([d[i] for d in data if d[0] == group]) for i in (1, 2))
        centred = x - x.mean(axis=0)
        exact = np.linalg.solve(centred.T @ centred + 2 * np.eye(3), centred.T @ (y - y.mean()))
        assert row.n_rows == len(y) and row.weights == pytest.approx(exact, rel=1e-8, abs=1e-12)
        assert row.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ exact)
    scored = gram.predict(df, fitted, ["g"], "features")
    assert scored.count() == len(data) + 2 and scored.where("prediction is null").count() == 1
    whole = gram.solve_ridge(gram.gram_statistics(df, [], "features", "label"), 2.0).collect()
    assert len(whole) == 1 and whole[0].n_rows == len(data) and 0 <= whole[0].r2 <= 1
    assert gram.solve_ridge(gram.gram_statistics(df.limit(0), ["g"], "features", "label"), 2.0).count() == 0


def test_compare_select_save_and_score(spark, tmp_path):
    df = price_listings(spark)
    data = pricing.PriceData.of(df)
    small = pricing.Settings(forest_trees=5, forest_depth=5, boosted_trees=5, boosted_depth=3, stack_forest_trees=3, stack_forest_depth=4, stack_boosted_trees=3, stack_boosted_depth=3)
    comparison, fitted = pricing.compare(data, small)
    got = comparison.collect()
    assert {r["model"] for r in got} == {"Random Forest", "Boosted Trees", "KNN", "Stacking Ensemble"} == set(fitted)
    assert pricing.select_best(comparison) == got[0]["model"] and got[0]["test_r2"] > 0.8
    fitted["Ridge"] = pricing.fit_ridge(data.train, 1.0)
    for name, model in fitted.items():
        whole, path = pricing.served(data.features, model), str(tmp_path / name)
        pricing.save_model(path, whole, comparison)
        pricing.save_model(path, whole, comparison)  # over the former one
        loaded = pricing.load_model(path)
        assert loaded.stages[0].fitted == data.features
        scored = pricing.score(df.drop("delivery_day"), loaded)
        prices = {r.article_id: r.predicted_price for r in scored.collect()}
        assert prices == pytest.approx({r.article_id: r.predicted_price for r in pricing.score(df.drop("delivery_day"), whole).collect()})
        assert len(prices) == 600 and scored.first()["formatted_price"].endswith(" Ft")
    assert {r["model"] for r in spark.read.json(f"{path}/metrics").collect()} == {r["model"] for r in got}
    forest = pricing.fit_forest(data.train, 5, 5)
    top = metrics.top_features(pricing.importances(spark, forest, data.features), 3).collect()
    assert top[0]["feature"] == "area_sqm" and len(top) == 3


def test_metrics_and_tie(spark):
    scored = spark.createDataFrame([(math.log(100.0), math.log(110.0)), (math.log(200.0), math.log(190.0))], "label double, prediction double")
    got = metrics.regression_metrics(scored).first()
    assert got["test_mae"] == pytest.approx(10) and got["test_rmse"] == pytest.approx(10)
    assert got["test_r2"] == pytest.approx(1 - 200 / 5000) and got["test_mape"] == pytest.approx(7.5)
    tie = spark.createDataFrame([("b", 1, 0.5), ("a", 0, 0.5), ("c", 2, 0.1)], "model string, model_order int, test_r2 double")
    assert metrics.best_model(tie).first()["model"] == "a"


# ---- Boundaries -------------------------------------------------------------------------------


def test_boundary_shapes(spark):
    relations = spark.createDataFrame(
        [("1", "one", [("way", "w1", "outer"), ("way", "w2", "inner")]), ("2", "two", [("way", "w2", "outer"), ("way", "w1", "outer"), ("node", "n1", "outer")])],
        "relation_id string, name string, members array<struct<type:string,ref:string,role:string>>",
    )
    ways = spark.createDataFrame([("w1", ["n3", "n1", "gone", "n3"]), ("w2", ["n2"])], "way_id string, refs array<string>")
    nodes = spark.createDataFrame([("n1", 1.0, 2.0), ("n2", 3.0, 4.0), ("n3", 5.0, 6.0)], "node_id string, lon double, lat double")
    shapes = geo.assemble_boundaries(relations, ways, nodes).orderBy("relation_id").collect()
    assert shapes[0]["geometry_type"] == "Polygon" and shapes[0]["rings"] == [[[5, 6], [1, 2], [5, 6]]]
    assert shapes[1]["geometry_type"] == "MultiPolygon" and shapes[1]["rings"] == [[[3, 4]], [[5, 6], [1, 2], [5, 6]]]


def _counted(df, column):
    """``df`` with ``column`` passed through a function that counts its calls."""
    calls = df.sparkSession.sparkContext.accumulator(0)

    def same(value):
        calls.add(1)
        return value

    through = F.udf(same, df.schema[column].dataType, useArrow=False).asNondeterministic()
    return df.withColumn(column, through(F.col(column))), calls


def test_neighbour_search_reads_its_queries_once(spark):
    points = spark.range(300).select(
        F.col("id").cast("string").alias("key"), F.array(F.col("id") * 1.0, (F.col("id") % 7) * 1.0).alias("features"), (F.col("id") * 2.0).alias("label")
    )
    queries, calls = _counted(points.where("key % 3 = 0"), "features")
    near, _ = neighbours.NeighbourModel.fit(points, 3, cell_points=50).found(queries)
    assert near.where(F.size("near") == 3).count() == 100
    assert calls.value == 100


def _price_listings(spark, n=400):
    listed = spark.range(n).select(
        F.col("id").cast("string").alias("article_id"), (2e7 + F.col("id") * 1e5).alias("price_huf"), (30.0 + F.col("id") % 50).alias("area_sqm"),
        (F.col("id") % 4).cast("double").alias("rooms"), (F.col("id") % 9).cast("int").alias("floor"), F.concat(F.lit("d"), F.col("id") % 3).alias("district"),
        F.lit(True).alias("relevant"),
    )
    return listed


def test_price_data_reads_its_listings_once(spark):
    listings, calls = _counted(_price_listings(spark), "area_sqm")
    data = pricing.PriceData.of(listings)
    assert data.train.count() + data.test.count() == 400
    assert calls.value <= 400


def test_parts_of_price_data_follow_cores_and_rows_not_the_shuffle_width(spark, monkeypatch):
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        slots = spark.sparkContext.defaultParallelism
        assert pricing.PriceData.of(_price_listings(spark)).train.rdd.getNumPartitions() == slots
        monkeypatch.setattr(pricing, "PART_ROWS", 20)
        assert pricing.PriceData.of(_price_listings(spark)).train.rdd.getNumPartitions() == 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_models_are_fitted_one_at_a_time_where_a_pass_fills_the_cores(spark, monkeypatch):
    assert pricing.fits_at_once(pricing.PriceData.of(_price_listings(spark)).train) == pricing.FITS_AT_ONCE
    monkeypatch.setattr(pricing, "PART_ROWS", 20)
    assert pricing.fits_at_once(pricing.PriceData.of(_price_listings(spark)).train) == 1
