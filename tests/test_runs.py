"""Relevance runs, sources, sinks and streams."""

import json
import threading
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelry.functions.text import cache_key
from parcelry.functions.verdict import POLICIES
from parcelry.operators import geo, incremental, relevance
from parcelry.plans import text_queries
from parcelry.schema import CHECKSUM_STATE, DECISION_LOG, FEEDBACK, LISTING, VERDICT, VERDICT_CACHE
from parcelry.session import cut_lineage
from parcelry.sinks import tables as sinks
from parcelry.sources import tables, text_files
from parcelry.streaming import verdict_cache
from parcelry.streaming.incremental import detect_changes, first_seen, listing_stream, remembered, state_before
from parcelry.streaming.progress import progress_report
from parcelry.streaming.verdict_cache import SETTINGS, held, serve


def rows(df):
    return sorted(tuple(r) for r in df.collect())


TEXTS = [
    ("1", "lakás", "szép és tágas", 1e7),
    ("2", "lakás", "tulajdoni hányad eladó", 1e7),
    ("3", "lakás", "SZÉP  és tágas", 1e7),
    ("4", "lakás", "olcsó", -5.0),
    ("5", None, None, 1e7),
]
TEXT_SCHEMA = "article_id string, title string, description string, price_huf double"


def yes(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: json.dumps({"relevant": "olcsó" not in p, "reason": str(len(p)), "floor": "4"}))


def failing(prompts: pd.Series) -> pd.Series:
    raise TimeoutError("model away")


class Counting:
    """Notes every prompt the model gets in a file per call."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, prompts: pd.Series) -> pd.Series:
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as out:
            out.write("\n".join(p.replace("\n", " ") for p in prompts))
        return yes(prompts)


def asked(folder):
    return [line for f in folder.iterdir() for line in f.read_text(encoding="utf-8").split("\n") if line]


def test_two_phase_asks_each_text_once(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, TEXT_SCHEMA).repartition(4)
    result = relevance.two_phase(df, relevance.Caller(Counting(tmp_path)), keep=cut_lineage)
    got = {r["article_id"]: r for r in result.decided.collect()}
    assert len(got) == 5
    assert got["2"]["relevant"] is False and got["2"]["filtered_by"] == "worker"
    assert got["4"]["relevant"] is True and "price_huf out of range" in got["4"]["reason"]
    assert got["1"]["relevant"] is True and got["1"]["floor"] == 4 and got["1"]["filtered_by"] == "llm"
    assert got["1"]["reason"] == got["3"]["reason"]
    result.new_cache.collect()
    # Texts 1 and 3 share a key, text 5 is empty: two prompts in all, although two results were read.
    assert len(asked(tmp_path)) == 2
    assert not any("hányad" in p or "olcsó" in p for p in asked(tmp_path))


def test_second_run_is_served_from_the_cache(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, TEXT_SCHEMA)
    first = relevance.two_phase(df, relevance.Caller(yes), as_of="2024-01-01")
    path = str(tmp_path / "cache")
    first.new_cache.write.parquet(path)
    (tmp_path / "calls").mkdir()
    again = relevance.two_phase(
        df, relevance.Caller(Counting(tmp_path / "calls")), cache=spark.read.parquet(path), as_of="2024-01-02"
    )
    assert rows(again.decided.select("article_id", "relevant", "reason")) == rows(
        first.decided.select("article_id", "relevant", "reason")
    )
    assert asked(tmp_path / "calls") == []
    late = relevance.two_phase(
        df, relevance.Caller(Counting(tmp_path / "calls")), cache=spark.read.parquet(path), as_of="2024-01-04"
    )
    late.decided.collect()
    assert len(asked(tmp_path / "calls")) == 2


def test_failed_calls_follow_the_policy(spark):
    df = spark.createDataFrame(TEXTS[:1], TEXT_SCHEMA)
    for name, expected in (("live", False), ("scheduled", True)):
        row = relevance.two_phase(df, relevance.Caller(failing), policy=POLICIES[name]).decided.first()
        assert row["relevant"] is expected and "model away" in row["reason"]


def test_batches_of_three_fall_back_singly(spark):
    def batch_model(prompts: pd.Series) -> pd.Series:
        def reply(prompt):
            if "#1:" not in prompt:
                return '{"relevant": false, "reason": "single"}'
            if "bad" in prompt:
                return "[1, 2]"
            return json.dumps([{"relevant": True, "reason": f"batch {i}"} for i in range(3)])

        return prompts.map(reply)

    texts = spark.createDataFrame([(f"k{i}", "bad" if i == 4 else f"text {i}") for i in range(20)], "cache_key string, text string")
    got = {r["cache_key"]: r["verdict"]["reason"] for r in relevance.classify_in_batches(texts, relevance.Caller(batch_model), 2).collect()}
    assert len(got) == 20 and got["k4"] == "single"
    assert sum(v.startswith("batch") for v in got.values()) % 3 == 0 and sum(v.startswith("batch") for v in got.values()) >= 12


def test_verdict_join_keeps_repeated_raw_rows(spark):
    raw = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", None)], "article_id string, street string")
    decided = spark.createDataFrame([("a", True, "r", "w", "utca"), ("a", True, "r", "w", "utca")], "article_id string, relevant boolean, reason string, filtered_by string, street string")
    joined = relevance.attach_verdicts(raw, decided)
    assert rows(joined.select("article_id", "street_x", "relevant").fillna("none", ["street_x"]).fillna(False)) == [
        ("a", "s1", True),
        ("a", "s2", True),
        ("b", "none", False),
    ]


# ---- Sources ----------------------------------------------------------------------------------


def test_missing_and_corrupt_tables_read_as_empty(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none"), CHECKSUM_STATE).count() == 0
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part.parquet").write_text("invalid json{{{")
    got = tables.read_table(spark, str(broken), CHECKSUM_STATE)
    assert got.count() == 0 and got.columns == CHECKSUM_STATE.names


def test_known_columns_are_cast_and_filled(spark, tmp_path):
    spark.createDataFrame([("a", 5)], "article_id string, price_huf int").write.parquet(str(tmp_path / "t"))
    got = tables.read_table(spark, str(tmp_path / "t"), LISTING)
    assert got.columns == LISTING.names and got.first()["price_huf"] == 5.0 and got.first()["title"] is None


def test_scan_pushes_predicate_and_columns(spark, sf_dir):
    path = f"{sf_dir}/lineitem.parquet"
    df = tables.scan(spark, path, ["l_orderkey", "absent"], F.col("l_quantity") > 49)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_tax" not in plan
    assert df.columns == ["l_orderkey"]
    assert tables.scan(spark, path, where=lambda d: d.where("l_quantity > 49")).count() == df.count()


def test_row_ranges_cover_the_file(spark, sf_dir):
    path = f"{sf_dir}/lineitem.parquet"
    total = spark.read.parquet(path).count()
    assert sum(tables.row_range(spark, path, s, s + 2500).count() for s in range(0, total, 2500)) == total


def test_profile_and_freshness(spark, sf_dir, tmp_path):
    got = tables.profile(spark, f"{sf_dir}/lineitem.parquet").first()
    assert got["total_rows"] > 5000 and got["num_columns"] == 11 and got["compression_ratio"] == 5.0
    assert got["recommended_chunk_size"] >= 1000
    assert tables.file_facts(spark, f"{sf_dir}/lineitem.parquet").count() == 1
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.range(5).write.parquet(old)
    time.sleep(1.1)
    spark.range(5).write.parquet(new)
    assert tables.freshness(spark, new, old)["is_newer"] and not tables.freshness(spark, old, new)["is_newer"]
    assert tables.freshness(spark, new, str(tmp_path / "none"))["is_newer"]
    names, sample = tables.schema_and_sample(spark.read.parquet(old))
    assert names == [("id", "bigint")] and sample.count() == 3


def test_every_row_is_in_one_batch_of_a_pruned_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    # Many row groups in each of a few files, ordered so that groups can be ruled out.
    spark.range(0, 200_000, 1, 3).write.option("parquet.block.size", 64 * 1024).option("parquet.page.size", 8 * 1024).parquet(path)
    listed = lambda batch: [pa.RecordBatch.from_pydict({"first": [batch.column(0)[0].as_py()], "ids": [batch.column(0).to_pylist()]})]
    whole = tables.in_batches(spark, path, listed, "first long, ids array<long>", batch_rows=777).collect()
    assert sorted(i for r in whole for i in r.ids) == list(range(200_000)) and max(len(r.ids) for r in whole) <= 777
    part = tables.in_batches(spark, path, listed, "first long, ids array<long>", ["id"], F.col("id") >= 150_000, 777)
    assert sorted(i for r in part.collect() for i in r.ids) == list(range(150_000, 200_000))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,150000)" in plan
    assert tables.in_batches(spark, path, listed, "first long, ids array<long>", where=F.col("id") < 0).count() == 0


def test_prior_verdicts(spark):
    relevant = spark.createDataFrame([("a", "r1", 3)], "article_id string, reason string, floor int")
    irrelevant = spark.createDataFrame([("b", "r2")], "article_id string, reason_to_relevance string")
    got = tables.prior_verdicts(relevant, irrelevant)
    assert rows(got.select("article_id", "reason", "relevant")) == [("a", "r1", True), ("b", "r2", False)]


def test_decision_log_survives_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 'line "one"\nline, two', True, ""), ("b", None, False, "x")], DECISION_LOG)
    path = str(tmp_path / "log")
    sinks.export_csv(df.repartition(2), path)
    got = {r["article_id"]: r for r in text_files.read_decision_log(spark, path).collect()}
    assert len(got) == 2 and got["a"]["description"] == 'line "one"\nline, two' and got["b"]["relevant"] is False


GEOJSON = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"Nev": "V", "id": 1}, "geometry": {"type": "Polygon", "coordinates": [[[1.0, 2.0]]]}},
        {"type": "Feature", "properties": {"Nev": "VI", "id": 2}, "geometry": {"type": "Point", "coordinates": [1.0]}},
    ],
}
MAP_XML = """<osm>
<node id="1" lat="2.0" lon="1.0"/><node id="2" lat="4.0" lon="3.0"/>
<way id="10"><nd ref="2"/><nd ref="1"/><nd ref="99"/></way>
<relation id="100"><member type="way" ref="10" role="outer"/><tag k="name" v="V. kerület"/></relation>
</osm>"""


def test_geojson(spark, tmp_path):
    path = tmp_path / "d.geojson"
    path.write_text(json.dumps(GEOJSON), encoding="utf-8")
    features, names = text_files.read_geojson(spark, str(path))
    areas = geo.only_areas(features)
    listings = spark.createDataFrame([("V",), ("V",), (None,)], "district string")
    got = geo.features_with_counts(areas, listings, geo.feature_name(names)).collect()
    assert [(r["area_name"], r["listing_count"], r["popup"]) for r in got] == [("V", 2, "<b>V</b><br>Hirdetések száma: 2")]


def test_map_xml_to_geojson(spark, tmp_path):
    path = tmp_path / "map.xml"
    path.write_text(MAP_XML, encoding="utf-8")
    shapes = geo.assemble_boundaries(*text_files.read_map_xml(spark, str(path)))
    out = str(tmp_path / "features")
    sinks.write_features(geo.feature_json(shapes), out)
    feature = json.loads(spark.read.text(out).first()["value"])
    assert feature["properties"] == {"name": "V. kerület"}
    assert feature["geometry"] == {"type": "Polygon", "coordinates": [[[3.0, 4.0], [1.0, 2.0]]]}


# ---- Sinks ------------------------------------------------------------------------------------


def test_versions_replace_what_they_read(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), CHECKSUM_STATE)
    assert table.read().count() == 0 and table.versions() == []
    frame = spark.createDataFrame([("a", "1"), ("b", "2")], "article_id string, checksum string")
    assert sinks.save_state(table, frame, "2024-01-01") == 1
    changed = spark.createDataFrame([("a", "9"), ("c", "3")], "article_id string, checksum string")
    assert sinks.save_state(table, changed, "2024-01-02") == 2
    assert rows(table.read().select("article_id", "checksum")) == [("a", "9"), ("b", "2"), ("c", "3")]
    with pytest.raises(sinks.InvalidTable):
        table.replace(changed.withColumn("updated_at", F.current_timestamp()), check=lambda d: d.count() > 100)
    assert table.versions() == [1, 2] and table.read().count() == 3
    table.reset()
    assert table.read().count() == 0


def test_two_writers_lose_nothing_and_a_stale_one_is_told(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), CHECKSUM_STATE)
    frame = lambda name: spark.createDataFrame([(f"{name}{i}", "1") for i in range(20)], "article_id string, checksum string")
    with ThreadPoolExecutor(4) as pool:
        numbers = sorted(w.result() for w in [pool.submit(sinks.save_state, table, frame(n), "2024-01-01") for n in "abcd"])
    assert numbers == table.versions() == [1, 2, 3, 4]
    assert table.read().count() == 80 and table.read(2).count() == 40
    with pytest.raises(sinks.Conflict):
        table.replace(table.read(), base=3)
    with pytest.raises(sinks.InvalidTable):
        table.update(lambda stored: stored, check=lambda d: False)
    assert table.versions() == [1, 2, 3, 4]


def test_old_versions_and_left_folders_expire(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), CHECKSUM_STATE)
    for i in range(4):
        sinks.save_state(table, spark.createDataFrame([(f"k{i}", "1")], "article_id string, checksum string"), "2024-01-01")
    with pytest.raises(sinks.InvalidTable):
        table.replace(table.read(), check=lambda d: False)
    folders = lambda: len(list((tmp_path / "t").glob("rows-*")))
    assert table.expire(3_600_000) == [] and folders() == 5
    time.sleep(0.05)
    assert table.expire(1, keep=2) == [1, 2] and table.versions() == [3, 4] and folders() == 2
    assert table.read().count() == 4 and sinks.VersionedTable(spark, str(tmp_path / "no"), CHECKSUM_STATE).expire(1) == []


def test_layers_written_and_merged(spark, tmp_path):
    decided = spark.createDataFrame(
        [("a", True, "r", 1), ("b", False, "s", 2)], "article_id string, relevant boolean, reason string, floor int"
    )
    sinks.write_layers(decided, str(tmp_path / "rel"), str(tmp_path / "irr"))
    assert spark.read.parquet(str(tmp_path / "irr")).columns == ["article_id", "reason_to_relevance"]
    layer = lambda name: sinks.VersionedTable(spark, str(tmp_path / name), decided.drop("relevant").schema)
    relevant, irrelevant = layer("vr"), layer("vi")
    sinks.merge_layers(relevant, irrelevant, decided)
    flipped = decided.where("article_id = 'a'").withColumn("relevant", F.lit(False))
    for _ in range(2):
        sinks.merge_layers(relevant, irrelevant, flipped)
        assert relevant.read().count() == 0
        assert rows(irrelevant.read().select("article_id")) == [("a",), ("b",)]


def test_feedback_queue_grows_only_by_new_keys(spark, tmp_path):
    decided = spark.createDataFrame(
        [("a", "x" * 600, True, "r", "llm"), ("b", None, False, "s", None)],
        "article_id string, description string, relevant boolean, reason string, filtered_by string",
    )
    path = str(tmp_path / "queue")
    for _ in range(2):
        sinks.append_feedback(spark, decided, path)
    got = spark.read.schema(FEEDBACK).parquet(path).orderBy("article_id").collect()
    assert [len(r["description_preview"]) for r in got] == [500, 0] and got[1]["filtered_by"] == "unknown"


def test_records_keep_nulls_and_show_times_as_text(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t")
    sinks.write_records(df, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()["value"]) == {"a": 1, "b": None, "t": "2024-01-02 03:04:05"}


# ---- Streams ----------------------------------------------------------------------------------


def run_changes(spark, folder, seed=None):
    stream = listing_stream(spark, f"{folder}/in", LISTING, files_per_batch=1)
    query = detect_changes(stream, f"{folder}/state", f"{folder}/out", f"{folder}/progress", "2024-01-01", seed=seed)
    query.awaitTermination()
    return query


def write_listings(spark, folder, *listings):
    data = spark.createDataFrame([(k, d) for k, d in listings], "article_id string, description string")
    full = data.select(*[F.col(c) if c in data.columns else F.lit(None).cast(LISTING[c].dataType).alias(c) for c in LISTING.names])
    full.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(1.1)


def test_stream_finds_new_and_changed_and_repeats_safely(spark, tmp_path):
    folder = str(tmp_path)
    seed = incremental.with_checksum(spark.createDataFrame([("s", "seeded")], "article_id string, description string"))
    seed = seed.select("article_id", "checksum", F.to_timestamp(F.lit("2023-01-01")).alias("updated_at"))
    write_listings(spark, folder, ("a", "1"), ("b", "1"), ("s", "seeded"))
    write_listings(spark, folder, ("a", "1"), ("b", "2"))
    query = run_changes(spark, folder, seed)
    out = spark.read.parquet(f"{folder}/out")
    assert rows(out.select("batch", "article_id", "change")) == [(0, "a", "new"), (0, "b", "new"), (1, "b", "changed")]
    assert len(progress_report(query)) >= 2
    # A batch that runs again sees the state before it, not its own.
    assert {r["article_id"]: r["checksum"] for r in state_before(spark, f"{folder}/state", 1, seed).collect()}.keys() == {"a", "b", "s"}
    write_listings(spark, folder, ("a", "3"), ("c", "1"))
    run_changes(spark, folder, seed)
    out = spark.read.parquet(f"{folder}/out")
    assert rows(out.where("batch = 2").select("article_id", "change")) == [("a", "changed"), ("c", "new")]


def test_first_seen_rows(spark, tmp_path):
    folder = str(tmp_path)
    write_listings(spark, folder, ("a", "1"), ("a", "2"), ("b", "1"))
    write_listings(spark, folder, ("a", "9"), ("c", "1"))
    stream = listing_stream(spark, f"{folder}/in", LISTING, files_per_batch=1)
    first_seen(stream).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/p"
    ).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/out").select("article_id")) == [("a",), ("b",), ("c",)]


def test_first_seen_forgets_in_time_and_drops_late_rows(spark, tmp_path):
    folder, schema = str(tmp_path), "k string, ts timestamp"
    day = lambda n, hour=0: pd.Timestamp(f"2024-01-{n:02d}") + pd.Timedelta(hours=hour)
    for increment in (
        [("a", day(1)), ("a", day(1, 1)), ("b", day(1, 2))],
        [("a", day(1, 20)), ("c", day(4))],  # a is known still; the watermark is on the third day afterwards
        [("a", day(4, 1)), ("b", day(2)), ("c", day(4, 2))],  # a is new again, b is late, c is known
    ):
        rows_in = [(k, t.to_pydatetime()) for k, t in increment]
        spark.createDataFrame(rows_in, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = first_seen(spark.readStream.schema(schema).parquet(f"{folder}/in"), "k", "ts", "1 day")
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/p")
        writer.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.k, r.ts.day, r.ts.hour) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("a", 1, 0), ("a", 4, 1), ("b", 1, 2), ("c", 4, 0)]
    assert rows(remembered(spark, f"{folder}/p")) == [("a",), ("c",)]


def test_state_cache_answers_repeats(spark, tmp_path):
    folder = str(tmp_path)
    write_listings(spark, folder, ("k1", "first"), ("k2", "x"))
    write_listings(spark, folder, ("k1", "second"), ("k3", "y"))
    stream = listing_stream(spark, f"{folder}/in", LISTING, files_per_batch=1).select(
        F.col("article_id").alias("cache_key"), F.col("description").alias("answer")
    )
    serve(stream, f"{folder}/out", f"{folder}/p").awaitTermination()
    got = rows(spark.read.parquet(f"{folder}/out").select("cache_key", "answer", "cache_hit"))
    assert got == [("k1", "first", False), ("k1", "first", True), ("k2", "x", False), ("k3", "y", False)]


def test_cache_takes_the_newest_live_entry(spark):
    entry = lambda key, hours, reason: (key, (True, reason, None, None, None, None, None), (pd.Timestamp("2024-01-03") - pd.Timedelta(hours=hours)).to_pydatetime())
    cache = spark.createDataFrame([entry("k", 1, "new"), entry("k", 5, "old"), entry("gone", 48, "x"), entry("later", -1, "x")], VERDICT_CACHE)
    df = spark.createDataFrame([("k",), ("gone",), ("later",)], "cache_key string")
    got = {r["cache_key"]: r["verdict"] and r["verdict"]["reason"] for r in relevance.cache_lookup(df, cache, "2024-01-03").collect()}
    assert got == {"k": "new", "gone": None, "later": None}


def test_verdict_schema_matches_parser(spark):
    from parcelry.functions.verdict import with_strict_verdict

    df = spark.createDataFrame([("{}",)], "a string").withColumn("key", cache_key("a"))
    assert with_strict_verdict(df, "a").schema["verdict"].dataType.simpleString() == VERDICT.simpleString()


def cache_run(spark, folder, rows_in, life_ms):
    """One more increment through the cache, from the checkpoint of the runs before."""
    spark.createDataFrame(rows_in, "cache_key string, answer string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("cache_key string, answer string").parquet(f"{folder}/in")
    query = serve(stream, f"{folder}/out", f"{folder}/p", life_ms)
    query.awaitTermination()
    assert query.exception() is None
    return progress_report(query)


def test_state_cache_goes_on_after_a_restart_and_forgets_in_time(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    long, short = str(tmp_path / "long"), str(tmp_path / "short")
    for folder, life in ((long, 3_600_000), (short, 1)):
        cache_run(spark, folder, [("a", None), ("a", "one"), ("a", "two"), ("b", None)], life)
        cache_run(spark, folder, [("a", "three"), ("b", "late"), ("b", None), ("c", None)], life)
    got = {f: Counter(tuple(r) for r in spark.read.parquet(f"{f}/out").select("cache_key", "answer", "cache_hit").collect()) for f in (long, short)}
    first = Counter([("a", None, False), ("a", "one", False), ("a", "one", True), ("b", None, False)])
    later = [("b", "late", False), ("b", "late", True), ("c", None, False)]
    assert got[long] == first + Counter([("a", "one", True), *later])
    assert got[short] == first + Counter([("a", "three", False), *later])
    assert rows(held(spark, f"{long}/p")) == [("a", "one"), ("b", "late")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider and SETTINGS


def test_expired_verdicts_leave_the_state(spark, tmp_path):
    folder = str(tmp_path)
    for i in range(3):
        cache_run(spark, folder, [(f"k{i}-{j}", "x") for j in range(50)], 1)
    assert held(spark, f"{folder}/p").count() <= 100


def test_cache_is_not_called_for_each_key(spark, tmp_path, monkeypatch):
    folder, calls = str(tmp_path), tmp_path / "calls"

    class Noted(verdict_cache.VerdictCache):
        def handleInputRows(self, key, rows, timerValues):
            with open(calls, "a") as note:
                note.write(".")
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(verdict_cache, "VerdictCache", Noted)
    keys = [None, "", *map(str, range(1498))]
    cache_run(spark, folder, [(k, f"answer {k}") for k in keys] * 2, 3_600_000)
    assert len(calls.read_text()) <= 1024
    got = Counter(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("cache_key", "answer", "cache_hit").collect())
    assert got == Counter((k, f"answer {k}", hit) for k in keys for hit in (False, True))
    assert Counter(rows(held(spark, f"{folder}/p").fillna("null"))) == Counter(("null" if k is None else k, f"answer {k}") for k in keys)


def slow(prompts):
    time.sleep(0.1)
    return ["ok"] * len(prompts)


def hanging(prompts):
    if prompts.str.contains("hang").any():
        time.sleep(20)
    if prompts.str.contains("bad").any():
        raise RuntimeError("bad prompt")
    return ["ok"] * (len(prompts) + int(prompts.str.contains("short").any()))


def test_calls_side_by_side_take_less_time(spark):
    prompts = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(32)], "cache_key string, prompt string")

    def seconds(at_a_time):
        began = time.monotonic()
        caller = relevance.Caller(slow, batch_rows=1, partitions=1, at_a_time=at_a_time)
        assert Counter(r.answer for r in caller.answers(prompts).collect()) == {"ok": 32}
        return time.monotonic() - began

    seconds(8)  # the worker starts
    assert seconds(8) < seconds(1) / 2


def test_hanging_calls_are_given_up_and_keep_no_other_waiting(spark):
    texts = ["hang" if i in (3, 20) else "bad" if i == 9 else "short" if i == 30 else "fine" for i in range(40)]
    prompts = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "cache_key string, prompt string")
    caller = relevance.Caller(hanging, batch_rows=5, partitions=2, at_a_time=3, seconds=1.0)
    began = time.monotonic()
    got = {r.cache_key: (r.answer, r.call_error) for r in caller.answers(prompts).collect()}
    assert time.monotonic() - began < 15 and len(got) == 40
    errors = {"hang": "call timed out after 1 s", "bad": "bad prompt", "short": "2 answers to 1 prompts", "fine": None}
    for i, t in enumerate(texts):
        assert got[f"k{i}"] == ("ok" if t == "fine" else None, errors[t])
    judged = relevance.judged_answers(caller.answers(prompts), POLICIES["scheduled"]).collect()
    assert sum(r.call_failed for r in judged) == 4 and all(r.verdict.relevant for r in judged if r.call_failed)


def test_pool_bounds_calls_under_way():
    under_way, most, lock = [0], [0], threading.Lock()

    def call(job):
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        time.sleep(0.01)
        with lock:
            under_way[0] -= 1
        return job * 2

    read = []
    pool = relevance.CallPool(call, 3, 5.0)
    found = []
    for job, result, problem in pool.outcomes(read.append(i) or i for i in range(1, 30)):
        found.append((job, result))
        assert problem is None and len(read) <= len(found) + 3
    assert sorted(found) == [(i, 2 * i) for i in range(1, 30)] and most[0] <= 3


def test_trial_mode_takes_the_first_rows_only(spark):
    df = spark.createDataFrame([(f"{i:03d}", "lakás", "tulajdoni hányad" if i % 4 == 0 else f"szép {i}", 1e7) for i in range(60)], TEXT_SCHEMA).repartition(5)
    got = relevance.two_phase(df, relevance.Caller(yes), trial=relevance.Trial(rows=20, model_rows=6)).decided.collect()
    by_rules = sorted(r.article_id for r in got if r.filtered_by == "worker")
    assert by_rules == [f"{i:03d}" for i in range(0, 20, 4)]
    assert sorted(r.article_id for r in got if r.filtered_by == "llm") == ["001", "002", "003", "005", "006", "007"]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_documents_of_one_file_and_of_a_folder(spark, tmp_path, files):
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 30).cast("string")).alias("text"),
        F.lit("hu").alias("lang"), F.lit("web").alias("source"), F.lit(6).cast("long").alias("n_chars"),
    )
    folder = str(tmp_path / "folder") if files == 1 else str(tmp_path / "documents.parquet")
    docs.repartition(files).write.parquet(folder)
    if files == 1:
        (part,) = (tmp_path / "folder").glob("*.parquet")
        part.rename(tmp_path / "documents.parquet")
    assert text_queries.streaming_first_seen(spark, str(tmp_path)).distinct().count() == 30
    got = rows(text_queries.streaming_change_detection(spark, str(tmp_path)))
    want = rows(text_queries.change_detection(spark, str(tmp_path)).where("change <> 'unchanged'"))
    assert got == want and len(got) > 4


def test_a_commit_file_is_never_seen_without_its_name(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), CHECKSUM_STATE)
    seen, over = set(), threading.Event()

    def watch():
        while not over.is_set():
            for file in (tmp_path / "t" / "_versions").glob("0*"):
                seen.add((int(file.name), file.read_bytes().decode()))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        for number in range(1, 41):
            table._commit(number, f"rows-{number}")
    finally:
        over.set()
        watcher.join()
    assert seen and all(name == f"rows-{number}" for number, name in seen)
    with pytest.raises(sinks.Conflict):
        table._commit(7, "rows-other")
    assert table._folder(7) == "rows-7" and table.versions() == list(range(1, 41))
    assert not list((tmp_path / "t" / "_versions").glob("draft-*"))


def test_of_many_writers_one_commits_a_number(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), CHECKSUM_STATE)

    def commit(folder):
        try:
            table._commit(1, folder)
            return folder
        except sinks.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [f for f in pool.map(commit, [f"rows-{i}" for i in range(24)]) if f]
    assert won == [table._folder(1)]
