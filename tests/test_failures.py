"""Failed model calls, unreadable tables and divisions by zero."""

import pytest
from pyspark.sql import functions as F

from parcelry.operators.contracts import with_violations
from parcelry.operators.metrics import regression_metrics
from parcelry.operators.relevance import Caller
from parcelry.schema import FEEDBACK
from parcelry.sinks.tables import VersionedTable


def picky_model(prompts):
    """Fails a whole batch if one prompt is bad."""
    if prompts.str.contains("bad").any():
        raise RuntimeError("bad prompt")
    return ["ok"] * len(prompts)


def test_one_failed_call_leaves_the_others_of_its_batch_alone(spark):
    prompts = spark.createDataFrame([(f"k{i}", "bad" if i == 7 else f"p{i}") for i in range(40)], "cache_key string, prompt string")
    got = {r.cache_key: (r.answer, r.call_error) for r in Caller(picky_model, partitions=1).answers(prompts).collect()}
    assert got.pop("k7") == (None, "bad prompt")
    assert set(got.values()) == {("ok", None)} and len(got) == 39


def test_unreadable_table_is_not_taken_for_an_empty_one_when_merging(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), FEEDBACK)
    assert table.read().count() == 0
    table.reset()
    (broken,) = (tmp_path / "t").glob("rows-*")
    for part in broken.glob("*.parquet"):
        part.write_bytes(b"no table")
    for check in broken.glob(".*.crc"):
        check.write_bytes(b"")
    with pytest.raises(Exception, match="(?i)parquet"):
        table.read().collect()


def test_equal_actual_values_have_no_r2(spark):
    scored = spark.createDataFrame([(1.0, 1.5)], "label double, prediction double")
    row = regression_metrics(scored).first()
    assert row.test_r2 is None and row.test_mae_log == 0.5


def test_a_price_that_is_no_number_is_not_out_of_range(spark):
    rows = spark.range(1).select(F.lit("a").alias("article_id"), F.lit(float("nan")).alias("price_huf"))
    assert with_violations(rows).first().violations == []
