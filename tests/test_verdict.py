import json

import pytest

from parcelry.functions import verdict

FULL = {
    "relevant": True,
    "reason": "ok",
    "floor": 3,
    "street": "Kossuth utca",
    "building_type": "tegla",
    "property_category": "lakas",
    "has_terrace": False,
}


def parse(spark, answer, how=verdict.with_strict_verdict, **options):
    rows = spark.createDataFrame([(answer,)], "a string")
    return how(rows, "a", **options).select("verdict.*").first().asDict()


def test_full_answer(spark):
    assert parse(spark, "Here: " + json.dumps(FULL) + " end") == FULL


@pytest.mark.parametrize(
    "change, field, value",
    [
        ({"floor": "5"}, "floor", 5),
        ({"floor": " -5 "}, "floor", -5),
        ({"floor": 5.0}, "floor", 5),
        ({"floor": True}, "floor", 1),
        ({"street": "   "}, "street", None),
        ({"street": None}, "street", None),
        ({"relevant": "no"}, "relevant", False),
        ({"relevant": 1}, "relevant", True),
        ({"has_terrace": "On"}, "has_terrace", True),
    ],
)
def test_accepted_spellings(spark, change, field, value):
    assert parse(spark, json.dumps({**FULL, **change})) == {**FULL, field: value}


@pytest.mark.parametrize(
    "change, named",
    [
        ({"floor": 51}, "floor"),
        ({"floor": "x"}, "floor"),
        ({"floor": 2.5}, "floor"),
        ({"floor": [1]}, "floor"),
        ({"building_type": "tégla"}, "building_type"),
        ({"property_category": 1}, "property_category"),
        ({"relevant": None}, "relevant"),
        ({"relevant": 2}, "relevant"),
        ({"reason": None}, "reason"),
        ({"reason": 5}, "reason"),
        ({"street": 7}, "street"),
        ({"has_terrace": "maybe", "floor": 99}, "floor,has_terrace"),
    ],
)
def test_one_bad_field_voids_the_answer(spark, change, named):
    got = parse(spark, json.dumps({**FULL, **change}))
    assert got["relevant"] is True and got["reason"] == verdict.INVALID_PREFIX + named
    assert all(got[f] is None for f in ("floor", "street", "building_type", "property_category", "has_terrace"))


@pytest.mark.parametrize(
    "answer, reason",
    [
        ("nothing here", verdict.NO_OBJECT),
        (None, verdict.NO_OBJECT),
        ('{"relevant": true, }', verdict.BAD_JSON),
        ('{"relevant": true, "reason": "a"} {"relevant": false}', verdict.BAD_JSON),
        ('{"relevant": true, "reason": "a"}, {"relevant": false}', verdict.BAD_JSON),
        ('{"relevant": true, "reason": "a"}] }', verdict.BAD_JSON),
        ('{"relevant": true, "reason": "a"}} {"b": 1}', verdict.BAD_JSON),
    ],
)
def test_unusable_answers(spark, answer, reason):
    assert parse(spark, answer)["reason"] == reason


def test_policies(spark):
    for name, policy in verdict.POLICIES.items():
        assert parse(spark, "none", policy=policy)["relevant"] is policy.on_parse_error, name


def test_lenient(spark):
    how = verdict.with_lenient_verdict
    assert parse(spark, '{"relevant": "x", "floor": "a"}', how)["floor"] is None
    got = parse(spark, '{"relevant": [], "reason": null, "floor": 2.9, "building_type": "", "has_terrace": 0}', how)
    assert got["relevant"] is False and got["reason"] == "None" and got["floor"] == 2
    assert got["building_type"] is None and got["has_terrace"] is False
    assert parse(spark, "{}", how)["reason"] == verdict.NO_REASON
    assert parse(spark, "no", how)["reason"] == "No JSON object found in response: no"


def test_fences(spark):
    rows = spark.createDataFrame([('```json\n{"a": 1}\n``` trailing {}',), ('{"a": 2}',)], "a string")
    assert [r[0].strip() for r in rows.select(verdict.strip_fences("a")).collect()] == ['{"a": 1}', '{"a": 2}']


def test_batch_members_need_the_exact_count(spark):
    rows = spark.createDataFrame([('x [{"a":1},{"a":2},{"a":3}] y',), ("[1,2]",), ("[1,2,",), ("[1,2,3] [4]",)], "a string")
    got = [r["parts"] for r in verdict.with_batch_members(rows, "a").collect()]
    assert got == [['{"a":1}', '{"a":2}', '{"a":3}'], None, None, None]
