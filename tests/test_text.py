import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parcelry.functions import rules, text


def column(spark, values, expression, name="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


SAMPLES = [
    "  Test   Description  ",
    "Test Description",
    "a b c　d",
    "x\x1cy\x1fz\x0bw\x85v",
    "",
    " \n\t ",
    "ÁRVÍZTŰRŐ tükörfúrógép",
    "<script>alert(1)</script>",
    "A" * 100_000,
]


def test_normalise_equals_split_and_join(spark):
    assert column(spark, SAMPLES, text.normalise("x")) == [" ".join(s.lower().split()) for s in SAMPLES]


def test_strip_equals_python(spark):
    assert column(spark, SAMPLES, text.strip("x")) == [s.strip() for s in SAMPLES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x1c  é", max_size=30), min_size=20, max_size=40))
def test_normalise_on_generated_texts(spark, values):
    assert column(spark, values, text.normalise("x")) == [" ".join(s.lower().split()) for s in values]


def test_cache_key(spark):
    first, second = column(spark, SAMPLES[:2], text.cache_key("x"))
    assert first == second == "llm_cache:" + hashlib.sha256(b"test description").hexdigest()


def test_terms_are_words_then_pairs(spark):
    assert column(spark, ["egy két a három_4", "xy", "a b", ""], text.terms("x")) == [
        ["egy", "két", "három_4", "egy két", "két három_4"],
        ["xy"],
        [],
        [],
    ]


def test_previews(spark):
    values = ["short", "y" * 101, "", None]
    assert column(spark, values, text.preview_if_longer("x", 100, "none")) == ["short", "y" * 100 + "...", "none", "none"]
    assert column(spark, ["short"], text.preview("x", 150, "...")) == ["short..."]


@pytest.mark.parametrize(
    "seconds, shown",
    [(0.0, ""), (None, ""), (42.9, "42s"), (60.0, "1m 0s"), (187.2, "3m 7s"), (3600.0, "1h 0m"), (7530.0, "2h 5m")],
)
def test_duration(spark, seconds, shown):
    assert spark.createDataFrame([(seconds,)], "s double").select(text.duration("s")).first()[0] == shown


def test_numbers(spark):
    rows = spark.createDataFrame([(2.5,), (1234567.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(text.grouped_number("v", 0, " Ft")).collect()] == ["2 Ft", "1,234,567 Ft", "N/A"]
    assert rows.where("v > 1e6").select(text.millions("v")).first()[0] == "1.2"


def test_rate(spark):
    rows = spark.createDataFrame([(0.5,), (2.0,)], "v double")
    assert [r[0] for r in rows.select(text.rate("v")).collect()] == ["30.0 elem/perc", "2.00 elem/sec"]


# ---- Rules, against a direct reading with Python's own word boundaries ------------------------


def expected_reason(body):
    if re.search(r"osztatlan közös tulajdon.*?\d+/\d+", body):
        return rules.RULE_PREFIX + rules.FRACTION_REASON
    for keyword, reason in rules.EXCLUSION_KEYWORDS.items():
        word = rf"\b{re.escape(keyword)}\b"
        if not re.search(word, body):
            continue
        near = [rf"\b{re.escape(n)}\b.{{0,50}}{word}|{word}.{{0,50}}\b{re.escape(n)}\b" for n in rules.NEGATIONS]
        if not any(re.search(p, body) for p in near):
            return rules.RULE_PREFIX + reason
    return None


FILLER = "ez egy hosszú kitöltő szöveg amely távolságot teremt a szavak közé és nem mond semmit "
RULE_TEXTS = [
    "tulajdoni hányad eladó",
    "altulajdoni hányadok",
    "nincs haszonélvezet",
    "haszonélvezet nincs",
    "haszonélvezet\nnincs",
    "haszonélvezet. " + FILLER + "nincs",
    "haszonélvezet " + "x" * 48 + " nincs",
    "haszonélvezet " + "x" * 49 + " nincs",
    "haszonélvezet törölve, de a bérleti jog is eladó",
    "haszonélvezettel terhelt",
    "osztatlan közös tulajdon 475/1000 rész",
    "osztatlan közös tulajdon\n475/1000 rész",
    "osztatlan közös kertrész",
    "1/1 tulajdon, ingatlancsere",
    "cserélhető",
    "újcserélhető",
    "cserélném; per- és tehermentes",
    "haszonélvezet-nincs",
    "haszonélvezet törölve. " + FILLER + FILLER + " haszonélvezet",
    "önkormányzati ingatlan",
    "",
]


def test_rules_follow_word_boundaries(spark):
    assert column(spark, RULE_TEXTS, rules.exclusion_reason("x")) == [expected_reason(t) for t in RULE_TEXTS]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.lists(
            st.sampled_from(
                [*rules.EXCLUSION_KEYWORDS, *rules.NEGATIONS, "osztatlan közös tulajdon", "3/4", "lakás", "\n", ".", ",", "é"]
            ),
            max_size=7,
        ).map(" ".join),
        min_size=30,
        max_size=60,
    )
)
def test_rules_on_generated_texts(spark, values):
    assert column(spark, values, rules.exclusion_reason("x")) == [expected_reason(t) for t in values]


def test_earlier_rules(spark):
    values = [" csere is érdekel ", " haszonélvezet törölve, iroda ", " haszonélvezet ", " cseresznye "]
    assert column(spark, values, rules.earlier_exclusion_reason("x")) == [
        "Rule-based: Csere (nem eladás)",
        None,
        "Rule-based: Haszonélvezet",
        None,
    ]


def test_routed_text(spark):
    rows = spark.createDataFrame(
        [("A cím elég hosszú", "rövid"), ("cím", "rövid"), ("cím", "x" * 100), (None, None)], "t string, d string"
    )
    assert [r[0] for r in rows.select(rules.routed_text("t", "d")).collect()] == [
        "Cím: A cím elég hosszú\n",
        None,
        "x" * 100,
        None,
    ]


def test_checksum_is_stable_and_price_sensitive(spark):
    rows = spark.createDataFrame([("d", "t", 45000000.0), ("d", "t", 46000000.0), (None, "t", float("nan"))], "d string, t string, p double")
    fields = [("d", "string"), ("t", "string"), ("p", "double")]
    first, second, third = [r[0] for r in rows.select(text.row_checksum(fields)).collect()]
    assert first == hashlib.sha256(b"dt45000000.0").hexdigest() and first != second
    assert third == hashlib.sha256(b"t").hexdigest()


def test_checksum_sees_the_whole_number(spark):
    values = [45.121, 45.124, 0.0, 12345678.5, 1e-12, 2e30]
    rows = spark.createDataFrame([(v,) for v in values], "p double")
    shown = [r[0] for r in rows.select(text.stable_string("p", "double")).collect()]
    assert shown[:4] == ["45.121", "45.124", "0.0", "12345678.5"] and [float(s) for s in shown] == values


def test_delimiter_tells_neighbouring_fields_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc")], "d string, t string")
    fields = [("d", "string"), ("t", "string")]
    plain = {r[0] for r in rows.select(text.row_checksum(fields)).collect()}
    separated = {r[0] for r in rows.select(text.row_checksum(fields, "\x1f")).collect()}
    assert len(plain) == 1 and len(separated) == 2


def test_combined_text(spark):
    rows = spark.createDataFrame([(None, "x "), ("a", None)], "t string, d string")
    assert [r[0] for r in rows.select(text.combined_text("t", F.col("d"))).collect()] == ["x", "a"]
