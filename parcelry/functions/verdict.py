"""Model answers (free text around JSON) to typed verdict columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parcelry.functions.text import as_col, strip
from parcelry.schema import BUILDING_TYPES, FLOOR_RANGE, PROPERTY_CATEGORIES, VERDICT

# Reasons given when an answer cannot be used.
NO_OBJECT = "Hibás LLM válasz formátum (alapértelmezés: relevant)"
BAD_JSON = "Hibás JSON formátum (alapértelmezés: relevant)"
INVALID_PREFIX = "Validációs hiba (alapértelmezés: relevant): "
NO_REASON = "No reason provided in JSON."

# Words and numbers a strict boolean field takes besides true and false.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


@dataclass(frozen=True)
class FailurePolicy:
    """What ``relevant`` becomes when the answer is unusable or the call itself failed."""

    on_parse_error: bool
    on_call_error: bool


# The five call paths differ only in these two switches.
POLICIES = {
    "live": FailurePolicy(on_parse_error=True, on_call_error=False),
    "batch": FailurePolicy(on_parse_error=True, on_call_error=False),
    "scheduled": FailurePolicy(on_parse_error=True, on_call_error=True),
    "earlier": FailurePolicy(on_parse_error=False, on_call_error=False),
    "async": FailurePolicy(on_parse_error=False, on_call_error=False),
}


def outer_object(text: str | Column) -> Column:
    """From the first opening to the last closing brace; null when there is no such span."""
    found = F.regexp_extract(as_col(text), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def outer_array(text: str | Column) -> Column:
    found = F.regexp_extract(as_col(text), r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def strip_fences(text: str | Column) -> Column:
    """Content of a leading fenced block, without its ``json`` tag; other text only trimmed."""
    trimmed = strip(text)
    inside = F.split(trimmed, "```", -1)[1]
    untagged = F.when(inside.startswith("json"), strip(F.substring(inside, 5, 2_147_483_647))).otherwise(inside)
    return F.when(trimmed.startswith("```"), untagged).otherwise(trimmed)


def parse_json(text: str | Column) -> Column:
    """Variant of ``text`` wrapped in a one-element array, or null.

    The parser stops after the first complete value, so trailing text would pass. Wrapping the text
    once as array element and once as object member leaves no trailing text that fits both.
    """
    text = as_col(text)
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(as_member.isNotNull(), as_element)


_MEMBERS = "struct<" + ",".join(f"{f.name}:variant" for f in VERDICT.fields) + ">"


class _Member:
    """One member of the parsed answer, held in three plain columns.

    ``kind`` is STRING, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, ARRAY<..> or OBJECT<..>, and null when
    the member is absent or JSON null.
    """

    def __init__(self, name: str):
        self.raw = F.col(f"_members.{name}")
        self.kind, self.text = F.col(f"_kind_{name}"), F.col(f"_text_{name}")
        self.number = self.text.try_cast("double")
        self.is_number = self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")
        self.is_text = self.kind == "STRING"
        self.is_flag = self.kind == "BOOLEAN"
        self.absent = self.kind.isNull()

    @staticmethod
    def columns(name: str) -> dict[str, Column]:
        raw = F.col(f"_members.{name}")
        kind = F.schema_of_variant(raw)
        return {f"_kind_{name}": F.when(kind != "VOID", kind), f"_text_{name}": F.try_variant_get(raw, "$", "string")}


def _open(df: DataFrame, body: Column) -> DataFrame:
    """Adds ``_body``, ``_parsed`` and the member columns.

    Each step is its own projection: later steps refer to a step's result several times, and Spark
    keeps such projections apart, so an answer is parsed once.
    """
    opened = df.withColumn("_body", body).withColumn("_parsed", parse_json(F.col("_body")))
    opened = opened.withColumn("_sole", F.try_variant_get("_parsed", "$[1]", "variant").isNull())
    opened = opened.withColumn(
        "_members", F.when(F.col("_sole"), F.try_variant_get("_parsed", "$[0]", _MEMBERS))
    )
    extra = {}
    for field in VERDICT.fields:
        extra.update(_Member.columns(field.name))
    return opened.withColumns(extra)


def _close(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_body", "_parsed", "_sole", "_members", "_kind_", "_text_", "_ok_", "_val_"))], "_failed")


def _strict_bool(member: _Member) -> Column:
    word = F.lower(member.text)
    return (
        F.when(member.is_flag, member.text == "true")
        .when(member.is_text & word.isin(*TRUE_WORDS), F.lit(True))
        .when(member.is_text & word.isin(*FALSE_WORDS), F.lit(False))
        .when(member.is_number & (member.number == 1), F.lit(True))
        .when(member.is_number & (member.number == 0), F.lit(False))
    )


def _strict_int(member: _Member) -> Column:
    """Integers, integral decimals and strings of either sort, within the floor range."""
    digits = strip(member.text)
    value = (
        F.when(member.is_number, member.number)
        .when(member.is_text & digits.rlike(r"^[+-]?[0-9]+(\.0+)?$"), digits.try_cast("double"))
        .when(member.is_flag, (member.text == "true").cast("double"))
    )
    return F.when((value == F.floor(value)) & value.between(*FLOOR_RANGE), value.cast("int"))


def _strict_text(member: _Member) -> Column:
    return F.when(member.is_text, member.text)


def _strict_choice(member: _Member, choices: tuple[str, ...]) -> Column:
    return F.when(member.is_text & member.text.isin(*choices), member.text)


def _struct(relevant: Column, reason: Column, **extra: Column) -> Column:
    members = [relevant.cast("boolean").alias("relevant"), reason.alias("reason")]
    for field in VERDICT.fields[2:]:
        value = extra.get(field.name, F.lit(None))
        members.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*members)


def _judge(opened: DataFrame) -> DataFrame:
    """Adds a typed ``_val_`` column per member and ``_failed``, the names of the invalid ones."""
    members = {f.name: _Member(f.name) for f in VERDICT.fields}
    values = {
        "relevant": _strict_bool(members["relevant"]),
        "reason": _strict_text(members["reason"]),
        "floor": _strict_int(members["floor"]),
        "street": _strict_text(members["street"]),
        "building_type": _strict_choice(members["building_type"], BUILDING_TYPES),
        "property_category": _strict_choice(members["property_category"], PROPERTY_CATEGORIES),
        "has_terrace": _strict_bool(members["has_terrace"]),
    }
    judged = opened.withColumns({f"_val_{name}": value for name, value in values.items()})
    required = ("relevant", "reason")
    broken = [
        F.when(
            F.col(f"_val_{name}").isNull() if name in required else F.col(f"_val_{name}").isNull() & ~member.absent,
            F.lit(name),
        )
        for name, member in members.items()
    ]
    return judged.withColumn("_failed", F.array_join(F.array(*broken), ","))


def _accepted() -> Column:
    value = {f.name: F.col(f"_val_{f.name}") for f in VERDICT.fields}
    value["street"] = F.when(strip(value["street"]) != "", value["street"])
    return _struct(**value)


def with_strict_verdict(
    df: DataFrame,
    answer: str | Column,
    policy: FailurePolicy = POLICIES["live"],
    into: str = "verdict",
) -> DataFrame:
    """Adds the validated verdict of an answer: one bad field voids the whole answer.

    The reason of a refused answer lists the offending fields. A null answer reads as one without an
    object.
    """
    judged = _judge(_open(df, outer_object(answer)))
    default = F.lit(policy.on_parse_error)
    verdict = (
        F.when(F.col("_body").isNull(), _struct(default, F.lit(NO_OBJECT)))
        .when(F.col("_members").isNull(), _struct(default, F.lit(BAD_JSON)))
        .when(F.col("_failed") == "", _accepted())
        .otherwise(_struct(default, F.concat(F.lit(INVALID_PREFIX), F.col("_failed"))))
    )
    return _close(judged.withColumn(into, verdict))


def with_member_verdict(df: DataFrame, member: str, into: str = "verdict") -> DataFrame:
    """Adds the verdict of one batch member, which is JSON or null; null stays null."""
    judged = _judge(_open(df, F.col(member)))
    refused = _struct(F.lit(True), F.concat(F.lit(INVALID_PREFIX), F.col("_failed")))
    verdict = F.when(
        F.col("_body").isNotNull(), F.when(F.col("_failed") == "", _accepted()).otherwise(refused)
    )
    return _close(judged.withColumn(into, verdict))


def _truthy(member: _Member) -> Column:
    """Truth value of any JSON member: empty text, zero, null and empty containers are false."""
    return (
        F.when(member.absent, F.lit(False))
        .when(member.is_flag, member.text == "true")
        .when(member.is_text, member.text != "")
        .when(member.is_number, member.number != 0)
        .otherwise(~F.to_json(member.raw).isin("[]", "{}"))
    )


def _plain(member: _Member) -> Column:
    """Text of any member: null reads None, booleans are capitalised, containers stay JSON."""
    return (
        F.when(member.absent, F.lit("None"))
        .when(member.is_flag, F.initcap(member.text))
        .otherwise(F.coalesce(member.text, F.to_json(member.raw)))
    )


def with_lenient_verdict(df: DataFrame, answer: str, into: str = "verdict") -> DataFrame:
    """Earlier reading: bad floors become null, anything truthy counts, unusable answers are irrelevant."""
    opened = _open(df, outer_object(answer))
    member = {f.name: _Member(f.name) for f in VERDICT.fields}
    level = member["floor"]
    floor = (
        F.when(level.is_number, level.number.cast("int"))
        .when(level.is_text & strip(level.text).rlike(r"^[+-]?[0-9]+$"), strip(level.text).try_cast("int"))
        .when(level.is_flag, (level.text == "true").cast("int"))
    )
    optional = {
        name: F.when(_truthy(member[name]), _plain(member[name]))
        for name in ("street", "building_type", "property_category")
    }
    terrace = member["has_terrace"]
    reason = F.when(member["reason"].raw.isNull(), F.lit(NO_REASON)).otherwise(_plain(member["reason"]))
    usable = _struct(
        _truthy(member["relevant"]),
        reason,
        floor=floor,
        has_terrace=F.when(~terrace.absent, _truthy(terrace)),
        **optional,
    )
    raw = as_col(answer)
    verdict = (
        F.when(F.col("_body").isNull(), _struct(F.lit(False), F.concat(F.lit("No JSON object found in response: "), raw)))
        .when(F.col("_members").isNull(), _struct(F.lit(False), F.concat(F.lit("Invalid JSON in response: "), raw)))
        .otherwise(usable)
    )
    return _close(opened.withColumn(into, verdict))


def with_batch_members(df: DataFrame, answer: str, size: int = 3, into: str = "parts") -> DataFrame:
    """Adds the members of an answer to ``size`` listings as JSON strings, or null when it has another size."""
    parsed = df.withColumn("_parsed", parse_json(outer_array(answer))).withColumn(
        "_members", F.try_variant_get("_parsed", "$[0]", "array<variant>")
    )
    sole = F.try_variant_get("_parsed", "$[1]", "variant").isNull()
    members = F.when(sole & (F.size("_members") == size), F.transform("_members", lambda m: F.to_json(m)))
    return parsed.withColumn(into, members).drop("_parsed", "_members")


def failed_call(message: Column, policy: FailurePolicy = POLICIES["live"]) -> Column:
    return _struct(F.lit(policy.on_call_error), F.concat(F.lit("LLM hívás sikertelen: "), message))
