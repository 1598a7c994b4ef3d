"""One question in SQL over given tables, judged by its parsed plan before anything is looked up."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Plan nodes that only read and shape rows, by the last part of their class.
PLANS = set(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Join Union Distinct Deduplicate Except Intersect SubqueryAlias "
    "LocalRelation OneRowRelation Generate Pivot Unpivot WithWindowDefinition UnresolvedWith UnresolvedHaving UnresolvedRelation "
    "UnresolvedInlineTable UnresolvedSubqueryColumnAliases Sample LateralJoin".split()
)
#: Parts of the parsed query that are neither plan nodes nor expressions of their own package.
UNRESOLVED = set(
    "UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias UnresolvedFunction UnresolvedOrdinal "
    "UnresolvedExtractValue UnresolvedGenerator UnresolvedRegex UnresolvedWindowExpression UnresolvedDeserializer MultiAlias GroupByAll".split()
)
#: Functions that a question may call.
FUNCTIONS = set(
    "abs ceil ceiling floor round bround sqrt power pow exp ln log log10 log2 sign mod pmod greatest least rand "
    "sum avg mean count min max count_if any every some bool_and bool_or any_value first last median mode percentile "
    "percentile_approx approx_count_distinct stddev stddev_pop stddev_samp variance var_pop var_samp corr covar_pop covar_samp skewness "
    "kurtosis collect_list collect_set array_agg max_by min_by grouping grouping_id regr_slope regr_intercept regr_r2 "
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value "
    "lower upper trim ltrim rtrim length char_length substr substring left right concat concat_ws replace translate split like rlike "
    "regexp regexp_replace regexp_extract regexp_like contains startswith endswith instr locate position lpad rpad reverse repeat initcap "
    "format_number string cast try_cast int bigint double float decimal boolean date timestamp "
    "coalesce nvl ifnull nullif nullifzero zeroifnull if isnull isnotnull isnan in "
    "date_trunc trunc year quarter month week day dayofmonth dayofweek dayofyear hour minute second date_add date_sub datediff "
    "date_diff add_months months_between last_day to_date to_timestamp date_format current_date current_timestamp now extract date_part make_date "
    "array map struct named_struct size cardinality explode posexplode inline sequence array_contains array_sort sort_array element_at "
    "flatten array_distinct array_join filter transform exists forall aggregate not and or between".split()
)


class NotASelect(ValueError):
    """The console got something other than one query over its tables."""


def parts(node) -> Iterator[dict]:
    """Every tree node of a plan's JSON form, those inside of expressions and common tables included."""
    if isinstance(node, list):
        for part in node:
            yield from parts(part)
    elif isinstance(node, dict):
        if "class" in node:
            yield node
        for value in node.values():
            yield from parts(value)


def common_tables(node) -> Iterator[str]:
    for part in parts(node):
        for relation in part.get("cteRelations", ()):
            yield relation["_1"].lower()


def names_of(text: str) -> list[str]:
    return [p.strip() for p in text.strip("[]").split(",")]


def check(spark: SparkSession, text: str, tables: set[str]) -> None:
    """Raise unless ``text`` is one query over ``tables`` (in lower case) that calls listed functions only."""
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as problem:
        raise NotASelect("only a single SELECT is accepted") from problem
    plan = json.loads(parsed.toJSON())
    own = set(common_tables(plan))
    # A common table must not stand in for a stored one where it is out of scope.
    hidden = [name for name in own - tables if spark.catalog.tableExists(name)]
    if hidden:
        raise NotASelect(f"{hidden[0]} is the name of another table")
    for part in parts(plan):
        package, _, kind = part["class"].rstrip("$").rpartition(".")
        if kind == "UnresolvedRelation":
            name = names_of(part["multipartIdentifier"])
            if len(name) > 1 or name[0].lower() not in tables | own:
                raise NotASelect(f"unknown table {'.'.join(name)}")
        elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = names_of(part["nameParts"]) if "nameParts" in part else [part["name"]["funcName"]]
            if len(name) > 1 or name[0].lower() not in FUNCTIONS:
                raise NotASelect(f"function {'.'.join(name)} is not available")
        elif kind not in PLANS | UNRESOLVED and not package.endswith(".catalyst.expressions") and ".catalyst.expressions." not in package:
            raise NotASelect(f"only a single SELECT is accepted, without {kind}")


def run_console(spark: SparkSession, tables: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Run one query over the named tables.

    The parsed, unresolved plan must consist of reading steps alone, and name no other table, file or
    function than the given and listed ones; this is judged before analysis could run anything.
    """
    body = text.strip().rstrip(";").strip()
    check(spark, body, {name.lower() for name in tables})
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(body)
