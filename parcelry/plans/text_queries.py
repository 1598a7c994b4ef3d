"""Queries over listing texts: keys, rules, verdicts, change detection, caching, relevance."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.functions import rules, text, verdict
from parcelry.operators import dedup, geo, incremental, relevance, stats
from parcelry.plans.bindings import (
    ANSWERS_SQL,
    ARTICLES_SQL,
    LISTINGS_SQL,
    TIE_BREAK,
    answers,
    article_columns,
    articles,
    listings,
    table,
)
from parcelry.plans.registry import Registry, rounded
from parcelry.schema import VERDICT
from parcelry.session import ensure_checkpoint_dir
from parcelry.sinks.tables import VersionedTable, merge_table, write_features
from parcelry.sources import text_files
from parcelry.streaming import verdict_cache
from parcelry.streaming.incremental import detect_changes, first_seen, remembered
from parcelry.streaming.progress import progress_report

registry = Registry()
query = registry.query

RUN_AS_OF = "2024-02-01"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# White space spelt out for RE2, whose own class is ASCII only.
_SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _normal(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '{_SPACE}+', ' ', 'g'))"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


# ---- Keys, previews, checksums --------------------------------------------------------------


@query(
    f"WITH {ARTICLES_SQL} SELECT article_id, {_normal('description')} AS normalised, "
    f"'llm_cache:' || sha256({_normal('description')}) AS cache_key FROM articles"
)
def text_normalise_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(
        "article_id", text.normalise("description").alias("normalised"), text.cache_key("description").alias("cache_key")
    )


@query(
    f"""WITH {ARTICLES_SQL} SELECT article_id, substr(description, 1, 150) || '...' AS table_preview,
       substr(description, 1, 500) AS review_preview,
       CASE WHEN description IS NULL OR description = '' THEN 'Nincs leírás'
            WHEN length(description) > 100 THEN substr(description, 1, 100) || '...' ELSE description END AS map_preview,
       {_strip("coalesce(title, '') || ' ' || coalesce(description, '')")} AS combined FROM articles"""
)
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(
        "article_id",
        text.preview("description", 150, "...").alias("table_preview"),
        text.preview("description", 500).alias("review_preview"),
        text.preview_if_longer("description", 100, "Nincs leírás").alias("map_preview"),
        text.combined_text("title", "description").alias("combined"),
    )


def _checksum_sql(description: str = "description") -> str:
    return (
        f"sha256(concat_ws('', {description}, title, CAST(CAST(price_huf AS DOUBLE) AS VARCHAR), "
        "CAST(CAST(area_sqm AS DOUBLE) AS VARCHAR), district))"
    )


@query(f"WITH {ARTICLES_SQL} SELECT article_id, {_checksum_sql()} AS checksum FROM articles")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.with_checksum(articles(spark, sf_dir)).select("article_id", "checksum")


# ---- Rules ----------------------------------------------------------------------------------


def _rule_sql(source: str, chosen: rules.RuleSet) -> str:
    branches = []
    if chosen.first_pattern:
        branches.append(
            f"WHEN regexp_matches({source}, {_quoted(chosen.first_pattern)}) "
            f"THEN {_quoted(chosen.prefix + chosen.first_reason)}"
        )
    for keyword, reason in chosen.keywords.items():
        test = f"regexp_matches({source}, {_quoted(rules.whole_word_pattern(keyword))})"
        if chosen.negations:
            near = rules.near_pattern(keyword, chosen.negations, chosen.window)
            test += f" AND NOT regexp_matches({source}, {_quoted(near)})"
        branches.append(f"WHEN {test} THEN {_quoted(chosen.prefix + reason)}")
    return "CASE " + "\n ".join(branches) + " END"


RULED_SQL = f"""{ARTICLES_SQL}, texts AS (
  SELECT *, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS body,
         concat_ws(',', CASE WHEN price_huf < 0 OR price_huf > 10000000000 THEN 'price_huf out of range' END,
                   CASE WHEN area_sqm < 10 OR area_sqm > 1000 THEN 'area_sqm out of range' END) AS broken FROM articles
), fired AS (SELECT *, CASE WHEN broken = '' THEN {_rule_sql('body', rules.CURRENT_RULES)} END AS excluded FROM texts
), ruled AS (
  SELECT *, CASE WHEN broken <> '' THEN true WHEN excluded IS NOT NULL THEN false END AS relevant,
         CASE WHEN broken <> '' THEN {_quoted(verdict.INVALID_PREFIX)} || broken
              ELSE coalesce(excluded, {_quoted(rules.UNDECIDED_REASON)}) END AS reason,
         broken = '' AND excluded IS NULL AS needs_llm FROM fired)
"""


@query(f"WITH {RULED_SQL} SELECT article_id, relevant, reason, needs_llm FROM ruled")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = relevance.classify_by_rules(articles(spark, sf_dir))
    return ruled.select("article_id", "relevant", "reason", "needs_llm")


_EARLIER = rules.RuleSet(rules.EARLIER_KEYWORDS, prefix=rules.EARLIER_PREFIX)
_NEGATED_SQL = " OR ".join(f"contains(body, '{n}')" for n in rules.EARLIER_NEGATIONS)


@query(
    f"""WITH {ARTICLES_SQL}, routed AS (
  SELECT *, CASE WHEN length({_strip('description')}) >= 100 THEN description
                 WHEN length({_strip('title')}) > 10 THEN 'Cím: ' || title || chr(10) END AS model_text FROM articles
), texts AS (SELECT *, lower(' ' || model_text || ' ') AS body FROM routed
), fired AS (
  SELECT *, CASE WHEN NOT (contains(body, '{rules.EARLIER_AMBIGUOUS}') AND ({_NEGATED_SQL}))
                 THEN {_rule_sql('body', _EARLIER)} END AS excluded FROM texts)
SELECT article_id, model_text,
       CASE WHEN model_text IS NULL THEN true WHEN excluded IS NOT NULL THEN false END AS relevant,
       CASE WHEN model_text IS NULL THEN '{rules.SHORT_TEXT_REASON}' ELSE excluded END AS reason,
       model_text IS NOT NULL AND excluded IS NULL AS needs_llm FROM fired"""
)
def rule_classify_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = relevance.classify_by_earlier_rules(articles(spark, sf_dir))
    return ruled.select("article_id", "model_text", "relevant", "reason", "needs_llm")


# ---- Verdicts -------------------------------------------------------------------------------

_TRUE_SQL = ", ".join(f"'{w}'" for w in verdict.TRUE_WORDS)
_FALSE_SQL = ", ".join(f"'{w}'" for w in verdict.FALSE_WORDS)
_NUMBER_KINDS = "('UBIGINT', 'BIGINT', 'DOUBLE')"


def _bool_sql(name: str) -> str:
    kind, value = f"json_type(j, '$.{name}')", f"lower(j->>'$.{name}')"
    return (
        f"CASE WHEN {kind} = 'BOOLEAN' THEN {value} = 'true' "
        f"WHEN {kind} = 'VARCHAR' AND {value} IN ({_TRUE_SQL}) THEN true "
        f"WHEN {kind} = 'VARCHAR' AND {value} IN ({_FALSE_SQL}) THEN false "
        f"WHEN {kind} IN {_NUMBER_KINDS} AND TRY_CAST({value} AS DOUBLE) = 1 THEN true "
        f"WHEN {kind} IN {_NUMBER_KINDS} AND TRY_CAST({value} AS DOUBLE) = 0 THEN false END"
    )


def _absent_sql(name: str) -> str:
    return f"coalesce(json_type(j, '$.{name}'), 'NULL') = 'NULL'"


def _strict_sql(source: str) -> str:
    """CTEs from ``body`` (JSON text or null) to the validated verdict; needs ``id`` and ``body``."""
    enum = {"building_type": "'tegla', 'panel', 'egyeb'", "property_category": "'lakas', 'haz'"}
    checks = {
        "relevant": "flag IS NOT NULL",
        "reason": "json_type(j, '$.reason') = 'VARCHAR'",
        "floor": f"({_absent_sql('floor')} OR coalesce(level BETWEEN -5 AND 50, false))",
        "street": f"({_absent_sql('street')} OR json_type(j, '$.street') = 'VARCHAR')",
        **{n: f"({_absent_sql(n)} OR coalesce(j->>'$.{n}' IN ({e}), false))" for n, e in enum.items()},
        "has_terrace": f"({_absent_sql('has_terrace')} OR terrace IS NOT NULL)",
    }
    failed = ", ".join(f"CASE WHEN NOT coalesce({test}, false) THEN '{name}' END" for name, test in checks.items())
    return f"""parsed AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM {source}
), typed AS (
  SELECT *, {_bool_sql('relevant')} AS flag, {_bool_sql('has_terrace')} AS terrace,
         CASE WHEN json_type(j, '$.floor') IN {_NUMBER_KINDS} AND CAST(j->>'$.floor' AS DOUBLE) = floor(CAST(j->>'$.floor' AS DOUBLE))
              THEN CAST(j->>'$.floor' AS DOUBLE)
              WHEN json_type(j, '$.floor') = 'VARCHAR' AND regexp_matches(j->>'$.floor', '^[+-]?[0-9]+(\\.0+)?$')
              THEN TRY_CAST(j->>'$.floor' AS DOUBLE) END AS level FROM parsed
), checked AS (SELECT *, concat_ws(',', {failed}) AS failed FROM typed
), strict AS (
  SELECT *, body IS NOT NULL AND j IS NOT NULL AND failed = '' AS sound FROM checked)
"""


_STRICT_COLUMNS = f"""CASE WHEN sound THEN flag ELSE true END AS relevant,
  CASE WHEN body IS NULL THEN {_quoted(verdict.NO_OBJECT)} WHEN j IS NULL THEN {_quoted(verdict.BAD_JSON)}
       WHEN failed <> '' THEN {_quoted(verdict.INVALID_PREFIX)} || failed ELSE j->>'$.reason' END AS reason,
  CASE WHEN sound THEN CAST(level AS INTEGER) END AS floor,
  CASE WHEN sound AND trim(j->>'$.street') <> '' THEN j->>'$.street' END AS street,
  CASE WHEN sound THEN j->>'$.building_type' END AS building_type,
  CASE WHEN sound THEN j->>'$.property_category' END AS property_category,
  CASE WHEN sound THEN terrace END AS has_terrace"""
_BODY_SQL = r"bodies AS (SELECT doc_id, nullif(regexp_extract(answer, '(?s)\{.*\}'), '') AS body FROM answers)"


@query(f"WITH {ANSWERS_SQL}, {_BODY_SQL}, {_strict_sql('bodies')} SELECT doc_id, {_STRICT_COLUMNS} FROM strict")
def verdict_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.with_strict_verdict(answers(spark, sf_dir), "answer").select("doc_id", "verdict.*")


@query(
    f"""WITH {ANSWERS_SQL}, bodies AS (
  SELECT doc_id, nullif(regexp_extract(CASE WHEN starts_with({_strip('answer')}, '```')
           THEN {_strip("substr(split_part(answer, '```', 2), 5)")} ELSE {_strip('answer')} END, '(?s)\\{{.*\\}}'), '') AS body
  FROM answers), {_strict_sql('bodies')} SELECT doc_id, {_STRICT_COLUMNS} FROM strict"""
)
def verdict_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    unwrapped = answers(spark, sf_dir).withColumn("answer", verdict.strip_fences("answer"))
    return verdict.with_strict_verdict(unwrapped, "answer", verdict.POLICIES["scheduled"]).select("doc_id", "verdict.*")


def _truthy_sql(name: str) -> str:
    kind, value = f"json_type(j, '$.{name}')", f"(j->>'$.{name}')"
    return (
        f"CASE WHEN {_absent_sql(name)} THEN false WHEN {kind} = 'BOOLEAN' THEN {value} = 'true' "
        f"WHEN {kind} = 'VARCHAR' THEN {value} <> '' ELSE TRY_CAST({value} AS DOUBLE) <> 0 END"
    )


@query(
    f"""WITH {ANSWERS_SQL}, {_BODY_SQL.replace('SELECT doc_id,', 'SELECT doc_id, answer,')},
parsed AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM bodies)
SELECT doc_id, j IS NOT NULL AND {_truthy_sql('relevant')} AS relevant,
  CASE WHEN body IS NULL THEN 'No JSON object found in response: ' || answer
       WHEN j IS NULL THEN 'Invalid JSON in response: ' || answer
       WHEN json_type(j, '$.reason') IS NULL THEN '{verdict.NO_REASON}' ELSE j->>'$.reason' END AS reason,
  CASE WHEN json_type(j, '$.floor') IN {_NUMBER_KINDS} THEN CAST(trunc(CAST(j->>'$.floor' AS DOUBLE)) AS INTEGER)
       WHEN regexp_matches(j->>'$.floor', '^[+-]?[0-9]+$') THEN CAST(j->>'$.floor' AS INTEGER) END AS floor,
  nullif(j->>'$.street', '') AS street, j->>'$.building_type' AS building_type,
  j->>'$.property_category' AS property_category,
  CASE WHEN NOT {_absent_sql('has_terrace')} THEN {_truthy_sql('has_terrace')} END AS has_terrace FROM parsed"""
)
def verdict_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.with_lenient_verdict(answers(spark, sf_dir), "answer").select("doc_id", "verdict.*")


# Groups of three documents share an answer; some answers have two members or do not parse.
_MEMBER_SQL = """CASE WHEN doc_id % 4 = 0 THEN '{"relevant": false, "reason": "m' || doc_id || '", "floor": "7"}'
  WHEN doc_id % 9 = 1 THEN '{"relevant": true, "reason": "m' || doc_id || '", "floor": 70}'
  ELSE '{"relevant": true, "reason": "m' || doc_id || '", "property_category": "lakas"}' END"""


@query(
    f"""WITH numbered AS (SELECT doc_id, doc_id // 3 AS grp, {_MEMBER_SQL} AS member FROM documents
), sized AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM numbered
), usable AS (SELECT doc_id, CASE WHEN n = 3 AND grp % 5 <> 0 AND grp % 7 <> 0 THEN member END AS body FROM sized
), {_strict_sql('usable')}
SELECT doc_id, body IS NOT NULL AS in_batch, CASE WHEN body IS NOT NULL THEN relevant END AS relevant,
       CASE WHEN body IS NOT NULL THEN reason END AS reason, floor FROM (SELECT doc_id, body, {_STRICT_COLUMNS} FROM strict)"""
)
def verdict_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    tagged = F.concat(F.lit('"reason": "m'), doc.cast("string"), F.lit('"'))
    member = (
        F.when(doc % 4 == 0, F.concat(F.lit('{"relevant": false, '), tagged, F.lit(', "floor": "7"}')))
        .when(doc % 9 == 1, F.concat(F.lit('{"relevant": true, '), tagged, F.lit(', "floor": 70}')))
        .otherwise(F.concat(F.lit('{"relevant": true, '), tagged, F.lit(', "property_category": "lakas"}')))
    )
    numbered = table(spark, sf_dir, "documents").select("doc_id", member.alias("member"))
    groups = numbered.groupBy(F.floor(doc / 3).alias("grp")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "member"))).alias("members")
    )
    parts = F.when(F.col("grp") % 5 == 0, F.slice("members.member", 1, 2)).otherwise(F.col("members.member"))
    closing = F.when(F.col("grp") % 7 == 0, F.lit("}")).otherwise(F.lit("] done"))
    answered = groups.withColumn("answer", F.concat(F.lit("Answers: ["), F.array_join(parts, ", "), closing))
    return relevance.verdicts_of_batches(answered, "doc_id").select(
        "doc_id", F.col("verdict").isNotNull().alias("in_batch"), "verdict.relevant", "verdict.reason", "verdict.floor"
    )


# ---- Change detection -----------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored state of the first snapshot, and the second snapshot."""
    current = articles(spark, sf_dir)
    number = F.col("article_id").cast("bigint")
    state = incremental.with_checksum(current.where(number % 10 != 0)).select(
        "article_id", "checksum", F.to_timestamp(F.lit("2024-01-01")).alias("updated_at")
    )
    altered = F.when(number % 7 == 0, F.concat("description", F.lit(" módosítva"))).otherwise(F.col("description"))
    return state, current.withColumn("description", altered)


CHANGES_SQL = f"""{ARTICLES_SQL}, hashed AS (
  SELECT article_id, {_checksum_sql()} AS known,
         {_checksum_sql("CASE WHEN CAST(article_id AS BIGINT) % 7 = 0 THEN description || ' módosítva' ELSE description END")} AS checksum
  FROM articles
), changes AS (
  SELECT article_id, checksum, CASE WHEN CAST(article_id AS BIGINT) % 10 = 0 THEN 'new' WHEN known <> checksum THEN 'changed'
         ELSE 'unchanged' END AS change FROM hashed)
"""


@query(f"WITH {CHANGES_SQL} SELECT article_id, checksum, change FROM changes")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, current = _snapshots(spark, sf_dir)
    changes = incremental.classify_changes(incremental.with_checksum(current), state)
    return changes.select("article_id", "checksum", "change")


@query(f"WITH {CHANGES_SQL} SELECT change, count(*) AS n_rows FROM changes GROUP BY change")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, current = _snapshots(spark, sf_dir)
    return incremental.change_summary(incremental.classify_changes(incremental.with_checksum(current), state))


@query(
    f"""WITH {CHANGES_SQL} SELECT count(*) AS total_articles_tracked, '2024-01-02' AS last_processing_date,
       count(*) FILTER (change = 'unchanged') AS kept_checksums FROM changes"""
)
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, current = _snapshots(spark, sf_dir)
    merged = incremental.merge_state(state, incremental.with_checksum(current), "2024-01-02")
    kept = dedup.with_keys(merged, state, ["article_id", "checksum"]).agg(F.count(F.lit(1)).alias("kept_checksums"))
    totals = incremental.state_statistics(merged).withColumn(
        "last_processing_date", F.date_format("last_processing_date", "yyyy-MM-dd")
    )
    return totals.withColumn("_one", F.lit(1)).join(kept.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _article_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream. A glob names a table of one file as well as a folder of files; a plain path
    would have to be a folder."""
    schema = table(spark, sf_dir, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")


@query(f"WITH {CHANGES_SQL} SELECT article_id, checksum, change FROM changes WHERE change <> 'unchanged'")
def streaming_change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = _snapshots(spark, sf_dir)
    doc = F.col("doc_id")
    shaped = _article_stream(spark, sf_dir).select("doc_id", *article_columns())
    altered = F.when(doc % 7 == 0, F.concat("description", F.lit(" módosítva"))).otherwise(F.col("description"))
    folder = _scratch(spark, "changes")
    running = detect_changes(
        shaped.withColumn("description", altered).drop("doc_id"),
        f"{folder}/state",
        f"{folder}/rows",
        f"{folder}/progress",
        RUN_AS_OF,
        seed=state,
    )
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("article_id", "checksum", "change")


@query("SELECT DISTINCT sha256(text) AS text_id FROM documents")
def streaming_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _article_stream(spark, sf_dir).select(F.sha2("text", 256).alias("text_id"))
    folder = _scratch(spark, "seen")
    running = (
        first_seen(stream, "text_id")
        .writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema("text_id string").parquet(f"{folder}/rows")


#: Time for which a user counts as known, in days, and days of an increment.
KNOWN_DAYS, INCREMENT_DAYS = 2, 6


@query(
    f"""WITH days AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events), late AS (
  SELECT user_id FROM days WHERE us > (SELECT max(us) FROM days) - {2 * KNOWN_DAYS} * 86400000000)
SELECT user_id, true AS state_is_bounded, user_id IN (SELECT user_id FROM late) AS may_be_remembered FROM days GROUP BY user_id"""
)
def streaming_first_seen_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of an event stream in increments of some days, known for a bounded time; the state is read back."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    start, end = events.agg(F.min("ts").cast("date"), F.max("ts")).first()
    day, folder = F.datediff("ts", F.lit(start)), _scratch(spark, "users")
    for first in range(0, (end.date() - start).days + 1, INCREMENT_DAYS):
        events.where((day >= first) & (day < first + INCREMENT_DAYS)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        kept = first_seen(stream, "user_id", "ts", f"{KNOWN_DAYS} days")
        writer = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()
    held = remembered(spark, f"{folder}/progress").distinct()
    late = events.where(F.col("ts") > F.lit(end) - F.make_dt_interval(F.lit(2 * KNOWN_DAYS))).select("user_id").distinct()
    beyond = held.join(late, "user_id", "left_anti").count()
    users = spark.read.parquet(f"{folder}/out").select("user_id").distinct()
    marked = users.join(late.withColumn("may_be_remembered", F.lit(True)), "user_id", "left")
    return marked.select("user_id", F.lit(beyond == 0).alias("state_is_bounded"), F.coalesce("may_be_remembered", F.lit(False)).alias("may_be_remembered"))


@query(
    """SELECT sha256(coalesce(text, '')) AS cache_key, count(*) AS n_rows, count(*) - 1 AS hits,
       count(*) - count(DISTINCT doc_id % 2) AS hits_of_short_life FROM documents GROUP BY 1"""
)
def streaming_verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two increments through the cache, which is started again for the second: with the usual
    life, and with one that is over before it."""
    docs = table(spark, sf_dir, "documents")
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    folder, lives = _scratch(spark, "verdicts"), {"long": verdict_cache.TTL_HOURS * verdict_cache.HOUR_MS, "short": 1}
    for part in (0, 1):
        rows = docs.where(F.col("doc_id") % 2 == part).select(key.alias("cache_key"), F.concat(F.lit("answer "), key).alias("answer"))
        rows.write.mode("append").parquet(f"{folder}/in")
        for name, life in lives.items():
            stream = spark.readStream.schema("cache_key string, answer string").parquet(f"{folder}/in")
            verdict_cache.serve(stream, f"{folder}/{name}", f"{folder}/{name}-progress", life).awaitTermination()
    served = [
        spark.read.parquet(f"{folder}/{name}").groupBy("cache_key").agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.count_if("cache_hit").alias(name)
        )
        for name in lives
    ]
    both = served[0].join(served[1], "cache_key")
    return both.select("cache_key", F.col("n_long").alias("n_rows"), F.col("long").alias("hits"), F.col("short").alias("hits_of_short_life"))


# ---- Cache and two-phase relevance ----------------------------------------------------------


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached verdicts for every third article text, up to four days old."""
    number = F.col("article_id").cast("bigint")
    values = {
        "relevant": number % 2 == 0,
        "reason": F.concat(F.lit("cached "), "article_id"),
    }
    stored = F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in VERDICT.fields]
    )
    age = F.make_dt_interval(F.lit(0), (number % 96).cast("int"))
    return articles(spark, sf_dir).where(number % 3 == 0).select(
        text.cache_key(text.combined_text("title", "description")).alias("cache_key"),
        stored.alias("verdict"),
        (F.to_timestamp(F.lit(RUN_AS_OF)) - age).alias("created_at"),
    )


_COMBINED = _strip("coalesce(title, '') || ' ' || coalesce(description, '')")
def _cache_sql(source: str) -> str:
    """Look-up of the rows of ``source`` in the derived cache."""
    return f"""keyed AS (
  SELECT *, {_COMBINED} AS model_text, 'llm_cache:' || sha256({_normal(_COMBINED)}) AS cache_key FROM {source}
), entries AS (
  SELECT 'llm_cache:' || sha256({_normal(_COMBINED)}) AS cache_key, CAST(article_id AS BIGINT) % 2 = 0 AS cached_flag,
         'cached ' || article_id AS cached_reason,
         TIMESTAMP '{RUN_AS_OF}' - to_hours(CAST(CAST(article_id AS BIGINT) % 96 AS INTEGER)) AS created_at
  FROM articles WHERE CAST(article_id AS BIGINT) % 3 = 0
), newest AS (
  SELECT * FROM entries WHERE created_at > TIMESTAMP '{RUN_AS_OF}' - INTERVAL 48 HOUR
  QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, cached_flag DESC, cached_reason DESC) = 1
), looked_up AS (SELECT keyed.*, cached_flag, cached_reason FROM keyed LEFT JOIN newest USING (cache_key))
"""


@query(
    f"""WITH {ARTICLES_SQL}, {_cache_sql('articles')}
SELECT article_id, cached_flag IS NOT NULL AS cache_hit, cached_flag AS relevant, cached_reason AS reason FROM looked_up"""
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir).select("article_id", "cache_hit", "verdict.relevant", "verdict.reason")


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = articles(spark, sf_dir).withColumn("cache_key", text.cache_key(text.combined_text("title", "description")))
    return relevance.cache_lookup(keyed, _cache(spark, sf_dir), RUN_AS_OF)


@query(
    f"""WITH {ARTICLES_SQL}, {_cache_sql('articles')}
SELECT count(cached_flag) AS hits, count(*) - count(cached_flag) AS misses,
       round(count(cached_flag) * 100.0::DOUBLE / count(*), 6) AS hit_rate FROM looked_up"""
)
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.cache_statistics(_lookups(spark, sf_dir)), 6, "hit_rate")


@query(
    f"""WITH {ARTICLES_SQL}, {_cache_sql('articles')}
SELECT count(*) AS cached_items FROM entries WHERE created_at > TIMESTAMP '{RUN_AS_OF}' - INTERVAL 48 HOUR"""
)
def live_cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.live_cache_entries(_cache(spark, sf_dir), RUN_AS_OF)


def stand_in_model(prompts: pd.Series) -> pd.Series:
    """Answers by prompt length alone, so that the checking SQL can follow it."""
    replies = (
        '{"relevant": true, "reason": "stand-in", "floor": "2", "building_type": "panel"}',
        'Sure: {"relevant": false, "reason": "stand-in"}',
        "no idea",
        '{"relevant": true, "reason": "stand-in", "floor": 99}',
    )
    return prompts.str.len().map(lambda n: replies[n % len(replies)])


_PROMPT_LENGTH = len(relevance.PROMPT) - len("{text}")
DECIDED_SQL = f"""{RULED_SQL}, {_cache_sql('(SELECT * FROM ruled WHERE needs_llm)')}, asked AS (
  SELECT *, (length(min(model_text) OVER (PARTITION BY cache_key)) + {_PROMPT_LENGTH}) % 4 AS reply FROM looked_up
), decided AS (
  SELECT article_id, relevant, reason, 'worker' AS filtered_by, CAST(NULL AS INTEGER) AS floor,
         CAST(NULL AS VARCHAR) AS building_type, description FROM ruled WHERE NOT needs_llm
  UNION ALL
  SELECT article_id, CASE WHEN cached_flag IS NOT NULL THEN cached_flag ELSE reply <> 1 END,
         '{relevance.MODEL_PREFIX}' || CASE WHEN cached_flag IS NOT NULL THEN cached_reason WHEN reply < 2 THEN 'stand-in'
           WHEN reply = 2 THEN {_quoted(verdict.NO_OBJECT)} ELSE {_quoted(verdict.INVALID_PREFIX)} || 'floor' END,
         'llm', CASE WHEN cached_flag IS NULL AND reply = 0 THEN 2 END,
         CASE WHEN cached_flag IS NULL AND reply = 0 THEN 'panel' END, description FROM asked)
"""


SUMMARY_SQL = f"""WITH {DECIDED_SQL} SELECT count(*) AS processed, count(*) FILTER (relevant) AS relevant_total,
       count(*) FILTER (NOT relevant) AS irrelevant_total,
       count(*) FILTER (filtered_by = 'worker' AND NOT relevant) AS rule_irrelevant,
       count(*) FILTER (filtered_by = 'llm') AS model_decided,
       round(count(*) FILTER (filtered_by = 'llm') * 100.0::DOUBLE / count(*), 6) AS model_share_percent FROM decided"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    caller = relevance.Caller(stand_in_model)
    return relevance.two_phase(articles(spark, sf_dir), caller, cache=_cache(spark, sf_dir), as_of=RUN_AS_OF).decided


@query(f"WITH {DECIDED_SQL} SELECT article_id, relevant, reason, filtered_by, floor, building_type FROM decided")
def two_phase_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("article_id", "relevant", "reason", "filtered_by", "floor", "building_type")


@query(SUMMARY_SQL)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.run_summary(_decided(spark, sf_dir)), 6, "model_share_percent")


@query(
    f"""WITH {DECIDED_SQL} SELECT article_id, coalesce(substr(description, 1, 500), '') AS description_preview,
       relevant AS llm_relevant, reason AS llm_reason, filtered_by, '' AS human_feedback FROM decided
WHERE CAST(article_id AS BIGINT) % 4 <> 0"""
)
def feedback_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = articles(spark, sf_dir).where(F.col("article_id").cast("bigint") % 4 == 0)
    return relevance.feedback_entries(_decided(spark, sf_dir), reviewed)


@query(
    f"""WITH {DECIDED_SQL}, raw AS (SELECT article_id, district FROM articles UNION ALL
  SELECT article_id, district FROM articles WHERE CAST(article_id AS BIGINT) % 5 = 0)
SELECT relevant, district, count(*) AS n_rows, count(floor) AS with_floor FROM raw JOIN decided USING (article_id) GROUP BY ALL"""
)
def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = articles(spark, sf_dir).select("article_id", "district")
    raw = raw.unionByName(raw.where(F.col("article_id").cast("bigint") % 5 == 0))
    rows = relevance.attach_verdicts(raw, _decided(spark, sf_dir), how="inner")
    relevant, irrelevant = relevance.split_layers(rows)

    def counted(layer: DataFrame, flag: bool, floors: Column) -> DataFrame:
        return layer.groupBy("district").agg(F.count(F.lit(1)).alias("n_rows"), floors.alias("with_floor")).withColumn(
            "relevant", F.lit(flag)
        )

    return counted(relevant, True, F.count("floor")).unionByName(
        counted(irrelevant, False, F.lit(0).cast("bigint"))
    )


@query(
    f"""WITH {ARTICLES_SQL}, texts AS (
  SELECT 'llm_cache:' || sha256({_normal('description')}) AS cache_key, min(description) AS body
  FROM articles WHERE description IS NOT NULL GROUP BY 1)
SELECT cache_key, (length(body) + {_PROMPT_LENGTH}) % 4 <> 1 AS relevant FROM texts"""
)
def batch_model_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in never answers with an array, so every batch falls back to single calls."""
    texts = (
        articles(spark, sf_dir)
        .where(F.col("description").isNotNull())
        .groupBy(text.cache_key("description").alias("cache_key"))
        .agg(F.min("description").alias("text"))
    )
    decided = relevance.classify_in_batches(texts, relevance.Caller(stand_in_model))
    return decided.select("cache_key", "verdict.relevant")


#: Seconds that the unsteady stand-in gets for a call.
PATIENCE = 2.0


def unsteady_model(prompts: pd.Series) -> pd.Series:
    """The stand-in, but some prompts (by their length) make it hang and some fail."""
    size = prompts.str.len()
    if (size % 200 == 7).any():
        time.sleep(3 * PATIENCE)
    if (size % 5 == 3).any():
        raise RuntimeError("model away")
    return stand_in_model(prompts)


@query(
    f"""WITH {ARTICLES_SQL}, texts AS (
  SELECT 'llm_cache:' || sha256({_normal('description')}) AS cache_key, length(min(description)) + {_PROMPT_LENGTH} AS size
  FROM articles WHERE description IS NOT NULL GROUP BY 1)
SELECT cache_key, CASE WHEN size % 200 = 7 THEN 'call timed out after {PATIENCE:g} s' WHEN size % 5 = 3 THEN 'model away' END AS call_error,
       size % 200 <> 7 AND size % 5 <> 3 AS answered FROM texts"""
)
def bounded_model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that hangs and fails for some texts: what is asked together with those is answered all the same."""
    texts = (
        articles(spark, sf_dir)
        .where(F.col("description").isNotNull())
        .groupBy(text.cache_key("description").alias("cache_key"))
        .agg(F.min("description").alias("text"))
    )
    prompts = texts.select("cache_key", relevance.prompt_for(F.col("text")).alias("prompt"))
    answers = relevance.Caller(unsteady_model, batch_rows=3, at_a_time=8, seconds=PATIENCE).answers(prompts)
    return answers.select("cache_key", "call_error", F.col("answer").isNotNull().alias("answered"))


@query(SUMMARY_SQL)
def observed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a run as they arise while its decisions are written, without a second pass."""
    decided, seen = stats.observed(_decided(spark, sf_dir))
    decided.write.parquet(f"{_scratch(spark, 'decided')}/rows")
    return rounded(stats.summary_of(spark, seen.get), 6, "model_share_percent")


@query(
    """SELECT doc_id % 3 AS increment, count(*) AS processed, count(*) FILTER (length(text) > 1000) AS relevant_total,
       count(*) FILTER (NOT length(text) > 1000) AS irrelevant_total, count(*) FILTER (doc_id % 2 = 0 AND NOT length(text) > 1000) AS rule_irrelevant,
       count(*) FILTER (doc_id % 2 = 1) AS model_decided, round(count(*) FILTER (doc_id % 2 = 1) * 100.0::DOUBLE / count(*), 6) AS model_share_percent
FROM documents GROUP BY 1"""
)
def observed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers for each increment of a stream, from its progress reports."""
    docs = table(spark, sf_dir, "documents").select(
        (F.length("text") > 1000).alias("relevant"), F.when(F.col("doc_id") % 2 == 0, "worker").otherwise("llm").alias("filtered_by"),
        (F.col("doc_id") % 3).alias("increment"),
    )
    folder, reports = _scratch(spark, "observed"), []
    for increment in range(3):
        docs.where(F.col("increment") == increment).drop("increment").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("relevant boolean, filtered_by string").parquet(f"{folder}/in")
        writer = stats.observed_stream(stream, "run").writeStream.format("parquet").option("path", f"{folder}/out")
        query = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        reports += [report["observed"]["run"] for report in progress_report(query) if report["rows"]]
    found = [stats.summary_of(spark, r).withColumn("increment", F.lit(i).cast("long")) for i, r in enumerate(reports)]
    return rounded(reduce(DataFrame.unionByName, found), 6, "model_share_percent")


@query("SELECT doc_id, sha256(text) AS text_id, 2 AS writers FROM documents")
def versioned_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers merge their halves of the documents into one table at the same time."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_id"))
    versions = VersionedTable(spark, _scratch(spark, "versions"), docs.schema)
    with ThreadPoolExecutor(2) as pool:
        merges = [pool.submit(merge_table, versions, docs.where(F.col("doc_id") % 2 == half), "doc_id", ("text_id",)) for half in (0, 1)]
        committed = {merge.result() for merge in merges}
    return versions.read().withColumn("writers", F.lit(len(committed)))


@query(
    f"""WITH {DECIDED_SQL}, first_rows AS (SELECT article_id, filtered_by FROM decided ORDER BY article_id LIMIT 100)
SELECT article_id, filtered_by FROM first_rows
QUALIFY filtered_by = 'worker' OR row_number() OVER (PARTITION BY filtered_by ORDER BY article_id) <= 50"""
)
def trial_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial mode of a run: the first hundred articles, of which fifty at most reach the model."""
    run = relevance.two_phase(articles(spark, sf_dir), relevance.Caller(stand_in_model), trial=relevance.Trial())
    return run.decided.select("article_id", "filtered_by")


# ---- Sequences and boundaries ---------------------------------------------------------------


@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS joined, count(*) AS n_items FROM conversations GROUP BY conv_id")
def ordered_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    sequences = geo.ordered_sequence(turns, ["conv_id"], "turn", F.col("text"))
    return sequences.select("conv_id", F.array_join("items", "|").alias("joined"), F.size("items").cast("bigint").alias("n_items"))


BOUNDARY_SQL = f"""WITH {LISTINGS_SQL}, kept AS (
  SELECT article_id, CAST(article_id AS BIGINT) // 10 AS way_id, CAST(article_id AS BIGINT) % 10 AS position, area_sqm, part_id
  FROM listings QUALIFY row_number() OVER (PARTITION BY article_id
    ORDER BY delivery_day NULLS FIRST, part_id, supplier_id, price_huf) = 1
), rings AS (
  SELECT o_custkey, way_id, string_agg(CAST(area_sqm AS BIGINT) || ' ' || part_id, ',' ORDER BY position) AS ring
  FROM orders JOIN kept ON way_id = o_orderkey WHERE o_orderstatus <> 'P' AND part_id % 7 <> 0 GROUP BY o_custkey, way_id)
SELECT CAST(o_custkey AS VARCHAR) AS relation_id, CASE WHEN count(*) = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS geometry_type,
       string_agg(ring, ';' ORDER BY way_id) AS shape FROM rings GROUP BY o_custkey"""


def _map_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as boundaries, their orders as ways, order lines as nodes (some not listed)."""
    rows = dedup.first_per_key(listings(spark, sf_dir, ["article_id", "area_sqm", *TIE_BREAK]), ["article_id"], TIE_BREAK)
    number = F.col("article_id").cast("bigint")
    ways = geo.ordered_sequence(
        rows.select(F.floor(number / 10).cast("string").alias("way_id"), (number % 10).alias("position"), "article_id"),
        ["way_id"],
        "position",
        F.col("article_id"),
    ).withColumnRenamed("items", "refs")
    nodes = rows.where(F.col("part_id") % 7 != 0).select(
        F.col("article_id").alias("node_id"), F.col("area_sqm").alias("lon"), F.col("part_id").cast("double").alias("lat")
    )
    member = F.struct(
        F.lit("way").alias("type"),
        F.col("o_orderkey").cast("string").alias("ref"),
        F.when(F.col("o_orderstatus") != "P", "outer").otherwise("inner").alias("role"),
    )
    relations = geo.ordered_sequence(
        table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("relation_id"), "o_orderkey", member.alias("m")),
        ["relation_id"],
        "o_orderkey",
        F.col("m"),
    ).select("relation_id", F.col("relation_id").alias("name"), F.col("items").alias("members"))
    return relations, ways, nodes


def _as_document(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of a partition inside of one element, so that each file is a document."""
    yield pd.DataFrame({"value": ["<osm>"]})
    yield from frames
    yield pd.DataFrame({"value": ["</osm>"]})


def _shapes_as_text(shapes: DataFrame) -> DataFrame:
    point = lambda p: F.concat(p[0].cast("bigint").cast("string"), F.lit(" "), p[1].cast("bigint").cast("string"))
    ring = lambda r: F.array_join(F.transform(r, point), ",")
    return shapes.select("relation_id", "geometry_type", F.array_join(F.transform("rings", ring), ";").alias("shape"))


@query(BOUNDARY_SQL)
def boundary_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes_as_text(geo.assemble_boundaries(*_map_parts(spark, sf_dir)))


@query(BOUNDARY_SQL)
def map_extract_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of files: a map extract is written and read, and the features made of it as well."""
    relations, ways, nodes = _map_parts(spark, sf_dir)
    refs = F.array_join(F.transform("refs", lambda r: F.concat(F.lit('<nd ref="'), r, F.lit('"/>'))), "")
    member = lambda m: F.format_string('<member type="%s" ref="%s" role="%s"/>', m["type"], m["ref"], m["role"])
    members = F.array_join(F.transform("members", member), "")
    lines = (
        nodes.select(F.format_string('<node id="%s" lat="%s" lon="%s"/>', "node_id", F.col("lat").cast("string"), F.col("lon").cast("string")))
        .union(ways.select(F.concat(F.lit('<way id="'), F.col("way_id"), F.lit('">'), refs, F.lit("</way>"))))
        .union(relations.select(F.concat(
            F.lit('<relation id="'), F.col("relation_id"), F.lit('">'), members, F.lit('<tag k="name" v="'), F.col("name"), F.lit('"/></relation>')
        )))
    )
    folder = _scratch(spark, "extract")
    lines.toDF("value").mapInPandas(_as_document, "value string").write.text(f"{folder}/map")
    shapes = geo.assemble_boundaries(*text_files.read_map_xml(spark, f"{folder}/map"))
    write_features(geo.feature_json(shapes), f"{folder}/features")
    schema = "properties struct<name:string>, geometry struct<type:string,coordinates:string>"
    features = spark.read.schema(schema).json(f"{folder}/features")
    of_kind = lambda kind: F.from_json("geometry.coordinates", kind)
    rings = F.when(F.col("geometry.type") == "Polygon", of_kind("array<array<array<double>>>")).otherwise(
        F.flatten(of_kind("array<array<array<array<double>>>>"))
    )
    return _shapes_as_text(features.select(F.col("properties.name").alias("relation_id"), F.col("geometry.type").alias("geometry_type"), rings.alias("rings")))


@query(
    f"""WITH {LISTINGS_SQL} SELECT n_name AS area_name, count(article_id) AS listing_count,
  '<b>' || n_name || '</b><br>Hirdetések száma: ' || count(article_id) AS popup
FROM nation LEFT JOIN listings ON n_name = district WHERE n_nationkey % 5 <> 4 GROUP BY n_name"""
)
def geojson_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas read from a GeoJSON file (points are none), with their listings."""
    kind = F.when(F.col("n_nationkey") % 5 == 4, "Point").when(F.col("n_nationkey") % 5 == 3, "MultiPolygon").otherwise("Polygon")
    geometry = F.struct(kind.alias("type"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("Nev"), F.col("n_nationkey").alias("id")).alias("properties"), geometry.alias("geometry"))
    collection = F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))
    folder = _scratch(spark, "areas")
    table(spark, sf_dir, "nation").agg(F.to_json(collection).alias("value")).write.text(folder)
    features, names = text_files.read_geojson(spark, folder)
    found = geo.features_with_counts(geo.only_areas(features), listings(spark, sf_dir, ["article_id", "district"]), geo.feature_name(names))
    return found.select("area_name", "listing_count", "popup")


@query(
    f"""WITH {LISTINGS_SQL} SELECT n_name AS area_name, count(district) AS listing_count,
  '<b>' || n_name || '</b><br>Hirdetések száma: ' || count(district) AS popup
FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)
LEFT JOIN (SELECT district FROM listings WHERE relevant) ON n_name = district GROUP BY n_name"""
)
def map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are areas as well, without a listing."""
    areas = table(spark, sf_dir, "nation").select("n_name").union(table(spark, sf_dir, "region").select("r_name")).toDF("name")
    features = areas.select(F.struct("name").alias("properties"))
    rows = listings(spark, sf_dir, ["district", "relevant"]).where("relevant")
    summary = geo.features_with_counts(features, rows, geo.feature_name(["name"]))
    return summary.select("area_name", "listing_count", "popup")
