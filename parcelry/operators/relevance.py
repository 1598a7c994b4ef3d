"""Two-phase relevance: rules as columns, then a pluggable model on what they leave undecided."""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelry.functions.rules import (
    CURRENT_RULES,
    SHORT_TEXT_REASON,
    UNDECIDED_REASON,
    RuleSet,
    earlier_exclusion_reason,
    exclusion_reason,
    routed_text,
)
from parcelry.functions.text import cache_key, combined_text, preview
from parcelry.functions.verdict import (
    INVALID_PREFIX,
    POLICIES,
    FailurePolicy,
    failed_call,
    with_batch_members,
    with_member_verdict,
    with_strict_verdict,
)
from parcelry.operators.contracts import violations
from parcelry.operators.dedup import first_per_key, without_keys
from parcelry.schema import VERDICT
from parcelry.session import task_slots

# A model takes prompts and gives one answer text each, from several threads; an exception fails its whole call.
Model = Callable[[pd.Series], pd.Series]

PROMPT = (
    "Decide whether this listing is a plain sale and extract its details.\n"
    "Listing: {text}\n"
    "Answer with one JSON object holding relevant, reason, floor, street, building_type, "
    "property_category and has_terrace."
)
# Fixed value: what every model reason starts with.
MODEL_PREFIX = "LLM elemzés: "
VERDICT_FIELDS = [f.name for f in VERDICT.fields]


def classify_by_rules(df: DataFrame, rules: RuleSet = CURRENT_RULES) -> DataFrame:
    """Adds ``relevant`` (null when undecided), ``reason`` and ``needs_llm``.

    Rows that break the row contract are kept as relevant, with the broken rules as the reason.
    """
    title = F.col("title") if "title" in df.columns else F.lit("")
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    # The cascade looks at the text many times, so lower-casing is a projection of its own.
    staged = df.withColumn("_broken", violations(df)).withColumn("_lower", text)
    staged = staged.withColumn("_excluded", F.when(F.size("_broken") == 0, exclusion_reason("_lower", rules)))
    broken, excluded = F.size("_broken") > 0, F.col("_excluded").isNotNull()
    return (
        staged.withColumn("relevant", F.when(broken, True).when(excluded, False))
        .withColumn(
            "reason",
            F.when(broken, F.concat(F.lit(INVALID_PREFIX), F.array_join("_broken", ",")))
            .when(excluded, F.col("_excluded"))
            .otherwise(F.lit(UNDECIDED_REASON)),
        )
        .withColumn("needs_llm", ~(broken | excluded))
        .drop("_broken", "_excluded", "_lower")
    )


def classify_by_earlier_rules(df: DataFrame) -> DataFrame:
    """The earlier first phase: short texts fall back to the title or are taken as relevant."""
    staged = (
        df.withColumn("_text", routed_text("title", "description"))
        .withColumn("_lower", F.lower(F.concat(F.lit(" "), F.col("_text"), F.lit(" "))))
        .withColumn("_excluded", earlier_exclusion_reason("_lower"))
    )
    unusable, excluded = F.col("_text").isNull(), F.col("_excluded").isNotNull()
    return (
        staged.withColumn("relevant", F.when(unusable, True).when(excluded, False))
        .withColumn("reason", F.when(unusable, F.lit(SHORT_TEXT_REASON)).otherwise(F.col("_excluded")))
        .withColumn("needs_llm", ~(unusable | excluded))
        .withColumnRenamed("_text", "model_text")
        .drop("_excluded", "_lower")
    )


def prompt_for(text: Column, template: str = PROMPT) -> Column:
    """Template with the listing text in place of ``{text}``."""
    before, after = template.split("{text}")
    return F.concat(F.lit(before), text, F.lit(after))


def live_verdicts(cache: DataFrame, as_of: str, ttl_hours: int = 48) -> DataFrame:
    """``(cache_key, verdict)`` of the newest unexpired entry of each key."""
    moment = F.to_timestamp(F.lit(as_of))
    start = moment - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))
    fresh = cache.where((F.col("created_at") > start) & (F.col("created_at") <= moment))
    return fresh.groupBy("cache_key").agg(
        F.max(F.struct("created_at", "verdict")).getField("verdict").alias("verdict")
    )


def cache_lookup(df: DataFrame, cache: DataFrame, as_of: str, ttl_hours: int = 48) -> DataFrame:
    """``df`` (with ``cache_key``) plus the live cached ``verdict`` and ``cache_hit``.

    Copies of one text share a key, so the row side may be skewed: the cache side is unique per key
    and AQE splits the row side.
    """
    joined = df.join(live_verdicts(cache, as_of, ttl_hours), "cache_key", "left")
    return joined.withColumn("cache_hit", F.col("verdict").isNotNull())


# Calls at a time, and seconds until a call is given up.
CALLS_AT_A_TIME = 4
CALL_SECONDS = 300.0


class CallPool:
    """Runs calls side by side, a bounded number at a time, each for a bounded time.

    A call that takes too long is given up: its place goes to the next one and its late answer is
    ignored. Python cannot end the thread it runs in, which is left behind and ends with the call or the worker.
    """

    def __init__(self, call: Callable, size: int, seconds: float):
        self.call, self.size, self.seconds = call, size, seconds
        self.finished: queue.SimpleQueue = queue.SimpleQueue()
        self.running: dict[int, tuple] = {}
        self.started = 0

    def start(self, job) -> None:
        number, self.started = self.started, self.started + 1

        def work() -> None:
            try:
                self.finished.put((number, self.call(job), None))
            except Exception as problem:  # a failed call is data: the caller decides
                self.finished.put((number, None, problem))

        self.running[number] = (job, time.monotonic() + self.seconds)
        threading.Thread(target=work, daemon=True).start()

    def outcomes(self, jobs: Iterator, again: Callable = lambda job, problem: ()) -> Iterator[tuple]:
        """(job, result, exception) in the order of completion. ``jobs`` is read as places get free; if
        ``again`` names jobs for a failed one, these are run in its stead."""
        waiting: deque = deque()
        more = iter(jobs)
        while True:
            while len(self.running) < self.size:
                job = waiting.popleft() if waiting else next(more, None)
                if job is None:
                    break
                self.start(job)
            if not self.running:
                return
            first = min(self.running, key=lambda n: self.running[n][1])
            try:
                left = max(0.0, self.running[first][1] - time.monotonic())
                number, result, problem = self.finished.get(timeout=left)
            except queue.Empty:
                number, result, problem = first, None, TimeoutError(f"call timed out after {self.seconds:g} s")
            if number not in self.running:
                continue  # the late end of a call that was given up
            job, _ = self.running.pop(number)
            retries = again(job, problem) if problem is not None else ()
            if retries:
                waiting.extend(retries)
            else:
                yield job, result, problem


@dataclass(frozen=True)
class Caller:
    """How the model is called on the workers: rows of a call, tasks, calls at a time in a task, and seconds for each."""

    model: Model
    batch_rows: int = 50
    partitions: int | None = None
    at_a_time: int = CALLS_AT_A_TIME
    seconds: float = CALL_SECONDS

    def answers(self, prompts: DataFrame) -> DataFrame:
        """``prompts(cache_key, prompt)`` to ``(cache_key, answer, call_error)``, in no order.

        A task has ``at_a_time`` calls under way, so that with the partition count caps concurrency. The count is
        set explicitly because AQE merges the small shuffle before it into few tasks, and by a hash of
        the key because a repartition by the grouping key itself would be dropped as redundant. Rows
        of a call that fails, takes too long or gives a wrong number of answers are asked one by one, once.
        """
        model, rows, size, seconds = self.model, self.batch_rows, self.at_a_time, self.seconds
        width = self.partitions or task_slots(prompts.sparkSession)

        def ask(part: pd.DataFrame) -> list:
            answers = list(model(part["prompt"]))
            if len(answers) != len(part):
                raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
            return answers

        def one_by_one(part: pd.DataFrame, problem: Exception) -> list[pd.DataFrame]:
            return [part.iloc[i : i + 1] for i in range(len(part))] if len(part) > 1 else []

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = (frame.iloc[start : start + rows] for frame in frames for start in range(0, len(frame), rows))
            for part, answers, problem in CallPool(ask, size, seconds).outcomes(parts, one_by_one):
                error = None if problem is None else str(problem)
                yield pd.DataFrame({"cache_key": part["cache_key"], "answer": answers or [None] * len(part), "call_error": [error] * len(part)})

        return prompts.repartition(width, F.xxhash64("cache_key")).mapInPandas(run, "cache_key string, answer string, call_error string")


def judged_answers(answers: DataFrame, policy: FailurePolicy) -> DataFrame:
    """``(cache_key, verdict, call_failed)`` of model answers and failed calls."""
    judged = with_strict_verdict(answers, "answer", policy)
    failure = F.col("call_error")
    verdict = F.when(failure.isNotNull(), failed_call(failure, policy)).otherwise(F.col("verdict"))
    return judged.select("cache_key", verdict.alias("verdict"), failure.isNotNull().alias("call_failed"))


def classify_by_model(
    df: DataFrame,
    caller: Caller,
    text: Column,
    cache: DataFrame | None = None,
    as_of: str | None = None,
    policy: FailurePolicy = POLICIES["live"],
    template: str = PROMPT,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    key: str = "article_id",
) -> DataFrame:
    """Adds ``verdict``, ``cache_key``, ``cache_hit`` and ``call_failed`` to the rows whose ``text`` is not null.

    Each distinct text without a live cached verdict is sent to the model once; rows without text are
    never sent. ``keep`` may store the parsed answers (a checkpoint, a written table) so that several
    uses of the result, or a lost executor, do not repeat model calls.
    """
    keyed = df.withColumn("_text", text).withColumn("cache_key", cache_key("_text"))
    # min() makes the representative of a key independent of partitioning. Rows without text meet in
    # one group, which map-side combining keeps to a row per partition.
    asked = keyed.groupBy("cache_key").agg(F.min("_text").alias("_text")).where(F.col("_text").isNotNull())
    cached = None
    if cache is not None:
        cached = live_verdicts(cache, as_of)
        asked = asked.join(cached.select("cache_key"), "cache_key", "left_anti")
    prompts = asked.select("cache_key", prompt_for(F.col("_text"), template).alias("prompt"))
    resolved = judged_answers(caller.answers(prompts), policy)
    if keep is not None:
        resolved = keep(resolved)
    resolved = resolved.withColumn("_hit", F.lit(False))
    if cached is not None:
        resolved = resolved.unionByName(cached.withColumns({"_hit": F.lit(True), "call_failed": F.lit(False)}))
    # A key of their own keeps the rows without text from piling up in the null partition.
    lone = F.concat(F.lit("no-text:"), F.xxhash64(key).cast("string"))
    rows = keyed.drop("_text").withColumn("cache_key", F.coalesce("cache_key", lone))
    return (
        rows.join(resolved, "cache_key", "left")
        .withColumn("cache_hit", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


BATCH_PROMPT = (
    "Judge each of these {count} listings on its own.\n"
    "{listings}"
    "Answer with a JSON array of exactly {count} objects in the same order."
)
BATCH = 3
# Texts that one task numbers and groups.
BUCKET_ROWS = 100_000


def groups_of_three(df: DataFrame, key: str, columns: Sequence[str], buckets: int) -> DataFrame:
    """Full groups of three rows as arrays; left-over rows come as groups of one or two.

    Rows are numbered inside hash buckets of the (unique) key, so no task numbers the whole table.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    numbered = df.withColumn("_bucket", bucket).withColumn("_position", position)
    members = F.array_sort(F.collect_list(F.struct("_position", key, *columns)))
    grouped = numbered.groupBy("_bucket", F.floor(F.col("_position") / BATCH).alias("_group"))
    return grouped.agg(members.alias("members")).drop("_bucket", "_group")


def batch_prompt(members: Column, text: str, template: str = BATCH_PROMPT) -> Column:
    before, rest = template.replace("{count}", str(BATCH)).split("{listings}")
    parts = F.transform(members, lambda m, i: F.concat(F.lit("#"), (i + 1).cast("string"), F.lit(": "), m[text], F.lit("\n")))
    return F.concat(F.lit(before), F.array_join(parts, ""), F.lit(rest))


def verdicts_of_batches(batches: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """``key`` and ``verdict`` per member, by position; null verdicts mean the answer was not usable.

    An answer counts only when it holds exactly three members.
    """
    parts = with_batch_members(batches, answer, BATCH)
    rows = parts.select(F.posexplode("members").alias("_index", "_member"), "parts")
    members = rows.select(F.col(f"_member.{key}").alias(key), F.col("parts")[F.col("_index")].alias("_part"))
    return with_member_verdict(members, "_part").drop("_part")


def classify_in_batches(
    texts: DataFrame,
    caller: Caller,
    buckets: int | None = None,
    policy: FailurePolicy = POLICIES["batch"],
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``texts(cache_key, text)``, one row per key, to ``(cache_key, verdict)``.

    Three listings per call; whatever a call leaves without a verdict is asked again on its own. Without
    ``buckets`` there are as many as keep each at about ``BUCKET_ROWS`` texts.
    """
    if buckets is None:
        buckets = max(1, -(-texts.count() // BUCKET_ROWS))
    grouped = groups_of_three(texts, "cache_key", ["text"], buckets)
    full = grouped.where(F.size("members") == BATCH).withColumn(
        "group_key", F.sha2(F.to_json("members.cache_key"), 256)
    )
    asked = caller.answers(
        full.select(F.col("group_key").alias("cache_key"), batch_prompt(F.col("members"), "text").alias("prompt"))
    ).withColumnRenamed("cache_key", "group_key")
    first = verdicts_of_batches(full.join(asked, "group_key"), "cache_key")
    if keep is not None:
        first = keep(first)
    settled = first.where(F.col("verdict").isNotNull())
    rest = without_keys(texts, settled, ["cache_key"])
    single = caller.answers(rest.select("cache_key", prompt_for(F.col("text")).alias("prompt")))
    return settled.unionByName(judged_answers(single, policy).drop("call_failed"))


@dataclass(frozen=True)
class Trial:
    """A trial run over the first rows by key: how many are taken, and how many of these go to the model."""

    # Fixed values.
    rows: int = 100
    model_rows: int = 50


@dataclass(frozen=True)
class Decisions:
    """Outcome of a run: one row per key, and the cache entries it adds."""

    decided: DataFrame
    new_cache: DataFrame = field(repr=False)


def two_phase(
    df: DataFrame,
    caller: Caller,
    rules: RuleSet = CURRENT_RULES,
    cache: DataFrame | None = None,
    as_of: str = "1970-01-01",
    policy: FailurePolicy = POLICIES["live"],
    keep: Callable[[DataFrame], DataFrame] | None = None,
    trial: Trial | None = None,
    key: str = "article_id",
) -> Decisions:
    """Rules decide what they can; only the rest reaches the model.

    Decided rows carry no model text, so they drop out before the model's Python stage: a conditional
    inside one expression would not keep them away from it. The rows stay in one flow, as filtering
    them into two halves would run the rules once per half.
    """
    ruled = classify_by_rules(df if trial is None else df.orderBy(key).limit(trial.rows), rules)
    if trial is not None:
        asked = ruled.where("needs_llm").orderBy(key).limit(trial.model_rows)
        ruled = ruled.where(~F.col("needs_llm")).unionByName(asked)
    title = F.col("title") if "title" in df.columns else F.lit("")
    text = F.when(F.col("needs_llm"), combined_text(title, "description"))
    own = ruled.withColumnsRenamed({"relevant": "_relevant", "reason": "_reason"})
    asked = classify_by_model(own, caller, text, cache, as_of, policy, keep=keep)
    by_model = F.col("needs_llm")
    model_reason = F.concat(F.lit(MODEL_PREFIX), F.col("verdict.reason"))
    values = {
        "relevant": F.when(by_model, F.col("verdict.relevant")).otherwise(F.col("_relevant")),
        "reason": F.when(by_model, model_reason).otherwise(F.col("_reason")),
        "filtered_by": F.when(by_model, F.lit("llm")).otherwise(F.lit("worker")),
        **{name: F.col(f"verdict.{name}") for name in VERDICT_FIELDS[2:]},
    }
    own_columns = [c for c in df.columns if c not in values]
    decided = asked.select(*own_columns, *[value.alias(name) for name, value in values.items()])
    fresh = (
        asked.where(by_model & ~F.col("cache_hit") & ~F.coalesce("call_failed", F.lit(False)))
        .groupBy("cache_key")
        .agg(F.any_value("verdict").alias("verdict"))
        .withColumn("created_at", F.to_timestamp(F.lit(as_of)))
    )
    return Decisions(decided, fresh)


def attach_verdicts(raw: DataFrame, decided: DataFrame, key: str = "article_id", how: str = "left") -> DataFrame:
    """Every raw row with the verdict of its key, first verdict per key.

    Raw rows may repeat a key heavily; verdicts are unique, so AQE can split the raw side.
    """
    columns = [c for c in decided.columns if c == key or c in {*VERDICT_FIELDS, "filtered_by"}]
    unique = first_per_key(decided.select(*columns), [key], ["relevant", "reason"])
    clash = {c: f"{c}_x" for c in columns if c != key and c in raw.columns}
    return raw.withColumnsRenamed(clash).join(unique, key, how)


def split_layers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relevant layer with verdict fields, irrelevant layer with the reason only."""
    relevant = rows.where(F.col("relevant"))
    detail = [c for c in VERDICT_FIELDS[2:] if c in rows.columns]
    irrelevant = rows.where(~F.col("relevant")).drop(*detail).withColumnRenamed("reason", "reason_to_relevance")
    return relevant.drop("relevant"), irrelevant.drop("relevant")


def feedback_entries(decided: DataFrame, reviewed: DataFrame | None = None, key: str = "article_id") -> DataFrame:
    """Rows for human review that are not queued yet."""
    entries = decided.select(
        key,
        F.coalesce(preview("description", 500), F.lit("")).alias("description_preview"),
        F.col("relevant").alias("llm_relevant"),
        F.col("reason").alias("llm_reason"),
        F.coalesce("filtered_by", F.lit("unknown")).alias("filtered_by"),
        F.lit("").alias("human_feedback"),
    )
    return without_keys(entries, reviewed, [key]) if reviewed is not None else entries


def decision_log(decided: DataFrame) -> DataFrame:
    return decided.select("article_id", "description", "relevant", "reason")
