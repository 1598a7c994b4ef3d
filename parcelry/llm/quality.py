"""Quality rules, with lines that too many documents of a host share.

Lines are normalised and hashed; for each host the distinct documents (texts) that hold a line are
counted. Lines above the limits are removed, and a document that loses too much is rejected.
Everything is a column expression, an aggregate or a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parcelry.llm.common import SPACE_CLASS, SPACES, WORD_CLASS, let, quoted, working_name
from parcelry.session import cut_lineage

WINDOW = 5
# Fixed value: signs that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """A line is removed if it is in at least ``min_documents`` documents of its host and in more than
    ``max_share`` of them; a document is rejected if fewer than ``min_words`` words or less than
    ``min_left`` of its words remain, or if it fails the base rules."""

    min_documents: int = 10
    max_share: float = 0.05
    min_left: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Words of a text that is not null."""
    return F.when(trimmed(text) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed(text), f"{SPACE_CLASS}+"))


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(line), f"{SPACE_CLASS}+", " "))


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of five words that occur twice or more among ``tokens``.

    Only where a window is repeated are the windows sorted; their hashes stand beside their places, so
    equal windows become neighbours.
    """

    def hashes(w: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)

    def places(ordered: Column) -> Column:
        def repeated(pair: Column, j: Column) -> Column:
            same = lambda k: F.coalesce(F.get(ordered, k)["h"] == pair["h"], F.lit(False))
            return F.when(same(j - 1) | same(j + 1), pair["i"])

        return F.sort_array(F.array_compact(F.transform(ordered, repeated)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(pairs, lambda ordered: let(places(ordered), covered))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(F.lit(0))

    return let(tokens, lambda w: F.when(F.size(w) >= WINDOW, let(hashes(w), count)).otherwise(F.lit(0))).cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept", "clean_text")


def assess(df: DataFrame, text: str, host: str, rules: Rules = Rules()) -> DataFrame:
    """The rows and columns of ``df`` with ``MEASURES`` (columns of these names are replaced).

    A document is a distinct (host, text): repeated rows and copies count once. Null and empty hosts
    are one host. A null text has no words, fails the base rules and keeps a null ``clean_text``; an
    empty line or one without a word is never removed. Hashes of lines are 64 bits, those that name a
    document 128.
    """
    columns = [c for c in df.columns if c not in MEASURES]
    t, at, k1, k2, tokens, lines, bad = working_name(df, "_text", "_host", "_k1", "_k2", "_tokens", "_lines", "_bad")
    site = F.coalesce(quoted(host), F.lit(""))
    marked = df.select(*[quoted(c) for c in columns], F.coalesce(quoted(text), F.lit("")).alias(t), site.alias(at))
    marked = marked.withColumns({k1: F.xxhash64(at, t), k2: F.xxhash64(F.lit("second"), t, at)})
    with_word = lambda c: F.filter(F.split(F.col(c), "\n"), lambda x: x.rlike(WORD_CLASS))
    hashed = lambda x: F.xxhash64(normalised(x))

    held = marked.select(at, k1, k2, F.explode(F.array_distinct(F.transform(with_word(t), hashed))).alias("line"))
    documents = held.distinct()
    hosts = marked.select(at, k1, k2).distinct().groupBy(at).agg(F.count(F.lit(1)).alias("documents"))
    counted = documents.groupBy(at, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.min_documents)
    common = counted.join(hosts, at).where(F.col("n") > rules.max_share * F.col("documents")).select(at, "line")
    common = cut_lineage(common)
    lost = cut_lineage(held.join(common, [at, "line"]).groupBy(k1, k2).agg(F.collect_set("line").alias(bad)))

    measured = marked.withColumn(tokens, words(F.col(t)))
    counts = lambda x: F.struct(hashed(x).alias("h"), F.size(F.split(trimmed(x), f"{SPACE_CLASS}+")).alias("w"))
    raw = with_word(t)
    measured = measured.select(
        *[quoted(c) for c in columns], k1, k2, t,
        F.size(tokens).cast("long").alias("n_words"),
        F.char_length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(raw) - F.size(F.array_distinct(raw))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(tokens)).alias("n_repeat_words"),
        F.transform(raw, counts).alias(lines),
    )
    few, much = F.col("n_words") < rules.min_words, 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    joined = measured.withColumn("base_failed", few | much).join(lost, [k1, k2], "left")
    gone = F.aggregate(
        F.filter(lines, lambda x: F.array_contains(F.col(bad), x["h"])), F.lit(0), lambda a, x: a + x["w"]
    )
    removed = joined.withColumn("n_removed_words", F.coalesce(gone, F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < rules.min_words) | (left < rules.min_left * F.col("n_words"))
    stays = lambda x: ~(x.rlike(WORD_CLASS) & F.array_contains(F.col(bad), hashed(x)))
    clean = F.when(F.col(bad).isNull(), quoted(text)).otherwise(F.array_join(F.filter(F.split(F.col(t), "\n"), stays), "\n"))
    return removed.select(
        *[quoted(c) for c in columns],
        *MEASURES[:7],
        (F.col("base_failed").cast("int") + depleted.cast("int") == 0).alias("kept"),
        clean.alias("clean_text"),
    )


#: The query's rows in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tokens,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (
  SELECT doc_id, unnest(list_transform(range(1, len(tokens) - 3),
    lambda i: {'i': i, 'win': array_to_string(list_slice(tokens, i, i + 4), ' ')})) AS s FROM w WHERE len(tokens) >= 5),
g AS (
  SELECT doc_id, s.i AS i, count(*) OVER (PARTITION BY doc_id, s.win) AS n FROM p),
r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(5) AS o(k) WHERE n > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, host, t, unnest(lines) AS line FROM w),
h AS (
  SELECT *, lower(regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS line_words FROM l),
hosts AS (
  SELECT host, count(DISTINCT t) AS documents FROM d GROUP BY host),
common AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM h GROUP BY host, norm) JOIN hosts USING (host)
  WHERE n >= 10 AND n > 0.05 * documents),
lost AS (
  SELECT doc_id, sum(line_words) AS n_removed_words FROM h JOIN common USING (host, norm) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(tokens) AS n_words, coalesce(list_sum(list_transform(tokens, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS lost_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  CAST(lost_words AS BIGINT) AS n_removed_words,
  NOT base_failed AND n_words - lost_words >= 10 AND n_words - lost_words >= 0.5 * n_words AS kept
FROM b
"""
