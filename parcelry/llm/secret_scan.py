"""Secrets in texts: a wide pattern finds candidates, a random forest removes false positives.

The forest sees a candidate's length, the transitions between its characters (their kinds, and how usual
they are in the corpus' own words), how much of it the corpus' frequent words cover, its path and the words
around it. It is trained on labelled findings and applied as a column expression inside each row, so texts
are neither shuffled nor sent to Python.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.llm.common import drop_stored, let, quoted, stored, working_name
from parcelry.llm.trees import nested, votes

# What may be a secret (long runs, and what is assigned), and the words that speak for or against one.
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = rf"(?<=[:=]\s{{0,3}}[\"']?)[^\s\"']{{8,}}|{RUN}"
ASSIGNED = (
    r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|(?:api|access|private|signing)[_-]?key)"
    r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?$"
)
NEAR_KEY = r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|credential|auth|bearer|api[_-]?key|access[_-]?key|private)"
NEAR_HARMLESS = r"(?i)(?:sha-?\d*|md5|checksum|digest|commit|revision|etag|uuid|guid|build|version|image|integrity|blob|hash|isbn|serial|phone|card|account)"
HARMLESS_PATH = r"(?i)(?:test|example|sample|mock|fixture|docs?/|tutorial)"
PLACEHOLDER = r"(?i)(?:your|example|sample|dummy|change|insert|placeholder|xxxx|todo|redacted|test)"
MASK = "[SECRET]"
CONTEXT = 60

FEATURES = (
    "length", "class_changes", "usual", "digits", "upper", "repeats", "covered", "harmless_path", "near_key", "near_harmless", "assigned",
    "placeholder",
)
#: Characters that transitions tell apart; any other is one more.
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"
WIDTH = len(SIGNS) + 1


@dataclass(frozen=True)
class Corpus:
    """What is learnt of a corpus: its most frequent words, and how likely each sign is behind each other in its words
    (natural logarithms, a row of ``WIDTH`` for each first sign, 0 standing for any other character)."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]

    @classmethod
    def of_words(cls, counted: Iterable[tuple[str, int]], size: int = 2000) -> Corpus:
        """From words with their counts, the most frequent first."""
        counted = list(counted)
        pairs: Counter = Counter()
        for word, n in counted:
            for pair in zip(word, word[1:]):
                pairs[tuple(SIGNS.find(c) + 1 for c in pair)] += n
        return cls(tuple(w for w, _ in counted[:size] if len(w) >= 3), logarithms(pairs))

    @classmethod
    def learn(cls, df: DataFrame, text: str, size: int = 2000) -> Corpus:
        """The ``size`` words of three or more letters that are in most rows of ``df`` (ties: by word), and the
        transitions in all words, each counted once for a row that has it."""
        found = F.split(F.lower(quoted(text)), r"[^\p{L}]+")
        words = df.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        words, path = stored(words.where("word <> ''"), "words")
        top = words.where(F.char_length("word") >= 3).orderBy(F.desc("n"), "word").limit(size).collect()
        codes = F.transform(F.split("word", ""), lambda c: F.position(c, F.lit(SIGNS)))
        place = F.transform(F.slice(codes, 2, F.size(codes)), lambda c, i: F.get(codes, i) * WIDTH + c)
        pairs = words.select("n", F.explode(place).alias("place")).groupBy("place").agg(F.sum("n").alias("n")).collect()
        drop_stored(df.sparkSession, path)
        return cls(tuple(r.word for r in top), logarithms({divmod(r.place, WIDTH): r.n for r in pairs}))


def logarithms(pairs: Mapping[tuple[int, int], int]) -> tuple[float, ...]:
    """Logarithms of the chances of second signs, each pair counted once more than it was seen."""
    rows = [[pairs.get((a, b), 0) + 1 for b in range(WIDTH)] for a in range(WIDTH)]
    return tuple(round(math.log(n / sum(row)), 4) for row in rows for n in row)


def usual(value: Column, transitions: Column) -> Column:
    """Mean logarithm of the chances of a value's transitions in the corpus' words."""
    codes = F.transform(F.split(F.lower(value), ""), lambda c: F.position(c, F.lit(SIGNS)))
    following = lambda k: F.slice(k, 2, F.greatest(F.size(k), F.lit(1)))
    chance = lambda k: F.transform(following(k), lambda c, i: F.get(transitions, F.get(k, i) * WIDTH + c))
    total = let(codes, lambda k: F.aggregate(chance(k), F.lit(0.0), lambda a, x: a + x))
    return total / F.greatest(F.char_length(value) - 1, F.lit(1))


def features(
    value: Column, left: Column, right: Column, path: Column, assigned: Column, known: Column, transitions: Column
) -> list[Column]:
    """``FEATURES`` of a candidate as doubles; the corpus' words and transitions are one array literal each."""
    length = F.char_length(value)
    share = lambda n: n / F.greatest(length, F.lit(1))
    changes = r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}{3,}"), F.lit(0))
    covered = F.aggregate(F.filter(runs, lambda r: F.array_contains(known, r)), F.lit(0), lambda a, r: a + F.char_length(r))
    near = F.concat(left, F.lit(" "), right)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        length.cast("double"), share(F.regexp_count(value, F.lit(changes))), usual(value, transitions), share(F.regexp_count(value, F.lit("[0-9]"))),
        share(F.regexp_count(value, F.lit("[A-Z]"))), share(F.regexp_count(value, F.lit(r"(.)\1"))), share(covered),
        flag(path.rlike(HARMLESS_PATH)), flag(near.rlike(NEAR_KEY)), flag(near.rlike(NEAR_HARMLESS)), flag(assigned),
        flag(value.rlike(PLACEHOLDER)),
    ]


def labelled_findings(spark: SparkSession, known: Sequence[str], each: int = 40, first: int = 0) -> DataFrame:
    """Labelled findings (value, left, right, path, assigned, label), ``each`` of every kind, by rule; other rows for
    another ``first``.

    A kind is an SQL expression over ``i`` and dictionary words ``w(k)``. Kinds are found in files of
    all sorts; what looks like a secret in a test, an example or a manual is harmless.
    """
    words = literal([w for w in known[:200] if w.isalpha()] or ["alpha", "beta", "gamma", "delta"])
    w = lambda k: f"w{k}"
    random64 = "base64(unhex(sha2(concat('v', i), 256)))"
    hexes = {32: "md5(concat('r', i))", 40: "sha1(concat('s', i))", 64: "sha2(concat('t', i), 256)"}
    alnum = f"substr(regexp_replace({random64}, '[^A-Za-z0-9]', ''), 1, 20 + cast(pmod(i, 14) as int))"
    letters = f"translate({alnum}, '0123456789', 'QwZxKvJpYt')"
    strange = lambda *k: f"translate(concat({', '.join(map(w, k))}), 'aeiou', 'eioua')"
    key_names = ["token", "api_key", "secret", "password", "auth", "access_key"]
    secrets = [
        *[(v, f"concat({w(1)}, ' {k} = \"')", w(2), "1") for k, v in zip(key_names, [*hexes.values(), alnum, random64, hexes[40]])],
        *[(f"upper({hexes[n]})", f"upper(concat({w(1)}, ' token = \"'))", f"upper({w(2)})", "1") for n in (32, 40)],
        (f"concat('AKIA', substr(upper({alnum}), 1, 16))", f"concat({w(1)}, ' access key ')", w(2), "0"),
        (f"concat('ghp_', {alnum})", f"concat('bearer ', {w(1)}, ' ')", w(2), "0"),
        (f"concat(substr({w(3)}, 1, 5), '!', substr({hexes[32]}, 1, 6), '#')", "'password: '", w(2), "1"),
        (random64, f"concat({w(1)}, ' private key ', {w(2)}, ' ')", w(4), "0"),
        (hexes[40], f"concat({w(1)}, ' ', {w(3)}, '; token=')", w(2), "1"),
        (f"concat('sk-', {alnum})", f"concat({w(1)}, ' api_key: ')", w(2), "1"),
        (f"concat('AKIA', substr(upper({letters}), 1, 16))", f"concat({w(1)}, ' access key ')", w(2), "0"),
        (f"concat('AKIA', substr(upper({letters}), 1, 16))", f"concat({w(1)}, ' bearer ')", w(2), "0"),
        (f"concat('ghp_', {letters})", f"concat('bearer ', {w(1)}, ' ')", w(2), "0"),
        (f"substr({letters}, 1, 16 + cast(pmod(i, 10) as int))", f"concat({w(1)}, ' bearer ')", w(2), "0"),
        (f"substr({letters}, 1, 16 + cast(pmod(i, 10) as int))", f"concat({w(1)}, ' access key ')", w(2), "0"),
        (letters, f"concat({w(1)}, ' secret = \"')", w(2), "1"),
    ]
    harmless = [
        ("cast(4000000000000000 + pmod(xxhash64(i, 5), 5000000000000000) as string)", w(1), w(2), "0"),
        ("cast(4000000000000000 + pmod(xxhash64(i, 6), 5000000000000000) as string)", f"concat('card ', {w(1)})", w(2), "0"),
        *[(v, f"concat({w(1)}, ' {k} ')", w(2), "0") for k, v in zip(("md5", "commit", "sha256"), hexes.values())],
        (f"concat(substr({hexes[32]}, 1, 8), '-', substr({hexes[40]}, 1, 4), '-', substr({hexes[64]}, 1, 12))", "'uuid '", w(2), "0"),
        (f"concat({w(3)}, '_', {w(4)}, '_', {w(5)}, '_', {w(6)}, i)", w(1), w(2), "0"),
        (f"concat({w(3)}, '/', {w(4)}, '/', {w(5)}, '-', pmod(i, 9), '/', {w(6)})", w(1), w(2), "0"),
        (f"concat({w(3)}, {w(4)}, {w(5)}, {w(6)}, {w(7)})", w(1), w(2), "0"),
        ("concat('2024-0', 1 + pmod(i, 9), '-1', pmod(i, 7), 'T00-00-0', pmod(i, 9))", w(1), w(2), "0"),
        ("repeat(substr('x-=_0', 1 + cast(pmod(i, 5) as int), 1), 16 + cast(pmod(i, 30) as int))", w(1), w(2), "0"),
        (f"concat('your_', {w(3)}, '_key_here_', i)", "'api_key = '", w(2), "1"),
        (f"concat({w(3)}, {w(4)}, {w(5)})", f"concat({w(1)}, ' token: ')", w(2), "1"),
        ("'changeme123'", "'password = '", w(2), "1"),
        (f"concat('example', substr({hexes[32]}, 1, 12))", "'secret: '", w(2), "1"),
        (hexes[40], f"concat('etag checksum ', {w(1)}, ' ')", w(2), "0"),
        (strange(3, 4, 5, 6), w(1), w(2), "0"),
        (strange(3, 4, 5, 6), f"concat({w(1)}, ' bearer ')", w(2), "0"),
        (f"concat({strange(3, 4)}, ',')", f"concat({w(1)}, ': ')", w(2), "0"),
        (f"upper({strange(3, 4, 5, 6)})", w(1), w(2), "0"),
        (f"upper(substr({strange(3, 4, 5, 6, 7)}, 1, 16 + cast(pmod(i, 10) as int)))", w(1), w(2), "0"),
        (f"upper(concat({w(3)}, {w(4)}, {w(5)}, {w(6)}))", w(1), w(2), "0"),
        (f"substr({strange(3, 4, 5, 6, 7)}, 1, 16 + cast(pmod(i, 10) as int))", w(1), w(2), "0"),
        (f"concat(initcap({w(3)}), initcap({w(4)}), initcap({w(5)}), initcap({w(6)}))", f"concat({w(1)}, ' access key ')", w(2), "0"),
        (f"upper(concat({w(3)}, '_', {w(4)}, '_', {w(5)}, '_', {w(6)}))", f"concat({w(1)}, ' token ')", w(2), "0"),
        (f"concat({w(3)}, '-', {w(4)}, '-', {w(5)}, '-', {w(6)})", f"concat({w(1)}, ' password ')", w(2), "0"),
        (f"upper(concat({w(3)}, {w(4)}, {w(5)}, 'ization'))", w(1), w(2), "0"),
        (f"upper(concat({strange(3, 4)}, 'mentation', {w(5)}))", w(1), w(2), "0"),
    ]
    code = "concat(element_at(array('src', 'src/app', 'lib/net', 'deploy', 'data'), cast(pmod(i, 5) + 1 as int)), pmod(i, 20))"
    manual = "concat(element_at(array('tests/', 'docs/', 'example_', 'fixtures/', 'tutorial '), cast(pmod(i, 5) + 1 as int)), pmod(i, 20))"
    structs = ", ".join(
        f"named_struct('value', {value}, 'left', {left}, 'right', {right}, 'assigned', {assigned} = 1, 'label', double({label}))"
        for kinds, label in ((secrets, 1), (harmless, 0)) for value, left, right, assigned in kinds
    )
    places = f"inline(array(named_struct('path', {code}, 'label', label), named_struct('path', {manual}, 'label', 0D)))"
    word = lambda k: F.element_at("words", (F.pmod(F.xxhash64("i", F.lit(k)), F.size("words")) + 1).cast("int"))
    base = spark.range(first, first + each, 1, 1).select(F.col("id").alias("i"), words.alias("words"))
    base = base.select("i", *[word(k).alias(w(k)) for k in range(1, 8)])
    found = base.selectExpr("i", f"inline(array({structs}))")
    return found.selectExpr("value", "left", "right", "assigned", places)


def fit(findings: DataFrame, corpus: Corpus, trees: int = 20, depth: int = 6, at_most: int = 100_000) -> list[tuple]:
    """A random forest over ``FEATURES``, trained on at most ``at_most`` labelled findings."""
    columns = features(*[F.col(c) for c in ("value", "left", "right", "path", "assigned")], *literals(corpus))
    rows = findings.limit(at_most).select(*[c.alias(n) for c, n in zip(columns, FEATURES)], "label").coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird").fit(vectors)
    return [nested(tree.rootNode()) for tree in model._java_obj.trees()]


def literal(known: Iterable[str]) -> Column:
    """Words as an array that is computed once."""
    return F.split(F.lit(" ".join(known)), " ")


def literals(corpus: Corpus) -> tuple[Column, Column]:
    return literal(corpus.words), literal(map(str, corpus.transitions)).cast("array<double>")


def scan(
    df: DataFrame, text: str, path: str, corpus: Corpus | None = None, findings: DataFrame | None = None,
    threshold: float = 0.5, trees: int = 20, depth: int = 6,
) -> DataFrame:
    """The rows of ``df`` with ``candidates`` and ``redacted`` (columns of these names are replaced).

    ``candidates`` holds each candidate of the text in order: place (from 0), value, score (share of
    trees that call it a secret) and secret (score at or above the threshold). ``redacted`` is the text
    with every secret's value replaced by a mark; it equals the text where there is none, and is null
    where that is. A null path says nothing. Without ``findings`` the labelled table made by rule is
    used, without ``corpus`` what is learnt of all texts of ``df``.
    """
    spark = df.sparkSession
    corpus = Corpus.learn(df, text) if corpus is None else corpus
    forest = fit(labelled_findings(spark, corpus.words) if findings is None else findings, corpus, trees, depth)
    kept = [c for c in df.columns if c.lower() not in ("candidates", "redacted")]
    gaps, found, described, scored = working_name(df, "_gaps", "_found", "_described", "_scored")
    matches = F.regexp_extract_all(quoted(text), F.lit(CANDIDATE), F.lit(0))
    rows = df.select(*[quoted(c) for c in kept]).withColumn(found, F.coalesce(matches, F.array().cast("array<string>")))
    rows = rows.withColumn(gaps, F.when(F.size(found) > 0, F.split(quoted(text), CANDIDATE)))
    place = F.coalesce(quoted(path).cast("string"), F.lit(""))
    words, transitions = literals(corpus)

    def describe(around: Column, value: Column, i: Column) -> Column:
        left = F.substring(F.get(around, i), -CONTEXT, CONTEXT)
        right = F.substring(F.get(around, i + 1), 1, CONTEXT)
        assigned = left.rlike(ASSIGNED)
        values = features(value, left, right, place, assigned, words, transitions)
        return F.struct(value.alias("value"), F.array(*values).alias("values"))

    judged = F.transform(described, lambda c: F.struct(c["value"].alias("value"), votes(forest, c["values"]).alias("score")))
    rows = rows.withColumn(described, let(F.col(gaps), lambda g: F.transform(found, lambda v, i: describe(g, v, i)))).withColumn(scored, judged)
    candidate = lambda c, i: F.struct(
        i.alias("place"), c["value"].alias("value"), c["score"].alias("score"), (c["score"] >= threshold).alias("secret")
    )
    listed = F.transform(scored, candidate)
    piece = lambda g, c, i: F.concat(
        F.get(g, i), F.when(c["score"] >= threshold, F.lit(MASK)).otherwise(c["value"])
    )
    shown = let(F.col(gaps), lambda g: F.transform(scored, lambda c, i: piece(g, c, i)))
    hit = F.exists(scored, lambda c: c["score"] >= threshold)
    redacted = F.when(hit, F.concat(F.array_join(shown, ""), F.element_at(gaps, -1))).otherwise(quoted(text))
    return rows.select(*[quoted(c) for c in kept], listed.alias("candidates"), redacted.alias("redacted"))
