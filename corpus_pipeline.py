"""A training corpus from raw documents: quality rules, near-duplicates, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored and read again as the
next stage's documents. All but the last return the columns of ``documents``, whatever these are, and
any number of rows, none included. Null and empty texts fail the quality rules; given to a later stage
alone, they count as texts without words. Rows that agree in all columns are one document to the
near-duplicate stage and are treated alike by the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry.llm import decontaminate, packing, quality, secret_scan, simhash
from parcelry.llm.common import quoted, read, scratch_path, working_name
from parcelry.llm.queries import WORD_BPE, WORD_END
from parcelry.plans.registry import Query


def with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` with the text from another column, and n_chars (if there is one) counted anew."""
    chars = F.char_length(quoted(text)).cast("long")
    fresh = {"text": quoted(text), "n_chars": F.coalesce(chars, quoted("n_chars")) if "n_chars" in columns else None}
    return df.select(*[(fresh[c] if c in fresh else quoted(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their source share."""
    taken = {c: n for c, n in zip([c for c in docs.columns if c in quality.MEASURES], working_name(docs, *["_own"] * len(docs.columns)))}
    assessed = quality.assess(docs.withColumnsRenamed(taken), "text", "source").where("kept")
    back = {n: c for c, n in taken.items()}
    (clean,) = working_name(docs, "_clean")
    named = assessed.withColumnRenamed("clean_text", clean).drop(*[m for m in quality.MEASURES if m != "clean_text"])
    return with_text(named.withColumnsRenamed(back), docs.columns, clean)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return simhash.representatives(docs, "doc_id", "text", shingle=3, most=3)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    (matches,) = working_name(docs, "_matches")
    found = decontaminate.with_matches(docs, "text", read(spark, sf_dir, "benchmark"), "item_id", "text", matches)
    return found.where(F.size(matches) == 0).select(*[quoted(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    own = {c: n for c, n in zip([c for c in docs.columns if c in ("candidates", "redacted")], working_name(docs, "_own", "_own"))}
    scanned = secret_scan.scan(docs.withColumnsRenamed(own), "text", "source").drop("candidates")
    (masked,) = working_name(docs, "_masked")
    named = scanned.withColumnRenamed("redacted", masked).withColumnsRenamed({n: c for c, n in own.items()})
    return with_text(named, docs.columns, masked)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences, with their ids."""
    return packing.pack_texts(docs, "doc_id", "text", WORD_BPE, WORD_END)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("secret_scans", secrets),
    ("packing", packed),
]

#: Fingerprints, edit distances, forests and tokenizers are beyond SQL; see the brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERY = Query(run, ORACLE_SQL)
