"""The dealt operators over the given tables, one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry.llm import (
    centroid_clusters, decontaminate, fill_in_middle, html_text, language_id, packing, quality, secret_scan, sharding, simhash,
    substring_dedup, suffix_tree, token_files,
)
from parcelry.llm.common import read, scratch_path
from parcelry.plans.registry import Registry

registry = Registry()

BYTE_BPE, BYTE_END = public_tokenizers.path("byte_bpe_50k.json"), 0
WORD_BPE, WORD_END = public_tokenizers.path("word_bpe_49k.json"), 1
#: A sequence holds pieces of sixteen documents at most.
LIMITS = packing.Limits(segments=16)


@registry.query()
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(read(spark, sf_dir, "documents"), path, "doc_id", "text", BYTE_BPE, BYTE_END)
    documents = token_files.read_token_files(spark, path)
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@registry.query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_texts(read(spark, sf_dir, "documents"), "doc_id", "text", WORD_BPE, WORD_END, limits=LIMITS)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"),
        "sequence_id", "offset", "segment",
    )


@registry.query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    placed = sharding.narrow_by_bytes(
        read(spark, sf_dir, "documents"), "doc_id", text, size, 40, text_crc32=F.crc32(text.cast("binary"))
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registry.query()
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract(read(spark, sf_dir, "pages"), "html", ("page_id", "url"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


@registry.query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, most=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@registry.query(quality.SQL)
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), "text", "source").select("doc_id", *quality.MEASURES[:8])


@registry.query()
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(read(spark, sf_dir, "documents"), "text", "source")
    # Outer, so that the scan is not made a second time to see which rows have a candidate.
    found = scanned.select("doc_id", F.explode_outer(F.filter("candidates", lambda c: c["secret"])).alias("c")).where("c is not null")
    return found.select(
        "doc_id", F.col("c.place").alias("place"), F.char_length("c.value").cast("long").alias("length"),
        F.sha2(F.col("c.value").cast("binary"), 256).alias("value_sha256"), F.col("c.score").alias("score"),
    )


@registry.query()
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    matched = decontaminate.with_matches(documents, "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    found = matched.select("doc_id", F.explode("matches").alias("m"))
    return found.select(
        "doc_id", F.col("m.item").alias("item_id"), F.col("m.start").alias("start"), F.col("m.words").alias("n_words"),
        F.col("m.distance").alias("distance"),
    )


@registry.query()
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_shared(read(spark, sf_dir, "documents"), "doc_id", "text", window=50)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@registry.query()
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 7 == 2
    scored = suffix_tree.score(read(spark, sf_dir, "documents"), "doc_id", "text", ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@registry.query(fill_in_middle.SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest(F.col("fim.output")).alias("output_sha256"),
        digest(fill_in_middle.restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


@registry.query(centroid_clusters.sql())
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters.clustered(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.withColumnRenamed("key", "vec_id").drop("evaluated")


@registry.query()
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 3 == 1
    fitted = language_id.fit(documents.where(~held_out), "text", "lang", "doc_id")
    judged = language_id.identify(documents.select("doc_id", "text", held_out.alias("held_out")), "text", fitted)
    return judged.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")
