"""The queries opN_<name>: the operators over the whole tables, with the digests of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.llm import bpe_words, collocations, decontaminate, language_id, licenses, parity_join, piece_sampling, quality_model, quality_rules, secret_ledger, spelling, suffix_dedup, token_files
from urbanweave.llm.common import documents

END_ID = 2
SLIPS = 199


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses, ledger = secret_ledger.scan(documents(spark, sf_dir).select("doc_id", "text"))
    found = secret_ledger.findings(addresses, ledger)
    kinds = [rule.kind for rule in secret_ledger.BASE_RULES]
    counts = [secret_ledger.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in kinds]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_ledger.span_text(F.col("spans"), kinds), 256).alias("base_sha256"),
        secret_ledger.span_text(F.col("spans")).alias("spans"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(documents(spark, sf_dir))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select(
        "doc_id",
        "n_bytes",
        removed.cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = language_id.in_fold("doc_id", 4, 2).alias("held_out")
    return quality_model.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, decoded again: their number and hash, and whether the text came back."""
    docs = documents(spark, sf_dir)
    model = piece_sampling.default_model(spark)
    back = piece_sampling.decode(piece_sampling.encode(docs, model, given=True), model)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.sha2("text", 256) == F.col("given")).alias("lossless"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = language_id.in_fold("doc_id", 5, 0).alias("held_out")
    return language_id.predict(docs, language_id.train(docs)).select("doc_id", held_out, "lang_pred", "score")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.with_digest(licenses.detect(documents(spark, sf_dir)))


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.with_counts(decontaminate.contamination(documents(spark, sf_dir), items))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated"
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(documents(spark, sf_dir), token_files.default_tokenizer(spark), END_ID)
    held = token_files.read_token_files(manifest)
    return held.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(documents(spark, sf_dir), slips=SLIPS))


def op13_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe_words.default_vocabulary(spark)
    return bpe_words.with_digests(bpe_words.decode(bpe_words.encode(documents(spark, sf_dir), path), path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_ledger": op2_secret_ledger,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_model": op4_quality_model,
    "op5_licenses": op5_licenses,
    "op6_piece_sampling": op6_piece_sampling,
    "op7_language_id": op7_language_id,
    "op8_parity_join": op8_parity_join,
    "op9_decontamination": op9_decontamination,
    "op10_token_files": op10_token_files,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_bpe_words": op13_bpe_words,
}
