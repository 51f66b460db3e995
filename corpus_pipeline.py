"""From raw documents to token ids: five stages, each on all that the one before has kept.

Every stage is a function of (spark, docs, sf_dir); its rows are written as
Parquet in the shared folder and read again by the next. All but the last return
the columns of ``documents``. Null and empty texts have no language and leave in
the first stage; repeated rows are copies, of which the second keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.llm import decontaminate, language_id, parity_join, piece_sampling, secret_ledger
from urbanweave.llm.common import be_frugal, documents
from urbanweave.runtime import settle

#: Near duplicates share four fifths of their runs of five words.
NEAR = parity_join.Rule(words=5, share=80, whole=100)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    be_frugal(spark)
    return language_id.keep_known(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: the one with the smallest doc_id."""
    be_frugal(spark)
    return parity_join.keep_one(docs, NEAR)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item, with or without id."""
    be_frugal(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars brought up to date."""
    be_frugal(spark)
    return secret_ledger.redact_all(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the sampled piece ids of the text, their number, and whether they spell the text again."""
    be_frugal(spark)
    model = piece_sampling.default_model(spark)
    back = piece_sampling.decode(piece_sampling.encode(docs, model, given=True), model)
    whole = F.sha2("text", 256) == F.col("given")
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), whole.alias("lossless"))


STAGES = [
    ("language_id", known_languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("secret_scan", secrets_redacted),
    ("piece_encoding", pieces),
]

# A trained language model and sampled pieces cannot be written in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
