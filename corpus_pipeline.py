"""From raw documents to tokens: quality rules, line dedup, near duplicates, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import line_spread, ngram_join, quality_rules, sentencepiece_codec, soft_mixing
from spanloom.llm.workspace import Workspace, documents

#: Near duplicates of the pipeline; op10 has its own setting.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior quality is under one half go."""
    return quality_rules.keep_good(docs, Workspace(spark, "pipeline-quality"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all texts but the first that shows them; n_chars follows the text."""
    cleaned = line_spread.line_spread(docs, Workspace(spark, "pipeline-lines")).withColumn("n_chars", F.char_length("text").cast("long"))
    return cleaned.select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: word shingles of five, Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, Workspace(spark, "pipeline-ngrams"), words=SHINGLE_WORDS, percent=SHINGLE_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the fitted rates; rows with no copy go, rows with several are repeated.

    Clean documents of the target languages all stay; a domain that no document belongs to misses its target.
    """
    labels = soft_mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)
    return soft_mixing.mix(docs, labels, Workspace(spark, "pipeline-mixing"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document drawn."""
    return sentencepiece_codec.round_trip(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: Rules weighed by EM, iterative fits and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each on what its predecessor wrote."""
    ws = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return docs
