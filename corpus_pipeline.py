"""The corpus pipeline: language ID, line dedup, near-duplicate join, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendroframe.llm import bpe, language_id, line_dedup, mixing, ngram_join, queries
from dendroframe.llm.common import fresh, materialize, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a certain language go."""
    return language_id.accepted(docs, queries.trained_language_model(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of a source's documents hold go."""
    return line_dedup.dedup_documents(docs, queries.LINE_RATIO, queries.LINE_MIN_PAGES, queries.LINE_LEAST)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once for each epoch in which it takes them."""
    mark = fresh(docs.columns, "_mixed")
    mixed = mixing.mix(docs, mixing.domain_of(F.col("source")), queries.MIX_WEIGHTS, queries.MIX_NUM, queries.MIX_DEN, queries.MIX_EPOCHS, queries.MIX_SEED, prefix=f"{mark}_")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{mark}_copies"))).alias(f"{mark}_epoch")
    return mixed.select(*(F.col(f"`{c}`") for c in docs.columns), copies).drop(f"{mark}_epoch")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and a digest of what the ids decode to."""
    out = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), queries.WORD_BPE)
    return out.select("doc_id", "lang", "source", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]
#: Language ID and BPE have no SQL form; the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder before the next begins."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
