"""Exact token-length histogram.

Documents are aggregated by their encoded length; suffix sums over the histogram answer totals, quantiles and truncated
totals for every context limit without touching the documents again.

Defined results: a null text counts as the empty text (length 0); repeated rows count as often as they occur; an empty
table gives an empty histogram. Ties: documents of one length share a row. A very long text is encoded whole, alone in its
slice; columns of any name may come along, only the text is used.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices

#: Lengths that are summed up together before the sums over all lengths are made.
BLOCK = 1024
BATCH_CHARS = 2_000_000


@lru_cache(maxsize=2)
def _encoding(pattern: str, ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_lengths(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """One row per document with n_tokens, the length of its whole text as the byte-level BPE encodes it. Only the text leaves the JVM."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    if len(raw) > 32 << 20:
        raise ValueError("the vocabulary is too large to send to every executor")
    held = df.sparkSession.sparkContext.broadcast((pattern, raw))

    def run(batches):
        enc = _encoding(*held.value)
        for batch in batches:
            for _, texts in text_slices(batch, 0, BATCH_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())], names=["n_tokens"])

    return df.select(df[f"`{text_col}`"]).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """The histogram of n_tokens with suffix sums, one row per length that occurs:

    n_docs, docs_at_least (documents of this length or more), tokens_at_least (their tokens), total_docs, total_tokens,
    truncated_tokens (tokens left when every document is cut to this length), docs_quantile (share of documents of this length or less).
    The sums run over blocks of lengths first, so no task holds more than a block of rows or the list of blocks.
    """
    hist = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    hist = materialize(hist, "token-histogram")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("t0"), F.sum("bd").over(every).alias("total_docs"), F.sum("bt").over(every).alias("total_tokens"))
    down = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumns({"dd": F.sum("n_docs").over(down), "tt": F.sum(F.col("n_docs") * F.col("n_tokens")).over(down)}).join(blocks, F.col("block") == F.col("b"))
    docs, tokens = F.col("d0") + F.col("dd"), F.col("t0") + F.col("tt")
    return out.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "total_docs", "total_tokens",
        (F.col("total_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_tokens"),
        ((F.col("total_docs") - docs + F.col("n_docs")) / F.col("total_docs")).alias("docs_quantile"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: tokens kept when documents are cut to it, and documents that are cut. Exact for any limit, from the histogram alone."""
    cut = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context_limit")
    return hist.select("n_tokens", "n_docs", cut).groupBy("context_limit").agg(F.sum(F.col("n_docs") * F.least("n_tokens", "context_limit")).alias("kept_tokens"), F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("cut_docs"))


def length_quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that at least this share of the documents does not exceed."""
    at = F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share")
    return hist.select("n_tokens", "docs_quantile", at).filter(F.col("docs_quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
