"""Operator 8, token counts: the exact histogram of encoded lengths.

Each batch is reduced to how many documents have which length; the counts are summed by length. Suffix sums
over the lengths then answer totals, quantiles and truncated totals for every context limit, without another
look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colsieve.llm.tokens import as_bytes, encoder, narrow_batches
from colsieve.sources.scratch import written

#: Lengths to a block of the two-level suffix sums.
BLOCK = 64


def length_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", special: bool = False) -> DataFrame:
    """``(n_tokens, docs)`` over all rows; null and empty texts have 0 tokens; an empty table gives no rows."""
    narrow_batches(docs.sparkSession)
    make = encoder(docs.sparkSession, tokenizer, special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            n, docs = np.unique(np.fromiter((len(encode(x)) for x in batch.column(0).to_pylist()), dtype="i8", count=batch.num_rows), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs.astype("i8"))], names=["n_tokens", "docs"])

    parts = docs.select(as_bytes(text_col).alias("_text")).mapInArrow(count, "n_tokens long, docs long")
    return parts.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text", special: bool = False) -> DataFrame:
    """One row for each length that occurs, with what holds if it is the context limit.

    ``n_tokens, docs, tokens`` (of that length), ``docs_at_least, tokens_at_least, docs_at_most`` and
    ``truncated_total``, the tokens left when every document is cut to ``n_tokens``. Sums go over blocks of
    64 lengths first, so that no task holds the histogram of all lengths.
    """
    counts = written(length_counts(docs, tokenizer, text_col, special), "lengths")
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    later = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0)
    blocks = blocks.select("_block", F.coalesce(F.sum("_d").over(later), zero).alias("_d"), F.coalesce(F.sum("_t").over(later), zero).alias("_t"), F.sum("_d").over(whole).alias("_dn"), F.sum("_t").over(whole).alias("_tn"))
    here = W.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    out = counts.join(blocks, "_block").withColumn("docs_at_least", F.col("_d") + F.sum("docs").over(here)).withColumn("tokens_at_least", F.col("_t") + F.sum("tokens").over(here))
    return out.select(
        "n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("_dn") - F.col("docs_at_least") + F.col("docs")).alias("docs_at_most"),
        (F.col("_tn") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
    )


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """``(n_limit, docs_over, truncated_total)`` for any context limits, occurring lengths or not: a bounded list of numbers in ``n_limit``.

    Documents over the limit are cut to it. One sum over the histogram for each limit.
    """
    joined = histogram.join(F.broadcast(limits), F.lit(True))
    return joined.groupBy("n_limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("n_limit"), F.col("docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.col("docs") * F.least("n_tokens", "n_limit")).alias("truncated_total"),
    )


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share ``q`` of documents don't exceed; None without documents."""
    total = F.col("docs_at_most") + F.col("docs_at_least") - F.col("docs")
    row = histogram.where(F.col("docs_at_most") >= F.lit(q) * total).agg(F.min("n_tokens")).first()
    return row[0]
