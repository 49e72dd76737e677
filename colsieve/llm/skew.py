"""Joins on keys of which one may hold a third of all rows, and filters of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsieve.llm.ranks import SLICES

#: log2 of the bits of a filter, at least and at most: 16 for each key in between. The largest is 128 MB to broadcast,
#: for 67 million keys; with more, more rows pass that needn't.
LEAST_BITS, MOST_BITS = 17, 30


def filter_bits(n_keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * n_keys).bit_length()))


def attach(rows: DataFrame, table: DataFrame, key: str, n: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (null where it hasn't the key) but ``n``.

    ``table`` has each ``key`` once and in ``n`` how many of ``rows`` have it. Keys with over 1/SLICES of the
    sum of ``n`` number fewer than SLICES, so they are broadcast; rows of the others meet in a shuffled join, at
    most that share of all in one key. ``spread`` is a column of ``rows`` that deals out the rows already done.
    """
    names = [c for c in table.columns if c not in (key, n)]
    total = table.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total"))
    sized = table.crossJoin(F.broadcast(total)).withColumn("_v", F.struct(*names))
    hot = sized.where(F.col(n) * SLICES > F.col("_total")).select(key, F.col("_v").alias("_hot"))
    rest = sized.where(F.col(n) * SLICES <= F.col("_total")).select(F.col(key).cast("string").alias("_key"), F.col("_v").alias("_rest"))
    marked = rows.join(F.broadcast(hot), key, "left")
    own = F.concat(F.lit("-"), F.xxhash64(spread).cast("string"), F.lit("-"))  # matches nothing
    marked = marked.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(own))
    found = marked.join(rest, "_key", "left")
    v = F.coalesce("_hot", "_rest")
    return found.select(*rows.columns, *[v[c].alias(c) for c in names])


def _slot(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The filter of ``key``: ``(_bucket, _bits)``, 4 KB for each 32,768 slots that aren't all empty."""
    slots = keys.select(_slot(key, bits).alias("_slot"))
    return slots.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))


def marked(rows: DataFrame, filter_: DataFrame, key: str, bits: int) -> DataFrame:
    """``rows`` with ``_maybe``, true where the filter has ``key``, and never null."""
    slotted = rows.withColumn("_slot", _slot(key, bits)).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = slotted.join(F.broadcast(filter_), "_bucket", "left")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)).alias("_maybe"))


def split(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be one of ``keys`` and those whose isn't. The first has all that are, and up to a
    sixteenth of the others: the filter between them has its size by the number of keys, up to a bound for its broadcast."""
    bits = filter_bits(keys.count())
    both = marked(rows, bitmap(keys, key, bits), key, bits)
    return both.where("_maybe").drop("_maybe"), both.where("NOT _maybe").drop("_maybe")


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The first part of :func:`split`."""
    return split(rows, keys, key)[0]


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` but those whose ``key`` is one of ``keys``; null keys stay. Only rows that may go are shuffled."""
    maybe, others = split(rows, keys, key)
    return others.unionByName(maybe.join(keys.select(key).distinct(), key, "left_anti").select(*rows.columns))
