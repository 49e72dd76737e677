"""Operator 2, sharding by proportional stratified interleaving.

Rows are shuffled by a seed within each source, get their fractional rank there, and are sorted by it; cut into
equal runs, every shard then has the sources in the proportions of the whole. Only DataFrame functions are
used, and no text is moved: ids, sizes and checksums are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.llm.ranks import positions, ranked, unit_interval
from colsieve.sources.scratch import written


def interleaved_shards(docs: DataFrame, n_shards: int = 8, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, size, text_crc32, source, fraction, shard, slot``.

    Shards differ by one row at most, and for every source by its rounding at the two cuts. The row at rank r
    (from 0) of n in its source gets the fraction (r + u) / n, where u in [0, 1) comes from the source's name:
    without it all sources of one row would fall on one place. A null source is a source of its own, a null
    text counts as empty (size 1, for the row itself), null ids sort first. Equal rows are interchangeable,
    so that ties change no result. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).cast("long").alias("_crc"),
        F.col(source_col).alias("_source"),
        name.alias("_name"),
        F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("_shuffle"),
    )
    rows = written(rows.withColumn("_at", unit_interval(F.col("_shuffle"))), "shard-rows")
    order = ["_shuffle", "_id", "_size", "_crc"]
    inner = ranked(rows, "_name", "_at", order)
    dither = unit_interval(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_name")).cast("binary")))
    inner = inner.withColumn("fraction", (F.col("rank").cast("double") + dither) / F.col("group_n").cast("double"))
    placed = written(inner.select("_id", "_size", "_crc", "_source", "_name", "_shuffle", "fraction"), "shard-fractions")
    out = positions(placed, "fraction", ["_name", *order])
    out = out.withColumn("_shard", F.expr(f"cast((position * {n_shards}L) div total as int)")).withColumn("_first", F.expr(f"(_shard * total + {n_shards - 1}L) div {n_shards}L"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_source").alias(source_col),
        "fraction", F.col("_shard").alias("shard"), (F.col("position") - F.col("_first")).cast("long").alias("slot"),
    )
