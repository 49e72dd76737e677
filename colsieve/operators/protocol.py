"""Tasks, splits, folds, and what is fitted on a training part: one plan for all tasks and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tasks_ovr(labels: DataFrame) -> DataFrame:
    """``(task, class, other, positive)`` of a ``label`` column: one binary task for two labels, else one against the rest for each.

    The second of a task's two values in sorted order is positive, so 'rest' is, where the class sorts before it.
    """
    names = labels.select(F.col("label").cast("string").alias("label")).where("label IS NOT NULL").distinct()
    n = F.broadcast(names.agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high")))
    rows = names.crossJoin(n)
    two = F.col("_n") == 2
    kept = rows.where(~two | (F.col("label") == F.col("_low")))
    other = F.when(two, F.col("_high")).otherwise(F.lit("rest"))
    return kept.select(F.when(two, F.lit("binary")).otherwise(F.concat(F.lit("ovr_"), "label")).alias("task"), F.col("label").alias("class"), other.alias("other"), F.greatest("label", other).alias("positive"))


def labelled(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """``rows`` for every task with ``y``, 1 for its positive value. Tasks are as few as labels."""
    value = F.when(F.col("label").cast("string") == F.col("class"), F.col("class")).otherwise(F.col("other"))
    return rows.crossJoin(F.broadcast(tasks)).withColumn("y", (value == F.col("positive")).cast("int")).drop("class", "other", "positive")


def order_key(seed: Column | int, *parts: str) -> Column:
    """An md5 by which rows are shuffled; the same in any engine."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("-", seed.cast("string"), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def places(rows: DataFrame, keys: list[str], md5: str, tie: str) -> DataFrame:
    """``rows`` with ``_place``, from 1, in the order of ``md5`` within ``keys``.

    A group may hold most rows, so it is ranked in 256 parts by the key's first two digits, which are even; what lies
    before a part comes from a table of counts.
    """
    parted = rows.withColumn("_part", F.substring(md5, 1, 2))
    counts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(md5, tie))
    return parted.withColumn("_own", own).join(offsets, [*keys, "_part"]).withColumn("_place", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def stratified_splits(rows: DataFrame, n_splits: int, train_size: float, seed: int = 42, sample_id: str = "sample_id", label: str = "label") -> DataFrame:
    """``(split, sample_id, label, part)``: draws without replacement, in each the training part has floor(train_size * n) rows.

    Classes get their share by largest remainders, larger classes first among equals, then by label. Within a
    class, rows are ordered by an md5 of seed, split and id. Null labels are left out.
    """
    labelled_rows = rows.select(F.col(sample_id).alias("sample_id"), F.col(label).alias("label")).where("label IS NOT NULL")
    sizes = labelled_rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy()
    total = F.sum("_n").over(whole)
    share = F.col("_n") * F.floor(F.lit(train_size) * total)
    quota = sizes.withColumn("_total", total).withColumn("_floor", F.expr(f"(_n * cast(floor({train_size}D * _total) as bigint)) div _total")).withColumn("_rest", share % F.col("_total"))
    spare = F.floor(F.lit(train_size) * F.col("_total")) - F.sum("_floor").over(whole)
    by_rest = W.orderBy(F.desc("_rest"), F.desc("_n"), "label")
    quota = quota.withColumn("_take", F.col("_floor") + F.when(F.row_number().over(by_rest) <= spare, 1).otherwise(0)).select("label", "_take")
    drawn = labelled_rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    placed = places(drawn.withColumn("_key", order_key(seed, "split", "sample_id")), ["split", "label"], "_key", "sample_id")
    return placed.join(F.broadcast(quota), "label").select("split", "sample_id", "label", F.when(F.col("_place") <= F.col("_take"), F.lit("train")).otherwise(F.lit("test")).alias("part"))


def folds(rows: DataFrame, cv: int, seed: int | None = None, keys: tuple[str, ...] = (), sample_id: str = "sample_id", label: str = "label") -> DataFrame:
    """``rows`` with ``fold`` in 0..cv-1, classes dealt out evenly; shuffled by ``seed``, else in the order of ids."""
    if seed is None:
        place = F.row_number().over(W.partitionBy(*keys, label).orderBy(sample_id))
        return rows.withColumn("fold", ((place - 1) % cv).cast("int"))
    placed = places(rows.withColumn("_key", order_key(seed, sample_id)), [*keys, label], "_key", sample_id)
    return placed.withColumn("fold", ((F.col("_place") - 1) % cv).cast("int")).drop("_key", "_place")


def medians(train: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians of each feature, nulls left out."""
    return train.groupBy(*keys, "feature").agg(F.expr("percentile(value, 0.5D)").alias("median"))


def impute(long: DataFrame, keys: list[str], train: Column) -> DataFrame:
    """``long`` with nulls replaced by the training rows' median of the feature."""
    known = medians(long.where(train), keys)
    return long.join(known, [*keys, "feature"], "left").withColumn("value", F.coalesce("value", "median")).drop("median")


def standardize(long: DataFrame, keys: list[str], train: Column) -> DataFrame:
    """``long`` centred and scaled by the training rows' mean and population deviation; constant features are not scaled."""
    stats = long.where(train).groupBy(*keys, "feature").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    scale = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    return long.join(stats, [*keys, "feature"], "left").withColumn("value", (F.col("value") - F.col("_mean")) / scale).drop("_mean", "_sd")


def train_count(n: int, train_size: float) -> int:
    return math.floor(train_size * n)
