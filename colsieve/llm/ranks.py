"""Ranks and running sums within groups, of which one may hold most rows, by DataFrame functions only.

A plain ``row_number() over (partition by group)`` sorts a whole group in one task. Here a group that
holds more than a ``1/slices`` part of all rows is cut along its (uniform) sort key into units of about
that part, so that no task gets more than about ``n/slices`` rows; what lies before a unit is added from
a table of at most ``2 * slices`` rows, which is the proven bound for broadcasting it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLICES = 1024


def unit_interval(hex_digits: Column) -> Column:
    """The first eight hex digits as a double in [0, 1)."""
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def heavy_groups(df: DataFrame, group: str, slices: int = SLICES) -> DataFrame:
    """``(group, _n, _units)`` of the groups over ``1/slices`` of all rows: fewer than ``slices`` rows by counting."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") * slices > F.col("_total")).select(
        group, "_n", F.ceil(F.col("_n") * slices / F.col("_total")).cast("int").alias("_units")
    )


def ranked(df: DataFrame, group: str, at: str, order: list[str], measure: str | None = None, slices: int = SLICES) -> DataFrame:
    """``df`` with ``rank`` (from 0), ``group_n`` and, given ``measure``, ``before`` and ``group_sum``.

    ``group`` must not be null. ``at`` is a double in [0, 1), spread evenly within each large group, by
    which rows are ordered first; ``order`` breaks its ties. ``df`` is read twice: give a written table.
    """
    heavy = heavy_groups(df, group, slices)
    cut = (
        df.join(F.broadcast(heavy.select(group, "_units")), group, "left")
        .withColumn("_unit", F.coalesce(F.floor(F.col(at) * F.col("_units")).cast("int"), F.lit(0)))
        .drop("_units")
    )
    sums = [F.count(F.lit(1)).alias("_c")] + ([F.sum(measure).alias("_s")] if measure else [])
    units = cut.join(F.broadcast(heavy.select(group)), group, "left_semi").groupBy(group, "_unit").agg(*sums)
    so_far = W.partitionBy(group).orderBy("_unit").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(group)
    offsets = units.select(
        group,
        "_unit",
        F.coalesce(F.sum("_c").over(so_far), F.lit(0)).alias("_c0"),
        F.sum("_c").over(whole).alias("_cn"),
        *([F.coalesce(F.sum("_s").over(so_far), F.lit(0)).alias("_s0"), F.sum("_s").over(whole).alias("_sn")] if measure else []),
    )
    w = W.partitionBy(group, "_unit").orderBy(at, *order)
    here = W.partitionBy(group, "_unit")
    out = cut.withColumn("_rn", F.row_number().over(w).cast("long") - 1).withColumn("_here", F.count(F.lit(1)).over(here))
    if measure:
        rows = w.rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn("_run", F.sum(measure).over(rows) - F.col(measure)).withColumn("_all", F.sum(measure).over(here))
    out = out.join(F.broadcast(offsets), [group, "_unit"], "left")
    out = out.withColumn("rank", F.col("_rn") + F.coalesce("_c0", F.lit(0))).withColumn("group_n", F.coalesce("_cn", "_here"))
    if measure:
        out = out.withColumn("before", F.col("_run") + F.coalesce("_s0", F.lit(0))).withColumn("group_sum", F.coalesce("_sn", "_all"))
    return out.drop("_unit", "_rn", "_here", "_c0", "_cn", "_s0", "_sn", "_run", "_all")


def positions(df: DataFrame, at: str, order: list[str], slices: int = SLICES) -> DataFrame:
    """``df`` with ``position``, its place from 0 in the order of ``at`` (a double in [0, 1)) over all rows."""
    return ranked(df.withColumn("_one", F.lit(1)), "_one", at, order, slices=slices).withColumnRenamed("rank", "position").withColumnRenamed("group_n", "total").drop("_one")
