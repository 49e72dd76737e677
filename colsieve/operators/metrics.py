"""Classification metrics over ``(keys, y_true, y_pred, score)``: an aggregate for each, so all cells at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Metrics of predicted classes, and those of scores. Add a line to extend.
METRICS = ("accuracy", "macro_f1", "balanced_accuracy", "mcc", "g_mean")
SCORE_METRICS = ("roc_auc",)


def check(names: list[str]) -> None:
    unknown = [x for x in names if x not in METRICS + SCORE_METRICS]
    if unknown:
        raise ValueError(f"Unknown metrics {unknown}. Available: {', '.join(METRICS + SCORE_METRICS)}")


def class_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, accuracy, macro_f1, balanced_accuracy, mcc, g_mean)``.

    macro F1 goes over all classes that are true or predicted, with 0 where a class has neither hits nor misses;
    recalls go over the classes that are true; mcc is 0 where its denominator is; g_mean is 0 if any recall is.
    """
    cells = rows.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("_n"))
    sides = F.explode(F.array(F.struct(F.col("y_true").alias("c"), F.col("_n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("_n")).otherwise(0).alias("h")), F.struct(F.col("y_pred").alias("c"), F.lit(0).cast("long").alias("t"), F.col("_n").alias("p"), F.lit(0).cast("long").alias("h"))))
    each = cells.select(*keys, sides.alias("_x")).groupBy(*keys, F.col("_x.c").alias("_c")).agg(F.sum("_x.t").alias("_t"), F.sum("_x.p").alias("_p"), F.sum("_x.h").alias("_h"))
    recall = F.when(F.col("_t") > 0, F.col("_h") / F.col("_t"))
    f1 = F.coalesce(2 * F.col("_h") / F.when(F.col("_t") + F.col("_p") > 0, F.col("_t") + F.col("_p")), F.lit(0.0))
    n, hits = F.sum("_t"), F.sum("_h")
    tp, tt, pp = F.sum(F.col("_t") * F.col("_p")), F.sum(F.col("_t") * F.col("_t")), F.sum(F.col("_p") * F.col("_p"))
    down = F.sqrt((n * n - pp).cast("double")) * F.sqrt((n * n - tt).cast("double"))
    mcc = F.when(down > 0, (hits * n - tp) / down).otherwise(F.lit(0.0))
    g = F.when(F.min(recall) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(recall))))
    return each.groupBy(*keys).agg((hits / n).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.avg(recall).alias("balanced_accuracy"), mcc.alias("mcc"), g.alias("g_mean"))


def roc_auc(rows: DataFrame, keys: list[str], positive: str) -> DataFrame:
    """``(keys, roc_auc)`` of ``score``, ties shared; ``positive`` is a 0/1 column. Null where a class is missing."""
    tie = W.partitionBy(*keys, "score")
    ranked = rows.withColumn("_t", F.count(F.lit(1)).over(tie)).withColumn("_r", F.rank().over(W.partitionBy(*keys).orderBy("score")) + (F.col("_t") - 1) / F.lit(2.0))
    p, n = F.sum(F.col(positive).cast("double")), F.count(F.lit(1)).cast("double")
    u = F.sum(F.when(F.col(positive) == 1, F.col("_r")).otherwise(0.0)) - p * (p + 1) / 2
    return ranked.groupBy(*keys).agg(F.when((p > 0) & (p < n), u / (p * (n - p))).alias("roc_auc"))
