"""Per-feature statistics over a long matrix, for any group keys at once: one plan scores every task and split.

Inputs have ``feature``, ``value`` and what each kernel names; ``keys`` go through. Values are doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colsieve.functions import columns
from colsieve.functions.special import ERFCC


def log_erfc(x: Column) -> Column:
    """log erfc(x) for x >= 0 by a fit with a relative error of 1e-7, which never underflows."""
    t = F.lit(1.0) / (F.lit(1.0) + x * F.lit(0.5))
    poly = reduce(lambda total, c: total * t + F.lit(c), reversed(ERFCC[:-1]), F.lit(ERFCC[-1]))
    return F.ln(t) - x * x + poly


def average_ranks(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``long`` with ``rank`` (ties share their mean) and ``tied``, the size of the tie; one shuffle on the feature."""
    group = W.partitionBy(*keys, "feature")
    tie = W.partitionBy(*keys, "feature", value)
    # the wider window first: its partitioning and its sort serve the narrower one
    out = long.withColumn("_first", F.rank().over(group.orderBy(value))).withColumn("tied", F.count(F.lit(1)).over(tie))
    return out.withColumn("rank", F.col("_first") + (F.col("tied") - 1) / F.lit(2.0)).drop("_first")


def rank_sums(long: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """``(keys, feature, label, rank_sum, n, ties)`` by class; ``ties`` is the class's part of the sum of t^3 - t.

    Ranks do not depend on which class is called positive: this one pass serves every one-against-rest task.
    """
    ranked = average_ranks(long, keys)
    square = F.col("tied").cast("double") * F.col("tied") - 1
    return ranked.groupBy(*keys, "feature", F.col(label).alias("label")).agg(F.sum("rank").alias("rank_sum"), F.count(F.lit(1)).alias("n"), F.sum(square).alias("ties"))


def rank_sums_by_value(long: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """What :func:`rank_sums` gives, for tall tables of few distinct values: equal values are counted before they move,
    and ranks come from running counts of distinct values."""
    cells = long.groupBy(*keys, "feature", "value", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_c"))
    feature = W.partitionBy(*keys, "feature")
    upto = F.sum("_c").over(feature.orderBy("value").rangeBetween(W.unboundedPreceding, W.currentRow))
    cells = cells.withColumn("_upto", upto).withColumn("_t", F.sum("_c").over(W.partitionBy(*keys, "feature", "value")))
    rank = F.col("_upto") - (F.col("_t") - 1) / F.lit(2.0)
    square = F.col("_t").cast("double") * F.col("_t") - 1
    return cells.groupBy(*keys, "feature", "label").agg(F.sum(F.col("_c") * rank).alias("rank_sum"), F.sum("_c").alias("n"), F.sum(F.col("_c") * square).alias("ties"))


def u_test(sums: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, task, feature, n1, n2, u, ties, z, log_p, auc)`` of the positive class (size n2) in every task.

    ``z`` has the tie-corrected deviation and a continuity correction of a half; ``log_p`` is the log of the
    two-sided p, at most 0. A feature whose values are all tied has z 0 and p 1. ``sums`` is small: a row for each
    feature and class.
    """
    group = W.partitionBy(*keys, "feature")
    totals = sums.withColumn("_n", F.sum("n").over(group)).withColumn("_ties", F.sum("ties").over(group))
    rows = totals.withColumn("_l", F.col("label").cast("string")).join(F.broadcast(tasks), F.col("_l") == F.col("class"))
    n = F.col("_n").cast("double")
    own, rank_sum = F.col("n").cast("double"), F.col("rank_sum")
    is_positive = F.col("class") == F.col("positive")
    n2 = F.when(is_positive, own).otherwise(n - own)
    r2 = F.when(is_positive, rank_sum).otherwise(n * (n + 1) / 2 - rank_sum)
    rows = rows.select(*keys, "task", "feature", (n - n2).alias("n1"), n2.alias("n2"), (r2 - n2 * (n2 + 1) / 2).alias("u"), F.col("_ties").alias("ties"), n.alias("_nn"))
    product = F.col("n1") * F.col("n2")
    variance = product / 12 * ((F.col("_nn") + 1) - F.col("ties") / (F.col("_nn") * (F.col("_nn") - 1)))
    z = F.when(variance > 0, (F.abs(F.col("u") - product / 2) - 0.5) / F.sqrt(variance)).otherwise(F.lit(0.0))
    rows = rows.withColumn("z", z)
    log_p = F.when(F.col("z") > 0, F.least(log_erfc(F.col("z") / F.lit(2.0**0.5)), F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.withColumn("log_p", log_p).withColumn("auc", F.col("u") / product).select(*keys, "task", "feature", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u", "ties", "z", "log_p", "auc")


def class_sums(long: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """``(keys, feature, label, n, s, q)``: count, sum and sum of squares by class."""
    v = F.col("value")
    return long.groupBy(*keys, "feature", F.col(label).alias("label")).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(v * v).alias("q"))


def anova_f(sums: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, feature, f, df1, df2)``, one-way analysis of variance over the classes; ``f`` is null for a constant feature."""
    n, s = F.col("n").cast("double"), F.col("s")
    t = sums.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("_k"), F.sum(n).alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), F.sum(s * s / n).alias("_c"))
    between = F.col("_c") - F.col("_s") * F.col("_s") / F.col("_n")
    within = F.col("_q") - F.col("_c")
    df1, df2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    constant = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) <= F.lit(1e-14) * F.col("_q")
    f = F.when(~constant & (within > 0), (between / df1) / (within / df2))
    return t.select(*keys, "feature", f.alias("f"), df1.cast("long").alias("df1"), df2.cast("long").alias("df2"))


def task_sums(sums: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Class sums of every task's two sides from the sums by label, without another pass over the values."""
    group = W.partitionBy(*keys, "feature")
    whole = sums.select("*", *[F.sum(c).over(group).alias(f"_{c}") for c in ("n", "s", "q")])
    each = whole.withColumn("_l", F.col("label").cast("string")).join(F.broadcast(tasks), F.col("_l") == F.col("class"))
    sides = F.array(F.struct(F.lit(1).alias("label"), F.col("n"), F.col("s"), F.col("q")), F.struct(F.lit(0).alias("label"), (F.col("_n") - F.col("n")).alias("n"), (F.col("_s") - F.col("s")).alias("s"), (F.col("_q") - F.col("q")).alias("q")))
    return each.select(*keys, "task", "feature", F.explode(sides).alias("_x")).select(*keys, "task", "feature", "_x.label", "_x.n", "_x.s", "_x.q")


def two_sided_t(t: Column, df: Column) -> Column:
    """P(|T| > t) for a whole number of degrees of freedom, by the finite cosine series (Abramowitz and Stegun 26.7.3-4)."""
    angle = F.atan(t / F.sqrt(df))
    cos2, sin, cos = F.cos(angle) * F.cos(angle), F.sin(angle), F.cos(angle)
    odd = df % 2 == 1
    steps = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    ratio = lambda i: F.when(odd, (2.0 * i) / (2.0 * i + 1)).otherwise((2.0 * i - 1) / (2.0 * i))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * ratio(i) * cos2
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, step)["sum"]
    inside = F.when(odd, F.lit(2 / 3.141592653589793) * (angle + F.when(df > 1, sin * cos * series).otherwise(0.0))).otherwise(sin * series)
    return F.greatest(F.lit(0.0), 1 - inside)


def correlations(long: DataFrame, keys: list[str], target: str) -> DataFrame:
    """``(keys, feature, r, n)``, Pearson's r of each feature with ``target``; null for a constant one."""
    r = F.when((F.max("value") > F.min("value")) & (F.max(target) > F.min(target)), F.corr("value", target))
    return long.groupBy(*keys, "feature").agg(r.alias("r"), F.count("value").alias("n"))


def f_regression(long: DataFrame, keys: list[str], target: str) -> DataFrame:
    """``(keys, feature, r, f)``: r^2 / (1 - r^2) * (n - 2), the largest double for a perfect fit, 0 where undefined."""
    rows = correlations(long, keys, target)
    r2 = F.col("r") * F.col("r")
    f = F.when(F.col("r").isNull(), 0.0).when(r2 >= 1, F.lit(1.7976931348623157e308)).otherwise(r2 / (1 - r2) * (F.col("n") - 2))
    return rows.select(*keys, "feature", "r", f.alias("f"))


def variances(long: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, feature, variance, spread)``: population variance and max - min."""
    return long.groupBy(*keys, "feature").agg(F.var_pop("value").alias("variance"), (F.max("value") - F.min("value")).alias("spread"))


def normality(long: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, feature, k2, p)``: D'Agostino and Pearson's test, from skewness and kurtosis as normal deviates."""
    m = long.groupBy(*keys, "feature").agg(F.count("value").cast("double").alias("n"), F.skewness("value").alias("g"), (F.kurtosis("value") + 3).alias("b"))
    n = F.col("n")
    y = F.col("g") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    scaled = y / F.sqrt(2 / (w2 - 1))
    z1 = F.ln(scaled + F.sqrt(scaled * scaled + 1)) / F.sqrt(0.5 * F.ln(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("b") - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    part = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(part) * F.pow(F.abs(part), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = m.select(*keys, "feature", (z1 * z1 + z2 * z2).alias("k2"))
    return k2.withColumn("p", F.exp(-F.col("k2") / 2))


def to_ranks(long: DataFrame, keys: list[str]) -> DataFrame:
    """``long`` with each value replaced by its average rank, as Spearman's correlation wants it."""
    return average_ranks(long, keys).withColumn("value", F.col("rank")).drop("rank", "tied")


def pair_correlations(long: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, a, b, r)`` for features a < b, a self-join on the sample. Prune the features first: pairs grow with their square."""
    left = long.select(*keys, "sample_id", F.col("feature").alias("a"), F.col("value").alias("_x"))
    right = long.select(*keys, "sample_id", F.col("feature").alias("b"), F.col("value").alias("_y"))
    pairs = left.join(right, [*keys, "sample_id"]).where("a < b")
    return pairs.groupBy(*keys, "a", "b").agg(F.corr("_x", "_y").alias("r"))


def close_pairs(long: DataFrame, limit: float, block: int = 1024) -> DataFrame:
    """``(a, b, r)`` of the pairs of features a < b with |r| over ``limit``, for any number of features.

    Features lie in blocks; a task holds two blocks of columns and multiplies them, so neither all pairs nor all
    columns are ever in one place, and a row is made for a pair that is kept alone. All samples need all features;
    constant features have no pairs.
    """
    blocks = long.agg(F.max("feature")).select((F.floor(F.col("max(feature)") / block) + 1).cast("int").alias("_n"))
    rows = long.select("sample_id", "feature", "value").withColumn("_b", F.floor(F.col("feature") / block).cast("int")).crossJoin(F.broadcast(blocks))
    columns = rows.groupBy("_b", "_n", "feature").agg(F.array_sort(F.collect_list(F.struct("sample_id", "value"))).alias("_c"))
    columns = columns.select("_b", "feature", F.transform("_c", lambda e: e["value"]).alias("_c"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o"))
    met = columns.select("feature", "_c", F.col("_b"), F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def multiply(part):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        part = part.sort_values("feature")
        z = np.stack(part["_c"].to_numpy())
        z = z - z.mean(1, keepdims=True)
        size = np.sqrt((z * z).sum(1, keepdims=True))
        z = np.divide(z, size, out=np.zeros_like(z), where=size > 0)
        feature, own = part["feature"].to_numpy(), part["_b"].to_numpy()
        left, right = own == part["_i"].iloc[0], own == part["_j"].iloc[0]
        r = z[left] @ z[right].T
        i, j = np.nonzero((np.abs(r) > limit) & (feature[left][:, None] < feature[right][None, :]))
        return pd.DataFrame({"a": feature[left][i], "b": feature[right][j], "r": r[i, j]})

    return met.groupBy("_i", "_j").applyInPandas(multiply, "a int, b int, r double")


def _by_column(long: DataFrame, keys: list[str], other: Column, score: str, measure: Callable) -> DataFrame:
    """``(keys, feature, score)``: ``measure(values, others)`` of each feature's rows without nulls, sorted in one task.
    A task holds the values of a feature, and the number of tasks grows with the features."""
    rows = long.select(*keys, "feature", F.col("value").cast("double").alias("value"), other.alias("_other")).where("value IS NOT NULL AND _other IS NOT NULL")
    names = [*keys, "feature"]

    def one(key, part):  # noqa: ANN001, ANN202
        import pandas as pd

        found = float(measure(part["value"].to_numpy()[:, None], part["_other"].to_numpy())[0])
        return pd.DataFrame([[*key, None if found != found else found]], columns=[*names, score]).astype({score: "object"})

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.groupBy(*names).applyInPandas(one, f"{schema}, `{score}` double")


def kendall(long: DataFrame, keys: list[str], target: str) -> DataFrame:
    """``(keys, feature, tau)``, Kendall's tau-b with ``target``: a sort for each feature. Rows with a null are left out;
    tau is null where value or target is constant."""
    return _by_column(long, keys, F.col(target).cast("double"), "tau", columns.kendall)


# --- cut-offs over a table of features ---


def best_first(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``scores`` with ``pos`` from 1: highest score first, among equals the higher feature."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.desc("feature"))
    return scores.withColumn("pos", F.row_number().over(w))


def cut_at(ranking: DataFrame, ks: list[int]) -> DataFrame:
    """A ranking cut at every k: computed once, used for all."""
    sizes = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return ranking.select("*", sizes).where("pos <= k")


def benjamini_hochberg(scores: DataFrame, keys: list[str], p: str, alpha: float) -> DataFrame:
    """``scores`` with ``selected``: p up to the largest one under its line alpha * rank / N."""
    w = W.partitionBy(*keys)
    ranked = scores.withColumn("_i", F.row_number().over(w.orderBy(p, "feature"))).withColumn("_n", F.count(F.lit(1)).over(w))
    under = F.when(F.col(p) <= F.lit(alpha) * F.col("_i") / F.col("_n"), F.col(p))
    edge = F.max(under).over(w)
    return ranked.withColumn("selected", F.coalesce(F.col(p) <= edge, F.lit(False))).drop("_i", "_n")


def bonferroni(scores: DataFrame, keys: list[str], p: str, alpha: float) -> DataFrame:
    """``scores`` with ``selected``: p under alpha / N."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return scores.withColumn("selected", F.coalesce(F.col(p) < F.lit(alpha) / n, F.lit(False)))


def higher_criticism(scores: DataFrame, keys: list[str], variant: str = "2008", alpha0: float = 0.1, log_p: str = "log_p") -> DataFrame:
    """``scores`` with ``selected``: p up to the rank, of the first alpha0 * N, at which p is most surprisingly small.

    The 2008 form centres rank i at i / (N + 1) with that fraction's own variance, the 2004 form at i / N with
    p's. Objectives are compared as logs while any is positive, so that tiny p don't overflow.
    """
    w = W.partitionBy(*keys)
    ranked = scores.withColumn("_i", F.row_number().over(w.orderBy(log_p, "feature"))).withColumn("_n", F.count(F.lit(1)).over(w))
    lp, i, n = F.col(log_p), F.col("_i"), F.col("_n")
    p = F.exp(lp)
    centre = i / (n + 1) if variant == "2008" else i / n
    log_var = F.ln(centre) + F.log1p(-centre) if variant == "2008" else lp + F.log1p(-p)
    first = i <= F.greatest(F.lit(1), F.floor(F.lit(alpha0) * n))
    above = F.when(first & (centre > p), F.ln(centre - p) - log_var / 2)
    below = F.when(first, (centre - p) / F.exp(log_var / 2))
    ranked = ranked.withColumn("_a", above).withColumn("_b", below)
    # the first of the best: the lowest rank among equal objectives
    best_a, best_b = F.max("_a").over(w), F.max("_b").over(w)
    ranked = ranked.withColumn("_hit", F.when(best_a.isNotNull(), F.col("_a") == best_a).otherwise(F.col("_b") == best_b))
    at = F.min(F.when(F.col("_hit"), F.struct("_i", F.col(log_p).alias("_lp")))).over(w)
    return ranked.withColumn("selected", F.coalesce(lp <= at["_lp"], F.lit(False))).drop("_i", "_n", "_a", "_b", "_hit")


def percentile_cut(scores: DataFrame, keys: list[str], score: str, percentile: float) -> DataFrame:
    """``scores`` with ``selected``: over the interpolated quantile, then ties at it by feature up to the count."""
    w = W.partitionBy(*keys)
    s = F.coalesce(F.col(score), F.lit(-1.7976931348623157e308))
    ranked = scores.withColumn("_s", s).withColumn("_n", F.count(F.lit(1)).over(w))
    cuts = ranked.groupBy(*keys).agg(F.expr(f"percentile(_s, {1 - percentile / 100}D)").alias("_cut"))
    ranked = ranked.join(F.broadcast(cuts), keys) if keys else ranked.crossJoin(F.broadcast(cuts))
    over = F.col("_s") > F.col("_cut")
    tie = F.row_number().over(W.partitionBy(*keys, F.col("_s") == F.col("_cut")).orderBy("feature"))
    room = F.floor(F.col("_n") * F.lit(percentile / 100)) - F.sum(over.cast("int")).over(w)
    picked = over | ((F.col("_s") == F.col("_cut")) & (tie <= room))
    if percentile in (0, 100):
        picked = F.lit(percentile == 100)
    return ranked.withColumn("selected", picked).drop("_s", "_n", "_cut")


def uncorrelated(target_corr: DataFrame, pairs: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Of each pair with |r| over ``limit``, the feature less correlated with the target goes (the lower one among equals).

    ``target_corr`` has ``feature, r``. All pairs are judged on their own, whatever other pairs remove.
    """
    side = lambda x: target_corr.select(*keys, F.col("feature").alias(x), F.abs("r").alias(f"_r{x}"))
    close = pairs.where(F.abs("r") > limit).drop("r").join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    losers = close.select(*keys, F.when(F.col("_ra") > F.col("_rb"), F.col("b")).otherwise(F.col("a")).alias("feature")).distinct()
    return target_corr.join(losers, [*keys, "feature"], "left_anti")


# --- mutual information ---


def mutual_information(long: DataFrame, keys: list[str], label: str = "label", k: int = 3) -> DataFrame:
    """``(keys, feature, mi)``: Ross's nearest-neighbour estimate by a sorted search in each feature; no noise is added.
    Rows with a null are left out, and so are classes of one sample."""
    return _by_column(long, keys, F.col(label), "mi", lambda x, y: columns.mutual_information(x, y, k))


def correlation_select(long: DataFrame, target: str, target_threshold: float, limit: float, n_features: int) -> DataFrame:
    """``(feature, r, pos)``: features correlated with the target, without the redundant ones, most correlated first."""
    candidates = correlations(long, [], target).where(F.abs("r") >= target_threshold).select("feature", "r")
    rows = long.join(F.broadcast(candidates.select("feature")), "feature", "left_semi")
    kept = uncorrelated(candidates, close_pairs(rows, limit), [], limit)
    first = W.orderBy(F.desc(F.round(F.abs("r"), 9)), "feature")
    return kept.withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= n_features)


def random_order(features: DataFrame, seed: int) -> DataFrame:
    """``(feature, pos)`` in an order by md5: a uniform choice without replacement that any engine repeats."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("feature").cast("string")).cast("binary"))
    return features.select("feature", F.row_number().over(W.orderBy(key, "feature")).alias("pos"))
