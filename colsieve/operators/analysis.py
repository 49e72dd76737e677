"""Queries over a table of results: stability of selections, choice of k, paired tests, frontiers.

A result has the keys ``task, split, train_size, preprocess, selector, k, model``; selections are rows
``(keys, split, feature)``, and a selection of nothing is a row whose feature is null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SETTING = ["task", "train_size", "preprocess", "selector", "k", "model"]
KEYS = ["task", "split", "train_size", "preprocess", "selector", "k", "model"]


def _same(a: str, b: str, keys: list[str]) -> Column:
    """Equal keys, null with null: k is null where a method chose its own count."""
    out = F.lit(True)
    for c in keys:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def kuncheva(chosen: DataFrame, keys: list[str], n_features: int) -> DataFrame:
    """``(keys, consistency_index, n_pairs, variable_size)``: mean over pairs of splits of (r - k^2/n) / (k - k^2/n).

    r is what both chose, k the mean of both sizes. Pairs come from the splits themselves, so a pair with nothing
    in common counts; pairs whose chance overlap is their whole size are left out.
    """
    sizes = chosen.groupBy(*keys, "split").agg(F.count("feature").alias("_size"))
    a, b = sizes.alias("a"), sizes.alias("b")
    pairs = a.join(b, _same("a", "b", keys) & (F.col("a.split") < F.col("b.split")))
    pairs = pairs.select(*[F.col(f"a.{c}").alias(c) for c in keys], F.col("a.split").alias("_s1"), F.col("b.split").alias("_s2"), F.col("a._size").alias("_n1"), F.col("b._size").alias("_n2"))
    x, y = chosen.where("feature IS NOT NULL").alias("a"), chosen.where("feature IS NOT NULL").alias("b")
    shared = x.join(y, (F.col("a.feature") == F.col("b.feature")) & _same("a", "b", keys) & (F.col("a.split") < F.col("b.split")))
    hits = shared.groupBy(*[F.col(f"a.{c}").alias(c) for c in keys], F.col("a.split").alias("_s1"), F.col("b.split").alias("_s2")).agg(F.count(F.lit(1)).alias("_r"))
    p, h = pairs.alias("a"), hits.alias("b")
    both = p.join(h, _same("a", "b", [*keys, "_s1", "_s2"]), "left").select("a.*", F.coalesce("b._r", F.lit(0)).alias("_r"))
    k = (F.col("_n1") + F.col("_n2")) / F.lit(2.0)
    by_chance = k * k / F.lit(float(n_features))
    scored = both.withColumn("_d", k - by_chance).where("_d > 0").withColumn("_i", (F.col("_r") - by_chance) / F.col("_d"))
    spread = F.max(F.greatest("_n1", "_n2")) > F.min(F.least("_n1", "_n2"))
    return scored.groupBy(*keys).agg(F.avg("_i").alias("consistency_index"), F.count(F.lit(1)).alias("n_pairs"), spread.alias("variable_size"))


def nogueira(chosen: DataFrame, keys: list[str], n_features: int) -> DataFrame:
    """``(keys, stability, n_splits, variable_size)``, the estimator of Nogueira, Sechidis and Brown for sets of any size.

    1 - mean over features of M/(M-1) p(1-p), over s(1-s); settings of one split, or whose mean share s is 0 or 1, are left out.
    """
    sizes = chosen.groupBy(*keys, "split").agg(F.count("feature").alias("_size"))
    whole = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_splits"), F.avg("_size").alias("_mean"), (F.max("_size") > F.min("_size")).alias("variable_size"))
    counts = chosen.where("feature IS NOT NULL").groupBy(*keys, "feature").agg(F.countDistinct("split").alias("_c"))
    c, w = counts.alias("a"), whole.alias("b")
    joined = w.join(c, _same("a", "b", keys), "left").select("b.*", "a._c")
    p = F.col("_c") / F.col("n_splits")
    sums = joined.groupBy(*keys, "n_splits", "variable_size", "_mean").agg(F.sum(p * (1 - p)).alias("_v"))
    share = F.col("_mean") / F.lit(float(n_features))
    m = F.col("n_splits")
    phi = 1 - m / (m - 1) * F.col("_v") / F.lit(float(n_features)) / (share * (1 - share))
    return sums.where((m > 1) & (share > 0) & (share < 1)).select(*keys, phi.alias("stability"), "n_splits", "variable_size")


def summarize(results: DataFrame, columns: list[str], keys: list[str] = SETTING) -> DataFrame:
    """Median and quartiles over splits of each column, a row for each setting; settings without k are a group too."""
    aggs = [F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in columns for name, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))]
    return results.groupBy(*keys).agg(*aggs)


def chosen_k(results: DataFrame, score: str = "validation_roc_auc") -> DataFrame:
    """The row of each task, split, method and model whose k has the best validation score; the smaller k among equals.

    A method without k has one row, without a score, and passes through.
    """
    keys = [c for c in KEYS if c != "k"]
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc_nulls_first("k"))
    return results.withColumn("_pos", F.row_number().over(w)).where("_pos = 1").drop("_pos")


def per_split(results: DataFrame, metric: str) -> DataFrame:
    """``(selector, k, split, score)``: the mean over tasks and models."""
    return results.groupBy("selector", "k", "split").agg(F.avg(metric).alias("score"))


def paired(diffs: DataFrame, keys: list[str], test_over_train: float) -> DataFrame:
    """``(keys, splits, mean_diff, se, t, first_wins)`` of ``diff``, by the corrected resampled t-test.

    The variance over J splits is widened from 1/J to 1/J + n_test/n_train, since training sets overlap. ``t`` is
    null where all differences are equal; ``t_result`` says what then holds.
    """
    rows = diffs.where("diff IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("splits"), F.avg("diff").alias("mean_diff"), F.var_samp("diff").alias("_v"), F.sum((F.col("diff") > 0).cast("long")).alias("first_wins"))
    se = F.sqrt((1 / F.col("splits") + F.lit(test_over_train)) * F.col("_v"))
    return rows.withColumn("se", se).withColumn("t", F.when(F.col("se") > 0, F.col("mean_diff") / F.col("se"))).drop("_v")


def t_result(tests: DataFrame, level: float = 0.95, m: int = 1) -> DataFrame:
    """``tests`` with ``ci_low, ci_high, p_value``; intervals at 1 - (1 - level) / m for m tests at once."""
    from colsieve.functions.special import t_ppf, t_sf

    @F.pandas_udf("double")
    def quantile(splits):  # noqa: ANN001, ANN202
        return splits.map(lambda n: t_ppf(1 - (1 - level) / (2 * m), n - 1) if n > 1 else float("nan"))

    @F.pandas_udf("double")
    def p_of(t, splits):  # noqa: ANN001, ANN202
        return pd.Series(2 * t_sf(t.abs().to_numpy(), (splits - 1).clip(lower=1).to_numpy()))

    half = F.coalesce(F.when(F.col("splits") > 1, quantile("splits") * F.col("se")), F.lit(0.0))
    flat = F.when(F.col("mean_diff") == 0, 1.0).otherwise(0.0)
    return tests.select("*", (F.col("mean_diff") - half).alias("ci_low"), (F.col("mean_diff") + half).alias("ci_high"), F.when(F.col("t").isNull(), flat).otherwise(p_of(F.coalesce("t", F.lit(0.0)), "splits")).alias("p_value"))


def against_control(scores: DataFrame, control: str) -> DataFrame:
    """``(selector, k, split, diff)``: each method less the control at the same k and split. The control is one method's rows."""
    base = scores.where(F.col("selector") == control).select(F.col("k").alias("_k"), F.col("split").alias("_s"), F.col("score").alias("_b"))
    rows = scores.where((F.col("selector") != control) & F.col("k").isNotNull())
    return rows.join(base, (F.col("k") == F.col("_k")) & (F.col("split") == F.col("_s"))).select("selector", "k", "split", (F.col("score") - F.col("_b")).alias("diff"))


def against_baseline(scores: DataFrame, baseline: str) -> DataFrame:
    """Each method less the baseline: a baseline of one setting meets every k, one with several the same k."""
    base = scores.where(F.col("selector") == baseline)
    single = F.broadcast(base.agg((F.countDistinct(F.coalesce("k", F.lit(-1))) == 1).alias("_one")))
    b = base.select(F.col("k").alias("_k"), F.col("split").alias("_s"), F.col("score").alias("_b")).crossJoin(single)
    rows = scores.where(F.col("selector") != baseline)
    return rows.join(b, (F.col("split") == F.col("_s")) & (F.col("_one") | F.col("k").eqNullSafe(F.col("_k")))).select("selector", "k", "split", (F.col("score") - F.col("_b")).alias("diff"))


def each_pair(scores: DataFrame) -> DataFrame:
    """``(k, first, second, split, diff)`` for every two methods at the same k and split, first before second by name."""
    a = scores.where("k IS NOT NULL").select("k", "split", F.col("selector").alias("first"), F.col("score").alias("_a"))
    b = scores.where("k IS NOT NULL").select("k", "split", F.col("selector").alias("second"), F.col("score").alias("_b"))
    return a.join(b, ["k", "split"]).where("first < second").select("k", "first", "second", "split", (F.col("_a") - F.col("_b")).alias("diff"))


def signed_against(tests: DataFrame, reference: str) -> DataFrame:
    """Tests of pairs seen from the reference: method less reference, turned round where the reference came first."""
    cols = ["k", "method", "mean_diff", "ci_low", "ci_high", "splits"]
    first = tests.where(F.col("second") == reference).select("k", F.col("first").alias("method"), "mean_diff", "ci_low", "ci_high", "splits")
    turned = tests.where(F.col("first") == reference).select("k", F.col("second").alias("method"), (-F.col("mean_diff")).alias("mean_diff"), (-F.col("ci_high")).alias("ci_low"), (-F.col("ci_low")).alias("ci_high"), "splits")
    return first.unionByName(turned).select(*cols)


def wilcoxon(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, p_wilcoxon)`` of ``diff``; a group holds a number for each split."""
    from colsieve.functions.special import wilcoxon_p

    @F.pandas_udf("double")
    def p_of(values):  # noqa: ANN001, ANN202
        return values.map(wilcoxon_p)

    return diffs.where("diff IS NOT NULL").groupBy(*keys).agg(F.sort_array(F.collect_list("diff")).alias("_d")).select(*keys, p_of("_d").alias("p_wilcoxon"))


def plain_and_corrected(tests: DataFrame, test_over_train: float, alpha: float = 0.05) -> DataFrame:
    """How many tests hold by the corrected and by the plain t-test: ``comparisons, corrected, plain``."""
    from colsieve.functions.special import t_sf

    @F.pandas_udf("double")
    def p_of(t, splits):  # noqa: ANN001, ANN202
        return pd.Series(2 * t_sf(t.abs().to_numpy(), (splits - 1).clip(lower=1).to_numpy()))

    ratio = F.sqrt((1 / F.col("splits") + F.lit(test_over_train)) * F.col("splits"))
    rows = tests.where("t IS NOT NULL").select(p_of("t", "splits").alias("c"), p_of(F.col("t") * ratio, F.col("splits")).alias("p"))
    return rows.agg(F.count(F.lit(1)).alias("comparisons"), F.sum((F.col("c") < alpha).cast("long")).alias("corrected"), F.sum((F.col("p") < alpha).cast("long")).alias("plain"))


def own_count_match(results: DataFrame, metric: str) -> DataFrame:
    """``(selector, against, k, split, gain)``: methods without k against fixed-k ones at the nearest k, if within 1%
    of their size, the mean over tasks; a comparison stays only if it is there on every split."""
    ks = F.broadcast(results.where("k IS NOT NULL").select(F.col("k").alias("_k")).distinct())
    own = results.where("k IS NULL").select("task", "split", "selector", "n_selected", F.col(metric).alias("_m"))
    w = W.partitionBy("task", "split", "selector").orderBy(F.abs(F.col("_k") - F.col("n_selected")), "_k")
    near = own.crossJoin(ks).withColumn("_pos", F.row_number().over(w)).where("_pos = 1").where(F.abs(F.col("_k") - F.col("n_selected")) <= 0.01 * F.col("n_selected"))
    fixed = results.where("k IS NOT NULL").select("task", "split", F.col("k").alias("_k"), F.col("selector").alias("against"), F.col(metric).alias("_o"))
    gains = near.join(fixed, ["task", "split", "_k"]).groupBy("selector", "against", F.col("_k").alias("k"), "split").agg(F.avg(F.col("_m") - F.col("_o")).alias("gain"))
    n = F.broadcast(results.agg(F.countDistinct("split").alias("_n")))
    return gains.crossJoin(n).withColumn("_c", F.count(F.lit(1)).over(W.partitionBy("selector", "against", "k"))).where("_c = _n").drop("_c", "_n")


def frontier_cells(results: DataFrame, metric: str) -> DataFrame:
    """``(selector, k, seconds, metric, metric_std)``: medians of time over splits, then the mean of tasks; means of splits."""
    fits = results.groupBy("selector", "k", "task", "split").agg(F.min("selection_time_s").alias("_t"))
    time = fits.groupBy("selector", "k", "task").agg(F.percentile("_t", F.lit(0.5)).alias("_t")).groupBy("selector", "k").agg(F.avg("_t").alias("seconds"))
    quality = per_split(results, metric).groupBy("selector", "k").agg(F.avg("score").alias(metric), F.stddev_samp("score").alias(f"{metric}_std"))
    t, q = time.alias("a"), quality.alias("b")
    return q.join(t, _same("a", "b", ["selector", "k"])).select("b.*", "a.seconds")


def frontier(cells: DataFrame, metric: str) -> DataFrame:
    """``cells`` with ``on_frontier``: no other is as fast and better. Cells are as few as settings."""
    before = W.orderBy("seconds", F.desc(metric), "selector", F.asc_nulls_first("k")).rowsBetween(W.unboundedPreceding, -1)
    best = F.max(metric).over(before)
    return cells.withColumn("on_frontier", best.isNull() | (F.col(metric) > best))


def curve(results: DataFrame, metric: str, ks: list[int]) -> DataFrame:
    """``(task, selector, k_<k>...)``: the mean over splits at each k, a column for each."""
    out = results.groupBy("task", "selector").pivot("k", ks).agg(F.avg(metric))
    return out.select("task", "selector", *[F.col(str(k)).alias(f"k_{k}") for k in ks])


def jaccard(chosen: DataFrame, keys: list[str], method: str = "selector") -> DataFrame:
    """``(keys, first, second, jaccard)``: what two methods both chose over what either did."""
    sets = chosen.groupBy(*keys, method).agg(F.collect_set("feature").alias("_f"))
    a = sets.select(*keys, F.col(method).alias("first"), F.col("_f").alias("_a"))
    b = sets.select(*keys, F.col(method).alias("second"), F.col("_f").alias("_b"))
    pairs = a.join(b, keys).where("first < second")
    return pairs.select(*keys, "first", "second", (F.size(F.array_intersect("_a", "_b")) / F.greatest(F.size(F.array_union("_a", "_b")), F.lit(1))).alias("jaccard"))


def recall_at(ranking: DataFrame, truth: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """``(keys, k, recall)``: the share of the known features among the first k."""
    sizes = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    found = ranking.join(F.broadcast(truth), "feature").select(*keys, "pos", sizes)
    total = F.broadcast(truth.agg(F.count(F.lit(1)).alias("_t")))
    return found.groupBy(*keys, "k").agg(F.sum((F.col("pos") <= F.col("k")).cast("long")).alias("_h")).crossJoin(total).select(*keys, "k", (F.col("_h") / F.col("_t")).alias("recall"))


def rank_depths(ranking: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, rank_50pct, rank_90pct)``: how deep half and nine tenths of the known features lie, as ranks that occur."""
    w = W.partitionBy(*keys)
    rows = ranking.join(F.broadcast(truth), "feature", "left_semi").withColumn("_i", F.row_number().over(w.orderBy("pos"))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda q: F.min(F.when(F.col("_i") >= q * F.col("_n"), F.col("pos")))
    return rows.groupBy(*keys).agg(at(0.5).alias("rank_50pct"), at(0.9).alias("rank_90pct"))


def scaling(runs: DataFrame) -> DataFrame:
    """``(workers, median, least, most, runs, speed_up, efficiency)`` over runs that kept their workers, against one worker."""
    rows = runs.where("workers = ended_with_workers").groupBy("workers").agg(F.percentile("seconds", F.lit(0.5)).alias("median"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.count(F.lit(1)).alias("runs"))
    one = F.broadcast(rows.where("workers = 1").select(F.col("median").alias("_one")))
    return rows.crossJoin(one).select("*", (F.col("_one") / F.col("median")).alias("speed_up"), (F.col("_one") / F.col("median") / F.col("workers")).alias("efficiency")).drop("_one")


def parsed_sweep(chosen: DataFrame, pattern: str, groups: tuple[str, ...]) -> DataFrame:
    """``chosen`` with what ``pattern`` finds in the method's label, a column for each group; labels that don't match go."""
    rows = chosen.where(F.col("selector").rlike(f"^{pattern}$"))
    return rows.select("*", *[F.regexp_extract("selector", f"^{pattern}$", i + 1).alias(g) for i, g in enumerate(groups)])


def sweep_tests(rows: DataFrame, value: str, reference: str, keys: list[str], metric: str, test_over_train: float) -> DataFrame:
    """Each parameter value against the reference value by split: :func:`paired` for ``keys`` and ``value``."""
    scores = rows.groupBy(*keys, value, "split").agg(F.avg(metric).alias("_s"))
    base = scores.where(F.col(value) == reference).select(*keys, "split", F.col("_s").alias("_b"))
    diffs = scores.where(F.col(value) != reference).join(base, [*keys, "split"]).withColumn("diff", F.col("_s") - F.col("_b"))
    return paired(diffs, [*keys, value], test_over_train)


def chosen_table(chosen: DataFrame, stability: DataFrame) -> DataFrame:
    """A row for each task and method at its chosen k: quality, size, time and how stable the choice is."""
    table = chosen.groupBy("task", "selector").agg(
        F.avg("roc_auc").alias("roc_auc"), F.percentile("roc_auc", F.lit(0.25)).alias("roc_auc_q1"), F.percentile("roc_auc", F.lit(0.75)).alias("roc_auc_q3"),
        F.percentile("n_selected", F.lit(0.5)).alias("n_selected_median"), F.min("n_selected").alias("n_selected_min"), F.max("n_selected").alias("n_selected_max"),
        F.percentile("selection_time_s", F.lit(0.5)).alias("selection_time_s"), F.countDistinct("split").alias("splits"),
    )
    return table.join(stability.select("task", "selector", "stability"), ["task", "selector"], "left")


def side_metrics(chosen: DataFrame) -> DataFrame:
    """Macro F1 with quartiles, balanced accuracy and memory of each task and method at its chosen k."""
    return chosen.groupBy("task", "selector").agg(
        F.avg("macro_f1").alias("macro_f1"), F.percentile("macro_f1", F.lit(0.25)).alias("macro_f1_q1"), F.percentile("macro_f1", F.lit(0.75)).alias("macro_f1_q3"),
        F.avg("balanced_accuracy").alias("balanced_accuracy"), F.percentile("selection_peak_mb", F.lit(0.5)).alias("memory_median"), F.max("selection_peak_mb").alias("memory_max"),
    )


def final_table(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """One row for each method over several data sets: the mean over tasks in a column for each set, null where missing."""
    out = None
    for name, table in tables.items():
        column = table.groupBy("selector").agg(F.avg(value).alias(name))
        out = column if out is None else out.join(column, "selector", "full")
    return out


def tuned_counts(results: DataFrame, field: str) -> DataFrame:
    """``(selector, k, value, n)``: how often each value of a tuned parameter, held as JSON, was chosen."""
    value = F.get_json_object("tuned_params", f"$.{field}")
    return results.groupBy("selector", "k", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def best_k_summary(results: DataFrame, metric: str, control: str) -> DataFrame:
    """``(model, selector, best_k, best_median, iqr, gain)``: the k with the best median, and the gain there over the control."""
    stats = results.where("k IS NOT NULL").groupBy("model", "selector", "k").agg(F.percentile(metric, F.lit(0.5)).alias("m"), (F.percentile(metric, F.lit(0.75)) - F.percentile(metric, F.lit(0.25))).alias("iqr"))
    best = stats.groupBy("model", "selector").agg(F.max_by("k", F.struct(F.col("m"), -F.col("k"))).alias("best_k"), F.max("m").alias("best_median"))
    own = best.join(stats.select("model", "selector", F.col("k").alias("best_k"), "iqr"), ["model", "selector", "best_k"])
    base = stats.where(F.col("selector") == control).select("model", F.col("k").alias("best_k"), F.col("m").alias("_b"))
    return own.join(base, ["model", "best_k"], "left").select("model", "selector", "best_k", "best_median", "iqr", (F.col("best_median") - F.col("_b")).alias("gain"))
