"""Queries over a table of results. ``lineitem`` stands for one: each group of its rows is a cell of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.functions.special import t_ppf
from colsieve.operators import analysis
from colsieve.plans.filters import t_two_sided
from colsieve.plans.registry import Catalogue
from colsieve.sources.scratch import read_table

C = Catalogue()
N_FEATURES = 400
RATIO = 30 / 70

RESULTS = """results AS MATERIALIZED (
  SELECT l_linestatus AS task, l_linenumber AS split, 0.7::DOUBLE AS train_size, 'none' AS preprocess, 'm' || (l_suppkey % 6) AS selector,
    CASE WHEN l_suppkey % 6 < 5 THEN (10 * (1 + l_partkey % 3))::INTEGER END AS k, 'model' || (l_partkey % 2) AS model,
    round(avg(l_discount) * 10, 6) AS roc_auc, round(avg(l_tax) * 10, 2) AS validation_roc_auc, round(avg(l_extendedprice) / 100000, 6) AS macro_f1,
    round(avg(l_quantity) / 50, 6) AS balanced_accuracy, round(max(l_quantity) * 2, 3) AS selection_peak_mb, round(min(l_extendedprice) / 1000, 5) AS selection_time_s,
    CASE WHEN l_suppkey % 6 < 5 THEN 10 * (1 + l_partkey % 3) ELSE 20 END::BIGINT AS n_selected, '{"C": ' || (l_linenumber % 3) || '}' AS tuned_params
  FROM lineitem GROUP BY ALL)"""
CHOSEN = """chosen AS MATERIALIZED (
  SELECT DISTINCT l_linestatus AS task, l_linenumber AS split, 'm' || (l_suppkey % 6) AS selector, CASE WHEN l_suppkey % 6 < 5 THEN (10 * (1 + l_partkey % 3))::INTEGER END AS k, (l_partkey % 400)::INTEGER AS feature
  FROM lineitem WHERE l_quantity >= 45)"""


def _keys() -> list:
    own = F.col("l_suppkey") % 6
    k = F.when(own < 5, (10 * (1 + F.col("l_partkey") % 3)).cast("int"))
    return [F.col("l_linestatus").alias("task"), F.col("l_linenumber").alias("split"), F.concat(F.lit("m"), own.cast("string")).alias("selector"), k.alias("k")]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(
        *_keys(), F.lit(0.7).alias("train_size"), F.lit("none").alias("preprocess"), F.concat(F.lit("model"), (F.col("l_partkey") % 2).cast("string")).alias("model"),
        F.coalesce((10 * (1 + F.col("l_partkey") % 3)) * F.when(F.col("l_suppkey") % 6 < 5, 1), F.lit(20)).cast("long").alias("n_selected"),
        F.concat(F.lit('{"C": '), (F.col("l_linenumber") % 3).cast("string"), F.lit("}")).alias("tuned_params"), "l_discount", "l_tax", "l_extendedprice", "l_quantity",
    )
    return rows.groupBy(*analysis.KEYS, "n_selected", "tuned_params").agg(
        F.round(F.avg("l_discount") * 10, 6).alias("roc_auc"), F.round(F.avg("l_tax") * 10, 2).alias("validation_roc_auc"), F.round(F.avg("l_extendedprice") / 100000, 6).alias("macro_f1"),
        F.round(F.avg("l_quantity") / 50, 6).alias("balanced_accuracy"), F.round(F.max("l_quantity") * 2, 3).alias("selection_peak_mb"), F.round(F.min("l_extendedprice") / 1000, 5).alias("selection_time_s"),
    )


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(*_keys(), (F.col("l_partkey") % N_FEATURES).cast("int").alias("feature")).distinct()


def _own(df: DataFrame) -> DataFrame:
    """-1 for a method's own count, which has no k: engines write a null integer in different ways."""
    return df.withColumn("k", F.coalesce("k", F.lit(-1)))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@C.query(f"""WITH {RESULTS} SELECT task, train_size, preprocess, selector, coalesce(k, -1) AS k, model, """ + ", ".join(f"round(quantile_cont({c}, {q}), 9) AS {c}_{n}" for c in ("roc_auc", "macro_f1", "selection_time_s") for n, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))) + " FROM results GROUP BY task, train_size, preprocess, selector, results.k, model")
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(_rounded(analysis.summarize(results(spark, sf_dir), ["roc_auc", "macro_f1", "selection_time_s"])))


CHOSEN_K = "best AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY task, split, train_size, preprocess, selector, model ORDER BY validation_roc_auc DESC NULLS LAST, k NULLS FIRST) = 1)"


@C.query(f"WITH {RESULTS}, {CHOSEN_K} SELECT task, split, selector, model, coalesce(k, -1) AS k, roc_auc, validation_roc_auc FROM best")
def chosen_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(analysis.chosen_k(results(spark, sf_dir))).select("task", "split", "selector", "model", "k", "roc_auc", "validation_roc_auc")


@C.query(
    f"""WITH {CHOSEN}, s AS (SELECT task, selector, k, split, count(*) AS n FROM chosen GROUP BY ALL),
w AS (SELECT task, selector, k, count(*) AS m, avg(n) / 400 AS share, max(n) > min(n) AS variable_size FROM s GROUP BY ALL),
c AS (SELECT task, selector, k, feature, count(*) AS c FROM chosen GROUP BY ALL),
v AS (SELECT w.task, w.selector, w.k, m, share, variable_size, sum(c / m * (1 - c / m)) AS v FROM w JOIN c ON w.task = c.task AND w.selector = c.selector AND w.k IS NOT DISTINCT FROM c.k GROUP BY ALL)
SELECT task, selector, coalesce(k, -1) AS k, round(1 - m / (m - 1) * v / 400 / (share * (1 - share)), 9) AS stability, m AS n_splits, variable_size FROM v WHERE m > 1 AND share > 0 AND share < 1"""
)
def nogueira_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(_rounded(analysis.nogueira(selections(spark, sf_dir), ["task", "selector", "k"], N_FEATURES)))


@C.query(
    f"""WITH {CHOSEN}, s AS (SELECT task, selector, k, split, count(*) AS n FROM chosen GROUP BY ALL),
p AS (SELECT a.task, a.selector, a.k, a.split AS s1, b.split AS s2, a.n AS n1, b.n AS n2, (a.n + b.n) / 2.0::DOUBLE AS kk FROM s a JOIN s b ON a.task = b.task AND a.selector = b.selector AND a.k IS NOT DISTINCT FROM b.k AND a.split < b.split),
h AS (SELECT a.task, a.selector, a.k, a.split AS s1, b.split AS s2, count(*) AS r FROM chosen a JOIN chosen b ON a.task = b.task AND a.selector = b.selector AND a.k IS NOT DISTINCT FROM b.k AND a.feature = b.feature AND a.split < b.split GROUP BY ALL)
SELECT p.task, p.selector, coalesce(p.k, -1) AS k, round(avg((coalesce(r, 0) - kk * kk / 400) / (kk - kk * kk / 400)), 9) AS consistency_index, count(*) AS n_pairs, max(greatest(n1, n2)) > min(least(n1, n2)) AS variable_size
FROM p LEFT JOIN h ON p.task = h.task AND p.selector = h.selector AND p.k IS NOT DISTINCT FROM h.k AND p.s1 = h.s1 AND p.s2 = h.s2 WHERE kk - kk * kk / 400 > 0 GROUP BY ALL"""
)
def kuncheva_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(_rounded(analysis.kuncheva(selections(spark, sf_dir), ["task", "selector", "k"], N_FEATURES)))


SCORES = "scores AS (SELECT selector, k, split, avg(roc_auc) AS score FROM results GROUP BY ALL)"
VS_CONTROL = "d AS (SELECT a.selector, a.k, a.split, a.score - b.score AS diff FROM scores a JOIN scores b ON a.k = b.k AND a.split = b.split WHERE b.selector = 'm0' AND a.selector <> 'm0')"


def _t(keys: str) -> str:
    return f"SELECT {keys}, count(*) AS splits, avg(diff) AS mean_diff, sum((diff > 0)::INTEGER)::BIGINT AS first_wins, sqrt((1 / count(*) + {RATIO}::DOUBLE) * var_samp(diff)) AS se FROM d GROUP BY {keys}"


@C.query(f"WITH {RESULTS}, {SCORES}, {VS_CONTROL}, t AS ({_t('selector, k')}) SELECT selector, k, splits, round(mean_diff, 9) AS mean_diff, first_wins, round(se, 9) AS se, round(CASE WHEN se > 0 THEN mean_diff / se END, 7) AS t FROM t")
def paired_t_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = analysis.against_control(analysis.per_split(results(spark, sf_dir), "roc_auc"), "m0")
    return _rounded(analysis.paired(diffs, ["selector", "k"], RATIO).withColumn("t", F.round("t", 7)))


@C.query(f"WITH {RESULTS}, {SCORES}, d AS (SELECT a.selector, a.k, a.split, a.score - b.score AS diff FROM scores a JOIN scores b ON a.split = b.split WHERE b.selector = 'm5' AND a.selector <> 'm5'), t AS ({_t('selector, k')}) SELECT selector, k, splits, round(mean_diff, 9) AS mean_diff, first_wins, round(se, 9) AS se, round(CASE WHEN se > 0 THEN mean_diff / se END, 7) AS t FROM t")
def paired_t_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a method of one setting, which meets every method at every k."""
    diffs = analysis.against_baseline(analysis.per_split(results(spark, sf_dir), "roc_auc"), "m5")
    return _rounded(analysis.paired(diffs, ["selector", "k"], RATIO).withColumn("t", F.round("t", 7)))


@C.query(f"WITH {RESULTS}, {SCORES}, d AS (SELECT a.k, a.selector AS first, b.selector AS second, a.split, a.score - b.score AS diff FROM scores a JOIN scores b ON a.k = b.k AND a.split = b.split AND a.selector < b.selector), t AS ({_t('k, first, second')}) SELECT k, first, second, splits, round(mean_diff, 9) AS mean_diff, first_wins, round(CASE WHEN se > 0 THEN mean_diff / se END, 7) AS t FROM t")
def paired_t_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = analysis.each_pair(analysis.per_split(results(spark, sf_dir), "roc_auc"))
    return _rounded(analysis.paired(diffs, ["k", "first", "second"], RATIO).drop("se").withColumn("t", F.round("t", 7)))


P_OF = t_two_sided("coalesce(t, 0)", "greatest(splits - 1, 1)")
HALF = "coalesce(se * CASE splits " + " ".join(f"WHEN {n} THEN {t_ppf(0.975, n - 1)!r}::DOUBLE" for n in range(2, 8)) + " END, 0)"
#: The signed-rank test by all 2**n ways to sign n ranks; there are seven splits at most, and no ties.
WILCOXON = """nz AS (SELECT selector, k, diff, rank() OVER (PARTITION BY selector, k ORDER BY abs(diff)) AS rk FROM d WHERE diff <> 0),
w0 AS (SELECT selector, k, count(*) AS n, least(coalesce(sum(rk) FILTER (diff > 0), 0), coalesce(sum(rk) FILTER (diff < 0), 0)) AS w FROM nz GROUP BY selector, k),
w AS (SELECT selector, k, least(1.0::DOUBLE, 2 * len(list_filter(range(0, (1 << n)::BIGINT), lambda s: coalesce(list_sum(list_transform(range(0, n), lambda i: CASE WHEN (s >> i) & 1 = 1 THEN i + 1 ELSE 0 END)), 0) <= w)) / (1 << n)::DOUBLE) AS p FROM w0)"""


@C.query(
    f"""WITH {RESULTS}, {SCORES}, {VS_CONTROL}, t0 AS ({_t('selector, k')}), t AS (SELECT *, CASE WHEN se > 0 THEN mean_diff / se END AS t FROM t0), {WILCOXON}
SELECT t.selector, t.k, splits, round(mean_diff, 9) AS mean_diff, first_wins, round(se, 9) AS se, round(t, 7) AS t, round(mean_diff - {HALF}, 7) AS ci_low, round(mean_diff + {HALF}, 7) AS ci_high,
round(CASE WHEN t IS NULL THEN (mean_diff = 0)::INTEGER::DOUBLE ELSE {P_OF} END, 7) AS p_value, round(coalesce(w.p, 1), 9) AS p_wilcoxon FROM t LEFT JOIN w ON w.selector = t.selector AND w.k = t.k"""
)
def paired_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals and p of both tests."""
    diffs = analysis.against_control(analysis.per_split(results(spark, sf_dir), "roc_auc"), "m0")
    tests = analysis.t_result(analysis.paired(diffs, ["selector", "k"], RATIO))
    out = tests.join(analysis.wilcoxon(diffs, ["selector", "k"]), ["selector", "k"])
    return _rounded(out.withColumns({c: F.round(c, 7) for c in ("t", "ci_low", "ci_high", "p_value")}))


@C.query(
    f"""WITH {RESULTS}, {SCORES}, {VS_CONTROL}, t0 AS ({_t('selector, k')}), t AS (SELECT *, mean_diff / se AS t FROM t0 WHERE se > 0),
u AS (SELECT splits, t * sqrt((1 / splits + {RATIO}::DOUBLE) * splits) AS t FROM t)
SELECT (SELECT count(*) FROM t) AS comparisons, (SELECT count(*) FROM t WHERE {P_OF} < 0.05) AS corrected, (SELECT count(*) FROM u WHERE {P_OF} < 0.05) AS plain"""
)
def plain_corrected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = analysis.against_control(analysis.per_split(results(spark, sf_dir), "roc_auc"), "m0")
    return analysis.plain_and_corrected(analysis.paired(diffs, ["selector", "k"], RATIO), RATIO)


@C.query(f"WITH {RESULTS}, {SCORES}, {VS_CONTROL} SELECT selector, k, split, round(diff, 9) AS diff FROM d")
def gain_over_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.against_control(analysis.per_split(results(spark, sf_dir), "roc_auc"), "m0"))


@C.query(
    f"""WITH {RESULTS}, own AS (SELECT task, split, selector, n_selected, macro_f1 FROM results WHERE k IS NULL),
one AS (SELECT task, split, selector, n_selected, avg(macro_f1) AS macro_f1 FROM own GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM results WHERE k IS NOT NULL),
near AS (SELECT * FROM one, ks WHERE abs(k - n_selected) <= 0.01 * n_selected QUALIFY row_number() OVER (PARTITION BY task, split, selector ORDER BY abs(k - n_selected), k) = 1),
g AS (SELECT near.selector, r.selector AS against, near.k, near.split, avg(near.macro_f1 - r.f) AS gain FROM near JOIN (SELECT task, split, k, selector, avg(macro_f1) AS f FROM results GROUP BY ALL) r ON r.task = near.task AND r.split = near.split AND r.k = near.k GROUP BY ALL)
SELECT selector, against, k, split, round(gain, 9) AS gain FROM g QUALIFY count(*) OVER (PARTITION BY selector, against, k) = (SELECT count(DISTINCT split) FROM results)"""
)
def own_count_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_model = results(spark, sf_dir).groupBy("task", "split", "selector", "k", "n_selected").agg(F.avg("macro_f1").alias("macro_f1"))
    return _rounded(analysis.own_count_match(one_model, "macro_f1"))


@C.query(
    f"""WITH {RESULTS}, f AS (SELECT selector, k, task, split, min(selection_time_s) AS t FROM results GROUP BY ALL),
ft AS (SELECT selector, k, task, quantile_cont(t, 0.5) AS t FROM f GROUP BY ALL), tm AS (SELECT selector, k, avg(t) AS seconds FROM ft GROUP BY ALL), {SCORES},
q AS (SELECT selector, k, avg(score) AS roc_auc, stddev_samp(score) AS roc_auc_std FROM scores GROUP BY ALL),
c AS (SELECT q.selector, q.k, round(roc_auc, 9) AS roc_auc, round(roc_auc_std, 9) AS roc_auc_std, round(seconds, 9) AS seconds FROM q JOIN tm ON q.selector = tm.selector AND q.k IS NOT DISTINCT FROM tm.k),
b AS (SELECT *, max(roc_auc) OVER (ORDER BY seconds, roc_auc DESC, selector, k NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c)
SELECT selector, coalesce(k, -1) AS k, roc_auc, roc_auc_std, seconds, best IS NULL OR roc_auc > best AS on_frontier FROM b"""
)
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(analysis.frontier(_rounded(analysis.frontier_cells(results(spark, sf_dir), "roc_auc")), "roc_auc"))


@C.query(f"WITH {RESULTS} SELECT task, selector, " + ", ".join(f"round(avg(roc_auc) FILTER (k = {k}), 9) AS k_{k}" for k in (10, 20, 30)) + " FROM results GROUP BY task, selector")
def curve_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.curve(results(spark, sf_dir), "roc_auc", [10, 20, 30]))


@C.query(
    f"""WITH {RESULTS}, {SCORES}, d AS (SELECT a.k, a.selector AS first, b.selector AS second, a.split, a.score - b.score AS diff FROM scores a JOIN scores b ON a.k = b.k AND a.split = b.split AND a.selector < b.selector), t AS ({_t('k, first, second')}),
w AS (SELECT *, se * CASE splits WHEN 7 THEN {t_ppf(1 - 0.025 / 30, 6)!r}::DOUBLE END AS half FROM t)
SELECT k, first AS method, splits, round(mean_diff, 9) AS mean_diff, round(mean_diff - half, 7) AS ci_low, round(mean_diff + half, 7) AS ci_high FROM w WHERE second = 'm2'
UNION ALL SELECT k, second, splits, round(-mean_diff, 9), round(-mean_diff - half, 7), round(-mean_diff + half, 7) FROM w WHERE first = 'm2'"""
)
def bonferroni_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair's interval at 1 - 0.05 / 30, seen from one method."""
    tests = analysis.paired(analysis.each_pair(analysis.per_split(results(spark, sf_dir), "roc_auc")), ["k", "first", "second"], RATIO)
    rows = analysis.signed_against(analysis.t_result(tests, m=30), "m2")
    return rows.select("k", "method", "splits", F.round("mean_diff", 9).alias("mean_diff"), F.round("ci_low", 7).alias("ci_low"), F.round("ci_high", 7).alias("ci_high"))


@C.query(
    f"""WITH {CHOSEN}, s AS (SELECT task, split, k, selector, list(feature) AS f FROM chosen WHERE k IS NOT NULL GROUP BY ALL)
SELECT a.task, a.split, a.k, a.selector AS first, b.selector AS second, round(len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f))), 9) AS jaccard
FROM s a JOIN s b ON a.task = b.task AND a.split = b.split AND a.k = b.k AND a.selector < b.selector"""
)
def jaccard_between_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.jaccard(selections(spark, sf_dir).where("k IS NOT NULL"), ["task", "split", "k"]))


RANKING = "ranking AS (SELECT 'm' || (l_suppkey % 6) AS selector, (l_partkey % 400)::INTEGER AS feature, row_number() OVER (PARTITION BY l_suppkey % 6 ORDER BY sum(l_quantity) DESC, l_partkey % 400) AS pos FROM lineitem GROUP BY l_suppkey % 6, l_partkey % 400)"
TRUTH = "truth AS (SELECT DISTINCT (p_partkey % 400)::INTEGER AS feature FROM part WHERE p_brand = 'Brand#1')"


def _ranking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    rows = read_table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 6).cast("string")).alias("selector"), (F.col("l_partkey") % 400).cast("int").alias("feature"), "l_quantity")
    sums = rows.groupBy("selector", "feature").agg(F.sum("l_quantity").alias("_s"))
    ranking = sums.withColumn("pos", F.row_number().over(W.partitionBy("selector").orderBy(F.desc("_s"), "feature")))
    truth = read_table(spark, sf_dir, "part").where("p_brand = 'Brand#1'").select((F.col("p_partkey") % 400).cast("int").alias("feature")).distinct()
    return ranking, truth


@C.query(f"WITH {RANKING}, {TRUTH} SELECT selector, k::INTEGER AS k, round(sum((pos <= k)::INTEGER) / (SELECT count(*) FROM truth), 9) AS recall FROM ranking JOIN truth USING (feature), (SELECT unnest([10, 50, 100]) AS k) GROUP BY selector, k")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.recall_at(*_ranking(spark, sf_dir), ["selector"], [10, 50, 100]))


@C.query(f"WITH {RANKING}, {TRUTH} SELECT selector, quantile_disc(pos, 0.5)::INTEGER AS rank_50pct, quantile_disc(pos, 0.9)::INTEGER AS rank_90pct FROM ranking JOIN truth USING (feature) GROUP BY selector")
def rank_depth_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.rank_depths(*_ranking(spark, sf_dir), ["selector"])


@C.query(
    """WITH runs AS (SELECT l_linenumber AS workers, CASE WHEN l_discount = 0.1 THEN 1 ELSE l_linenumber END AS ended_with_workers, l_extendedprice / 1000 AS seconds FROM lineitem),
s AS (SELECT workers, quantile_cont(seconds, 0.5) AS median, min(seconds) AS least, max(seconds) AS most, count(*) AS runs FROM runs WHERE workers = ended_with_workers GROUP BY workers)
SELECT workers, round(median, 9) AS median, round(least, 9) AS least, round(most, 9) AS most, runs, round(o / median, 9) AS speed_up, round(o / median / workers, 9) AS efficiency FROM s, (SELECT median AS o FROM s WHERE workers = 1)"""
)
def scaling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("workers"), F.when(F.col("l_discount") == 0.1, 1).otherwise(F.col("l_linenumber")).alias("ended_with_workers"), (F.col("l_extendedprice") / 1000).alias("seconds"))
    return _rounded(analysis.scaling(runs))


@C.query(f"WITH {RESULTS}, {CHOSEN_K} SELECT task, selector, round(avg(macro_f1), 9) AS macro_f1, round(quantile_cont(macro_f1, 0.25), 9) AS macro_f1_q1, round(quantile_cont(macro_f1, 0.75), 9) AS macro_f1_q3, round(avg(balanced_accuracy), 9) AS balanced_accuracy, round(quantile_cont(selection_peak_mb, 0.5), 9) AS memory_median, round(max(selection_peak_mb), 9) AS memory_max FROM best GROUP BY task, selector")
def side_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.side_metrics(analysis.chosen_k(results(spark, sf_dir))))


@C.query(
    f"""WITH {RESULTS}, {CHOSEN_K}, {CHOSEN}, s AS (SELECT task, selector, split, count(DISTINCT feature) AS n FROM chosen GROUP BY ALL),
w AS (SELECT task, selector, count(*) AS m, avg(n) / 400 AS share FROM s GROUP BY ALL), c AS (SELECT task, selector, feature, count(DISTINCT split) AS c FROM chosen GROUP BY ALL),
v AS (SELECT task, selector, m, share, sum(c / m * (1 - c / m)) AS v FROM w JOIN c USING (task, selector) GROUP BY ALL),
st AS (SELECT task, selector, 1 - m / (m - 1) * v / 400 / (share * (1 - share)) AS stability FROM v WHERE m > 1 AND share > 0 AND share < 1),
t AS (SELECT task, selector, avg(roc_auc) AS roc_auc, quantile_cont(roc_auc, 0.25) AS roc_auc_q1, quantile_cont(roc_auc, 0.75) AS roc_auc_q3, quantile_cont(n_selected, 0.5) AS n_selected_median, min(n_selected) AS n_selected_min, max(n_selected) AS n_selected_max, quantile_cont(selection_time_s, 0.5) AS selection_time_s, count(DISTINCT split) AS splits FROM best GROUP BY ALL)
SELECT task, selector, round(roc_auc, 9) AS roc_auc, round(roc_auc_q1, 9) AS roc_auc_q1, round(roc_auc_q3, 9) AS roc_auc_q3, n_selected_median, n_selected_min, n_selected_max, round(selection_time_s, 9) AS selection_time_s, splits, round(stability, 9) AS stability FROM t LEFT JOIN st USING (task, selector)"""
)
def chosen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selections(spark, sf_dir).select("task", "selector", "split", "feature").distinct()
    return _rounded(analysis.chosen_table(analysis.chosen_k(results(spark, sf_dir)), analysis.nogueira(kept, ["task", "selector"], N_FEATURES)))


@C.query(f"WITH {RESULTS}, a AS (SELECT selector, avg(roc_auc) AS f FROM results WHERE task = 'F' GROUP BY ALL), b AS (SELECT selector, avg(roc_auc) AS o FROM results WHERE task = 'O' AND selector <> 'm3' GROUP BY ALL) SELECT selector, round(f, 9) AS set_f, round(o, 9) AS set_o FROM a FULL JOIN b USING (selector)")
def final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    return _rounded(analysis.final_table({"set_f": rows.where("task = 'F'"), "set_o": rows.where("task = 'O' AND selector <> 'm3'")}, "roc_auc"))


@C.query(f"WITH {RESULTS} SELECT selector, coalesce(k, -1) AS k, tuned_params->>'$.C' AS value, count(*) AS n FROM results GROUP BY 1, 2, 3")
def tuned_parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(analysis.tuned_counts(results(spark, sf_dir), "C"))


@C.query(
    f"""WITH {RESULTS}, p AS (SELECT regexp_extract(selector || '_C' || k, '^(m\\d)_C(.+)$', 1) AS method, regexp_extract(selector || '_C' || k, '^(m\\d)_C(.+)$', 2) AS value, split, roc_auc FROM results WHERE k IS NOT NULL),
s AS (SELECT method, value, split, avg(roc_auc) AS s FROM p GROUP BY ALL), d AS (SELECT a.method, a.value, a.split, a.s - b.s AS diff FROM s a JOIN s b ON a.method = b.method AND a.split = b.split WHERE b.value = '20' AND a.value <> '20'), t AS ({_t('method, value')})
SELECT method, value, splits, round(mean_diff, 9) AS mean_diff, first_wins, round(CASE WHEN se > 0 THEN mean_diff / se END, 7) AS t FROM t"""
)
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter read from the method's label, each value against the reference value by split."""
    named = results(spark, sf_dir).where("k IS NOT NULL").withColumn("selector", F.concat("selector", F.lit("_C"), F.col("k").cast("string")))
    rows = analysis.parsed_sweep(named, r"(m\d)_C(.+)", ("method", "value"))
    return _rounded(analysis.sweep_tests(rows, "value", "20", ["method"], "roc_auc", RATIO).drop("se").withColumn("t", F.round("t", 7)))


@C.query(
    f"""WITH {RESULTS}, s AS (SELECT model, selector, k, quantile_cont(roc_auc, 0.5) AS m, quantile_cont(roc_auc, 0.75) - quantile_cont(roc_auc, 0.25) AS iqr FROM results WHERE k IS NOT NULL GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY model, selector ORDER BY m DESC, k) = 1)
SELECT b.model, b.selector, b.k AS best_k, round(b.m, 9) AS best_median, round(b.iqr, 9) AS iqr, round(b.m - c.m, 9) AS gain FROM b LEFT JOIN s c ON c.selector = 'm0' AND c.model = b.model AND c.k = b.k"""
)
def best_k_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.best_k_summary(results(spark, sf_dir), "roc_auc", "m0"))
