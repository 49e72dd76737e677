"""Queries of the protocol, metrics, targets, models, grids and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colsieve.operators import copies, kernels, metrics, models, protocol, runner
from colsieve.operators import selectors as sel
from colsieve.plans.filters import BIN, F_TASK, MI, PAIRS, SEED, SPLITS, TASKS, TRAIN, U_ALL, X, _binary, _f_task, _hc_sql, _u_all
from colsieve.plans.registry import Catalogue
from colsieve.sources import loader
from colsieve.sources.layouts import embeddings, to_long
from colsieve.sources.scratch import read_table

C = Catalogue()


@C.query(f"WITH {TASKS} SELECT task, vec_id AS sample_id, (CASE WHEN label::VARCHAR = class THEN class ELSE 'rest' END = positive)::INTEGER AS y FROM embeddings, tasks WHERE label IS NOT NULL")
def tasks_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return protocol.labelled(e.select("sample_id", "label"), protocol.tasks_ovr(e)).select("task", "sample_id", "y")


@C.query(f"WITH {SPLITS} SELECT split, sample_id, label, part FROM splits")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.stratified_splits(embeddings(spark, sf_dir), 4, TRAIN, SEED)


@C.query(
    """SELECT vec_id AS sample_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42-' || vec_id), vec_id) - 1) % 5)::INTEGER AS fold,
((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5)::INTEGER AS plain_fold FROM embeddings WHERE label IS NOT NULL"""
)
def kfold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("sample_id", "label").where("label IS NOT NULL")
    plain = protocol.folds(rows, 5).withColumnRenamed("fold", "plain_fold")
    return protocol.folds(plain, 5, seed=42).select("sample_id", "label", "fold", "plain_fold")


GAPS = f"WITH {X}, g AS (SELECT sample_id, feature, CASE WHEN (sample_id + feature) % 7 = 0 THEN NULL ELSE value END AS value, sample_id % 3 < 2 AS train FROM x)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with every seventh value missing, and two of three samples for training."""
    rows = to_long(embeddings(spark, sf_dir))
    value = F.when((F.col("sample_id") + F.col("feature")) % 7 != 0, F.col("value"))
    return rows.select("sample_id", "feature", value.alias("value"), (F.col("sample_id") % 3 < 2).alias("train"))


@C.query(f"{GAPS}, m AS (SELECT feature, quantile_cont(value, 0.5) AS median FROM g WHERE train GROUP BY feature) SELECT sample_id, feature, round(coalesce(value, median), 9) AS value FROM g JOIN m USING (feature)")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.impute(_gaps(spark, sf_dir), [], F.col("train")).select("sample_id", "feature", F.round("value", 9).alias("value"))


@C.query(f"WITH {X}, m AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd FROM x WHERE sample_id % 3 < 2 GROUP BY feature) SELECT sample_id, feature, round((value - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 8) AS value FROM x JOIN m USING (feature)")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.standardize(to_long(embeddings(spark, sf_dir)), [], F.col("sample_id") % 3 < 2).select("sample_id", "feature", F.round("value", 8).alias("value"))


def _report_sql(table: str, column: str, numeric: bool) -> str:
    """One column's row of the report."""
    number = f"'{column}' AS target_name, count({column}) AS n_samples, count(*) - count({column}) AS n_missing, count(DISTINCT {column}) AS k"
    stats = ", ".join(f"{f} AS {n}" for f, n in ((f"avg({column})", "a"), (f"stddev_samp({column})", "s"), (f"min({column})", "lo"), (f"quantile_cont({column}, 0.25)", "q1"), (f"quantile_cont({column}, 0.5)", "q2"), (f"quantile_cont({column}, 0.75)", "q3"), (f"max({column})", "hi"))) if numeric else "NULL::DOUBLE AS a, NULL::DOUBLE AS s, NULL::DOUBLE AS lo, NULL::DOUBLE AS q1, NULL::DOUBLE AS q2, NULL::DOUBLE AS q3, NULL::DOUBLE AS hi"
    classes = f"(SELECT string_agg({column}::VARCHAR || ': ' || c, ', ' ORDER BY {column}) FROM (SELECT {column}, count(*) AS c FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}))"
    balance = f"(SELECT min(c) / max(c) FROM (SELECT count(*) AS c FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}))"
    few = f"k <= 20{'' if numeric else ' OR true'}"
    return f"""SELECT target_name, CASE WHEN k = 0 THEN 'unknown' WHEN ({few}) AND k = 2 THEN 'binary' WHEN {few} THEN 'multiclass' ELSE 'regression' END AS type, n_samples, n_missing,
  CASE WHEN {few} THEN k ELSE -1 END AS n_classes, CASE WHEN k <= 20 THEN {classes} END AS class_counts, CASE WHEN {few} THEN format('{{:.3f}}', {balance}) END AS balance_ratio,
  {", ".join(f"CASE WHEN NOT ({few}) THEN format('{{:.3f}}', {v}::DOUBLE) END AS {n}" for v, n in (("a", "mean"), ("s", "std"), ("lo", "min"), ("q1", "q1"), ("q2", "median"), ("q3", "q3"), ("hi", "max")))}
FROM (SELECT {number}, {stats} FROM {table})"""


TARGETS = {"c_mktsegment": False, "c_nationkey": True, "c_acctbal": True, "c_name": False}


@C.query("\nUNION ALL\n".join(_report_sql("customer", c, n) for c, n in TARGETS.items()))
def target_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = loader.target_report(read_table(spark, sf_dir, "customer"), list(TARGETS))
    return report.withColumn("n_classes", F.coalesce("n_classes", F.lit(-1)).cast("long"))


DIRTY = """d AS (SELECT vec_id AS sample, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS feature,
  unnest(embedding)::DOUBLE AS v, label FROM embeddings),
dirty AS (SELECT sample, feature, CASE WHEN label = 3 OR feature = 5 THEN NULL WHEN feature IN (7, 9) THEN 1.0 ELSE v END AS value FROM d)"""


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with one label's samples and one feature all null, and two constant features."""
    value = F.when((F.col("label") == 3) | (F.col("feature") == 5), None).when(F.col("feature").isin(7, 9), 1.0).otherwise(F.col("value"))
    return to_long(embeddings(spark, sf_dir)).select(F.col("sample_id").alias("sample"), "feature", value.alias("value"))


@C.query(
    f"""WITH {DIRTY}, f AS (SELECT sample FROM dirty GROUP BY sample HAVING count(value) > 0), k AS (SELECT feature, count(value) AS c, count(DISTINCT value) AS n FROM dirty WHERE sample IN (SELECT sample FROM f) GROUP BY feature)
SELECT (SELECT count(DISTINCT sample) FROM dirty) - (SELECT count(*) FROM f) AS samples_removed_all_nan, count(*) FILTER (c = 0) AS features_removed_all_nan, count(*) FILTER (c > 0 AND n <= 1) AS features_removed_single_value,
  (SELECT count(*) FROM dirty WHERE sample IN (SELECT sample FROM f) AND feature IN (SELECT feature FROM k WHERE n > 1)) AS values_kept FROM k"""
)
def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dirty(spark, sf_dir)
    kept, counts = loader.clean(rows, rows.select("sample").distinct())
    return counts.crossJoin(kept.agg(F.count(F.lit(1)).alias("values_kept")))


@C.query("SELECT (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS matched, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS only_features, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS only_metadata")
def align_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample"))
    return loader.align(samples, read_table(spark, sf_dir, "labels"), "doc_id")[1]


@C.query(f"WITH {X} SELECT feature, round((max(value) - min(value)) / max(abs(value)), 9) AS spread, (max(value) - min(value)) / max(abs(value)) < 1.7 AS flat FROM x GROUP BY feature")
def flat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.flat_features(to_long(embeddings(spark, sf_dir)), 1.7).withColumn("spread", F.round("spread", 9))


@C.query("SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM embeddings), 9) AS share FROM embeddings GROUP BY label")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = embeddings(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 9).alias("share"))


@C.query("SELECT coalesce(l_returnflag, 'All') AS l_returnflag, coalesce(l_linestatus, 'All') AS l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = read_table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return cube.select(*[F.coalesce(c, F.lit("All")).alias(c) for c in ("l_returnflag", "l_linestatus")], "n")


PREDICTED = """p AS (SELECT l_linenumber AS cell, l_returnflag AS y_true, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_discount > 0.05 THEN 'N' ELSE 'R' END AS y_pred FROM lineitem)"""


@C.query(
    f"""WITH {PREDICTED}, c AS (SELECT cell, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), tot AS (SELECT cell, sum(n) AS n, sum(n) FILTER (y_true = y_pred) AS h FROM c GROUP BY cell),
t AS (SELECT cell, y_true AS k, sum(n) AS t FROM c GROUP BY ALL), q AS (SELECT cell, y_pred AS k, sum(n) AS p FROM c GROUP BY ALL), h AS (SELECT cell, y_true AS k, sum(n) AS h FROM c WHERE y_true = y_pred GROUP BY ALL),
e AS (SELECT cell, k, coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(h, 0) AS h FROM t FULL JOIN q USING (cell, k) LEFT JOIN h USING (cell, k)),
m AS (SELECT cell, avg(CASE WHEN t + p > 0 THEN 2 * h / (t + p) ELSE 0 END) AS f1, avg(h / t) FILTER (t > 0) AS ba, min(h / t) FILTER (t > 0) AS lo, exp(avg(ln(greatest(h, 1) / t)) FILTER (t > 0)) AS g, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp FROM e GROUP BY cell)
SELECT cell, round(h / n, 9) AS accuracy, round(f1, 9) AS macro_f1, round(ba, 9) AS balanced_accuracy, round((h * n - tp) / (sqrt((n * n - pp)::DOUBLE) * sqrt((n * n - tt)::DOUBLE)), 9) AS mcc, round(CASE WHEN lo <= 0 THEN 0 ELSE g END, 9) AS g_mean FROM m JOIN tot USING (cell)"""
)
def metrics_from_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.when(F.col("l_quantity") > 30, "A").when(F.col("l_discount") > 0.05, "N").otherwise("R")
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("cell"), F.col("l_returnflag").alias("y_true"), predicted.alias("y_pred"))
    out = metrics.class_metrics(rows, ["cell"])
    return out.select("cell", *[F.round(m, 9).alias(m) for m in metrics.METRICS])


KNN = """t AS (SELECT * FROM embeddings WHERE vec_id % 3 < 2), q AS (SELECT * FROM embeddings WHERE vec_id % 3 = 2),
d AS (SELECT q.vec_id AS sample_id, q.label AS y_true, t.vec_id AS tid, t.label AS l, round(list_sum(list_transform(list_zip(t.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9) AS d FROM q, t),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d, tid) <= 5),
votes AS (SELECT sample_id, y_true, l, count(*) AS v FROM near GROUP BY ALL)"""


@C.query(f"WITH {KNN} SELECT sample_id, y_true, l AS y_pred, v / 5.0::DOUBLE AS score FROM votes QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, l) = 1")
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors by the five nearest of the others, all of them."""
    e = embeddings(spark, sf_dir)
    return models.knn_votes(e.where("sample_id % 3 < 2"), e.where("sample_id % 3 = 2"), 5)


@C.query(
    f"""WITH {TASKS}, s AS (SELECT task, vec_id, round(embedding[1]::DOUBLE, 2) AS score, (label::VARCHAR = class) = (class = positive) AS p FROM embeddings, tasks WHERE label IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY score) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0::DOUBLE AS r FROM s)
SELECT task, round((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / (count(*) FILTER (p) * count(*) FILTER (NOT p))::DOUBLE, 9) AS roc_auc FROM r GROUP BY task"""
)
def roc_auc_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component, in steps of a hundredth, as every task's score."""
    e = embeddings(spark, sf_dir)
    rows = protocol.labelled(e.where("label IS NOT NULL").select("sample_id", "label", F.round(F.col("features")[0], 2).alias("score")), protocol.tasks_ovr(e))
    return metrics.roc_auc(rows, ["task"], "y").withColumn("roc_auc", F.round("roc_auc", 9))


GRID = {
    "n_splits": 2, "train_sizes": [0.7], "preprocess": ["standard"], "metrics": ["accuracy", "macro_f1", "roc_auc"],
    "selectors": [{"name": "MannWhitneySelector", "k": [5, 20]}, {"name": "RandomSelector", "k": [5, 20]}, {"steps": [{"name": "MannWhitneySelector", "params": {"n_features": 30}}, {"name": "LassoSelector", "params": {"C": 1.0}}], "k": [5]}],
    "models": [{"name": "logistic_regression"}, {"name": "lda"}],
}
TIMES = ["selection_time_s", "selection_peak_mb", "search_time_s", "validation_time_s", "fit_time_s", "predict_time_s"]


@C.query()
def run_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid on the embeddings: ten tasks, two splits, three selectors, two models; without what differs from run to run."""
    return runner.run(embeddings(spark, sf_dir), GRID, truth=[0, 1, 2, 3]).drop(*TIMES)


@C.query(
    """WITH g AS (SELECT t.task, s.split::INTEGER AS split, c.selector, c.k::INTEGER AS k, m.model FROM (SELECT 'ovr_' || label AS task FROM embeddings WHERE label IS NOT NULL GROUP BY label) t, (SELECT unnest([0, 1]) AS split) s,
  (VALUES ('MannWhitneySelector', 5), ('MannWhitneySelector', 20), ('FDRSelector', NULL)) c(selector, k), (VALUES ('logistic_regression'), ('lda')) m(model))
SELECT task, split, 0.7::DOUBLE AS train_size, 'none' AS preprocess, selector, coalesce(k, -1) AS k, model FROM g WHERE NOT (split = 0 AND selector = 'FDRSelector') AND NOT (selector = 'MannWhitneySelector' AND k = 5 AND model = 'lda')"""
)
def resume_remaining_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some cells are done: a method's own count in the first split, and one model at the smaller k."""
    config = {**GRID, "preprocess": ["none"], "selectors": [{"name": "MannWhitneySelector", "k": [5, 20]}, {"name": "FDRSelector"}]}
    tasks = [r["task"] for r in protocol.tasks_ovr(embeddings(spark, sf_dir)).select("task").collect()]
    grid = runner.cells(spark, tasks, runner.checked(config))
    done = grid.where("(split = 0 AND selector = 'FDRSelector') OR (selector = 'MannWhitneySelector' AND k = 5 AND model = 'lda')")
    return runner.remaining(grid, done).withColumn("k", F.coalesce("k", F.lit(-1)))


@C.query(
    f"""WITH {X}, v AS (SELECT feature, round(var_pop(value), 12) AS v FROM x GROUP BY feature), r AS (SELECT feature, row_number() OVER (ORDER BY v DESC, feature DESC) AS pos FROM v)
SELECT k::INTEGER AS k, round(count(*) FILTER (pos <= k AND feature % 4 = 0) / 16.0::DOUBLE, 9) AS truth_recall, round(count(*) FILTER (pos <= k AND feature % 4 = 0) / k::DOUBLE, 9) AS truth_precision FROM r, (SELECT unnest([5, 10, 20]) AS k) GROUP BY k"""
)
def truth_recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by variance against a known set, every fourth one, at three counts."""
    scores = kernels.variances(to_long(embeddings(spark, sf_dir)), []).withColumn("variance", F.round("variance", 12))
    cut = kernels.cut_at(kernels.best_first(scores, [], "variance"), [5, 10, 20])
    hits = F.sum((F.col("feature") % 4 == 0).cast("long"))
    return cut.groupBy("k").agg(F.round(hits / F.lit(16.0), 9).alias("truth_recall"), F.round(hits / F.count(F.lit(1)), 9).alias("truth_precision"))


# --- selectors that SQL cannot express ---


def _selection(spark: SparkSession, fitted: sel.Selector, **columns) -> DataFrame:  # noqa: ANN003
    """A row for each feature: whether it is kept, and measures."""
    rows = [(i, bool(k), *[float(v[i]) for v in columns.values()]) for i, k in enumerate(fitted.support_)]
    return spark.createDataFrame(rows, ", ".join(["feature int", "selected boolean", *[f"{c} double" for c in columns]]))


def _selection_or(spark: SparkSession, selector: sel.Selector, matrix: DataFrame, nothing: bool | None) -> DataFrame:
    """A row for each feature; where none passes, which ``fit`` says by an error, every feature has ``nothing``."""
    try:
        return _selection(spark, selector.fit(matrix))
    except sel.NothingKept:
        rows = [(i, nothing) for i in range(selector.n_features_in_)]
        return spark.createDataFrame(rows, "feature int, selected boolean")


def _first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, the first label against the rest."""
    e = embeddings(spark, sf_dir)
    return e.withColumn("label", F.when(F.col("label") == 0, "0").otherwise("rest"))


#: log p of the rank-sum test from z, by the series of the normal distribution function: its terms are all positive.
LOG_P = """CASE WHEN z > 0 THEN least(0, ln(2.0::DOUBLE) + ln(0.5::DOUBLE - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150),
  lambda i: exp((2 * i + 1) * ln(z) - (i + 1) * ln(2.0::DOUBLE) - lgamma(i + 1.5::DOUBLE) + 0.5::DOUBLE * ln(pi()))))) ) ELSE 0 END"""
#: P(the i-th smallest of n uniform p is exp(lp) or less) is that of i or more of n falling there.
BERK_JONES = "ln(list_sum(list_transform(range(i, n + 1), lambda j: exp(lgamma(n + 1.0::DOUBLE) - lgamma(j + 1.0::DOUBLE) - lgamma(n - j + 1.0::DOUBLE) + j * lp + (n - j) * ln(1 - exp(lp))))))"


@C.query(
    f"""{U_ALL}, l AS (SELECT feature, {LOG_P} AS lp FROM u WHERE task = 'ovr_0'),
o AS (SELECT *, row_number() OVER (ORDER BY lp, feature) AS i, count(*) OVER () AS n FROM l),
s AS (SELECT i, lp, {BERK_JONES} AS score FROM o WHERE i <= greatest(1, floor(0.1::DOUBLE * n)) AND lp < 0)
SELECT feature, lp <= (SELECT arg_min(lp, round(score, 9)) FROM s) AS selected, round(lp, 6) AS log_p FROM l"""
)
def berk_jones_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = sel.BerkJonesSelector().fit(_first_label(spark, sf_dir))
    return _selection(spark, fitted, log_p=fitted.log_pvalues_.round(6))


@C.query(f"{F_TASK} SELECT task, feature, round(f, 8) AS f, round(ln(p), 7) AS log_p FROM f WHERE f IS NOT NULL")
def log_f_sf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log p of every F, by a vectorised function of the incomplete beta."""
    import pandas as pd

    from colsieve.functions import special

    @F.pandas_udf("double")
    def log_p(f, d1, d2):  # noqa: ANN001, ANN202
        return pd.Series(special.log_f_sf(f.to_numpy(), d1.to_numpy("f8"), d2.to_numpy("f8")))

    return _f_task(spark, sf_dir).where("f IS NOT NULL").select("task", "feature", F.round("f", 8).alias("f"), F.round(log_p("f", "df1", "df2"), 7).alias("log_p"))


# --- selectors by their names, fitted on a table, against the plain statistic in SQL ---


@C.query(f"WITH {X} SELECT feature, var_pop(value) > 0.0156 AS selected FROM x GROUP BY feature")
def fit_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sel.Selector.create("variance", threshold=0.0156).fit(embeddings(spark, sf_dir)))


@C.query(f"{U_ALL} SELECT feature, row_number() OVER (ORDER BY z DESC, feature DESC) <= 10 AS selected FROM u WHERE task = 'ovr_0'")
def fit_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sel.Selector.create("Mann_Whitney", n_features=10).fit(_first_label(spark, sf_dir)))


@C.query(f"{F_TASK} SELECT feature, row_number() OVER (ORDER BY f DESC, feature DESC) <= 10 AS selected FROM f WHERE task = 'ovr_0'")
def fit_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sel.Selector.create("anova", n_features=10).fit(_first_label(spark, sf_dir)))


@C.query(f"{F_TASK} SELECT feature, p < 0.2 AS selected, round(p, 8) AS p FROM f WHERE task = 'ovr_0'")
def fit_anova_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features with p under a level, as no count is given."""
    fitted = sel.Selector.create("anova", alpha=0.2).fit(_first_label(spark, sf_dir))
    return _selection(spark, fitted, p=fitted.pvalues_.round(8))


@C.query(f"{F_TASK}, o AS (SELECT *, 0.9::DOUBLE * row_number() OVER (ORDER BY p, feature) / count(*) OVER () AS line FROM f WHERE task = 'ovr_0') SELECT feature, p <= (SELECT max(p) FROM o WHERE p <= line) AS selected FROM o")
def fit_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null where no p is under its line, as then there is none to compare with."""
    return _selection_or(spark, sel.Selector.create("FDRSelector", alpha=0.9), _first_label(spark, sf_dir), None)


@C.query(f"{F_TASK} SELECT feature, f > (SELECT quantile_cont(f, 0.9) FROM f WHERE task = 'ovr_0') AS selected FROM f WHERE task = 'ovr_0'")
def fit_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the features; no F lies at the percentile, between two of 64."""
    return _selection(spark, sel.Selector.create("PercentileSelector", percentile=10).fit(_first_label(spark, sf_dir)))


@C.query(f"SELECT feature, selected FROM ({_hc_sql('2008')}) WHERE task = 'ovr_0'")
def fit_higher_criticism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sel.Selector.create("HigherCriticismSelector", variant="2008").fit(_first_label(spark, sf_dir)))


@C.query(f"SELECT feature, selected FROM ({_hc_sql('2004')}) WHERE task = 'ovr_0'")
def fit_higher_criticism_2004(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sel.Selector.create("HigherCriticismSelector", variant="2004").fit(_first_label(spark, sf_dir)))


@C.query(
    f"""WITH {BIN}, {PAIRS}, t AS (SELECT feature, corr(value, y) AS r FROM xb GROUP BY feature), c AS (SELECT * FROM t WHERE abs(r) >= 0.02),
losers AS (SELECT CASE WHEN abs(ca.r) > abs(cb.r) THEN cb.feature ELSE ca.feature END AS feature FROM pr JOIN c ca ON ca.feature = pr.a JOIN c cb ON cb.feature = pr.b WHERE abs(pr.r) > 0.08),
kept AS (SELECT feature FROM c WHERE feature NOT IN (SELECT feature FROM losers) ORDER BY abs(r) DESC, feature LIMIT 20)
SELECT feature, feature IN (SELECT feature FROM kept) AS selected FROM t"""
)
def fit_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No feature is selected where none is correlated with the target."""
    selector = sel.Selector.create("correlation", n_features=20, target_threshold=0.02, inter_feature_threshold=0.08)
    return _selection_or(spark, selector, _first_label(spark, sf_dir), False)


@C.query(f"{MI} SELECT feature, row_number() OVER (ORDER BY mi DESC, feature DESC) <= 10 AS selected FROM mi")
def fit_mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its noise of 1e-10 parts equal values; there are none here."""
    return _selection(spark, sel.Selector.create("mutual_info", n_features=10).fit(embeddings(spark, sf_dir)))


@C.query()
def lasso_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = sel.LassoSelector(20, C=1.0).fit(_first_label(spark, sf_dir))
    return _selection(spark, fitted, weight=fitted.coef_[0].round(6))


@C.query()
def lasso_best_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = sel.LassoSelector(20, Cs=[1.0, 2.0, 4.0]).fit(_first_label(spark, sf_dir))
    return spark.createDataFrame([(float(c), float(s.round(6)), bool(c == fitted.C_)) for c, s in zip(fitted.cv_results_["C"], fitted.cv_results_["mean_test_score"], strict=True)], "C double, mean_auc double, best boolean")


@C.query()
def tree_importance_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = sel.TreeImportanceSelector(10, n_estimators=20).fit(_first_label(spark, sf_dir))
    return _selection(spark, fitted, importance=fitted.feature_importances_.round(9))


@C.query()
def rfe_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = sel.RFESelector(10).fit(_first_label(spark, sf_dir))
    return _selection(spark, fitted, ranking=fitted.ranking_)


@C.query()
def rfecv_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = sel.RFECVSelector(step=8, cv=3, scoring="roc_auc").fit(_first_label(spark, sf_dir))
    return _selection(spark, fitted, ranking=fitted.ranking_)


@C.query()
def sequential_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = sel.SequentialSelector(4, cv=3, solver="newton").fit(_first_label(spark, sf_dir))
    return _selection(spark, fitted)


@C.query()
def sequential_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the twelve features that the rank-sum test puts first down to four."""
    matrix = _first_label(spark, sf_dir)
    first = sel.MannWhitneySelector(12).fit(matrix)
    fitted = sel.SequentialSelector(4, direction="backward", cv=3).fit(first.transform(matrix))
    kept = set(first.get_support(indices=True)[fitted.support_].tolist())
    return spark.createDataFrame([(i, i in kept) for i in range(first.n_features_in_)], "feature int, selected boolean")


@C.query()
def chain_mw_then_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = kernels.best_first(_u_all(spark, sf_dir).where("task = 'ovr_0'").select("feature", "z"), [], "z").where("pos <= 30").select("feature")
    rows = _binary(spark, sf_dir).join(F.broadcast(z), "feature", "left_semi")
    wide = rows.groupBy("sample_id", F.col("y").alias("label")).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_v"))
    fitted = sel.LassoSelector(10).fit(wide.select("sample_id", F.transform("_v", lambda e: e["value"]).alias("features"), "label"))
    names = sorted(r["feature"] for r in z.collect())
    return spark.createDataFrame([(f, bool(k), float(w)) for f, k, w in zip(names, fitted.support_, fitted.coef_[0].round(6), strict=True)], "feature int, selected boolean, weight double")


# --- copies ---

PAIRS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
c AS (SELECT a.vec_id AS q, b.vec_id AS r, round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id),
near AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, r) <= 30),
pairs AS MATERIALIZED (SELECT DISTINCT least(q, r) AS a, greatest(q, r) AS b, cosine FROM near)"""
LINK = 0.42
GROUPS = f"""reach AS (SELECT vec_id AS node, vec_id AS r FROM embeddings UNION SELECT CASE WHEN a = node THEN b ELSE a END, r FROM reach JOIN pairs ON cosine >= {LINK} AND (a = node OR b = node)),
least AS (SELECT node, min(r) AS root FROM reach GROUP BY node),
groups AS MATERIALIZED (SELECT node AS vec_id, dense_rank() OVER (ORDER BY root) - 1 AS copy_group FROM least WHERE root IN (SELECT root FROM least GROUP BY root HAVING count(*) > 1))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.nearest_pairs(embeddings(spark, sf_dir), 30)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.groups(_pairs(spark, sf_dir).where(F.col("cosine") >= LINK)).select(F.col("node").alias("vec_id"), "copy_group")


@C.query(f"WITH {PAIRS} SELECT a, b, cosine FROM pairs")
def copy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@C.query(f"WITH RECURSIVE {PAIRS}, {GROUPS} SELECT vec_id, copy_group::INTEGER AS copy_group FROM groups")
def copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


@C.query(f"WITH RECURSIVE {PAIRS}, {GROUPS}, s AS (SELECT copy_group, count(*) AS size FROM groups GROUP BY copy_group) SELECT size, count(*) AS n_groups FROM s GROUP BY size")
def copy_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).groupBy("copy_group").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


@C.query(f"WITH RECURSIVE {PAIRS}, {GROUPS}, j AS (SELECT e.vec_id, label, copy_group FROM embeddings e LEFT JOIN groups USING (vec_id)), l AS (SELECT copy_group, count(DISTINCT label) AS n, min(vec_id) AS first FROM j WHERE copy_group IS NOT NULL GROUP BY copy_group) SELECT vec_id, label FROM j LEFT JOIN l USING (copy_group) WHERE copy_group IS NULL OR (n = 1 AND vec_id = first)")
def drop_copies_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label").join(_groups(spark, sf_dir), "vec_id", "left")
    return copies.without_copies(rows, "vec_id", "label", "copy_group").select("vec_id", "label")


@C.query(f"WITH RECURSIVE {PAIRS}, {GROUPS}, {SPLITS}, s AS (SELECT split, copy_group, count(DISTINCT part) AS n FROM splits JOIN groups ON vec_id = sample_id GROUP BY ALL) SELECT split, count(*) AS n_groups, count(*) FILTER (n > 1) AS leaking FROM s GROUP BY split")
def leaking_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = protocol.stratified_splits(embeddings(spark, sf_dir), 4, TRAIN, SEED)
    return copies.leaks(splits.join(_groups(spark, sf_dir).withColumnRenamed("vec_id", "sample_id"), "sample_id"))


@C.query(f"WITH {X}, k AS (SELECT feature, kurtosis_pop(value) AS excess_kurtosis, avg((value = 0)::INTEGER) AS zero_share, avg((abs(value) > 0.2)::INTEGER) AS large_share FROM x GROUP BY feature) SELECT feature, round(excess_kurtosis, 8) AS excess_kurtosis, round(zero_share, 9) AS zero_share, round(large_share, 9) AS large_share FROM k")
def feature_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    return to_long(embeddings(spark, sf_dir)).groupBy("feature").agg(F.round(F.kurtosis("value"), 8).alias("excess_kurtosis"), share(F.col("value") == 0).alias("zero_share"), share(F.abs("value") > 0.2).alias("large_share"))


@C.query(f"WITH {X}, pr AS (SELECT abs(corr(a.value, b.value)) AS r FROM x a JOIN x b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY a.feature, b.feature) SELECT round(quantile_cont(r, 0.5), 9) AS median_abs_r, round(max(r), 9) AS max_abs_r, count(*) AS n_pairs FROM pr")
def correlation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = kernels.pair_correlations(to_long(embeddings(spark, sf_dir)), []).select(F.abs("r").alias("r"))
    return r.agg(F.round(F.percentile("r", F.lit(0.5)), 9).alias("median_abs_r"), F.round(F.max("r"), 9).alias("max_abs_r"), F.count(F.lit(1)).alias("n_pairs"))


@C.query()
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many principal components hold 50, 90 and 99 % of the variance, by Spark ML's covariance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = embeddings(spark, sf_dir).select(array_to_vector("features").alias("v"))
    p = len(rows.first()["v"])
    shares = PCA(k=p, inputCol="v", outputCol="o").fit(rows).explainedVariance.toArray().cumsum()
    return spark.createDataFrame([(float(s), int((shares < s - 1e-12).sum()) + 1) for s in (0.5, 0.9, 0.99)], "share double, components int")


@C.query("SELECT array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS statuses, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def distinct_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("statuses"), F.count(F.lit(1)).alias("n"))


@C.query("SELECT event_type, (props::JSON->>'$.k') AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def json_parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@C.query()
def forest_seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two forests with other seeds agree on the first features, by number of trees; a task for each forest."""
    matrix, out = _first_label(spark, sf_dir), []
    for trees in (10, 40):
        a, b = (sel.TreeImportanceSelector(20, n_estimators=trees, random_state=s).fit(matrix).ranking() for s in (1, 2))
        out += [(trees, k, len(set(a[:k]) & set(b[:k])) / len(set(a[:k]) | set(b[:k]))) for k in (5, 10, 20)]
    return spark.createDataFrame(out, "n_trees int, k int, jaccard double")


@C.query()
def baseline_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed baseline: random features against the ANOVA's best, five draws, logistic regression on all tasks."""
    config = {"n_splits": 5, "train_sizes": [0.8], "metrics": ["accuracy", "macro_f1"], "selectors": [{"name": "RandomSelector", "k": [20]}, {"name": "ANOVAFSelector", "k": [20]}], "models": [{"name": "logistic_regression"}]}
    rows = runner.run(embeddings(spark, sf_dir), config)
    return rows.groupBy("selector").agg(F.round(F.avg("accuracy"), 9).alias("accuracy"), F.round(F.avg("macro_f1"), 9).alias("macro_f1"), F.count(F.lit(1)).alias("n"))


@C.query()
def loo_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out predictions of a hundredth of the samples from five features, with an inner choice of C, in one task."""

    def predict(parts):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(parts)).sort_values("sample_id")
        m = runner.loo_confusion(np.stack(rows["features"].to_numpy()), rows["label"].to_numpy(), alpha=0.01)
        yield pd.DataFrame([(i, j, int(m[i, j])) for i in range(2) for j in range(2)], columns=["actual", "predicted", "n"])

    rows = _first_label(spark, sf_dir).withColumn("features", F.slice("features", 1, 5))
    return rows.select("sample_id", "features", "label").coalesce(1).mapInPandas(predict, "actual int, predicted int, n long")


@C.query(
    f"""WITH {X}, c AS (SELECT feature, value - avg(value) OVER (PARTITION BY feature) AS d FROM x),
m AS (SELECT feature, count(*)::DOUBLE AS n, avg(d * d * d) / pow(avg(d * d), 1.5) AS g, avg(d * d * d * d) / pow(avg(d * d), 2) AS b FROM c GROUP BY feature),
s AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x4,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM m),
t AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM s),
u AS (SELECT *, (1 - 2 / a) / (1 + x4 * sqrt(2 / (a - 4))) AS part FROM t),
k AS (SELECT feature, z1 * z1 + pow((1 - 2 / (9 * a) - sign(part) * cbrt(abs(part))) / sqrt(2 / (9 * a)), 2) AS k2 FROM u)
SELECT feature, round(k2, 6) AS k2, round(exp(-k2 / 2), 8) AS p FROM k"""
)
def normality_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.normality(to_long(embeddings(spark, sf_dir)), []).select("feature", F.round("k2", 6).alias("k2"), F.round("p", 8).alias("p"))


@C.query()
def rfecv_scoring_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features recursive elimination keeps by each score; a task for each."""
    matrix, out = _first_label(spark, sf_dir), []
    for scoring in ("accuracy", "balanced_accuracy", "roc_auc"):
        fitted = sel.RFECVSelector(step=8, cv=3, scoring=scoring).fit(matrix)
        best = fitted.cv_results_["mean_test_score"].max()
        out.append((scoring, int(fitted.n_features_), float(round(best, 6))))
    return spark.createDataFrame(out, "scoring string, n_features int, score double")


@C.query()
def embedding_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which half of the embedding's components validates better, on each split and task."""
    e = embeddings(spark, sf_dir)
    half = lambda start: e.withColumn("features", F.slice("features", start, 32))
    return runner.choose_matrix({"first": half(1), "second": half(33)}, 2, 0.7, cv=3).withColumn("validation_auc", F.round("validation_auc", 6))
