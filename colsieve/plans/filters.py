"""Queries of the filter selectors and their kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.operators import analysis, kernels, protocol
from colsieve.plans.registry import Catalogue
from colsieve.sources.layouts import columns_to_long, embeddings, to_long
from colsieve.sources.scratch import read_table, written

C = Catalogue()
N_SPLITS, TRAIN, SEED = 4, 0.7, 42
KS = [5, 10, 20]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# --- DuckDB building blocks ---

X = "x AS MATERIALIZED (SELECT vec_id AS sample_id, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS feature, unnest(embedding)::DOUBLE AS value, label FROM embeddings)"
TASKS = """tasks AS (SELECT 'ovr_' || label AS task, label::VARCHAR AS class, greatest(label::VARCHAR, 'rest') AS positive FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL))"""
SPLITS = f"""quota AS (
  SELECT label, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, label) <= floor({TRAIN} * total) - sum(f) OVER () THEN 1 ELSE 0 END AS take
  FROM (SELECT label, n, total, (n * floor({TRAIN}::DOUBLE * total)::BIGINT) // total AS f, (n * floor({TRAIN}::DOUBLE * total)::BIGINT) % total AS rest
        FROM (SELECT label, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM embeddings WHERE label IS NOT NULL GROUP BY label))),
splits AS MATERIALIZED (
  SELECT split, vec_id AS sample_id, e.label, CASE WHEN row_number() OVER (PARTITION BY split, e.label ORDER BY md5('{SEED}-' || split || '-' || vec_id), vec_id) <= take THEN 'train' ELSE 'test' END AS part
  FROM embeddings e JOIN quota USING (label), (SELECT unnest(range({N_SPLITS}))::INTEGER AS split) s)"""


def ranks(source: str, keys: str) -> str:
    """CTEs ``r`` and ``sums`` of rank sums by class over ``source``."""
    return f"""r AS MATERIALIZED (
  SELECT *, rank() OVER (PARTITION BY {keys}feature ORDER BY value) + (tied - 1) / 2.0::DOUBLE AS rnk
  FROM (SELECT *, count(*) OVER (PARTITION BY {keys}feature, value) AS tied FROM {source})),
sums AS (SELECT {keys}feature, label, sum(rnk) AS rank_sum, count(*) AS n, sum(tied::DOUBLE * tied - 1) AS ties FROM r GROUP BY {keys}feature, label)"""


def u_sql(keys: str) -> str:
    """CTE ``u`` of the rank-sum test from ``sums`` and ``tasks``, with the fitted log p."""
    t = "(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * (z / sqrt(2.0::DOUBLE))))"
    from colsieve.functions.special import ERFCC

    poly = f"{ERFCC[-1]}::DOUBLE"
    for c in reversed(ERFCC[:-1]):
        poly = f"({poly} * {t} + ({c})::DOUBLE)"
    return f"""u0 AS (
  SELECT {keys}task, feature, tot::DOUBLE AS nn, CASE WHEN class = positive THEN n ELSE tot - n END::DOUBLE AS n2, all_ties AS ties,
         CASE WHEN class = positive THEN rank_sum ELSE tot::DOUBLE * (tot + 1) / 2 - rank_sum END AS r2
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}feature) AS tot, sum(ties) OVER (PARTITION BY {keys}feature) AS all_ties FROM sums) JOIN tasks ON label::VARCHAR = class),
u1 AS (SELECT {keys}task, feature, nn - n2 AS n1, n2, nn, ties, r2 - n2 * (n2 + 1) / 2 AS u FROM u0),
u2 AS (SELECT *, n1 * n2 / 12 * ((nn + 1) - ties / (nn * (nn - 1))) AS variance FROM u1),
u3 AS (SELECT *, CASE WHEN variance > 0 THEN (abs(u - n1 * n2 / 2) - 0.5::DOUBLE) / sqrt(variance) ELSE 0 END AS z FROM u2),
u AS MATERIALIZED (SELECT {keys}task, feature, n1::BIGINT AS n1, n2::BIGINT AS n2, u, ties, z, u / (n1 * n2) AS auc,
  CASE WHEN z > 0 THEN least(ln({t}) - (z / sqrt(2.0::DOUBLE)) * (z / sqrt(2.0::DOUBLE)) + {poly}, 0) ELSE 0 END AS log_p FROM u3)"""


U_ALL = f"WITH {X}, {TASKS}, {ranks('x', '')}, {u_sql('')}"
U_SPLIT = f"WITH {X}, {TASKS}, {SPLITS}, xs AS (SELECT split, feature, value, x.label FROM x JOIN splits USING (sample_id) WHERE part = 'train'), {ranks('xs', 'split, ')}, {u_sql('split, ')}"


def _u_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return kernels.u_test(kernels.rank_sums(to_long(e), []), protocol.tasks_ovr(e), [])


def _u_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    splits = protocol.stratified_splits(e, N_SPLITS, TRAIN, SEED).where("part = 'train'").select("split", "sample_id")
    rows = to_long(e.join(splits, "sample_id"))
    return kernels.u_test(kernels.rank_sums(rows, ["split"]), protocol.tasks_ovr(e), ["split"])


def _lineitem(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return columns_to_long(read_table(spark, sf_dir, "lineitem"), NUMERIC, *keep)


def _r(name: str, digits: int = 9) -> F.Column:
    return F.round(name, digits).alias(name)


@C.query(
    f"""{U_SPLIT}, top AS MATERIALIZED (
  SELECT split, task, k, feature FROM (SELECT *, row_number() OVER (PARTITION BY split, task ORDER BY round(z, 9) DESC, feature DESC) AS pos FROM u), (SELECT unnest([5, 10, 20])::INTEGER AS k) WHERE pos <= k),
pairs AS (SELECT t.task, k.k, a.split AS s1, b.split AS s2 FROM tasks t, (SELECT unnest([5, 10, 20])::INTEGER AS k) k, (SELECT unnest(range(4)) AS split) a, (SELECT unnest(range(4)) AS split) b WHERE a.split < b.split),
hits AS (SELECT a.task, a.k, a.split AS s1, b.split AS s2, count(*) AS r FROM top a JOIN top b ON a.task = b.task AND a.k = b.k AND a.feature = b.feature AND a.split < b.split GROUP BY ALL)
SELECT task, k, round(avg((coalesce(r, 0) - k * k / 64.0::DOUBLE) / (k - k * k / 64.0::DOUBLE)), 9) AS consistency_index, count(*) AS n_pairs, false AS variable_size
FROM pairs LEFT JOIN hits USING (task, k, s1, s2) GROUP BY task, k"""
)
def mw_kuncheva_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features chosen by the rank-sum test for each task, split and k, and how alike the splits' choices are."""
    ranking = kernels.best_first(_u_split(spark, sf_dir).withColumn("z", F.round("z", 9)), ["split", "task"], "z")
    chosen = kernels.cut_at(ranking.where(F.col("pos") <= max(KS)), KS).select("task", "k", "split", "feature")
    chosen = written(chosen, "selections")  # small, and read four times
    return analysis.kuncheva(chosen, ["task", "k"], 64).withColumn("consistency_index", F.round("consistency_index", 9))


@C.query(f"{U_ALL} SELECT task, feature, n1, n2, u, ties, round(z, 9) AS z FROM u")
def mw_u_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _u_all(spark, sf_dir).select("task", "feature", "n1", "n2", "u", "ties", _r("z"))


@C.query(
    f"""WITH tasks AS (SELECT 'ovr_' || l AS task, l AS class, greatest(l, 'rest') AS positive FROM (SELECT DISTINCT l_returnflag AS l FROM lineitem)),
x AS (SELECT unnest(range(4))::INTEGER AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value, l_returnflag AS label FROM lineitem), {ranks("x", "")}, {u_sql("")}
SELECT task, feature, n1, n2, u, ties, round(z, 9) AS z, round(auc, 9) AS auc FROM u"""
)
def mw_ties_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of few distinct values, so that nearly all ranks are shared."""
    rows = _lineitem(spark, sf_dir, F.col("l_returnflag").alias("label"))
    tasks = protocol.tasks_ovr(read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label")))
    return kernels.u_test(kernels.rank_sums_by_value(rows, []), tasks, []).select("task", "feature", "n1", "n2", "u", "ties", _r("z"), _r("auc"))


@C.query(f"{U_ALL} SELECT task, feature, round(auc, 9) AS auc FROM u")
def mw_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _u_all(spark, sf_dir).select("task", "feature", _r("auc"))


@C.query(f"{U_ALL} SELECT task, feature, pos::INTEGER AS pos, round(z, 9) AS z FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(z, 9) DESC, feature DESC) AS pos FROM u) WHERE pos <= 10")
def mw_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.best_first(_u_all(spark, sf_dir).withColumn("z", F.round("z", 9)), ["task"], "z").where("pos <= 10").select("task", "feature", "pos", "z")


@C.query(f"{U_SPLIT} SELECT split, task, k, feature, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY split, task ORDER BY round(z, 9) DESC, feature DESC) AS pos FROM u), (SELECT unnest([5, 10, 20])::INTEGER AS k) WHERE pos <= k")
def mw_ranking_cut_all_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking for each task and split, cut at every k."""
    ranking = kernels.best_first(_u_split(spark, sf_dir).withColumn("z", F.round("z", 9)), ["split", "task"], "z")
    return kernels.cut_at(ranking, KS).select("split", "task", "k", "feature", "pos")


def t_two_sided(t: str, df: str) -> str:
    """P(|T| > t) for a whole number of degrees of freedom, by the finite series in the angle atan(t / sqrt(df))."""
    a = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    even = f"sin({a}) * list_sum(list_transform(range(0, ({df}) // 2), lambda i: exp(lgamma(i + 0.5::DOUBLE) - lgamma(i + 1.0::DOUBLE) - 0.5::DOUBLE * ln(pi()) + 2 * i * ln(cos({a})))))"
    odd = f"2 / pi() * ({a} + sin({a}) * cos({a}) * coalesce(list_sum(list_transform(range(0, (({df}) - 1) // 2), lambda i: exp(lgamma(i + 1.0::DOUBLE) - lgamma(i + 1.5::DOUBLE) + 0.5::DOUBLE * ln(pi()) - ln(2.0::DOUBLE) + 2 * i * ln(cos({a}))))), 0))"
    return f"greatest(0, 1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


F_SUMS = "cs AS (SELECT feature, label, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM x GROUP BY feature, label)"
F_ALL = f"""WITH {X}, {F_SUMS},
f0 AS (SELECT feature, count(*) AS k, sum(n)::DOUBLE AS nn, sum(s) AS ss, sum(q) AS qq, sum(s * s / n::DOUBLE) AS c FROM cs GROUP BY feature),
f AS (SELECT feature, ((c - ss * ss / nn) / (k - 1)) / ((qq - c) / (nn - k)) AS f, (k - 1)::BIGINT AS df1, (nn - k)::BIGINT AS df2 FROM f0)"""
F_TASK = f"""WITH {X}, {F_SUMS}, {TASKS},
w AS (SELECT *, sum(n) OVER g AS tn, sum(s) OVER g AS ts, sum(q) OVER g AS tq FROM cs WINDOW g AS (PARTITION BY feature)),
f0 AS (SELECT task, feature, tn::DOUBLE AS nn, ts, tq, s * s / n::DOUBLE + (ts - s) * (ts - s) / (tn - n)::DOUBLE AS c FROM w JOIN tasks ON label::VARCHAR = class),
f1 AS (SELECT task, feature, (c - ts * ts / nn) / ((tq - c) / (nn - 2)) AS f, (nn - 2)::BIGINT AS df FROM f0),
f AS MATERIALIZED (SELECT task, feature, f, df, {t_two_sided("sqrt(greatest(f, 0))", "df")} AS p FROM f1)"""


def _f_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    sums = kernels.task_sums(kernels.class_sums(to_long(e), []), protocol.tasks_ovr(e), [])
    f = kernels.anova_f(sums, ["task"])
    return f.withColumn("p", kernels.two_sided_t(F.sqrt(F.greatest("f", F.lit(0.0))), F.col("df2")))


@C.query(f"{F_ALL} SELECT feature, round(f, 9) AS f, df1, df2 FROM f")
def anova_f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.anova_f(kernels.class_sums(to_long(embeddings(spark, sf_dir)), []), []).withColumn("f", F.round("f", 9))


@C.query(f"{F_TASK} SELECT task, feature, pos::INTEGER AS pos, round(f, 8) AS f FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(f, 8) DESC, feature DESC) AS pos FROM f) WHERE pos <= 10")
def anova_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    sums = kernels.task_sums(kernels.class_sums(to_long(e), []), protocol.tasks_ovr(e), [])
    f = kernels.anova_f(sums, ["task"]).withColumn("f", F.round("f", 8))
    return kernels.best_first(f, ["task"], "f").where("pos <= 10").select("task", "feature", "pos", "f")


REG = "x AS (SELECT unnest(range(3))::INTEGER AS feature, unnest([l_quantity, l_discount, l_tax]) AS value, l_extendedprice AS target FROM lineitem)"


@C.query(f"WITH {REG}, c AS (SELECT feature, corr(value, target) AS r, count(value) AS n FROM x GROUP BY feature) SELECT feature, round(r, 9) AS r, round(r * r / (1 - r * r) * (n - 2), 5) AS f FROM c")
def f_regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns_to_long(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], F.col("l_extendedprice").alias("target"))
    return kernels.f_regression(rows, [], "target").select("feature", _r("r"), _r("f", 5))


@C.query(
    f"""{F_TASK}, c AS (SELECT task, quantile_cont(round(f, 8), 0.9) AS cut, count(*) AS n FROM f GROUP BY task),
m AS (SELECT f.task, feature, round(f, 8) AS f, cut, n, row_number() OVER (PARTITION BY f.task, round(f, 8) = cut ORDER BY feature) AS tie, count(*) FILTER (round(f, 8) > cut) OVER (PARTITION BY f.task) AS above FROM f JOIN c ON c.task = f.task)
SELECT task, feature, f, f > cut OR (f = cut AND tie <= floor(n * 0.1::DOUBLE) - above) AS selected FROM m"""
)
def percentile_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _f_task(spark, sf_dir).select("task", "feature", _r("f", 8))
    return kernels.percentile_cut(f, ["task"], "f", 10).select("task", "feature", "f", "selected")


@C.query(f"WITH {X} SELECT feature, round(var_pop(value), 12) AS variance, var_pop(value) > 0.0156 AS selected FROM x GROUP BY feature")
def variance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = kernels.variances(to_long(embeddings(spark, sf_dir)), [])
    return v.select("feature", F.round("variance", 12).alias("variance"), (F.col("variance") > 0.0156).alias("selected"))


@C.query(f"{F_TASK}, s AS (SELECT *, CASE WHEN p <= 0.2::DOUBLE * row_number() OVER (PARTITION BY task ORDER BY p, feature) / count(*) OVER (PARTITION BY task) THEN p END AS under FROM f) SELECT task, feature, round(p, 9) AS p, coalesce(p <= max(under) OVER (PARTITION BY task), false) AS selected FROM s")
def fdr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.benjamini_hochberg(_f_task(spark, sf_dir), ["task"], "p", 0.2).select("task", "feature", _r("p"), "selected")


@C.query(f"{F_TASK} SELECT task, feature, round(p, 9) AS p, p < 0.5::DOUBLE / count(*) OVER (PARTITION BY task) AS selected FROM f")
def fwe_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.bonferroni(_f_task(spark, sf_dir), ["task"], "p", 0.5).select("task", "feature", _r("p"), "selected")


@C.query(f"{U_ALL}, s AS (SELECT *, exp(log_p) AS p FROM u), b AS (SELECT *, CASE WHEN p <= 0.2::DOUBLE * row_number() OVER (PARTITION BY task ORDER BY p, feature) / count(*) OVER (PARTITION BY task) THEN p END AS under FROM s) SELECT task, feature, round(p, 8) AS p, coalesce(p <= max(under) OVER (PARTITION BY task), false) AS selected FROM b")
def mw_bh_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _u_all(spark, sf_dir).withColumn("p", F.exp("log_p"))
    return kernels.benjamini_hochberg(p, ["task"], "p", 0.2).select("task", "feature", _r("p", 8), "selected")


def _hc_sql(variant: str) -> str:
    centre, log_var = ("i / (n + 1)::DOUBLE", "ln(i / (n + 1)::DOUBLE) + ln(1 - i / (n + 1)::DOUBLE)") if variant == "2008" else ("i / n::DOUBLE", "lp + ln(1 - exp(lp))")
    return f"""{U_ALL}, i AS (SELECT task, feature, round(log_p, 9) AS lp FROM u),
h0 AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY lp, feature) AS i, count(*) OVER (PARTITION BY task) AS n FROM i),
h1 AS (SELECT *, i <= greatest(1, floor(0.1::DOUBLE * n)) AS first, {centre} AS centre FROM h0),
h AS (SELECT *, CASE WHEN first AND centre > exp(lp) THEN ln(centre - exp(lp)) - ({log_var}) / 2 END AS a, CASE WHEN first AND lp < 0 THEN (centre - exp(lp)) / exp(({log_var}) / 2) END AS b FROM h1),
m AS (SELECT task, max(a) AS ma, max(b) AS mb FROM h GROUP BY task),
best AS (SELECT h.task, arg_min(lp, i) AS edge FROM h JOIN m ON m.task = h.task WHERE CASE WHEN ma IS NOT NULL THEN a = ma ELSE b = mb END GROUP BY h.task)
SELECT i.task, feature, lp AS log_p, coalesce(lp <= edge, false) AS selected FROM i LEFT JOIN best ON best.task = i.task"""


@C.query(_hc_sql("2004"))
def hc2004_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.higher_criticism(_u_all(spark, sf_dir).withColumn("log_p", F.round("log_p", 9)), ["task"], "2004").select("task", "feature", "log_p", "selected")


@C.query(_hc_sql("2008"))
def hc2008_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.higher_criticism(_u_all(spark, sf_dir).withColumn("log_p", F.round("log_p", 9)), ["task"], "2008").select("task", "feature", "log_p", "selected")


BIN = f"{X}, xb AS (SELECT sample_id, feature, value, (label <> 0)::INTEGER AS y FROM x)"


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 0 against the rest; 'rest' sorts after it and is positive."""
    return to_long(embeddings(spark, sf_dir)).select("sample_id", "feature", "value", (F.col("label") != 0).cast("int").alias("y"))


@C.query(f"WITH {BIN} SELECT feature, round(corr(value, y), 9) AS r FROM xb GROUP BY feature")
def pearson_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.correlations(_binary(spark, sf_dir), [], "y").select("feature", _r("r"))


@C.query(f"WITH {BIN}, rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS v FROM xb) SELECT feature, round(corr(v, y), 9) AS r FROM rk GROUP BY feature")
def spearman_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of a two-valued target are a linear function of it, so its values serve."""
    return kernels.correlations(kernels.to_ranks(_binary(spark, sf_dir), []), [], "y").select("feature", _r("r"))


@C.query(f"WITH {BIN}, s AS (SELECT a.feature, sum(sign(a.value - b.value) * sign(a.y - b.y)) AS c, sum(abs(sign(a.value - b.value))) AS nx, sum(abs(sign(a.y - b.y))) AS ny FROM xb a JOIN xb b ON a.feature = b.feature AND a.sample_id < b.sample_id GROUP BY a.feature) SELECT feature, round(c / sqrt(nx::DOUBLE * ny), 9) AS tau FROM s")
def kendall_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.kendall(_binary(spark, sf_dir), [], "y").select("feature", _r("tau"))


PAIRS = "pr AS MATERIALIZED (SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM x a JOIN x b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY a.feature, b.feature)"


@C.query(f"WITH {X}, {PAIRS} SELECT a, b, round(r, 9) AS r FROM pr WHERE abs(r) > 0.1")
def redundant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.close_pairs(to_long(embeddings(spark, sf_dir)), 0.1).select("a", "b", _r("r"))


@C.query(
    f"""WITH {BIN}, {PAIRS}, t AS (SELECT feature, corr(value, y) AS r FROM xb GROUP BY feature),
c AS (SELECT * FROM t WHERE abs(r) >= 0.02),
losers AS (SELECT CASE WHEN abs(ca.r) > abs(cb.r) THEN cb.feature ELSE ca.feature END AS feature FROM pr JOIN c ca ON ca.feature = pr.a JOIN c cb ON cb.feature = pr.b WHERE abs(pr.r) > 0.08)
SELECT feature, round(r, 9) AS r, row_number() OVER (ORDER BY round(abs(r), 9) DESC, feature)::INTEGER AS pos FROM c WHERE feature NOT IN (SELECT feature FROM losers) QUALIFY pos <= 20"""
)
def correlation_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.correlation_select(_binary(spark, sf_dir), "y", 0.02, 0.08, 20).select("feature", _r("r"), "pos")


MI = f"""WITH {X}, c AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS c, count(*) OVER (PARTITION BY feature) AS n0 FROM x),
g AS (SELECT *, count(*) OVER (PARTITION BY feature) AS n, value - lag(value, 1) OVER w AS d1, value - lag(value, 2) OVER w AS d2, value - lag(value, 3) OVER w AS d3,
  lead(value, 1) OVER w - value AS e1, lead(value, 2) OVER w - value AS e2, lead(value, 3) OVER w - value AS e3 FROM c WHERE c > 3 WINDOW w AS (PARTITION BY feature, label ORDER BY value, sample_id)),
rad AS (SELECT *, least(d3, e3, CASE WHEN d1 IS NOT NULL AND e2 IS NOT NULL THEN greatest(d1, e2) END, CASE WHEN d2 IS NOT NULL AND e1 IS NOT NULL THEN greatest(d2, e1) END) AS r FROM g),
m AS (SELECT a.feature, a.sample_id, a.c, a.n, count(*) FILTER (abs(b.value - a.value) < a.r) AS m FROM rad a JOIN rad b ON a.feature = b.feature GROUP BY ALL),
h AS (SELECT i, sum(1.0::DOUBLE / greatest(i, 1)) FILTER (i > 0) OVER (ORDER BY i) AS h FROM (SELECT unnest(range(0, (SELECT count(*) + 1 FROM embeddings))) AS i)),
mi AS (SELECT feature, greatest(avg(coalesce(hk.h, 0) - coalesce(hc.h, 0) - coalesce(hm.h, 0) + coalesce(hn.h, 0)), 0) AS mi FROM m JOIN h hk ON hk.i = 2 JOIN h hc ON hc.i = c - 1 JOIN h hm ON hm.i = greatest(m, 1) - 1 JOIN h hn ON hn.i = n - 1 GROUP BY feature)"""


@C.query(f"{MI} SELECT feature, round(mi, 8) AS mi FROM mi")
def mi_knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.mutual_information(to_long(embeddings(spark, sf_dir)), []).select("feature", _r("mi", 8))


@C.query(f"{MI} SELECT feature, round(mi, 8) AS mi, row_number() OVER (ORDER BY round(mi, 8) DESC, feature DESC)::INTEGER AS pos FROM mi QUALIFY pos <= 10")
def mi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    mi = kernels.mutual_information(to_long(embeddings(spark, sf_dir)), []).select("feature", _r("mi", 8))
    return kernels.best_first(mi, [], "mi").where("pos <= 10")


@C.query(f"WITH {X} SELECT feature, row_number() OVER (ORDER BY md5('42-' || feature), feature)::INTEGER AS pos FROM (SELECT DISTINCT feature FROM x) QUALIFY pos <= 10")
def random_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = to_long(embeddings(spark, sf_dir)).select("feature").distinct()
    return kernels.random_order(features, 42).where("pos <= 10")


@C.query(
    f"""{U_ALL}, y0 AS (SELECT sample_id, feature, value, (label <> 0)::INTEGER AS y FROM x),
kept AS (SELECT feature FROM u WHERE task = 'ovr_0' ORDER BY round(z, 9) DESC, feature DESC LIMIT 30),
xk AS (SELECT * FROM y0 WHERE feature IN (SELECT feature FROM kept)),
pr AS (SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM xk a JOIN xk b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY a.feature, b.feature),
c AS (SELECT feature, corr(value, y) AS r FROM xk GROUP BY feature HAVING abs(corr(value, y)) >= 0.02),
losers AS (SELECT CASE WHEN abs(ca.r) > abs(cb.r) THEN cb.feature ELSE ca.feature END AS feature FROM pr JOIN c ca ON ca.feature = pr.a JOIN c cb ON cb.feature = pr.b WHERE abs(pr.r) > 0.08)
SELECT feature, round(r, 9) AS r, row_number() OVER (ORDER BY round(abs(r), 9) DESC, feature)::INTEGER AS pos FROM c WHERE feature NOT IN (SELECT feature FROM losers) QUALIFY pos <= 10"""
)
def chain_mw_then_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank-sum test keeps 30 features, and of those the correlation rule keeps 10."""
    z = _u_all(spark, sf_dir).where("task = 'ovr_0'").select("feature", _r("z"))
    kept = kernels.best_first(z, [], "z").where("pos <= 30").select("feature")
    rows = _binary(spark, sf_dir).join(F.broadcast(kept), "feature", "left_semi")
    return kernels.correlation_select(rows, "y", 0.02, 0.08, 10).select("feature", _r("r"), "pos")


@C.query(
    f"""{U_SPLIT}, s AS (SELECT *, exp(log_p) AS p FROM u), b AS (SELECT *, CASE WHEN p <= 0.05::DOUBLE * row_number() OVER (PARTITION BY split, task ORDER BY p, feature) / count(*) OVER (PARTITION BY split, task) THEN p END AS under FROM s),
c AS (SELECT split, task, p, coalesce(p <= max(under) OVER (PARTITION BY split, task), false) AS passes FROM b)
SELECT split, task, round(avg(passes::INTEGER), 9) AS bh_share, round(avg((p < 0.05)::INTEGER), 9) AS nominal_share FROM c GROUP BY split, task"""
)
def bh_share_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of features that pass the rank-sum test on each training part, with and without correction."""
    p = kernels.benjamini_hochberg(_u_split(spark, sf_dir).withColumn("p", F.exp("log_p")), ["split", "task"], "p", 0.05)
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    return p.groupBy("split", "task").agg(share(F.col("selected")).alias("bh_share"), share(F.col("p") < 0.05).alias("nominal_share"))
