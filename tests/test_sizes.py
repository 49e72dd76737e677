"""Queries on tables that the given ones don't stand for: without any signal, with copies, or too large for the plain way."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import duckdb
import numpy as np
import pytest

from colsieve.functions import solvers, special
from colsieve.operators import models, runner
from colsieve.operators import selectors as sel
from colsieve.plans import catalogue
from tests.fixtures import frame, planted
from tests.test_queries import rows


def table(spark, path, vectors, labels) -> str:
    """A folder with a table of embeddings."""
    found = [(i, [float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(vectors, labels, strict=True))]
    spark.createDataFrame(found, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{path}/embeddings.parquet")
    return str(path)


def twin(spark, name: str, sf_dir: str) -> tuple[list, list]:
    """What the query gives and what its SQL gives."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet/*.parquet'")
    ours, theirs = catalogue.QUERIES[name](spark, sf_dir), con.sql(catalogue.ORACLES[name])
    return rows(ours.columns, [tuple(r) for r in ours.collect()]), rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", ["fit_correlation", "fit_fdr"])
def test_no_feature_passes(spark, tmp_path, name):
    """Each vector once with either label, so that no feature says anything of it."""
    x = np.random.default_rng(0).normal(size=(30, 6))
    ours, theirs = twin(spark, name, table(spark, tmp_path, np.r_[x, x], np.repeat([0, 1], 30)))
    assert ours == theirs and len(ours) == 6


@pytest.mark.parametrize("f", [0.0010253, 0.5, 4.0, 35.0, 150.0])
def test_log_p_of_f_with_many_rows(f):
    """To what 7 digits need in hundreds of rows, by the finite series for an even number of degrees of freedom, in 60 digits."""
    df = 102562
    with localcontext() as digits:
        digits.prec = 60
        square = Decimal(df) / (Decimal(df) + Decimal(f))
        term = total = Decimal(1)
        for i in range(1, df // 2):
            term *= square * (2 * i - 1) / (2 * i)
            total += term
        exact = float((1 - (1 - square).sqrt() * total).ln())
    assert special.log_f_sf(f, 1, df) == pytest.approx(exact, rel=0, abs=1e-11)


def test_log_beta_of_small_and_large():
    for a, b in ((1, 1), (3, 7), (1, 19), (1, 20), (30, 45), (3, 4000), (500, 700)):
        exact = math.log(math.factorial(a + b - 1) // math.factorial(a - 1) // math.factorial(b - 1))  # 1 / B(a, b), a whole number
        assert special._log_beta(a, b) == pytest.approx(-exact, rel=1e-13, abs=1e-13)


def test_forest_has_a_task_for_each_tree(spark):
    x, y = planted(90, 8, informative=3, classes=3)
    x[:, 5], x[:, 6] = 1.0, x[:, 6].round()
    sc = spark.sparkContext
    sc.setJobGroup("forest", "trees")
    fitted = sel.TreeImportanceSelector(3, n_estimators=7, random_state=5).fit(frame(spark, x, y))
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("forest") for s in tracker.getJobInfo(j).stageIds]
    sc.setJobGroup("tests", "")
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) == 7
    plain = sel.TreeImportanceSelector(3, n_estimators=7, random_state=5).fit(x, y)
    assert (fitted.feature_importances_ == plain.feature_importances_).all() and plain.feature_importances_[5] == 0


def test_nearest_in_blocks(spark, tmp_path, monkeypatch):
    """Several blocks a side, many copies, and no row for a pair in the plan."""
    monkeypatch.setattr(models, "KNN_BLOCK", 20)
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(100, 4)), np.repeat(rng.normal(size=(2, 4)), 30, axis=0), rng.integers(0, 2, size=(60, 4))]
    sf = table(spark, tmp_path, x[rng.permutation(len(x))], rng.integers(0, 3, len(x)))
    ours, theirs = twin(spark, "knn_predict", sf)
    assert ours == theirs and len(ours) == 73
    plan = catalogue.QUERIES["knn_predict"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("n", [60, 400, 3000])
def test_logistic_without_rows(n):
    x, y = planted(n, 4, informative=2)
    sign = np.where(y == 1, 1.0, -1.0)
    without = np.stack([np.arange(12), np.arange(12) + 20], axis=1)
    for c in (0.01, 10.0):
        got = solvers.LogisticWithout(x, sign, c).weights(without)
        exact = (solvers.logistic_l2(np.delete(x, rows, axis=0), np.delete(sign, rows), c) for rows in without)
        assert np.abs(got - np.stack([np.r_[w, b] for w, b in exact])).max() < 2e-9


def test_leave_one_out_fits_each_c_once(monkeypatch):
    """Of many rows; 31 * 30 * 4 fits and more before."""
    x, y = planted(3100, 4, informative=2, shift=3.0)
    fits = []
    plain = solvers.logistic_l2
    monkeypatch.setattr(solvers, "logistic_l2", lambda *a: fits.append(a) or plain(*a))
    m = runner.loo_confusion(x, y, alpha=0.01)
    assert m.sum() == 31 and np.trace(m) >= 29 and len(fits) == 4


def test_leave_one_out_of_wide_matrix():
    x, y = planted(40, 12, informative=3, shift=3.0)
    m = runner.loo_confusion(x, y, alpha=0.1)
    assert m.sum() == 4 and np.trace(m) == 4
