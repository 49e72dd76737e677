from __future__ import annotations

import numpy as np
import pytest

from colsieve.functions import columns, solvers
from colsieve.operators import selectors as s
from tests.fixtures import frame, planted

CONFIGURED = [
    s.VarianceThreshold(), s.ANOVAFSelector(n_features=5), s.ANOVAFSelector(), s.PercentileSelector(20), s.FDRSelector(), s.FWESelector(), s.MannWhitneySelector(5),
    s.HigherCriticismSelector(), s.HigherCriticismSelector("2004"), s.BerkJonesSelector(), s.CorrelationSelector(5), s.CorrelationSelector(5, method="spearman"), s.CorrelationSelector(5, method="kendall"), s.MutualInfoSelector(5), s.RandomSelector(5),
    s.LassoSelector(5), s.TreeImportanceSelector(5, n_estimators=20), s.RFESelector(5), s.RFECVSelector(), s.SequentialSelector(3, solver="newton"),
]
NAMES = [f"{type(x).__name__}{i}" for i, x in enumerate(CONFIGURED)]


@pytest.mark.parametrize("selector", CONFIGURED, ids=NAMES)
def test_api(selector):
    x, y = planted()
    fresh = selector.clone()
    assert fresh.get_params() == selector.get_params()
    with pytest.raises(s.NotFitted):
        fresh.transform(x)
    kept = fresh.fit_transform(x, y)
    assert kept.shape == (len(x), fresh.support_.sum())
    assert fresh.support_.dtype == bool and fresh.support_.any()
    assert (fresh.get_support(indices=True) == np.flatnonzero(fresh.support_)).all()
    assert len(fresh.get_feature_names_out()) == fresh.support_.sum()
    again = selector.clone().fit(x, y)
    assert (again.support_ == fresh.support_).all()
    if hasattr(fresh, "ranking") and fresh.rank_once and not isinstance(fresh, s.RFESelector):
        fewer = selector.clone().set_params(n_features=3).fit(x, y)
        assert (np.sort(fresh.ranking()[:3]) == fewer.get_support(indices=True)).all()
    if not isinstance(fresh, (s.VarianceThreshold, s.RandomSelector)):
        assert fresh.support_[:5].sum() >= 1
        with pytest.raises(ValueError):
            selector.clone().fit(x)
    if getattr(fresh, "check_input", False):
        bad = x.copy()
        bad[0, 0] = np.nan
        with pytest.raises(ValueError):
            selector.clone().fit(bad, y)


FRAMES = [x for x in CONFIGURED if not isinstance(x, (s.RandomSelector, s.TreeImportanceSelector, s.RFECVSelector, s.SequentialSelector, s.MutualInfoSelector))]


@pytest.mark.parametrize("selector", FRAMES, ids=[type(x).__name__ for x in FRAMES])
def test_frame_equals_memory(spark, selector):
    x, y = planted(60, 12)
    in_memory = selector.clone().fit(x, y)
    on_spark = selector.clone().fit(frame(spark, x, y))
    assert (in_memory.support_ == on_spark.support_).all()
    short = on_spark.transform(frame(spark, x, y)).first()["features"]
    assert len(short) == on_spark.support_.sum()


def test_mutual_information_frame_finds_signal(spark):
    x, y = planted(80, 20, informative=3, shift=2.5)
    got = s.MutualInfoSelector(3).fit(frame(spark, x, y)).get_support(indices=True)
    assert set(got) == {0, 1, 2}


def test_registry():
    assert s.Selector.lookup("mannwhitneyselector") is s.MannWhitneySelector
    assert s.Selector.create("MANN_WHITNEY", n_features=3).n_features == 3
    with pytest.raises(ValueError, match="Available"):
        s.Selector.lookup("nothing")
    with pytest.raises(ValueError, match="belongs"):
        type("Other", (s.Selector,), {}, aliases=["anova"])
    with pytest.raises(TypeError):
        s.Selector.create("anova", no_such=1)
    with pytest.raises(TypeError):
        s.RandomSelector(3, random_state=None)


def test_empty_selections_raise():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 10)), np.arange(40) % 2
    for selector in (s.FDRSelector(1e-6), s.FWESelector(1e-6), s.CorrelationSelector(3, target_threshold=0.99), s.LassoSelector(C=1e-6), s.VarianceThreshold(100)):
        with pytest.raises(ValueError):
            selector.fit(x, y)
    with pytest.raises(ValueError):
        s.MannWhitneySelector(3).fit(x, np.arange(40) % 3)


def test_constant_columns():
    x, y = planted(60, 8)
    x[:, 7] = 3.0
    assert not s.VarianceThreshold().fit(x).support_[7]
    anova = s.ANOVAFSelector(n_features=2).fit(x, y)
    assert anova.scores_[7] == 0 and anova.pvalues_[7] == 1
    u = s.MannWhitneySelector(2).fit(x, y)
    assert u.log_pvalues_[7] == 0 and u.auc_[7] == 0.5


def test_monotone_transform_keeps_the_rank_test():
    x, y = planted(80, 15)
    a = s.MannWhitneySelector(5).fit(x, y)
    b = s.MannWhitneySelector(5).fit(np.exp(x), y)
    assert (a.support_ == b.support_).all() and np.allclose(a.log_pvalues_, b.log_pvalues_)
    assert (s.FWESelector(0.2).fit(x, y).support_ <= s.FDRSelector(0.2).fit(x, y).support_).all()


def test_redundant_columns_drop_the_lower_of_equals():
    x, y = planted(100, 6, informative=2)
    x[:, 5] = x[:, 0]
    kept = s.CorrelationSelector(inter_feature_threshold=0.95, target_threshold=0.2).fit(x, y)
    assert not kept.support_[0] and kept.support_[5]


def test_mutual_information_against_brute_force():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 4)).round(2) + rng.normal(size=(40, 4)) * 1e-6, np.arange(40) % 3
    got = columns.mutual_information(x, y)
    h = np.concatenate([[0], np.cumsum(1 / np.arange(1, 100))])
    for j in range(4):
        total = 0.0
        for i in range(40):
            d = np.abs(x[:, j] - x[i, j])
            own = np.sort(d[(y == y[i]) & (np.arange(40) != i)])
            m = (d < own[2]).sum()
            total += h[39] + h[2] - h[(y == y[i]).sum() - 1] - h[m - 1]
        assert got[j] == pytest.approx(max(0, total / 40), abs=1e-9)


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_lasso_is_optimal(c):
    x, y = planted(80, 40, shift=0.8)
    sign = np.where(y == 1, 1.0, -1.0)
    w, b, residual = solvers.lasso_logistic(x, sign, c)
    assert residual < 1e-6
    margin = sign * (x @ w + b)
    g = -c * (np.c_[x, np.ones(80)]).T @ (sign / (1 + np.exp(margin)))
    v = np.r_[w, b]
    assert np.where(v != 0, np.abs(g + np.sign(v)), np.maximum(np.abs(g) - 1, 0)).max() < 1e-6


@pytest.mark.parametrize("c", [0.01, 0.1, 1.0])
def test_svm_and_logistic_are_optimal(c):
    x, y = planted(60, 100, shift=0.3)
    sign = np.where(y == 1, 1.0, -1.0)
    w, b = solvers.squared_hinge(x, sign, c)
    slack = np.maximum(0, 1 - sign * (x @ w + b))
    assert np.abs(np.r_[w, b] - 2 * c * np.c_[x, np.ones(60)].T @ (sign * slack)).max() < 1e-7
    w, b = solvers.logistic_l2(x, sign, c)
    pull = sign / (1 + np.exp(sign * (x @ w + b)))
    assert np.abs(w - c * x.T @ pull).max() < 1e-6 and abs(c * pull.sum()) < 1e-6


def test_search_and_fixed():
    x, y = planted(100, 20)
    lasso = s.LassoSelector(Cs=[1.0, 0.05, 0.3]).fit(x, y)
    assert lasso.searches() and lasso.C_ in (0.05, 0.3, 1.0)
    assert (lasso.fixed().fit(x, y).support_ == lasso.support_).all() and not lasso.fixed().searches()
    rfecv = s.RFECVSelector(step=2).fit(x, y)
    assert (rfecv.fixed().fit(x, y).support_ == rfecv.support_).all()
    assert rfecv.cv_results_["n_features"][0] == 1


def test_backward_and_multiclass():
    x, y = planted(90, 8, classes=3, shift=1.5)
    assert s.SequentialSelector(3, direction="backward", cv=3).fit(x, y).support_.sum() == 3
    assert s.LassoSelector(4).fit(x, y).coef_.shape == (3, 8)
    assert s.RFESelector(4, step=3).fit(x, y).ranking_.max() == 3
