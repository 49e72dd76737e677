"""Selectors by a statistic of each feature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.functions import columns
from colsieve.functions.special import log_beta_cdf, log_f_sf, log_norm_sf
from colsieve.operators import kernels
from colsieve.operators.selectors.base import Filter, NothingKept, Seeded, Selector, binary_long
from colsieve.sources.layouts import to_long


class VarianceThreshold(Filter, aliases=["variance"]):
    """Keeps features whose population variance exceeds ``threshold``; at 0 the spread counts too, so that rounding keeps no constant."""

    needs_y = False

    def __init__(self, threshold: float = 0.0, device: str = "auto", check_input: bool = True):
        self.threshold, self.device, self.check_input = threshold, device, check_input

    def _measure(self, X, y) -> None:  # noqa: ANN001, N803
        self.variances_, self._spread = columns.variances(X)

    def _table(self, matrix: DataFrame) -> None:
        self.variances_, self._spread = self._columns(kernels.variances(to_long(matrix), []), "variance", "spread")

    def _choose(self) -> None:
        if self.threshold == 0:
            self.variances_ = np.minimum(self.variances_, self._spread)
        self.support_ = self.variances_ > self.threshold
        if not self.support_.any():
            raise ValueError(f"no feature has a variance over {self.threshold}")


class _ByF(Filter, register=False):
    def _task(self) -> str:
        if self.task not in ("classification", "regression"):
            raise ValueError(f"task must be 'classification' or 'regression', got '{self.task}'")
        return self.task

    def _measure(self, X, y) -> None:  # noqa: ANN001, N803
        of = columns.f_classification if self._task() == "classification" else columns.f_regression
        self.scores_, log_p = of(X, y)
        self.pvalues_ = np.exp(log_p)

    def _table(self, matrix: DataFrame) -> None:
        long = to_long(matrix)
        if self._task() == "classification":
            f, d1, d2 = self._columns(kernels.anova_f(kernels.class_sums(long, []), []), "f", "df1", "df2")
            log_p = np.where(np.isnan(f), np.nan, log_f_sf(np.nan_to_num(f), d1, d2))
        else:
            rows = long.withColumn("label", F.col("label").cast("double"))
            (f,) = self._columns(kernels.f_regression(rows, [], "label"), "f")
            log_p = log_f_sf(f, 1, matrix.count() - 2)
        self.scores_, self.pvalues_ = f, np.exp(log_p)


class ANOVAFSelector(_ByF, aliases=["anova"]):
    """The ``n_features`` with the largest F, or all with p under ``alpha``. A constant feature has F 0 and p 1."""

    rank_once = True

    def __init__(self, n_features: int | None = None, alpha: float = 0.05, task: str = "classification", device: str = "auto", check_input: bool = True):
        self.n_features, self.alpha, self.task, self.device, self.check_input = n_features, alpha, task, device, check_input

    def _choose(self) -> None:
        self.scores_, self.pvalues_ = np.nan_to_num(self.scores_, nan=0.0), np.nan_to_num(self.pvalues_, nan=1.0)
        self.support_ = self.pvalues_ < self.alpha if self.n_features is None else self._mask(self.ranking()[: self.n_features])

    def ranking(self) -> np.ndarray:
        return self._best_first(self.scores_)


class PercentileSelector(_ByF):
    """Features over the interpolated percentile of F, then ties at it in order, up to the count."""

    def __init__(self, percentile: float = 10, task: str = "classification", device: str = "auto", check_input: bool = True):
        self.percentile, self.task, self.device, self.check_input = percentile, task, device, check_input

    def _choose(self) -> None:
        n = len(self.scores_)
        if self.percentile in (0, 100):
            self.support_ = np.full(n, self.percentile == 100)
            return
        s = np.nan_to_num(self.scores_, nan=np.finfo("f8").min)
        cut = np.percentile(s, 100 - self.percentile)
        self.support_ = s > cut
        room = int(n * self.percentile / 100) - int(self.support_.sum())
        self.support_[np.flatnonzero(s == cut)[: max(room, 0)]] = True


class FDRSelector(_ByF):
    """Benjamini-Hochberg at ``alpha``."""

    def __init__(self, alpha: float = 0.05, task: str = "classification", device: str = "auto", check_input: bool = True):
        self.alpha, self.task, self.device, self.check_input = alpha, task, device, check_input

    def _choose(self) -> None:
        p = np.sort(self.pvalues_[~np.isnan(self.pvalues_)])
        under = p[p <= self.alpha * np.arange(1, len(p) + 1) / len(self.pvalues_)]
        if not len(under):
            raise NothingKept(f"no feature passes a false discovery rate of {self.alpha}")
        self.support_ = self.pvalues_ <= under[-1]


class FWESelector(_ByF):
    """Bonferroni at ``alpha``."""

    def __init__(self, alpha: float = 0.05, task: str = "classification", device: str = "auto", check_input: bool = True):
        self.alpha, self.task, self.device, self.check_input = alpha, task, device, check_input

    def _choose(self) -> None:
        self.support_ = self.pvalues_ < self.alpha / len(self.pvalues_)
        if not self.support_.any():
            raise ValueError(f"no feature passes a family-wise error rate of {self.alpha}")


class _ByRank(Filter, register=False):
    def _measure(self, X, y) -> None:  # noqa: ANN001, N803
        self.z_, self.log_pvalues_, self.auc_ = columns.rank_sum(X, y)

    def _table(self, matrix: DataFrame) -> None:
        long, tasks = binary_long(matrix, type(self).__name__)
        self.z_, self.auc_ = self._columns(kernels.u_test(kernels.rank_sums(long, []), tasks, []), "z", "auc")
        self.log_pvalues_ = np.where(self.z_ > 0, np.minimum(np.log(2) + log_norm_sf(np.maximum(self.z_, 0)), 0.0), 0.0)


class MannWhitneySelector(_ByRank, aliases=["mann_whitney", "wilcoxon"]):
    """The ``n_features`` with the smallest p of the rank-sum test."""

    rank_once = True

    def __init__(self, n_features: int | None = None, device: str = "auto", check_input: bool = True):
        self.n_features, self.device, self.check_input = n_features, device, check_input

    def fit(self, X, y=None) -> Selector:  # noqa: ANN001, N803
        self._need_n()
        return super().fit(X, y)

    def _choose(self) -> None:
        self.support_ = self._mask(self.ranking()[: self.n_features])

    def ranking(self) -> np.ndarray:
        return self._best_first(-self.log_pvalues_)


class _ByExceedance(_ByRank, register=False):
    """Looks for the rank, of the first ``alpha0`` of all, whose p is the most surprising as the i-th smallest, and keeps every p up to it."""

    def _surprise(self, rank: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Columns to compare ranks by, the most important first; larger is more surprising."""
        raise NotImplementedError

    def _choose(self) -> None:
        in_order = np.sort(self.log_pvalues_)
        log_p = in_order[: max(1, int(self.alpha0 * len(in_order)))]
        rank = np.arange(1, len(log_p) + 1)
        keys = self._surprise(rank, log_p)
        best = np.lexsort((-rank, *reversed(keys)))[-1]  # the first rank among equals
        self.support_ = self.log_pvalues_ <= log_p[best]


class HigherCriticismSelector(_ByExceedance):
    """Features up to the p that is most surprisingly small for its rank, among the first ``alpha0`` of ranks.

    Rank i of n expects p at i / (n + 1) with the variance of a share, q (1 - q), q being that expectation (2008); or at
    i / n, with q = p itself (2004). Standardised distances are compared by their side and logarithm, which hold for any p.
    """

    def __init__(self, variant: str = "2008", alpha0: float = 0.1, device: str = "auto", check_input: bool = True):
        self.variant, self.alpha0, self.device, self.check_input = variant, alpha0, device, check_input

    def _surprise(self, rank: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        if self.variant not in ("2004", "2008"):
            raise ValueError(f"there are the variants '2004' and '2008', not '{self.variant}'")
        n = self.n_features_in_
        expected = rank / (n + (self.variant == "2008"))
        log_q = np.log(expected) if self.variant == "2008" else log_p
        distance = expected - np.exp(log_p)
        with np.errstate(divide="ignore"):
            log_sd = (log_q + np.log1p(-np.minimum(np.exp(log_q), 1.0))) / 2
            size = np.log(np.abs(distance))
        side = np.sign(distance)
        flat = (side == 0) & np.isneginf(log_sd)  # no distance over no spread says nothing
        away = np.where(side == 0, 0.0, side * (np.where(side == 0, 0.0, size) - np.where(side == 0, 0.0, log_sd)))
        return np.stack([np.where(flat, -2.0, side), away])


class BerkJonesSelector(_ByExceedance):
    """Features up to the rank i whose p is least likely as the i-th smallest of uniform ones, which has a Beta(i, n - i + 1) distribution."""

    def __init__(self, alpha0: float = 0.1, device: str = "auto", check_input: bool = True):
        self.alpha0, self.device, self.check_input = alpha0, device, check_input

    def _surprise(self, rank: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        self.log_scores_ = log_beta_cdf(log_p, rank.astype("f8"), self.n_features_in_ + 1.0 - rank)
        return -self.log_scores_[None, :]


class CorrelationSelector(Filter, aliases=["correlation"]):
    """Features correlated with the target, without those of redundant pairs, the most correlated first.

    Of a pair over ``inter_feature_threshold`` the one less correlated with the target goes, the lower one among
    equals. ``method`` is pearson, spearman or kendall.
    """

    rank_once = True

    def __init__(self, n_features: int | None = None, target_threshold: float = 0.1, inter_feature_threshold: float = 0.95, method: str = "pearson", device: str = "auto", check_input: bool = True):
        self.n_features, self.target_threshold, self.inter_feature_threshold, self.method, self.device, self.check_input = n_features, target_threshold, inter_feature_threshold, method, device, check_input

    def _fit_frame(self, matrix: DataFrame) -> Selector:
        """Kendall's pairs of samples are a solver's work, in one task; the others are plans."""
        return Selector._fit_frame(self, matrix) if self.method == "kendall" else super()._fit_frame(matrix)

    def _method(self) -> None:
        if self.method not in ("pearson", "spearman", "kendall"):
            raise ValueError(f"method must be 'pearson', 'spearman' or 'kendall', got '{self.method}'")

    def _measure(self, X, y) -> None:  # noqa: ANN001, N803
        self._method()
        if not np.issubdtype(np.asarray(y).dtype, np.number):
            classes = np.unique(y)
            if len(classes) != 2:
                raise ValueError(f"a target that isn't a number needs exactly two classes, got {len(classes)}")
            y = y == classes[1]
        y = np.asarray(y, "f8")
        if self.method == "spearman":
            X, y = columns.average_ranks(X)[0], columns.average_ranks(y[:, None])[0][:, 0]  # noqa: N806
        self.target_corr_ = np.nan_to_num(np.abs(columns.kendall(X, y) if self.method == "kendall" else columns.correlation(X, y)))
        at = np.flatnonzero(self.target_corr_ >= self.target_threshold)
        self._pairs = []
        if self.method == "kendall":
            for a, i in enumerate(at):
                tau = np.abs(columns.kendall(X[:, at[a + 1 :]], X[:, i]))
                self._pairs += [(i, j) for j in at[a + 1 :][tau > self.inter_feature_threshold]]
            return
        z = X[:, at] - X[:, at].mean(0)
        z = z / np.sqrt((z * z).sum(0))
        for start in range(0, len(at), 1024):  # in blocks, so that the full square never exists
            r = np.abs(z[:, start : start + 1024].T @ z)
            i, j = np.nonzero(r > self.inter_feature_threshold)
            self._pairs += [(at[start + a], at[b]) for a, b in zip(i, j, strict=True) if start + a < b]

    def _table(self, matrix: DataFrame) -> None:
        self._method()
        kind = dict(matrix.dtypes)["label"]
        long = to_long(matrix)
        if kind == "string":
            long, tasks = binary_long(matrix, type(self).__name__)
            high = tasks.first()["positive"]
            long = long.withColumn("_y", (F.col("label") == high).cast("double"))
        else:
            long = long.withColumn("_y", F.col("label").cast("double"))
        if self.method == "spearman":
            y = long.select("sample_id", F.lit(0).alias("feature"), F.col("_y").alias("value")).distinct()
            y = kernels.to_ranks(y, []).select("sample_id", F.col("value").alias("_y"))
            long = kernels.to_ranks(long.drop("_y"), []).join(y, "sample_id")
        (r,) = self._columns(kernels.correlations(long, [], "_y"), "r")
        self.target_corr_ = np.abs(np.nan_to_num(r))
        kept = [int(i) for i in np.flatnonzero(self.target_corr_ >= self.target_threshold)]
        few = matrix.sparkSession.createDataFrame([(i,) for i in kept], "feature int")
        rows = long.join(F.broadcast(few), "feature", "left_semi")
        self._pairs = [(p["a"], p["b"]) for p in kernels.close_pairs(rows, self.inter_feature_threshold).select("a", "b").collect()]

    def _choose(self) -> None:
        if not (self.target_corr_ >= self.target_threshold).any():
            raise NothingKept(f"no feature has a correlation of {self.target_threshold} with the target")
        t = self.target_corr_
        gone = {j if t[i] > t[j] else i for i, j in self._pairs}
        self._kept = np.array([i for i in np.flatnonzero(t >= self.target_threshold) if i not in gone], dtype=int)
        self.support_ = self._mask(self.ranking()[: self.n_features])

    def ranking(self) -> np.ndarray:
        return self._kept[np.argsort(-self.target_corr_[self._kept], kind="stable")]


class MutualInfoSelector(Filter, Seeded, aliases=["mutual_info"]):
    """The ``n_features`` with the most mutual information with the target, by nearest neighbours.

    Features are scaled to unit deviation and get noise of 1e-10, which parts tied values.
    """

    rank_once = True

    def __init__(self, n_features: int | None = None, task: str = "classification", n_neighbors: int = 3, random_state: int = 42, device: str = "auto", check_input: bool = True):
        Seeded.__init__(self, random_state)
        self.n_features, self.task, self.n_neighbors, self.device, self.check_input = n_features, task, n_neighbors, device, check_input

    def fit(self, X, y=None) -> Selector:  # noqa: ANN001, N803
        self._need_n()
        if self.task not in ("classification", "regression"):
            raise ValueError(f"task must be 'classification' or 'regression', got '{self.task}'")
        return super().fit(X, y)

    def _measure(self, X, y) -> None:  # noqa: ANN001, N803
        scale = X.std(0)
        X = X / np.where(scale > 0, scale, 1)  # noqa: N806
        noise = np.random.RandomState(self.random_state).standard_normal(X.shape)
        X = X + 1e-10 * np.maximum(1, np.abs(X).mean(0)) * noise  # noqa: N806
        self.scores_ = columns.mutual_information(X, y, self.n_neighbors) if self.task == "classification" else columns.mutual_information_regression(X, y, self.n_neighbors)

    def _table(self, matrix: DataFrame) -> None:
        """Columns go to tasks in blocks of features, each sorted there; nothing is joined."""
        import pandas as pd

        me = {"k": self.n_neighbors, "seed": self.random_state, "task": self.task}

        def measure(key, part):  # noqa: ANN001, ANN202
            wide = part.pivot(index="sample_id", columns="feature", values="value").sort_index()
            y = part.drop_duplicates("sample_id").set_index("sample_id")["label"].reindex(wide.index).to_numpy()
            x = wide.to_numpy("f8")
            sd = x.std(0)
            x = x / np.where(sd > 0, sd, 1)
            x = x + 1e-10 * np.maximum(1, np.abs(x).mean(0)) * np.random.RandomState(me["seed"] + int(key[0])).standard_normal(x.shape)
            of = columns.mutual_information if me["task"] == "classification" else columns.mutual_information_regression
            return pd.DataFrame({"feature": wide.columns.to_numpy(), "mi": of(x, y, me["k"])})

        long = to_long(matrix).withColumn("_block", F.floor(F.col("feature") / 16))
        (self.scores_,) = self._columns(long.groupBy("_block").applyInPandas(measure, "feature int, mi double"), "mi")

    def _choose(self) -> None:
        self.support_ = self._mask(self.ranking()[: self.n_features])

    def ranking(self) -> np.ndarray:
        return self._best_first(self.scores_)


class RandomSelector(Seeded, aliases=["random"]):
    """``n_features`` drawn without replacement; looks at neither values nor target."""

    needs_y = False

    def __init__(self, n_features: int | None = None, random_state: int = 42, device: str = "auto", check_input: bool = True):
        super().__init__(random_state)
        self.n_features, self.device, self.check_input = n_features, device, check_input

    def fit(self, X, y=None) -> Selector:  # noqa: ANN001, N803
        self._need_n()
        return super().fit(X, y)

    def _draw(self) -> None:
        p = self.n_features_in_
        self.support_ = self._mask(self._rng().choice(p, size=min(self.n_features, p), replace=False))

    def _fit(self, X, y) -> None:  # noqa: ANN001, N803
        self._draw()

    def _fit_frame(self, matrix: DataFrame) -> Selector:
        self.n_features_in_ = matrix.agg(F.max(F.size("features"))).first()[0]
        self._draw()
        return self
