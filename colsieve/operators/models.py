"""Classifiers as NumPy kernels, one fit for each cell of a grid, and nearest neighbours as a join.

``MODELS`` maps a name to a class with ``fit(X, y)``, ``predict(X)`` and ``score(X)`` (the larger, the likelier the
second of the sorted classes, for two classes). Add a line to extend.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colsieve.functions import solvers


class Classifier:
    """Two classes or one against the rest for more; parameters are checked, as a misspelled one must not pass."""

    defaults: dict = {}

    def __init__(self, **params):  # noqa: ANN003
        unknown = set(params) - set(self.defaults) - {"random_state"}
        if unknown:
            raise TypeError(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        self.params = {"random_state": 42, **self.defaults, **params}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Classifier:
        self.classes_ = np.unique(y)
        x = np.asarray(x, dtype="f8")
        if len(self.classes_) == 2:
            self.models_ = [self.fit_binary(x, np.where(y == self.classes_[1], 1.0, -1.0))]
        else:
            self.models_ = [self.fit_binary(x, np.where(y == c, 1.0, -1.0)) for c in self.classes_]
        return self

    def fit_binary(self, x: np.ndarray, sign: np.ndarray):  # noqa: ANN201
        raise NotImplementedError

    def decision(self, model, x: np.ndarray) -> np.ndarray:  # noqa: ANN001
        w, b = model
        return x @ w + b

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype="f8")
        return np.stack([self.decision(m, x) for m in self.models_], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x)[:, 0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        return self.classes_[(s[:, 0] > 0).astype(int)] if len(self.classes_) == 2 else self.classes_[s.argmax(1)]


class Logistic(Classifier):
    """L2 penalty, free intercept."""

    defaults = {"C": 1.0, "max_iter": 100}

    def fit_binary(self, x: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, float]:
        return solvers.logistic_l2(x, sign, self.params["C"], self.params["max_iter"])


class LinearSvm(Classifier):
    """Squared hinge, penalised bias."""

    defaults = {"C": 1.0, "max_iter": 1000}

    def fit_binary(self, x: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, float]:
        return solvers.squared_hinge(x, sign, self.params["C"], self.params["max_iter"])


class Lda(Classifier):
    """Least squares with the Ledoit-Wolf shrunk covariance, for any number of classes."""

    defaults = {"solver": "lsqr", "shrinkage": "auto"}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Lda:
        self.classes_ = np.unique(y)
        self.coef_, self.intercept_ = solvers.shrunk_lda(np.asarray(x, dtype="f8"), y, self.classes_)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = np.asarray(x, dtype="f8") @ self.coef_.T + self.intercept_
        return s[:, 1:] - s[:, :1] if len(self.classes_) == 2 else s


class Knn(Classifier):
    """Five neighbours, Euclidean; the smaller class among equal votes."""

    defaults = {"n_neighbors": 5}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Knn:
        self.classes_, self.y_ = np.unique(y, return_inverse=True)
        self.x_ = np.asarray(x, dtype="f8")
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype="f8")
        k = min(self.params["n_neighbors"], len(self.x_))
        d = (x * x).sum(1)[:, None] - 2 * x @ self.x_.T + (self.x_ * self.x_).sum(1)[None, :]
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        votes = np.stack([(self.y_[near] == c).mean(1) for c in range(len(self.classes_))], axis=1)
        return votes[:, 1:] - 0.5 if len(self.classes_) == 2 else votes


class Forest(Classifier):
    """Fully grown trees on bootstrap samples, the root of the feature count tried at each node."""

    defaults = {"n_estimators": 100, "max_depth": None, "n_jobs": 1}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.classes_, code = np.unique(y, return_inverse=True)
        self.forest_ = solvers.Forest(self.params["n_estimators"], self.params["max_depth"], self.params["random_state"]).fit(np.asarray(x, dtype="f8"), code)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        p = self.forest_.predict(np.asarray(x, dtype="f8"))
        return p[:, 1:] - 0.5 if len(self.classes_) == 2 else p


MODELS = {"logistic_regression": Logistic, "linear_svm": LinearSvm, "random_forest": Forest, "knn": Knn, "lda": Lda}


def create(name: str, **params) -> Classifier:  # noqa: ANN003
    if name not in MODELS:
        raise ValueError(f"Unknown model '{name}'. Available: {', '.join(sorted(MODELS))}")
    return MODELS[name](**params)


#: Rows to a block of training rows and of queries; a task multiplies one with the other.
KNN_BLOCK = 8192


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, squared distance)`` of rows that may be among a query's k nearest, by distances rounded to 9 digits and ids.

    Products find those up to the k-th distance and what rounding and their own error may move; these are then summed
    component by component, as the plan of one pair would. Of rows just as far, the k with the smallest ids are enough.
    """
    size, out = (x * x).sum(1), []
    for start in range(0, len(q), 256):
        part = q[start : start + 256]
        own = (part * part).sum(1)
        d = own[:, None] + size[None, :] - 2 * part @ x.T
        slack = 2e-9 + 1e-14 * x.shape[1] * (own + size.max())
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack if len(x) > k else np.full(len(part), np.inf)
        i, j = np.nonzero(d <= limit[:, None])
        exact = np.zeros(len(i))
        for c in range(x.shape[1]):
            exact += (x[j, c] - part[i, c]) ** 2
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        new = np.r_[True, (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])] if len(i) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        out.append((i[place < k] + start, j[place < k], exact[place < k]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def knn_votes(train: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(sample_id, y_true, y_pred, score)`` by the k nearest training rows; the smaller id, then class, among equals.

    Both are wide. Rows lie in blocks by a hash of their ids; a task holds a block of training rows and one of queries,
    multiplies them, and gives each query's nearest there, so a pair of rows is never a row of a plan. Distances are
    rounded so that engines agree on ties. Vectors have one length and finite components; any others go pair by pair.
    """
    both = train.select(F.lit(True).alias("_train"), "sample_id", "features").unionAll(queries.select(F.lit(False), "sample_id", "features"))
    odd = F.col("features").isNull() | F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    about = both.agg(F.count_if("_train"), F.count_if(~F.col("_train")), F.min(F.size("features")), F.max(F.size("features")), F.count_if(odd)).first()
    if about[4] or about[2] != about[3]:
        return _votes(_pair_by_pair(train, queries), k)
    n_train, n_queries = (max(1, -(-n // KNN_BLOCK)) for n in about[:2])
    # both sides may come from one table: with names of their own they stay apart in a cogroup
    side = lambda rows, names, own, n, other, m: rows.select(*[F.col(c).alias(names[c]) for c in names], F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    t, q = side(train, {"sample_id": "_t", "features": "_x", "label": "_l"}, "_i", n_train, "_j", n_queries), side(queries, {"sample_id": "sample_id", "features": "_q", "label": "y_true"}, "_j2", n_queries, "_i2", n_train)

    def nearest(rows, asked):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(rows) or not len(asked):
            return pd.DataFrame({c: [] for c in ("sample_id", "y_true", "_t", "_l", "_d")})
        i, j, d = _nearest(np.stack(rows["_x"].to_numpy()), rows["_t"].to_numpy(), np.stack(asked["_q"].to_numpy()), k)
        asked, rows = asked.iloc[i], rows.iloc[j]
        return pd.DataFrame({"sample_id": asked["sample_id"].array, "y_true": asked["y_true"].array, "_t": rows["_t"].array, "_l": rows["_l"].array, "_d": d})

    of, to = dict(train.dtypes), dict(queries.dtypes)
    schema = f"sample_id {to['sample_id']}, y_true {to['label']}, _t {of['sample_id']}, _l {of['label']}, _d double"
    met = t.groupBy("_i", "_j").cogroup(q.groupBy("_i2", "_j2")).applyInPandas(nearest, schema)
    return _votes(met.withColumn("_d", F.round("_d", 9)), k)


def _pair_by_pair(train: DataFrame, queries: DataFrame) -> DataFrame:
    """Rounded distances of all pairs, a row for each."""
    t = train.select(F.col("sample_id").alias("_t"), F.col("features").alias("_x"), F.col("label").alias("_l"))
    q = queries.select("sample_id", F.col("features").alias("_q"), F.col("label").alias("y_true"))
    distance = F.aggregate(F.zip_with("_x", "_q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return q.crossJoin(t).select("sample_id", "y_true", "_t", "_l", F.round(distance, 9).alias("_d"))


def _votes(distances: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("sample_id").orderBy("_d", "_t")
    near = distances.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= k)
    votes = near.groupBy("sample_id", "y_true", "_l").agg(F.count(F.lit(1)).alias("_v"))
    best = W.partitionBy("sample_id").orderBy(F.desc("_v"), "_l")
    return votes.withColumn("_pos", F.row_number().over(best)).where("_pos = 1").select("sample_id", "y_true", F.col("_l").alias("y_pred"), (F.col("_v") / F.lit(float(k))).alias("score"))
