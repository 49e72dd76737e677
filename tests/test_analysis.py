from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsieve.operators import analysis, copies, graph, kernels
from colsieve.operators.graph import connected_components
from colsieve.sources.layouts import to_long
from colsieve.sources.scratch import written
from tests.fixtures import frame, planted


def chosen(spark, sets, **keys):
    rows = [(*keys.values(), i, f) for i, s in enumerate(sets) for f in (s or [None])]
    return spark.createDataFrame(rows, ", ".join([*[f"{k} string" for k in keys], "split int", "feature int"]))


def test_nogueira_equals_kuncheva_at_equal_sizes(spark):
    rows = chosen(spark, [{0, 1, 2}, {0, 1, 3}, {0, 4, 5}, {1, 2, 6}], task="t")
    a = analysis.nogueira(rows, ["task"], 20).first()
    b = analysis.kuncheva(rows, ["task"], 20).first()
    assert a["stability"] == pytest.approx(b["consistency_index"]) and b["n_pairs"] == 6 and not a["variable_size"]


def test_stability_bounds(spark):
    same = chosen(spark, [{1, 2}, {1, 2}, {1, 2}], task="t")
    assert analysis.nogueira(same, ["task"], 10).first()["stability"] == pytest.approx(1)
    assert analysis.kuncheva(same, ["task"], 10).first()["consistency_index"] == pytest.approx(1)
    apart = chosen(spark, [{1, 2}, {3, 4}], task="t")
    assert analysis.kuncheva(apart, ["task"], 10).first()["consistency_index"] < 0  # a pair without anything shared counts
    assert analysis.nogueira(chosen(spark, [set(), set()], task="t"), ["task"], 10).count() == 0
    assert analysis.nogueira(chosen(spark, [{0, 1}, {0, 1}], task="t"), ["task"], 2).count() == 0
    assert analysis.nogueira(chosen(spark, [{0}], task="t"), ["task"], 5).count() == 0


def results(spark, rows):
    full = [(r.get("task", "t"), r["split"], 0.7, "none", r["selector"], r.get("k"), "m", r.get("v"), r.get("auc", 0.5)) for r in rows]
    return spark.createDataFrame(full, "task string, split int, train_size double, preprocess string, selector string, k int, model string, validation_roc_auc double, roc_auc double")


def test_chosen_k(spark):
    rows = [{"split": 0, "selector": "a", "k": 10, "v": 0.6}, {"split": 0, "selector": "a", "k": 50, "v": 0.8}, {"split": 1, "selector": "a", "k": 10, "v": 0.7}, {"split": 1, "selector": "a", "k": 50, "v": 0.7}, {"split": 0, "selector": "own"}]
    got = {(r["selector"], r["split"]): r["k"] for r in analysis.chosen_k(results(spark, rows)).collect()}
    assert got == {("a", 0): 50, ("a", 1): 10, ("own", 0): None}


def test_baseline_meets_its_own_k_or_every_k(spark):
    rng = np.random.default_rng(0)
    rows = [{"split": s, "selector": m, "k": k, "auc": float(rng.random())} for s in range(4) for m, ks in (("a", (10, 50)), ("r", (10, 50)), ("all", (99,))) for k in ks]
    scores = analysis.per_split(results(spark, rows), "roc_auc")
    same_k = analysis.against_baseline(scores, "r").where("selector = 'a'")
    assert same_k.count() == 8
    every = analysis.against_baseline(scores, "all").where("selector = 'a'")
    assert every.count() == 8


def test_corrected_t(spark):
    diffs = spark.createDataFrame([("a", float(v)) for v in (0.1, 0.2, 0.3)] + [("flat", 0.5), ("flat", 0.5), ("none", 0.0), ("none", 0.0)], "m string, diff double")
    got = {r["m"]: r for r in analysis.t_result(analysis.paired(diffs, ["m"], 0.5)).collect()}
    se = np.sqrt((1 / 3 + 0.5) * 0.01)
    assert got["a"]["t"] == pytest.approx(0.2 / se) and got["a"]["first_wins"] == 3
    assert got["a"]["ci_high"] - got["a"]["mean_diff"] == pytest.approx(4.30265273 * se, rel=1e-6)
    assert got["flat"]["p_value"] == 0 and got["none"]["p_value"] == 1 and got["flat"]["ci_low"] == 0.5


def test_frontier(spark):
    cells = spark.createDataFrame([("a", 1, 1.0, 0.5), ("b", 1, 2.0, 0.4), ("c", 1, 3.0, 0.9), ("d", 1, 3.0, 0.8)], "selector string, k int, seconds double, auc double")
    assert {r["selector"] for r in analysis.frontier(cells, "auc").where("on_frontier").collect()} == {"a", "c"}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300)] + [(500, 500 + j) for j in range(1, 30)] + [tuple(map(int, rng.integers(1000, 1100, 2))) for _ in range(80)]
    links = spark.createDataFrame(edges + [(None, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert got == {x: root(x) for x in up}
    assert connected_components(links.where("false")).count() == 0


@pytest.mark.parametrize("at_once, kind", [(graph.AT_ONCE, "long"), (graph.AT_ONCE, "string"), (20, "long"), (20, "string")])
def test_components_of_few_links_take_no_rounds(spark, monkeypatch, at_once, kind):
    """In one task or in rounds the result is the same; a small graph costs the driver one table, and a table is its parts alone."""
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    path = [int(x) for x in rng.permutation(60) + 1000]
    edges = [*zip(path, path[1:], strict=False), *[(3000, 2000 + i) for i in range(30)], (2005, 3000), (7, 7), (None, 1000)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(5).select(F.col("a").cast(kind), F.col("b").cast(kind))
    got = {int(r["node"]): int(r["component"]) for r in connected_components(links).collect()}
    assert got == {x: 1000 for x in path} | {x: 2000 for x in [3000, *range(2000, 2030)]}
    assert len(tables) == 1 if at_once > 20 else len(tables) > 1
    assert {p.suffix for p in Path(tables[-1]._scratch_path.removeprefix("file://")).iterdir()} == {".parquet"}


def test_nearest_pairs_over_several_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(70, 6))
    got = {(r["a"], r["b"]) for r in copies.nearest_pairs(frame(spark, x, np.zeros(70, dtype=int)), 5, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = u @ u.T
    np.fill_diagonal(c, -2)
    want = {tuple(sorted((i, int(j)))) for i in range(70) for j in np.argsort(-c[i])[:5]}
    assert got == want


def test_kernels_against_arrays(spark):
    from colsieve.functions import columns
    from colsieve.operators import protocol

    x, y = planted(60, 5)
    x[:, 4] = np.round(x[:, 4])  # ties
    matrix = frame(spark, x, y)
    long = to_long(matrix)
    u = kernels.u_test(kernels.rank_sums(long, []), protocol.tasks_ovr(matrix), []).orderBy("feature").collect()
    z, log_p, auc = columns.rank_sum(x, y)
    assert np.allclose([r["z"] for r in u], z) and np.allclose([r["auc"] for r in u], auc) and np.allclose([r["log_p"] for r in u], log_p, rtol=1e-6)
    f = kernels.anova_f(kernels.class_sums(long, []), []).orderBy("feature").collect()
    assert np.allclose([r["f"] for r in f], columns.f_classification(x, y)[0])
    p = kernels.anova_f(kernels.class_sums(long, []), []).withColumn("p", kernels.two_sided_t(F.sqrt("f"), F.col("df2"))).orderBy("feature").collect()
    assert np.allclose([r["p"] for r in p], np.exp(columns.f_classification(x, y)[1]), atol=1e-12)
    tau = kernels.kendall(long, [], "label").orderBy("feature").collect()
    assert np.allclose([r["tau"] for r in tau], columns.kendall(x, y.astype(float)))
