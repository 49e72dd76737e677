from __future__ import annotations

import gzip

import numpy as np
import pytest

from colsieve.sources import datasets, loader


@pytest.fixture
def config(tmp_path):
    rng = np.random.default_rng(0)
    names = [f"s{i}" for i in range(8)]
    lines = [",".join(["id", *names])]
    lines += [",".join([f"f{j}", *(f"{v:.4f}" for v in rng.normal(size=8))]) for j in range(4)]
    lines += ["constant," + ",".join(["1.0"] * 8), "empty," + ",".join(["NA"] * 8), "gap," + ",".join(["", *"1234567"])]
    lines = [x if i == 0 else x for i, x in enumerate(lines)]
    # the last sample has no values at all
    lines = [lines[0]] + [x.rsplit(",", 1)[0] + "," for x in lines[1:]]
    (tmp_path / "features.csv").write_text("\n".join(lines))
    (tmp_path / "metadata.csv").write_text("name,label,age\n" + "\n".join(f"s{i},class{i % 2},{20 + i}" for i in range(9)))
    return {"paths": {"features": f"file://{tmp_path}/features.csv", "metadata": f"file://{tmp_path}/metadata.csv"}, "sample_id_column": "name", "target_column": "label", "transpose_features": True}


def test_loader(spark, config):
    data = loader.DataLoader(spark, config)
    r = data.report
    assert (r["matched"], r["only_features"], r["only_metadata"]) == (8, 0, 1)
    assert (r["samples_removed_all_nan"], r["features_removed_all_nan"], r["features_removed_single_value"]) == (1, 1, 1)
    assert len(data) == 7 and data.feature_names == ["f0", "f1", "f2", "f3", "gap"] and r["missing_values_remaining"] == 1
    assert data.X.count() == data.y.count() == 7
    assert data[0].count() == 1 and data[1:3].count() == 2 and data[[0, -1]].count() == 2
    with pytest.raises(TypeError):
        data["a"]
    with pytest.raises(IndexError):
        data[99]
    assert set(data.get_available_targets()) == {"name", "label", "age"}
    data.set_target("age")
    assert data.target_column == "age"
    with pytest.raises(ValueError, match="Available"):
        data.set_target("nothing")
    kinds = {x["target_name"]: x["type"] for x in data.analyze_targets().collect()}
    assert kinds == {"name": "multiclass", "label": "binary", "age": "multiclass"}


def test_report_kinds(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i), None, "x") for i in range(30)] + [(None, None, float("nan"), None, None)], "a int, b int, c double, d string, e string")
    got = {r["target_name"]: r for r in loader.target_report(rows).collect()}
    assert [got[c]["type"] for c in "abcde"] == ["regression", "binary", "regression", "unknown", "multiclass"]
    assert got["c"]["n_missing"] == 1 and got["b"]["class_counts"] == "0: 15, 1: 15" and got["b"]["balance_ratio"] == "1.000" and got["a"]["median"] == "14.500"


def test_series_matrix(spark, tmp_path):
    text = '!other\t"x"\n!Sample_characteristics\t"age: 50"\t"age: NA"\n!Sample_characteristics\t"er: 1"\t"er: 0"\n'
    (tmp_path / "m.txt.gz").write_bytes(gzip.compress(text.encode()))
    got = {(r["pos"], r["key"]): r["value"] for r in loader.read_series_matrix(spark, f"file://{tmp_path}/m.txt.gz", "!Sample_characteristics").collect()}
    assert got == {(0, "age"): "50", (1, "age"): None, (0, "er"): "1", (1, "er"): "0"}


def test_datasets(spark):
    matrix, truth = datasets.dataset(spark, "rare_signal", {"n_samples": 40, "n_features": 60, "n_signal": 5})
    assert matrix.count() == 40 and len(truth) == 5 and matrix.where("label = 'positive'").count() == 12
    assert datasets.dataset(spark, "planted", {"n_classes": 3})[0].select("label").distinct().count() == 3
    with pytest.raises(ValueError, match="Available"):
        datasets.dataset(spark, "none", {})
