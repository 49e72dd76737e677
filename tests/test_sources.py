from __future__ import annotations

import io
import tarfile

import numpy as np
import pytest

from colsieve.operators import benchmark, kernels, runner
from colsieve.operators.selectors import ANOVAFSelector, MannWhitneySelector
from colsieve.sources import archives
from colsieve.sources.datasets import frame
from colsieve.sources.layouts import to_long, to_wide, wide_from_columns
from tests.fixtures import planted


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, data in (("x/1.txt", b"one"), ("x/2.bin", b"two"), ("y/3.txt", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = {r["name"]: bytes(r["content"]) for r in archives.read_tar(spark, f"file://{tmp_path}/a.tar.gz", "*.txt").collect()}
    assert got == {"x/1.txt": b"one", "y/3.txt": b""}
    a = np.arange(24).reshape(4, 2, 3)
    np.savez(tmp_path / "b.npz", images=a)
    rows = archives.read_npz(spark, f"file://{tmp_path}/b.npz", "images").orderBy("row").collect()
    assert [r["values"] for r in rows] == a.reshape(4, 6).tolist()


def test_layouts(spark):
    x, y = planted(10, 4, informative=2)
    matrix = frame(spark, x, y)
    assert sorted(to_wide(to_long(matrix)).collect()) == sorted(matrix.collect())
    table = spark.createDataFrame([(1, 2.0, float("nan"), "a")], "id long, p double, q double, l string")
    assert to_long(wide_from_columns(table, "id", ["p", "q"], "l")).where("value IS NULL").count() == 1


def test_close_pairs_over_several_blocks(spark):
    x, y = planted(40, 11)
    x[:, 9] = x[:, 2] + 0.01 * x[:, 3]
    x[:, 5] = 1.0
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(x.T)
    want = {(i, j) for i in range(11) for j in range(i + 1, 11) if abs(r[i, j]) > 0.2}
    got = kernels.close_pairs(to_long(frame(spark, x, y)), 0.2, block=4).collect()
    assert {(p["a"], p["b"]) for p in got} == want and all(p["r"] == pytest.approx(r[p["a"], p["b"]]) for p in got)


def test_benchmark(spark):
    rows = benchmark.benchmark(spark, {"anova": lambda: ANOVAFSelector(5), "u": lambda: MannWhitneySelector(5)}, [10, 20], lambda p: planted(60, p), repeats=2, originals={"anova": lambda: MannWhitneySelector(5)}).collect()
    assert len(rows) == 4 and all(r["reproducible"] and r["seconds"] > 0 for r in rows)
    assert all(0 < r["agreement"] <= 1 for r in rows if r["selector"] == "anova")
    slow = benchmark.benchmark(spark, {"anova": lambda: ANOVAFSelector(5)}, [10, 20], lambda p: planted(60, p), slow=0.0)
    assert slow.count() == 1


def test_run_until_done(spark, tmp_path):
    x, y = planted(40, 8)
    config = {"output": f"file://{tmp_path}/out", "n_splits": 1, "selectors": [{"name": "random", "k": [3]}], "models": [{"name": "knn"}]}
    assert runner.run_until_done(spark, frame(spark, x, y), config).count() == 1
    assert runner.run_until_done(spark, frame(spark, x, y), {**config, "n_splits": 2}).count() == 2


def test_scratch_tables(spark):
    from colsieve.sources import scratch
    from colsieve.sources.sinks import exists

    table = scratch.written(spark.range(5).where("id > 9"), "test")
    assert table.count() == 0 and table.schema["id"].dataType.simpleString() == "bigint"
    path = scratch._written[-1][1].toString()
    assert exists(spark, path)
    scratch.clear()
    assert not exists(spark, path)


def test_discard(spark):
    """A table that is superseded goes at once; others stay."""
    import os

    from colsieve.sources import scratch

    a, b = scratch.written(spark.range(5), "a"), scratch.written(spark.range(7), "b")
    path = a._scratch_path.removeprefix("file://")
    assert os.path.isdir(path)
    scratch.discard(a, a, spark.range(2))
    assert not os.path.exists(path) and b.count() == 7
