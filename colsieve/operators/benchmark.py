"""Timing selectors: warm-up, repeated fits, whether they repeat themselves, and how they agree with a reference fit."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from colsieve.operators.selectors import Selector


def timed_fits(make: Callable[[], Selector], x: np.ndarray, y: np.ndarray, repeats: int = 3, warm_up: bool = True) -> dict:
    """Median seconds of ``repeats`` fresh fits, after one that doesn't count; ``reproducible`` if all chose the same."""
    if warm_up:
        make().fit(x, y)
    seconds, masks = [], []
    for _ in range(repeats):
        selector = make()
        start = time.perf_counter()
        selector.fit(x, y)
        seconds.append(time.perf_counter() - start)
        masks.append(selector.support_)
    return {"seconds": float(np.median(seconds)), "reproducible": all((m == masks[0]).all() for m in masks), "support": masks[-1]}


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    return float((a & b).sum() / max((a | b).sum(), 1))


def benchmark(spark: SparkSession, selectors: dict[str, Callable[[], Selector]], sizes: list[int], data: Callable[[int], tuple[np.ndarray, np.ndarray]], repeats: int = 3, slow: float = 60.0, originals: dict[str, Callable[[], Selector]] | None = None) -> DataFrame:
    """``(selector, n_features, seconds, reproducible, agreement)`` over growing sizes; a selector that took over ``slow`` seconds skips larger ones."""
    rows, stopped = [], set()
    for p in sorted(sizes):
        x, y = data(p)
        for name, make in selectors.items():
            if name in stopped:
                continue
            got = timed_fits(make, x, y, repeats)
            other = (originals or {}).get(name)
            agreement = jaccard(got["support"], other().fit(x, y).support_) if other else None
            rows.append((name, p, got["seconds"], got["reproducible"], agreement))
            if got["seconds"] > slow:
                stopped.add(name)
    return spark.createDataFrame(rows, "selector string, n_features int, seconds double, reproducible boolean, agreement double")
