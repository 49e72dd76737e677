"""Labelled matrices with planted signal, seeded."""

from __future__ import annotations

import numpy as np


def planted(n: int = 120, p: int = 30, informative: int = 5, classes: int = 2, shift: float = 1.2, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The first ``informative`` columns move with the class."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, p))
    x[:, :informative] += shift * (y[:, None] * np.where(np.arange(informative) % 2, -1, 1))
    return x, y


def frame(spark, x: np.ndarray, y) -> object:  # noqa: ANN001
    return spark.createDataFrame([(i, [float(v) for v in row], label.item() if hasattr(label, "item") else label) for i, (row, label) in enumerate(zip(x, y, strict=True))], "sample_id long, features array<double>, label " + ("string" if isinstance(y[0], str) else "int"))
