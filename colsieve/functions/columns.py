"""Statistics of the columns of a matrix in memory: what the kernels compute as plans, for one cell of a grid."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from colsieve.functions.special import harmonic, log_f_sf, log_norm_sf

_LARGEST = np.finfo("f8").max
#: Columns to a block: a few megabytes, which stay in a core's cache.
BLOCK = 128


def _threads() -> int:
    """As many as BLAS may use: Spark allows a task one for each of its cores."""
    return int(os.environ.get("OMP_NUM_THREADS") or os.cpu_count() or 1)


def in_blocks(of: Callable[..., tuple[np.ndarray, ...]], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """``of`` each block of columns, its results put one after the other."""
    blocks = [x[:, i : i + BLOCK] for i in range(0, x.shape[1], BLOCK)] or [x]
    if _threads() == 1 or len(blocks) == 1:
        parts = [of(b) for b in blocks]
    else:
        with ThreadPoolExecutor(_threads()) as pool:
            parts = list(pool.map(of, blocks))
    return tuple(np.concatenate(v, axis=-1) for v in zip(*parts, strict=True))


def variances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The population variance of each column and its spread."""
    return in_blocks(lambda b: (b.var(0), b.max(0) - b.min(0)), x)


def f_classification(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-way F and log p of each column; NaN for a constant one."""
    classes, code = np.unique(y, return_inverse=True)
    n, k = len(y), len(classes)
    one = np.eye(k)[code]
    sizes = one.sum(0)
    sums, square, constant = in_blocks(lambda b: (one.T @ b, np.einsum("ij,ij->j", b, b), (b == b[0]).all(0)), x)
    explained = (sums * sums / sizes[:, None]).sum(0)
    total = sums.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (explained - total * total / n) / (k - 1) / ((square - explained) / (n - k))
    f[constant] = np.nan
    with np.errstate(invalid="ignore"):
        log_p = np.where(np.isnan(f), np.nan, log_f_sf(np.nan_to_num(f, nan=0.0), k - 1, n - k))
    return f, log_p


def f_regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """F of the correlation with a number and log p; 0 and log 1 where it is undefined."""
    r = correlation(x, np.asarray(y, "f8"))
    r2 = np.nan_to_num(r * r, nan=0.0)
    with np.errstate(divide="ignore"):
        f = np.where(r2 >= 1, _LARGEST, r2 / (1 - r2) * (len(y) - 2))
    return f, log_f_sf(f, 1, len(y) - 2)


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's r of each column with y; NaN for a constant one."""
    yc = y - y.mean()

    def of(b: np.ndarray) -> tuple[np.ndarray]:
        xc = b - b.mean(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = xc.T @ yc / np.sqrt(np.einsum("ij,ij->j", xc, xc) * (yc @ yc))
        r[(b == b[0]).all(0)] = np.nan
        return (np.clip(r, -1, 1),)

    return in_blocks(of, x)[0]


def average_ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of each column, ties sharing their mean, and the column's sum of t^3 - t."""
    ranks, ties = np.empty(x.shape), np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        _, place, count = np.unique(x[:, j], return_inverse=True, return_counts=True)
        ranks[:, j] = (np.cumsum(count) - (count - 1) / 2)[place]
        ties[j] = (count.astype("f8") ** 3 - count).sum()
    return ranks, ties


def rank_sum(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, log p and AUC of the rank-sum test for the second of two sorted classes."""
    classes = np.unique(y)
    if len(classes) != 2:
        raise ValueError(f"the rank-sum test needs exactly two classes, got {len(classes)}")
    positive = y == classes[1]
    n2 = int(positive.sum())
    n1, n = len(y) - n2, len(y)
    places = np.arange(1.0, n + 1)

    def of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the second class's ranks and of t^3 - t: places in order, but columns with ties by their mean ranks."""
        rows = np.ascontiguousarray(b.T)
        order = np.argsort(rows, axis=1)
        sums, ties = positive[order] @ places, np.zeros(len(rows))
        in_order = np.take_along_axis(rows, order, 1)
        tied = np.flatnonzero((in_order[:, 1:] == in_order[:, :-1]).any(1))
        if len(tied):
            ranks, ties[tied] = average_ranks(b[:, tied])
            sums[tied] = ranks[positive].sum(0)
        return sums, ties

    sums, ties = in_blocks(of, x)
    u = sums - n2 * (n2 + 1) / 2
    variance = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(variance > 0, (np.abs(u - n1 * n2 / 2) - 0.5) / np.sqrt(variance), 0.0)
    log_p = np.where(z > 0, np.minimum(np.log(2) + log_norm_sf(np.maximum(z, 0)), 0.0), 0.0)
    return z, log_p, u / (n1 * n2)


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> np.ndarray:
    """Ross's nearest-neighbour estimate for classes, by one sort of each column."""
    h = harmonic(len(y) + 1)
    out = np.zeros(x.shape[1])
    classes, code, sizes = np.unique(y, return_inverse=True, return_counts=True)
    used = sizes[code] > 1
    code = code[used]
    n = int(used.sum())
    if not n:
        return out
    parts = [np.flatnonzero(code == c) for c in range(len(classes)) if sizes[c] > 1]
    for j in range(x.shape[1]):
        v = x[used, j]
        radius, kk = np.empty(n), np.empty(n, dtype=int)
        for at in parts:
            m = len(at)
            order = at[np.argsort(v[at], kind="stable")]
            s, near = v[order], min(k, m - 1)
            best = np.full(m, np.inf)
            for a in range(near + 1):
                down = np.full(m, np.inf)
                down[a:] = s[a:] - s[: m - a]
                up = np.full(m, np.inf)
                b = near - a
                up[: m - b] = s[b:] - s[: m - b]
                best = np.minimum(best, np.maximum(down, up))
            radius[order], kk[order] = best, near
        s, count = np.unique(v, return_counts=True)
        upto, last = np.r_[0, np.cumsum(count)], len(s) - 1
        low, high = np.searchsorted(s, v - radius, "left"), np.searchsorted(s, v + radius, "right")
        # the ends by differences, as sums may round across them
        for _ in range(3):
            low = np.where((low <= last) & (v - s[np.minimum(low, last)] >= radius) & (s[np.minimum(low, last)] < v), low + 1, low)
            low = np.where((low > 0) & (v - s[np.maximum(low - 1, 0)] < radius), low - 1, low)
            high = np.where((high > 0) & (s[np.maximum(high - 1, 0)] - v >= radius) & (s[np.maximum(high - 1, 0)] > v), high - 1, high)
            high = np.where((high <= last) & (s[np.minimum(high, last)] - v < radius), high + 1, high)
        low, high = upto[low], upto[high]
        m = np.where(radius > 0, np.maximum(high - low, 1), 1)
        own = sizes[sizes > 1]
        mean_class = (h[own - 1] * own).sum() / n
        out[j] = max(0.0, h[n - 1] + h[kk - 1].mean() - mean_class - h[m - 1].mean())
    return out


def mutual_information_regression(x: np.ndarray, y: np.ndarray, k: int = 3) -> np.ndarray:
    """The estimate of Kraskov and others for two numbers: the k-th neighbour by the larger of both distances."""
    n = len(y)
    h = harmonic(n + 1)
    y = np.asarray(y, "f8")
    y = y / (y.std() or 1.0)
    dy = np.abs(y[:, None] - y[None, :])
    out = np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        v = x[:, j] / (x[:, j].std() or 1.0)
        dx = np.abs(v[:, None] - v[None, :])
        d = np.maximum(dx, dy)
        np.fill_diagonal(d, np.inf)
        radius = np.partition(d, min(k, n - 1) - 1, axis=1)[:, min(k, n - 1) - 1]
        nx, ny = (dx < radius[:, None]).sum(1), (dy < radius[:, None]).sum(1)
        out[j] = max(0.0, h[n - 1] + h[min(k, n - 1) - 1] - h[np.maximum(nx, 1) - 1].mean() - h[np.maximum(ny, 1) - 1].mean())
    return out


def tied_pairs(*codes: np.ndarray) -> int:
    """How many pairs of rows agree in all of ``codes``."""
    count = np.unique(np.stack(codes), axis=1, return_counts=True)[1].astype("i8")
    return int((count * (count - 1) // 2).sum())


def inversions(codes: np.ndarray) -> int:
    """How many pairs of an array of whole numbers stand with the larger one first, bit by bit from the highest:
    a pair is out of order if, at the first bit in which both differ, the one in front has it set."""
    total = 0
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        prefix, is_set = codes >> (bit + 1), (codes >> bit) & 1
        before = np.cumsum(is_set) - is_set
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        before = before - np.repeat(before[starts], np.diff(np.r_[starts, len(codes)]))
        total += int(before[is_set == 0].sum())
        codes = codes[np.argsort(codes >> bit, kind="stable")]
    return total


def kendall(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """tau-b of each column with y, by sorting: pairs of samples are counted and never made. A column with a NaN, or
    without two different values, has none (NaN)."""
    out = np.full(x.shape[1], np.nan)
    if np.isnan(np.asarray(y, "f8")).any():
        return out
    b = np.unique(y, return_inverse=True)[1].astype("i8")
    pairs = len(b) * (len(b) - 1) // 2
    tied_b = tied_pairs(b)
    for j in range(x.shape[1]):
        if np.isnan(x[:, j]).any():
            continue
        a = np.unique(x[:, j], return_inverse=True)[1].astype("i8")
        tied_a = tied_pairs(a)
        if tied_a < pairs and tied_b < pairs:
            apart = pairs - tied_a - tied_b + tied_pairs(a, b)
            out[j] = (apart - 2 * inversions(b[np.lexsort((b, a))])) / (np.sqrt(float(pairs - tied_a)) * np.sqrt(float(pairs - tied_b)))
    return out
