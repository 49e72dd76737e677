"""Operator 4, a quality classifier: ordinal cumulative-link regression on graded ratings.

A document's score is one sum of weights over its hashed features; ordered thresholds t1 < t2 < ... on that
score give P(grade <= k) = sigmoid(t_k - score), so the weights are shared by all grades. The model is fitted
on a bounded sample of rated documents; every document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsieve.llm.tokens import as_bytes, narrow_batches

#: Buckets of hashed words and of their beginnings, then of word shapes by share, then of the text's own measures.
WORD_BITS, BEGIN_BITS, BEGIN, SHAPES, LEVELS = 18, 16, 4, 128, 16
DIMENSIONS = (1 << WORD_BITS) + (1 << BEGIN_BITS) + SHAPES * LEVELS + 64
#: Rated documents that the model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 16384

_RUNS = (
    (re.compile(rb"[A-Z]+"), b"A"),
    (re.compile(rb"[a-z\x80-\xff]+"), b"a"),
    (re.compile(rb"[0-9]+"), b"9"),
    (re.compile(rb"([^Aa9])\1+"), rb"\1+"),
)


class Features(dict):
    """For a word: its bucket, 20 bits up its beginning's (the first bytes, so that compounds share it) and 40 bits up its
    shape's. Bounded, like any cache."""

    def __missing__(self, word: bytes) -> int:
        import zlib

        if len(self) > 200_000:
            self.clear()
        shape = word[:64]
        for pattern, letter in _RUNS:
            shape = pattern.sub(letter, shape)
        bare = word.lower().strip(b".,;:!?\"'()[]{}|*#$%&-")
        v = self[word] = (zlib.crc32(bare) >> (32 - WORD_BITS)) | (zlib.crc32(bare[:BEGIN]) >> (32 - BEGIN_BITS)) << 20 | (zlib.crc32(shape[:8]) % SHAPES) << 40
        return v


def features(text: bytes, seen: Features) -> np.ndarray:
    """The distinct feature buckets of a text: its words and their beginnings, the shares of its words' shapes, its length and variety."""
    counts = Counter(text.split())
    words = 1 << WORD_BITS
    base = words + (1 << BEGIN_BITS)
    own = base + SHAPES * LEVELS
    n = sum(counts.values())
    if not n:
        return np.array([own], dtype="i8")
    both = np.fromiter(map(seen.__getitem__, counts), dtype="i8", count=len(counts))
    times = np.fromiter(counts.values(), dtype="f8", count=len(counts))
    share = np.bincount(both >> 40, weights=times, minlength=SHAPES) / n
    shapes = np.flatnonzero(share)
    levels = np.minimum((share[shapes] * LEVELS).astype("i8"), LEVELS - 1)
    variety = own + 1 + min(int(len(counts) / n * 16), 15)
    length = own + 20 + min(int(np.log2(n) * 2), 40)
    return np.concatenate([np.unique(both & (words - 1)), words + np.unique(both >> 20 & ((1 << BEGIN_BITS) - 1)), base + shapes * LEVELS + levels, [variety, length]])


@dataclass
class Ordinal:
    """Weights of the buckets and thresholds between the grades 0..len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))

    def scores(self, texts: Iterable[bytes], seen: Features, n: int) -> np.ndarray:
        return np.fromiter((float(self.weights[features(x, seen)].sum(dtype="f8")) for x in texts), dtype="f8", count=n)

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return self.tails(scores).sum(1)


def minimised(of: Callable[[np.ndarray], tuple[float, np.ndarray]], p: np.ndarray, tolerance: float, rounds: int, memory: int = 10) -> np.ndarray:
    """Where ``of``, which gives a value and its gradient, is least: L-BFGS from ``p`` until no part of the gradient exceeds ``tolerance``."""
    value, g = of(p)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance:
            break
        d, shares = -g, []
        for s, y, r in reversed(steps):
            shares.append(r * (s @ d))
            d = d - shares[-1] * y
        if steps:
            s, y, _ = steps[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.sqrt(g @ g))
        for (s, y, r), share in zip(steps, reversed(shares), strict=True):
            d = d + (share - r * (y @ d)) * s
        slope, length = g @ d, 1.0
        if slope >= 0:
            d, slope, steps = -g, -(g @ g), []
        while True:
            to, after = of(p + length * d)
            if to <= value + 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-12:  # no descent left that doubles can tell
                return p
        s, y = length * d, after - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
        p, value, g = p + s, to, after
    return p


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = 3e-4, tolerance: float = 2e-5, rounds: int = 500) -> Ordinal:
    """Penalised maximum likelihood; buckets of fewer than three documents get no weight.

    Thresholds start at the grades' own frequencies and stay ordered: each is the one before plus an
    exponential. Nothing is random. The fit ends where no part of the gradient exceeds ``tolerance``.
    """
    if not len(rows):
        return Ordinal(np.zeros(DIMENSIONS, "f4"), np.arange(1, n_grades) - 1.0)
    sizes, at = np.array([len(r) for r in rows]), np.concatenate(rows)
    used = np.flatnonzero(np.bincount(at, minlength=DIMENSIONS) >= 3)
    place = np.full(DIMENSIONS, -1)
    place[used] = np.arange(len(used))
    at = place[at]
    doc = np.repeat(np.arange(len(rows)), sizes)[at >= 0]
    at = at[at >= 0]
    n, y = len(rows), np.asarray(grades)
    sizes = np.bincount(doc, minlength=n)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    del doc
    share = np.clip(np.array([(y < k).mean() for k in range(1, n_grades)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))

    def thresholds(raw: np.ndarray) -> np.ndarray:
        return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])

    def of(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, raw = p[: len(used)], p[len(used) :]
        s = np.zeros(n)
        if len(some):
            s[some] = np.add.reduceat(w[at], starts)
        edge = np.concatenate([[-np.inf], thresholds(raw), [np.inf]])
        up, low = 1 / (1 + np.exp(-np.clip(edge[y + 1] - s, -40, 40))), 1 / (1 + np.exp(-np.clip(edge[y] - s, -40, 40)))
        chance = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / chance, low * (1 - low) / chance
        g_t = np.array([(np.where(y == k, -d_up, 0) + np.where(y == k + 1, d_low, 0)).sum() / n for k in range(n_grades - 1)])
        g_raw = np.concatenate([[g_t.sum()], [g_t[k + 1 :].sum() * np.exp(raw[k + 1]) for k in range(n_grades - 2)]])
        g_w = np.bincount(at, weights=np.repeat((d_up - d_low) / n, sizes), minlength=len(used)) + l2 * w
        return float(-np.log(chance).mean() + l2 / 2 * (w @ w)), np.concatenate([g_w, g_raw])

    p = minimised(of, np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))]), tolerance, rounds)
    weights = np.zeros(DIMENSIONS, "f4")
    weights[used] = p[: len(used)]
    return Ordinal(weights, thresholds(p[len(used) :]))


def train(docs: DataFrame, grades: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ordinal:
    """Fits on the ``sample`` rated documents (``id_col, grade``) whose ids hash smallest, in one task of an executor. Rows
    with null grades or ids don't count, nor do grades of no document."""
    narrow_batches(docs.sparkSession)
    rated = grades.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col("grade").cast("int").alias("_grade"))
    chosen = rated.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), as_bytes(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Features()
        for b in batches:
            rows = [features(x.as_py(), seen).astype("<i4").tobytes() for x in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.string()), b.column("_grade"), pa.array(rows, pa.binary())], names=["_id", "_grade", "_x"])

    # ids may repeat in the documents, so the limit holds once more; it leaves one partition, whose task fits
    got = texts.select("_id", "_grade", "_text").mapInArrow(extract, "_id string, _grade int, _x binary").orderBy(F.xxhash64("_id"), "_x", "_grade").limit(sample)

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for b in batches:
            rows += [np.frombuffer(x.as_py(), "<i4") for x in b.column("_x")]
            grades += b.column("_grade").to_pylist()
        model = fit(rows, np.array(grades, dtype="i8"), n_grades)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.astype("f8").tobytes()], pa.binary())], names=["w", "t"])

    fitted = got.select("_grade", "_x").mapInArrow(fit_all, "w binary, t binary").first()
    return Ordinal(np.frombuffer(fitted["w"], "f4"), np.frombuffer(fitted["t"])) if fitted else fit([], np.array([]), n_grades)


def scored(docs: DataFrame, model: Ordinal, text_col: str = "text", prefix: str = "", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``score, expected_grade`` and ``tail``, an array of
    P(grade >= 1), P(grade >= 2), ...

    The model is about a megabyte, whatever the data. A null or empty text gets what the model says of texts
    without words. Give ``prefix`` where ``docs`` has columns of these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns if carry is None else carry
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), as_bytes(f"`{text_col}`").alias("_text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType()), T.StructField("tail", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, Features()
        for b in batches:
            s = model.scores((x.as_py() for x in b.column(1)), seen, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(model.expected(s)), pa.array(list(model.tails(s)), pa.list_(pa.float64()))], names=["_row", "score", "expected", "tail"])

    got = rows.mapInArrow(score, schema)
    return got.select(*[F.col("_row")[c].alias(c) for c in names], F.col("score").alias(f"{prefix}score"), F.col("expected").alias(f"{prefix}expected_grade"), F.col("tail").alias(f"{prefix}tail"))


def accepted(docs: DataFrame, model: Ordinal, grade: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose grade is ``grade`` or more with a chance of ``least`` or more.

    Texts travel once. Nulls as in :func:`scored`; equal rows stay or go together; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow_batches(docs.sparkSession)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    at, plain = names.index(text_col), docs.schema[text_col].dataType == T.StringType()
    if not plain:  # as text beside it
        rows = rows.withColumn("_text", F.col("_row")[text_col].cast("string"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, Features()
        for b in batches:
            texts = b.column(0).field(at) if plain else b.column(1)
            s = model.scores(((x.as_py() or "").encode() for x in texts), seen, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(model.tails(s)[:, grade - 1] >= least))], names=["_row"])

    got = rows.mapInArrow(choose, T.StructType([rows.schema["_row"]]))
    return got.select(*[F.col("_row")[c].alias(c) for c in names])


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, grade)`` from the two labels: 0 toxic, 1 of low quality, 2 good; null if a label is null."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNull(), None).otherwise(F.col("quality") + 1)
    return labels.select(id_col, grade.cast("int").alias("grade"))


N_GRADES = 3
