"""Operator 10, language-model scoring by Brown class-based n-grams.

P(word | previous word) = P(class | class of the previous word) * P(word | class), smoothed and mixed with the
unigram model. All counts are taken over all training documents.

Words with at least 2**-18 of all tokens, of which there can be no more than 2**18, get their classes by exchange
clustering over the table of all their bigrams: every round moves half of them to the class under which their
neighbours are likeliest, and is kept only if the likelihood of the class bigrams rises. Every other word seen twice
or more, the tail, then gets the class under which its own neighbours are likeliest, with the frequent words' classes
held: its tokens are dealt by word, so that no task has more than its share. Words seen once have a class by their
ending, a rule that needs no table, so that a word never seen has one too. Class bigrams are counted again after that.

Classes and counts of tail words are too many to send to every task. They are a table dealt by word; each slice of
texts asks the table's parts for the words that it has.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.llm.tokens import as_bytes, small_batches
from colsieve.sources.scratch import discard, written

#: A word is frequent from this share of all tokens on, so at most as many words are.
FREQUENT = 1 << 18
CLASSES, ENDINGS, ROUNDS = 64, 32, 6
#: Parts that the table of bigrams is dealt into, at least.
PARTS = 64
#: Bytes of text whose words are held at once, and tokens whose bigrams are.
SLICE, TOKENS = 2 << 20, 1_500_000
#: Weight of the class model against the unigram model, and of class frequencies against class bigrams.
LAMBDA, BETA = 0.95, 100.0
#: The end of a text; words are never empty.
END = b""


def identity(word: bytes) -> int:
    """A word's 64-bit hash, as Spark's signed long."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


class Ids(dict):
    """Ids of words: 0.. for the frequent ones, from ``len(frequent)`` on by the ending. A bounded cache."""

    def __init__(self, frequent: dict[int, int]):
        super().__init__()
        self.frequent, self.n = frequent, len(frequent)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self.frequent.get(identity(word))
        v = self[word] = self.n + ending(word) if found is None else found
        return v


class Hashes(dict):
    """Hashes of words seen; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        v = self[word] = identity(word)
        return v


def in_training(id_col: str, folds: int = 7, held_out: int = 2):  # noqa: ANN201
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds != held_out


def vocabulary(train: DataFrame) -> DataFrame:
    """``(word, ending, n)`` of the words of ``_text`` and the text's end (ending -1), words by their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        texts = 0

        def flush() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([identity(w) for w in words] + [identity(END)], pa.int64()), pa.array([ending(w) for w in words] + [-1], pa.int32()), pa.array([*seen.values(), texts], pa.int64())], names=["word", "ending", "n"])

        for b in batches:
            for text in b.column(0):
                seen.update(text.as_py().lower().split())
            texts += b.num_rows
            if len(seen) > 250_000:
                yield flush()
                seen.clear()
                texts = 0
        if texts:
            yield flush()

    return train.select("_text").mapInArrow(count, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Model:
    """``frequent`` maps a word's hash to its id; ``classes`` has the class of each id (words, endings, the end).
    ``log_step`` has a row for each class of the word before and a column for each class, then for each ending of a word never seen."""

    frequent: dict[int, int]
    log_counts: np.ndarray
    classes: np.ndarray
    log_step: np.ndarray
    end_count: int
    total: int
    types: int


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Where texts of a few megabytes begin and end in a column, and their words: a whole batch's words are too many objects."""
    start, texts, size = 0, [], 0
    for i, x in enumerate(column):
        text = x.as_py()
        texts.append(text.lower().split())
        size += len(text)
        if size > SLICE:
            yield start, i + 1, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, len(column), texts


def _row(texts: list[list[bytes]], ids: Ids, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts one after the other, an end before the first and after each, and how many tokens each has."""
    size = np.array([len(x) + 1 for x in texts], dtype="i8")
    row = np.full(int(size.sum()) + 1, end, dtype="i8")
    inside = np.ones(len(row), dtype=bool)
    inside[0] = inside[np.cumsum(size)] = False
    row[inside] = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(texts)), dtype="i8", count=int(inside.sum()))
    return row, size


def _dealt(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Bigrams as packed arrays, one row for each part of their ``key``."""
    part = key % parts
    order = np.argsort(part, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
    a, b, n = (v[order].astype(t) for v, t in ((a, "<i4"), (b, "<i4"), (n, "<i8")))
    for i in np.flatnonzero(np.diff(ends)):
        at = slice(ends[i], ends[i + 1])
        yield int(i), a[at].tobytes(), b[at].tobytes(), n[at].tobytes()


_PACKED = "part int, a binary, b binary, n binary"


def _packed(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "a", "b", "n"])


def _unpacked(part: pa.RecordBatch | pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    columns = [part[c] for c in ("a", "b", "n")] if isinstance(part, pd.DataFrame) else [part.column(part.schema.names.index(c)).to_pylist() for c in ("a", "b", "n")]
    for a, b, n in zip(*columns, strict=True):
        yield np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4"), np.frombuffer(n, "<i8")


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of an array, each up to one of ``ends``, as a binary column."""
    offsets = (np.r_[0, ends] * data.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _flat(column: pa.Array | pa.ChunkedArray | pd.Series, kind: str) -> np.ndarray:
    """All of a binary column as one array."""
    return np.frombuffer(b"".join(column.tolist() if isinstance(column, pd.Series) else column.to_pylist()), kind)


def coded(rows: DataFrame, frequent, n_ids: int) -> DataFrame:  # noqa: ANN001
    """``rows`` with, for ``_text``, the ids of its words and its end (``_ids``), the hashes of those words that aren't
    frequent in their order (``_tail``)."""
    others = [c for c in rows.columns if c != "_text"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, end, n_words = Ids(frequent.value), Hashes(), n_ids - 1, len(frequent.value)
        for b in batches:
            for first, last, texts in _slices(b.column(b.schema.names.index("_text"))):
                row, size = _row(texts, ids, end)
                row, ends = row[1:], np.cumsum(size)
                tail = (row >= n_words) & (row < end)
                words = itertools.compress(itertools.chain.from_iterable(texts), tail[row != end].tolist())
                found = np.fromiter(map(hashes.__getitem__, words), dtype="<i8", count=int(tail.sum()))
                part = b.slice(first, last - first)
                made = [part.column(b.schema.names.index(c)) for c in others]
                made += [_binary(row.astype("<i4"), ends), _binary(found, np.cumsum(tail)[ends - 1])]
                yield pa.RecordBatch.from_arrays(made, names=[*others, "_ids", "_tail"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInArrow(code, f"{kinds}_ids binary, _tail binary")


def bigrams(train: DataFrame, frequent, n_ids: int, parts: int) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Counts of neighbouring ids over whole texts, from end to end: packed in parts by the first id, and by the second."""
    if "_ids" not in train.columns:
        train = coded(train.select("_text"), frequent, n_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = n_ids - 1
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _packed(list(_dealt(code // n_ids, code // n_ids, code % n_ids, n, parts)))

        for b in batches:
            row = _flat(b.column(0), "<i4").astype("i8")
            held.append(np.r_[end, row[:-1]] * n_ids + row)
            if sum(map(len, held)) > TOKENS:
                yield flush()
        if held:
            yield flush()

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (np.concatenate(v) for v in zip(*_unpacked(part), strict=True))
        code, place = np.unique(x.astype("i8") * n_ids + y, return_inverse=True)
        total = np.bincount(place, weights=n).astype("<i8")
        return pd.DataFrame([(int(part["part"].iloc[0]), (code // n_ids).astype("<i4").tobytes(), (code % n_ids).astype("<i4").tobytes(), total.tobytes())], columns=["part", "a", "b", "n"])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, n in _unpacked(batch):
                yield _packed(list(_dealt(y, x, y, n, parts)))

    with small_batches(train.sparkSession):
        by_a = written(train.select("_ids").mapInArrow(count, _PACKED).groupBy("part").applyInPandas(merged, _PACKED), "bigrams-a")
    by_b = written(by_a.mapInArrow(turned, _PACKED).groupBy("part").applyInPandas(merged, _PACKED), "bigrams-b")
    return by_a, by_b


def _class_bigrams(table: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams: a small matrix from each task."""
    shared = table.sparkSession.sparkContext.broadcast(classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, c = np.zeros(k * k), shared.value.astype("i8")
        for batch in batches:
            for x, y, n in _unpacked(batch):
                total += np.bincount(c[x] * k + c[y], weights=n, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = table.mapInArrow(add, "m binary").collect()
    return sum((np.frombuffer(r["m"]) for r in parts), np.zeros(k * k)).reshape(k, k)


def _fit_of_classes(table: DataFrame, first: bool, classes: np.ndarray, logs: np.ndarray, n_frequent: int) -> np.ndarray:
    """For each frequent word and class, the log likelihood of the word's neighbours on one side. ``table`` is dealt by
    the word, its first id or its second, so a task returns its own words' rows: in all 2**18 * 64 floats at most."""
    shared = table.sparkSession.sparkContext.broadcast((classes, logs.astype("f4")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, logs = shared.value
        k = logs.shape[0]
        for batch in batches:
            for x, y, n in _unpacked(batch):
                w, o = (x, y) if first else (y, x)
                own = w < n_frequent
                words, row = np.unique(w[own], return_inverse=True)
                near = np.bincount(row * k + c[o[own]].astype("i8"), weights=n[own], minlength=len(words) * k).reshape(len(words), k)
                yield pa.RecordBatch.from_arrays([pa.array([words.astype("<i4").tobytes()], pa.binary()), pa.array([(near.astype("f4") @ logs).tobytes()], pa.binary())], names=["w", "s"])

    out = np.zeros((n_frequent, CLASSES), dtype="f4")
    for r in table.mapInArrow(add, "w binary, s binary").collect():
        out[np.frombuffer(r["w"], "<i4")] += np.frombuffer(r["s"], dtype="f4").reshape(-1, CLASSES)
    return out


def _likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, less what emissions lose to the classes' sizes."""
    x = m[m > 0]
    left, right = m.sum(1), m.sum(0)
    return float((x * np.log(x)).sum() - (left[left > 0] * np.log(left[left > 0])).sum() - (right[right > 0] * np.log(right[right > 0])).sum())


def exchange(by_a: DataFrame, by_b: DataFrame, counts: np.ndarray, classes: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Exchange clustering of the frequent words: their classes and the counts of class bigrams at the end."""
    n_words = len(counts)
    m = _class_bigrams(by_a, classes, k)
    best = _likelihood(m)
    for t in range(rounds if n_words else 0):
        p = (m + 0.1) / (m + 0.1).sum(1, keepdims=True)
        follow, lead = np.log(p[:CLASSES]).T, np.log(p[:, :CLASSES])  # (class of the next, own), (class of the one before, own)
        size = np.maximum(m.sum(0)[:CLASSES], 1)
        score = _fit_of_classes(by_a, True, classes, follow, n_words) + _fit_of_classes(by_b, False, classes, lead, n_words)
        score -= counts[:, None].astype("f4") * np.log(size)[None, :].astype("f4")
        moved = classes.copy()
        half = np.arange(n_words) % 2 == t % 2
        moved[:n_words][half] = score.argmax(1)[half].astype(classes.dtype)
        after = _class_bigrams(by_a, moved, k)
        if _likelihood(after) <= best:
            if t % 2:
                break
            continue
        classes, m, best = moved, after, _likelihood(after)
    return classes, m


def _cells(rows: DataFrame, n: int) -> np.ndarray:
    """Sums of ``(cell, n)`` rows."""
    out = np.zeros(n)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _by_part(words: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has some of ``words``, and where they are."""
    part = words % parts
    order = np.argsort(part, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
    for i in np.flatnonzero(np.diff(ends)):
        yield int(i), order[ends[i] : ends[i + 1]]


_TAILS = "part int, w binary, c binary, v binary"
#: ``kind`` 0: a part's words, their classes and counts. 1: cells and counts. 2: words of the part, classes of the words before.
_ASSIGNED = "kind int, part int, w binary, c binary, n binary"
#: Tail words whose neighbours' classes are counted at once.
WORDS = 8192


def assign(train: DataFrame, classes: np.ndarray, m: np.ndarray, n_words: int, parts: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Classes of the tail: ``(part, w, c, n)`` with each part's words, classes and counts packed; the counts of class
    bigrams that a tail word is part of; and how many tail words each class has. ``train`` is :func:`coded`, ``classes``
    and ``m`` are those of :func:`exchange`.

    A word seen twice or more gets the likeliest of the frequent words' classes from all its neighbours, of which
    tail words count under their endings. A word seen once keeps its ending.
    """
    k = len(m)
    p = (m + 0.1) / (m + 0.1).sum(1, keepdims=True)
    shared = train.sparkSession.sparkContext.broadcast((classes, np.log(p[:, :CLASSES]), np.log(p[:CLASSES]).T, np.log(np.maximum(m.sum(0)[:CLASSES], 1))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0]
        end = len(of) - 1
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            w, c, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows = [(i, w[at].tobytes(), c[at].tobytes(), v[at][_is_tail(c[at, 2])].tobytes()) for i, at in _by_part(w, parts)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "w", "c", "v"])

        for b in batches:
            row, w = _flat(b.column(0), "<i4"), _flat(b.column(1), "<i8")
            c = of[row]
            at = np.flatnonzero((row >= n_words) & (row < end))
            if len(at):  # every text ends with an end, so there is a token after each
                held.append((w, np.stack([c[at], np.r_[of[end], c[:-1]][at], c[at + 1]], 1), np.r_[w[1:], w[:1]]))
            if sum(len(x[0]) for x in held) > TOKENS:
                yield flush()
        if held:
            yield flush()

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        _, lead, follow, log_size = shared.value
        w, c, v = _flat(part["w"], "<i8"), _flat(part["c"], "u1").reshape(-1, 3), _flat(part["v"], "<i8")
        after = np.zeros(len(w), dtype="i8")
        after[_is_tail(c[:, 2])] = v
        order = np.argsort(w, kind="stable")
        w, c, after = w[order], c[order], after[order]
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        n = np.diff(np.r_[start, len(w)])
        chosen = c[start, 0].copy()
        often = np.flatnonzero(n > 1)
        for i in range(0, len(often), WORDS):
            some = often[i : i + WORDS]
            row = np.repeat(np.arange(len(some)), n[some])
            at = np.arange(len(row)) + np.repeat(start[some] - np.cumsum(n[some]) + n[some], n[some])
            near = [np.bincount(row * k + c[at, j], minlength=len(some) * k).reshape(-1, k) for j in (1, 2)]
            chosen[some] = (near[0] @ lead + near[1] @ follow - n[some][:, None] * log_size).argmax(1)
        own = np.repeat(chosen, n).astype("i8")
        first, last = ~_is_tail(c[:, 1]), _is_tail(c[:, 2])
        cells = np.bincount(np.r_[c[first, 1].astype("i8") * k + own[first], own[~last] * k + c[~last, 2]], minlength=k * k)
        cells = np.r_[cells, np.bincount(chosen, minlength=k)]
        full = np.flatnonzero(cells)
        mine = int(part["part"].iloc[0])
        rows = [(0, mine, w[start].tobytes(), chosen.tobytes(), n.astype("<i8").tobytes()), (1, mine, full.astype("<i8").tobytes(), b"", cells[full].astype("<i8").tobytes())]
        rows += [(2, i, after[last][at].tobytes(), own[last][at].astype("u1").tobytes(), b"") for i, at in _by_part(after[last], parts)]
        return pd.DataFrame(rows, columns=["kind", "part", "w", "c", "n"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k, dtype="i8")
        for b in batches:
            np.add.at(total, _flat(b.column(0), "<i8"), _flat(b.column(1), "<i8"))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        table, asked = part[part["kind"] == 0], part[part["kind"] == 2]
        words, of = _flat(table["w"], "<i8"), _flat(table["c"], "u1")
        at = np.searchsorted(words, _flat(asked["w"], "<i8"))
        cells = np.bincount(_flat(asked["c"], "u1").astype("i8") * k + (of[at] if len(at) else at), minlength=k * k)
        full = np.flatnonzero(cells)
        return pd.DataFrame({"cell": full, "n": cells[full]})

    with small_batches(train.sparkSession):
        made = written(train.select("_ids", "_tail").mapInArrow(deal, _TAILS).groupBy("part").applyInPandas(choose, _ASSIGNED), "assigned")
    beside = _cells(made.where("kind = 1").select("w", "n").mapInArrow(unpack, "cell long, n long"), k * k + k)
    between = _cells(made.where("kind <> 1").groupBy("part").applyInPandas(meet, "cell long, n long"), k * k)
    return made.where("kind = 0").drop("kind"), (beside[: k * k] + between).reshape(k, k), beside[k * k :]


def _is_tail(classes: np.ndarray) -> np.ndarray:
    """Before they are assigned, tail words alone have the classes of endings."""
    return (classes >= CLASSES) & (classes < CLASSES + ENDINGS)


@dataclass
class Head:
    """The frequent words' hashes and ids, counts and endings, and the sums of the vocabulary."""

    frequent: dict[int, int]
    counts: np.ndarray
    endings: np.ndarray
    end_count: int
    total: int
    types: int

    @property
    def n_ids(self) -> int:
        return len(self.frequent) + ENDINGS + 1


def head_of(vocab: DataFrame) -> Head:
    total, types, ends = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("ending") < 0, F.col("n"))), F.lit(0))).first()
    # at most FREQUENT words can have a 1/FREQUENT of all tokens each
    top = vocab.where((F.col("ending") >= 0) & (F.col("n") * FREQUENT >= F.lit(total)) & (F.col("n") > 1)).select("word", "n", "ending").toPandas().sort_values(["n", "word"], ascending=[False, True])
    return Head({w: i for i, w in enumerate(top["word"].tolist())}, top["n"].to_numpy("f8"), top["ending"].to_numpy("i8"), int(ends), int(total), int(types))


def n_parts(spark: SparkSession) -> int:
    return max(PARTS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def fit(train: DataFrame, head: Head, shared) -> tuple[Model, DataFrame]:  # noqa: ANN001
    """The model of :func:`coded` rows, and the tail's words, classes and counts as :func:`assign` gives them. The driver
    gets the frequent words' hashes and counts and class matrices: all of a size that doesn't grow with the corpus."""
    n_words, k = len(head.frequent), CLASSES + ENDINGS + 1
    # to begin with, the most frequent words have classes of their own and the others lie with those of their ending
    classes = np.concatenate([np.minimum(np.arange(n_words), CLASSES), CLASSES + np.arange(ENDINGS + 1)]).astype("u1")
    rest = np.arange(CLASSES // 2, n_words)
    classes[rest] = CLASSES // 2 + head.endings[rest] % (CLASSES // 2)
    parts = n_parts(train.sparkSession)
    by_a, by_b = bigrams(train, shared, head.n_ids, parts)
    classes, m = exchange(by_a, by_b, head.counts, classes, k)
    tails, with_tail, kinds = assign(train, classes, m, n_words, parts)
    # bigrams of frequent words and ends alone: those with a tail word are in class k here
    m = _class_bigrams(by_a, np.where(_is_tail(classes), k, classes).astype("u1"), k + 1)[:k, :k] + with_tail
    discard(by_a, by_b)
    size = m.sum(0)  # every token is the second of one bigram
    np.add.at(kinds, classes[:n_words], 1)
    kinds[CLASSES:] += 1  # a word never seen for each ending; the end
    frequency = np.where(kinds > 0, size + 1, 0)  # a class without words never comes
    step = (m + BETA * frequency / frequency.sum()) / (m.sum(1, keepdims=True) + BETA)
    by_class = LAMBDA * step / np.maximum(size + kinds, 1)[None, :]  # counts are raised by one each
    one = (1 - LAMBDA) / (head.total + head.types + 1)
    # behind the classes, the words never seen by their endings: they share what the unigram model has for one
    log_step = np.log10(np.concatenate([by_class + one, by_class[:, CLASSES : CLASSES + ENDINGS] + one / ENDINGS], 1))
    return Model(head.frequent, np.log10(head.counts + 1), classes, log_step, head.end_count, head.total, head.types), tails


def train_model(train: DataFrame, vocab: DataFrame) -> Model:
    """Fits the model on rows with ``_text``; see :func:`fit`, which also gives the classes of the tail."""
    head = head_of(vocab)
    shared = train.sparkSession.sparkContext.broadcast(head.frequent)
    with small_batches(train.sparkSession):
        rows = written(coded(train.select("_text"), shared, head.n_ids), "coded")
    return fit(rows, head, shared)[0]


#: What a token of the tail has for the class of a neighbour that is in the tail too, and for a word that isn't known.
UNKNOWN = 255


def _parted(rows: DataFrame, shared, parts: int) -> DataFrame:  # noqa: ANN001
    """Of :func:`coded` rows what the frequent words alone decide, and what is left to ask. Two kinds of rows:

    0: ``_id, _held`` and a text's ``_tokens``; ``_log, _steps, _known`` summed over its frequent words and end; and for
    each word of the tail its hash (``_tail``), the classes before and after it (``_before, _after``) and its ending (``_ends``).
    1: the distinct hashes (``_tail``) that the texts of one ``_slice`` ask a ``part`` of the table for.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_kind", "_slice", "part", "_id", "_held", "_tokens", "_log", "_steps", "_known", "_tail", "_before", "_after", "_ends"]

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        n_words, end = len(m.frequent), len(m.classes) - 1
        log_of = np.r_[m.log_counts, np.zeros(ENDINGS), np.log10(m.end_count + 1)]
        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def asked(id_type: pa.DataType) -> pa.RecordBatch:
            w = np.unique(np.concatenate(held))
            made = [(i, w[k].tobytes()) for i, k in _by_part(w, parts)]
            n, (part, raw) = len(made), list(zip(*made, strict=True)) or ((), ())
            none = [pa.nulls(n, t) for t in (id_type, pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, 1, "i4")), pa.array(np.full(n, at)), pa.array(part, pa.int32()), *none, pa.array(raw, pa.binary()), *[pa.nulls(n, pa.binary())] * 3], names=names)

        id_type = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, id_type = b.column("_ids").to_pylist(), b.column("_id").type
            row, tail = np.frombuffer(b"".join(ids), "<i4"), _flat(b.column("_tail"), "<i8")
            tokens = np.array([len(x) // 4 for x in ids], dtype="i8")
            starts = np.cumsum(tokens) - tokens
            rare = (row >= n_words) & (row < end)
            c = np.where(rare, UNKNOWN, m.classes[row]).astype("u1")
            before = np.r_[m.classes[end], c[:-1]]  # every text ends with an end
            plain = ~rare & (before != UNKNOWN)
            steps = np.zeros(len(row))
            steps[plain] = m.log_step[before[plain], c[plain]]
            known = np.where(row == end, m.end_count > 0, ~rare)
            log, steps, known = (np.add.reduceat(x, starts) for x in (log_of[row], steps, known.astype("i8")))
            ends = np.cumsum(np.add.reduceat(rare.astype("i8"), starts))
            after = np.r_[c[1:], m.classes[end]]
            made = [pa.array(np.zeros(len(tokens), "i4")), pa.array(np.full(len(tokens), at)), pa.nulls(len(tokens), pa.int32()), b.column("_id"), b.column("_held")]
            made += [pa.array(tokens), pa.array(log), pa.array(steps), pa.array(known), _binary(tail, ends), _binary(before[rare], ends), _binary(after[rare], ends), _binary((row[rare] - n_words).astype("u1"), ends)]
            yield pa.RecordBatch.from_arrays(made, names=names)
            held.append(tail)
            size += len(row)
            if size > TOKENS:
                yield asked(id_type)
                at, held, size = at + 1, [], 0
        if held:
            yield asked(id_type)

    return rows.select("_id", "_held", "_ids", "_tail").mapInArrow(divide, f"_kind int, _slice long, part int, _id {kind}, _held boolean, _tokens long, _log double, _steps double, _known long, _tail binary, _before binary, _after binary, _ends binary")


def _looked_up(parted: DataFrame, tails: DataFrame) -> DataFrame:
    """``(_slice, part, c, n)``: classes and counts of the words that each slice asks each part for, in their order; UNKNOWN
    and 0 for those that ``tails`` hasn't. Counts of the tail are under 2**-18 of all tokens, so 32 bits hold them."""

    def find(part: pd.DataFrame) -> pd.DataFrame:
        table, asked = part[part["_slice"] < 0], part[part["_slice"] >= 0]
        words, of, n = _flat(table["w"], "<i8"), _flat(table["c"], "u1"), _flat(table["n"], "<i8")
        rows = []
        for at, mine, raw in zip(asked["_slice"].tolist(), asked["part"].tolist(), asked["w"], strict=True):
            w = np.frombuffer(raw, "<i8")
            c, count = np.full(len(w), UNKNOWN, "u1"), np.zeros(len(w), "<u4")
            if len(words):
                place = np.minimum(np.searchsorted(words, w), len(words) - 1)
                there = words[place] == w
                c[there], count[there] = of[place[there]], n[place[there]]
            rows.append((at, mine, c.tobytes(), count.tobytes()))
        return pd.DataFrame(rows, columns=["_slice", "part", "c", "n"])

    asked = parted.where("_kind = 1").select("part", "_slice", F.col("_tail").alias("w"), F.lit(b"").alias("c"), F.lit(b"").alias("n"))
    both = tails.select("part", F.lit(-1).cast("long").alias("_slice"), "w", "c", "n").unionByName(asked)
    return both.groupBy("part").applyInPandas(find, "_slice long, part int, c binary, n binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents whose crc32(id as text) mod ``folds`` is ``held_out`` are kept out of training; a null id counts as
    an empty text. Tokens are words (A-Z lower-cased, between ASCII white space) and one end; a null text is its
    end alone. Words are told apart by 64-bit hashes. ``base_score`` is the add-one unigram model's log10
    probability, ``score`` the class model's. An empty table gives an empty table; with no training documents
    every token has the same chance. Equal rows get equal scores.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), as_bytes(text_col).alias("_text"), (~in_training(id_col, folds, held_out)).alias("_held"))
    with small_batches(spark):
        vocab = written(vocabulary(rows.where("NOT _held")), "vocabulary")
        head = head_of(vocab)
        discard(vocab)
        frequent = spark.sparkContext.broadcast(head.frequent)
        whole = written(coded(rows.select("_id", "_text", "_held"), frequent, head.n_ids), "coded", compression="zstd")
    model, tails = fit(whole.where("NOT _held"), head, frequent)
    shared, parts = spark.sparkContext.broadcast(model), n_parts(spark)
    with small_batches(spark):
        parted = written(_parted(whole, shared, parts), "parted", compression="zstd")
        discard(whole)
        found = written(_looked_up(parted, tails), "looked-up", compression="zstd")
    floor = float(np.log10(model.total + model.types + 1))

    def measure(texts: pa.Table, answers: pa.Table) -> pa.Table:
        m: Model = shared.value
        tail, before, after = _flat(texts["_tail"], "<i8"), _flat(texts["_before"], "u1"), _flat(texts["_after"], "u1")
        words, place = np.unique(tail, return_inverse=True)
        of, n = np.full(len(words), UNKNOWN, "u1"), np.zeros(len(words), "i8")
        at_part = {p: (c, k) for p, c, k in zip(*(answers[x].to_pylist() for x in ("part", "c", "n")), strict=True)}
        for i, at in _by_part(words, parts):
            of[at], n[at] = np.frombuffer(at_part[i][0], "u1"), np.frombuffer(at_part[i][1], "<u4")
        found, n = of[place], n[place]
        raw = texts["_tail"].to_pylist()
        size = np.array([len(x) // 8 for x in raw], dtype="i8")
        unseen = found == UNKNOWN
        ends = _flat(texts["_ends"], "u1")
        c = np.where(unseen, CLASSES + ends, found).astype("i8")  # as the word before
        now = np.where(unseen, c + ENDINGS + 1, c)  # never seen
        previous = np.where(before == UNKNOWN, np.r_[0, c[:-1]], before)
        steps = m.log_step[previous, now]
        leaves = after != UNKNOWN  # into a frequent word or the end; a step into the tail is the next word's
        steps[leaves] += m.log_step[c[leaves], after[leaves]]
        text = np.repeat(np.arange(len(size)), size)
        add = lambda x: np.bincount(text, weights=x, minlength=len(size))
        tokens = texts["_tokens"].to_numpy()
        log = texts["_log"].to_numpy() + add(np.log10(n + 1.0))
        made = [texts["_id"], texts["_held"], texts["_tokens"], pa.array(texts["_known"].to_numpy() + add(~unseen).astype("i8")), pa.array(np.full(len(size), m.total, dtype="i8"))]
        made += [pa.array(log - tokens * floor), pa.array(log + texts["_steps"].to_numpy() + add(steps))]
        return pa.Table.from_arrays(made, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = parted.where("_kind = 0").drop("_kind", "part")
    return texts.groupBy("_slice").cogroup(found.groupBy("_slice")).applyInArrow(measure, schema)
