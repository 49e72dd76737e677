"""Operator 9, packing into windows by best-fit decreasing.

Documents longer than a window are cut into full windows first. What is left is packed in chunks of a few
thousand pieces: longest first, each into the open window that it leaves the least room in, found by a segment
tree over remaining capacities. A chunk leaves a few windows part empty, which is the price for packing any
number of chunks side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.llm.tokens import as_bytes, encoder, narrow_batches
from colsieve.sources.scratch import written

#: Pieces to a chunk, about.
CHUNK = 4096


class Capacities:
    """Open windows by remaining capacity, in a segment tree of counts whose leaves are the capacities."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.counts = [0] * (2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        i = self.half + capacity
        while i:
            self.counts[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A window with the smallest capacity of ``least`` or more, and that capacity."""
        counts, i = self.counts, self.half + least
        while not counts[i]:
            while i & 1:  # a right child: what lies to the right is its parent's right sibling
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.half:
            i = 2 * i if counts[2 * i] else 2 * i + 1
        capacity = i - self.half
        while i:
            counts[i] -= 1
            i >>= 1
        return self.open[capacity].pop(), capacity


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """The window and the offset there of each length; lengths come longest first, 1..window."""
    tree, windows, offsets, n = Capacities(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found, n = (n, window), n + 1
        at, capacity = found
        windows.append(at)
        offsets.append(window - capacity)
        if capacity > length:
            tree.put(capacity - length, at)
    return windows, offsets


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str, special: bool = False) -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, _salt``: each document's ids and ``end_id`` in windows and a rest."""
    narrow_batches(docs.sparkSession)
    make = encoder(docs.sparkSession, tokenizer, special)
    end = np.array([end_id], dtype="<u4")
    rows = docs.select(F.col(id_col).alias("_id"), as_bytes(text_col).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, _salt long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = make(), 0
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([encode(text.as_py()), end])
                raw, n = memoryview(ids.tobytes()), len(ids)
                for s in range(0, n, window):
                    e = min(s + window, n)
                    at.append(i)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                    total.append(n)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, range(salt, salt + len(at))))]
            salt += len(at)
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "start", "length", "ids_crc32", "doc_tokens", "_salt"])

    return rows.mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, special: bool = False) -> DataFrame:
    """One row for each piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    The ids of a document are those of its text and ``end_id``; each lies in one piece. Pieces of one sequence
    lie side by side from offset 0; the rest up to ``window`` is padding. A null or empty text is its end
    alone. Rows with null or equal ids are documents of their own. An empty table gives an empty table. Equal
    lengths are packed in the order of ids. The pieces are written before they are dealt into chunks, and
    chunks depend on a running number too, so that no repeated row makes a large chunk.
    """
    cut = written(pieces(docs, tokenizer, window, end_id, id_col, text_col, special), "pieces")
    n = max(1, -(-cut.count() // chunk))
    dealt = cut.withColumn("_chunk", F.pmod(F.xxhash64("_id", "start", "_salt", "ids_crc32"), F.lit(n)))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "_id", "start", "_salt"], ascending=[False, True, True, True])
        windows, offsets = best_fit(part["length"].tolist(), window)
        part["sequence_id"] = np.array(windows, dtype="i8") * n + key[0]
        part["offset"] = np.array(offsets, dtype="i8")
        return part[["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    kind = cut.schema["_id"].dataType.simpleString()
    packed = dealt.groupBy("_chunk").applyInPandas(fit, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("_id", id_col)
