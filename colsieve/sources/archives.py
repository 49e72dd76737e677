"""Arrays and files inside archives, through Spark's binary reader: a task for each archive, nothing is unpacked to disk."""

from __future__ import annotations

import fnmatch
import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_tar(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(archive, name, content)`` of the regular files in tar archives, compressed or not, whose names match."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile() and fnmatch.fnmatch(m.name, pattern):
                            yield pa.RecordBatch.from_arrays([pa.array([archive.as_py()]), pa.array([m.name]), pa.array([tar.extractfile(m).read()], pa.binary())], names=["archive", "name", "content"])

    return files.mapInArrow(members, "archive string, name string, content binary")


def read_npz(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``(row, values)``: one array of an npz archive, each index of its first axis a row of doubles."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as archive:
                    a = archive[name].astype("f8")
                a = a.reshape(len(a), -1)
                for start in range(0, len(a), 1024):
                    part = a[start : start + 1024]
                    offsets = np.arange(len(part) + 1, dtype="i4") * a.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))], names=["row", "values"])

    return files.mapInArrow(load, "row long, values array<double>")
