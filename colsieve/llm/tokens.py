"""Token ids of texts by a public byte-level BPE vocabulary, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What the pre-tokenizer of byte-level BPE splits at. Fixed value, part of the public vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A longer run of white space goes to the ``tokenizers`` library: ``tiktoken`` fails from a million characters on.
BLANKS = 500_000
_BLANK = re.compile(r"\s{2,}")

_encodings: dict[str, object] = {}


def byte_letters() -> dict[str, int]:
    """The letter that the vocabulary's file writes for each byte: printable ones stand for themselves, others from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids from a ``tokenizer.json`` of byte-level BPE whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} isn't plain byte-level BPE")
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {x["id"] for x in spec["added_tokens"]}
    return {k: v for k, v in ranks.items() if v not in special}


def long_blank(text: str) -> bool:
    """Whether white space runs over BLANKS characters; each run is looked at once."""
    return len(text) >= BLANKS and any(x.end() - x.start() >= BLANKS for x in _BLANK.finditer(text))


def encoder(spark: SparkSession, path: str, special: bool = False) -> Callable[[], Callable[[bytes], np.ndarray]]:
    """For workers: a function from a text's UTF-8 bytes to its ids (uint32), made once in each process.

    Special tokens written out in a text are ordinary text or, with ``special``, tokens, as they are for the
    ``tokenizers`` library unless it is told otherwise. None are added, and bytes that aren't UTF-8 are replaced. Texts
    with such tokens or very long white space are left to that library. The vocabulary goes out as a broadcast; its size is that of a vocabulary file, checked here.
    """
    ranks = load_ranks(path)
    if len(ranks) > 1_000_000:
        raise ValueError("a vocabulary of over a million tokens isn't broadcast")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    added = [x["content"] for x in json.loads(spec)["added_tokens"]] if special else []
    shared = spark.sparkContext.broadcast((ranks, spec))

    def make() -> Callable[[bytes], np.ndarray]:
        import tiktoken

        if path not in _encodings:
            _encodings[path] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=shared.value[0], special_tokens={})
        one = _encodings[path]
        slow = []

        def encode(raw: bytes) -> np.ndarray:
            text = raw.decode("utf-8", "replace")
            if any(x in text for x in added) or long_blank(text):
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_str(shared.value[1]))
                    slow[0].encode_special_tokens = not special
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
            return np.array(one.encode_ordinary(text), dtype="<u4")

        return encode

    return make


def as_bytes(text_col: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def narrow_batches(spark: SparkSession, rows: int = 1024, size: int = 16 << 20) -> None:
    """At most so many rows and bytes to an Arrow batch for the rest of the session, as a frame that is returned runs
    later: whole texts make wide rows, and executors hold a batch's buffers outside the heap."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """While a table is written: fewer rows to an Arrow batch, as whole texts make wide rows, and executors hold a
    batch's buffers outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
