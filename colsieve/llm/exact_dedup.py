"""Operator 1, exact dedup: a log-structured merge index of text digests.

Every scan task is a memtable: it sorts the digests of the rows it has read and flushes them as one run, a
Parquet file with a Bloom filter and minimum and maximum of the digest. Compaction merges the runs of a level into
one of the next, partial aggregates first, and keeps one identifier for each digest; a level's parts are ranges of
the digest, each in order. Digests that came more than once are hits; a filter over them, sized by their number, lets
the second scan pass on the texts of possible hits alone, whose bytes are compared, so that two texts with one digest
stay apart.

:class:`DigestIndex` keeps levels from one batch of documents to the next: a batch is looked up in the older runs
through their ranges and filters, and a run that can't have any of its digests isn't read.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.llm.skew import attach, bitmap, filter_bits, marked, maybe_in, split
from colsieve.sources.scratch import written

def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: A run's own filters, for readers that look digests up in its files.
BLOOM = {"parquet.bloom.filter.enabled#_digest": "true", "parquet.bloom.filter.expected.ndv#_digest": "100000"}


def flush_runs(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One sorted run with its filter for each scan task; ids and digests only."""
    rows = docs.select(F.col(id_col).alias("_id"), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("_digest"))
    return written(rows.sortWithinPartitions("_digest"), "lsm-runs", **BLOOM)


def merged(runs: DataFrame, keep: str) -> DataFrame:
    """``(_digest, _keep, _n)`` of rows with these columns, one for each digest. Rows are summed up in each task before
    they move, so copies don't meet in one task."""
    best = F.max if keep == "max" else F.min
    return runs.groupBy("_digest").agg(best("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def compact(runs: DataFrame, keep: str) -> DataFrame:
    """The runs of the memtables merged into the first level."""
    return written(merged(runs.select("_digest", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n")), keep), "lsm-level")


@dataclass
class Run:
    """A sorted table of digests, its level, smallest and largest digest, filter and number of rows."""

    level: int
    rows: DataFrame
    low: str
    high: str
    filter: DataFrame
    bits: int
    n: int


class DigestIndex:
    """An index that grows batch by batch; ``keep`` (min or max) is the identifier that stays for a digest.

    ``add`` returns one row for each digest of a batch, ``_digest, _keep, _n``, over this batch and all before it. Runs
    are merged once ``fanout`` lie on a level, so a digest is rewritten as often as there are levels. ``skipped`` counts
    the runs that the last batch needn't read. A null text counts as empty, null ids stay only where there are no others,
    and an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, keep: str = "min", fanout: int = 4, digest: Callable[[Column], Column] = sha256):
        self.spark, self.keep, self.fanout, self.digest, self.runs, self.skipped = spark, keep, fanout, digest, [], 0

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        batch = compact(flush_runs(docs, id_col, text_col, self.digest), self.keep)
        found = self._found(batch)
        self._put(0, batch)
        return merged(batch.unionByName(found), self.keep) if found is not None else batch

    def _found(self, batch: DataFrame) -> DataFrame | None:
        """What the runs have of a batch's digests."""
        low, high = batch.agg(F.min("_digest"), F.max("_digest")).first()
        self.skipped, parts = 0, []
        for run in self.runs:
            maybe = None
            if low is not None and run.low <= high and low <= run.high:
                maybe = marked(batch.where(F.col("_digest").between(run.low, run.high)), run.filter, "_digest", run.bits).where("_maybe").select("_digest")
                maybe = written(maybe, "lsm-asked")
            if maybe is None or maybe.isEmpty():
                self.skipped += 1
            else:
                parts.append(run.rows.join(maybe, "_digest", "left_semi"))
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def _put(self, level: int, rows: DataFrame) -> None:
        n, low, high = rows.agg(F.count(F.lit(1)), F.min("_digest"), F.max("_digest")).first()
        if not n:
            return
        sorted_rows = written(rows.repartitionByRange("_digest").sortWithinPartitions("_digest"), f"lsm-{level}", **BLOOM)
        bits = filter_bits(n)
        self.runs.append(Run(level, sorted_rows, low, high, written(bitmap(sorted_rows, "_digest", bits), "lsm-filter"), bits, n))
        same = [r for r in self.runs if r.level == level]
        if len(same) >= self.fanout:
            self.runs = [r for r in self.runs if r.level != level]
            union = same[0].rows
            for r in same[1:]:
                union = union.unionByName(r.rows)
            self._put(level + 1, merged(union, self.keep))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, keep_id, group_size, kept, digest``.

    Rows whose texts are the same bytes form a group; ``keep`` (min or max) says which id of it stays. A null
    text counts as empty. Null ids are allowed: they never stay unless all ids of the group are null, and
    then ``kept`` is false and ``keep_id`` null. Repeated ids stay together, both kept if theirs is the id
    that stays. An empty table gives an empty table. Other columns of ``docs`` are not looked at.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    best = F.max if keep == "max" else F.min
    runs = flush_runs(docs, id_col, text_col, digest)
    level = compact(runs, keep)
    hits = level.where("_n > 1")

    # Byte verification of the hits. Copies are merged in the task that has read them.
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = texts.withColumn("_digest", digest(F.col("_text")))
    groups = maybe_in(texts, hits, "_digest").groupBy("_digest", "_text").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = written(groups.select("_digest", "_keep", "_n"), "lsm-verified")
    several = groups.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_digest")
    one, plain, apart = groups.where("_n > 1"), runs, None
    if not several.isEmpty():  # digests of more than one text: their rows are told apart by the bytes
        mixed = texts.join(several, "_digest", "left_semi")
        classes = mixed.groupBy("_digest", "_text").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        apart = mixed.join(classes, ["_digest", "_text"]).select("_id", "_digest", "_keep", "_n")
        one, plain = one.join(several, "_digest", "left_anti"), runs.join(several, "_digest", "left_anti")

    found = attach(plain, one.withColumn("_size", F.col("_n")), "_digest", "_n", "_id")
    found = found.select("_id", "_digest", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_size", F.lit(1)).alias("_n"))
    both = found.unionByName(apart) if apart is not None else found
    return both.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("_keep"), F.lit(False)).alias("kept"),
        F.col("_digest").alias("digest"),
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each text: the one with the largest (or smallest) id.

    Of rows with that id too, and where all ids are null, the row whose other columns sort last stays. Texts are
    compared byte by byte, null as empty. Rows that the filter rules out as copies are not shuffled.
    """
    names = docs.columns
    level = compact(flush_runs(docs, id_col, text_col, sha256), keep)
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    maybe, alone = split(aside.withColumn("_digest", sha256(F.col("_text"))), level.where("_n > 1"), "_digest")
    if keep == "max":
        order = F.struct(F.col("_id"), F.col("_row"))
        best = maybe.groupBy("_text").agg(F.max(order).alias("_o"))
    else:
        order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))
        best = maybe.groupBy("_text").agg(F.min(order).alias("_o"))
    rows = alone.select("_row").unionByName(best.select(F.col("_o._row").alias("_row")))
    return rows.select(*[F.col("_row")[c].alias(c) for c in names])
