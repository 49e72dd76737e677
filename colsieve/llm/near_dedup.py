"""Operator 3, near-duplicates by HyperMinHash.

1. Every document gets its shingle count, a digest of its shingle set and 256 compressed registers.
2. Documents of one set are one class; its smallest id stands for it, and copies go no further.
3. Registers are cut into bands, 36 of 7 at 0.85 and 51 of 5 at 0.80. Classes that share a band meet in its bucket, where each is compared with
   the bucket's centre by the corrected estimate, never with all others. Centres that are similar at all (over
   ATTACH) tie their class into one neighbourhood. A class leaves the bucket only if the centre is so close that
   whatever is linked with the class is tied to the centre too. The others meet again by size, with more centres
   each time, until every bucket lies in one neighbourhood or is used up: none is capped. Once all pairs that are left
   are no more than the first round's and no bucket is larger than a block, they are all compared, which ends the rounds.
4. The classes of a neighbourhood get their full sets again, and are compared in blocks: pairs whose estimate may
   reach the threshold are confirmed on the full sets unless they are connected already. A block returns a
   spanning forest of confirmed links, never all pairs.
5. Components of the links give the result.

Every table has a row for a class, a band of a class or a pair with a centre, and every join has one side with at most as
many rows of a key as a bucket has centres; the other side may hold a third of all rows, and is split by Spark's adaptive
skew joins, which are on by default and which this relies on. Sums by key are added up in each task first. Tables of a round
are deleted when the next round has its own.

At similarity s a band of r registers is shared with chance s**r. Bands are as long as they may be for at most MISSED
of the pairs at the threshold to share none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.llm.shingles import REGISTERS, WordHashes, least_estimate, registers, shingle_set, similarity
from colsieve.llm.skew import attach, maybe_in
from colsieve.llm.tokens import as_bytes, narrow_batches
from colsieve.operators.graph import add_links, connected_components
from colsieve.sources.scratch import discard, written

#: Share of the pairs at the threshold that may share no band.
MISSED = 1e-6
#: Estimates from here on tie classes into a neighbourhood.
ATTACH = 0.35
#: Classes to a block, so at most so many pairs of sets meet in a task.
BLOCK = 512


def band_length(threshold: float) -> int:
    """Registers to a band."""
    return max((r for r in range(2, 33) if (1 - threshold**r) ** (REGISTERS // r) <= MISSED), default=1)


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), as_bytes(text_col).alias("_text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = WordHashes()
        for batch in batches:
            n, digest, regs = [], [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), seen)
                n.append(len(hashes))
                digest.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                regs.append(registers(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["_id", "_n", "_digest", "_regs"])

    return written(rows.mapInArrow(sketch, "_id long, _n long, _digest binary, _regs binary"), "sketches")


def _neighbours(classes: DataFrame, threshold: float) -> DataFrame | None:
    """``(node, component)``: neighbourhoods such that every pair over the threshold that shares a band lies in one."""
    band = band_length(threshold)
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // band - 1)), lambda i: F.xxhash64(i, F.substring(F.col("_regs"), i * (2 * band) + 1, F.lit(2 * band))))
    rows = classes.select(F.explode(bands).alias("_key"), "_rep", "_n")
    left = _shared(rows, "_rep")
    found, centres, first = None, 1, None
    while (size := _size(left))[0]:
        n, pairs, largest = size
        first = first or n
        few = pairs <= first and largest <= BLOCK  # no more pairs than the first round has, and no more to a bucket than to a block
        tops = _members(left) if few else written(_centres(left, centres), "centres")
        pairs = left.join(tops, "_key").where("_label <> _other" if "_label" in left.columns else "_rep <> _c")
        pairs = pairs.where("_rep < _c") if few else pairs
        wanted = pairs.select(F.least("_rep", "_c").alias("a"), F.greatest("_rep", "_c").alias("b")).distinct()
        near = written(_estimated(wanted, classes, threshold), "near")
        known, found = found, written(connected_components(near) if found is None else add_links(found, near), "neighbourhoods")
        if few:
            discard(left, near, *([known] if known is not None else []))
            break
        # who is this close to a centre is tied by it to whatever it is linked with (1 - similarity is a metric)
        close = near.where("close").select("a", "b")
        done = left.join(tops, "_key").select("_key", "_rep", F.least("_rep", "_c").alias("a"), F.greatest("_rep", "_c").alias("b")).join(close, ["a", "b"]).select("_key", "_rep")
        done = done.unionByName(tops.select("_key", F.col("_c").alias("_rep"))).distinct()
        rest = left.drop("_label").join(done, ["_key", "_rep"], "left_anti")
        if centres == 1:  # linked classes are alike in size: each goes into its own size's part and the next
            level = F.floor(F.ln("_n") / F.lit(math.log(1 / threshold))).cast("int")
            rest = rest.withColumn("_level", F.explode(F.array(level, level + 1))).withColumn("_key", F.xxhash64("_key", "_level")).drop("_level")
        labelled = rest.join(found.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("_label", F.coalesce("component", "_rep")).drop("component")
        before, left = left, _shared(labelled, "_label")
        discard(before, tops, near, *([known] if known is not None else []))  # what is left is all that the next round reads
        centres *= 2
    return found


def _shared(rows: DataFrame, of: str) -> DataFrame:
    """The rows of buckets with more than one ``of``."""
    several = rows.groupBy("_key").agg(F.min(of).alias("_a"), F.max(of).alias("_b")).where("_a < _b").select("_key")
    return written(rows.join(several, "_key"), "bands")


def _size(left: DataFrame) -> tuple[int, float, int]:
    """Rows of all buckets, pairs within them, and rows of the largest bucket."""
    m = F.col("count")
    return tuple(x or 0 for x in left.groupBy("_key").count().agg(F.sum(m), F.sum(m.cast("double") * (m - 1) / 2), F.max(m)).first())


def _members(left: DataFrame) -> DataFrame:
    """Like :func:`_centres`, with every class of a bucket as a centre."""
    return left.select("_key", F.col("_rep").alias("_c"), F.col("_label" if "_label" in left.columns else "_rep").alias("_other"))


def _centres(left: DataFrame, centres: int) -> DataFrame:
    """``(_key, _c, _other)``: one class of each of so many parts of a bucket, and its neighbourhood so far."""
    own = F.struct(F.xxhash64("_key", "_rep").alias("h"), F.col("_rep").alias("r"), (F.col("_label") if "_label" in left.columns else F.col("_rep")).alias("l"))
    part = F.pmod(F.xxhash64("_rep", "_key", F.lit(centres)), F.lit(centres)).alias("_part")
    tops = left.groupBy("_key", part).agg(F.min(own).alias("_o"))
    return tops.select("_key", F.col("_o.r").alias("_c"), F.col("_o.l").alias("_other"))


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` that are similar at all, and which of them are close."""
    side = lambda x: classes.select(F.col("_rep").alias(x), F.col("_regs").alias(f"_r{x}"), F.col("_n").alias(f"_n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            regs = [np.frombuffer(b"".join(x[n].to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for n in ("_ra", "_rb")]
            s, draws = similarity(*regs, x["_na"].to_numpy(), x["_nb"].to_numpy())
            attach = np.minimum(ATTACH, least_estimate(threshold, draws))
            tied = s >= attach
            close = s >= attach + (1 - threshold) + 0.1
            yield pa.RecordBatch.from_arrays([x["a"].filter(pa.array(tied)), x["b"].filter(pa.array(tied)), pa.array(close[tied])], names=["a", "b", "close"])

    return both.select("a", "b", "_ra", "_rb", "_na", "_nb").mapInArrow(estimate, "a long, b long, close boolean")


class Forest:
    """Union of classes by their positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def forest_of_links(ids: list[int], sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between classes of one block, or of two blocks (``side`` 0 and 1) across.

    Pairs are taken by falling estimate; one that is connected already is skipped, any other whose estimate may
    be the threshold's is confirmed: 100 * shared >= percent * union on the full sets.
    """
    n = np.array([len(s) for s in sets])
    regs = np.stack([registers(s) for s in sets])
    sides = np.array(side)
    two = len(set(side)) > 1
    found = []
    for i in range(len(ids) - 1):
        others = np.arange(i + 1, len(ids))
        if two:
            others = others[sides[others] != sides[i]]
        # sizes alone rule out most pairs
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        if not len(others):
            continue
        s, draws = similarity(regs[others], regs[i][None, :], n[others], np.array([n[i]]))
        may = s >= least_estimate(percent / 100, draws)
        found.append((s[may].astype("f4"), np.full(int(may.sum()), i, dtype="i4"), others[may].astype("i4")))
    forest, links = Forest(len(ids)), []
    if not found:
        return links
    s, first, second = (np.concatenate(v) for v in zip(*found, strict=True))
    for at in np.lexsort((second, first, -s)):
        i, j = int(first[at]), int(second[at])
        if forest.root(i) == forest.root(j):
            continue
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
            forest.join(i, j)
            links.append((ids[i], ids[j]))
    return links


def _confirmed(docs: DataFrame, neighbourhoods: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Links ``(a, b)`` between the classes of each neighbourhood, as spanning forests of its blocks."""
    sizes = neighbourhoods.groupBy("component").agg(F.count(F.lit(1)).alias("_m"))
    members = neighbourhoods.join(sizes, "component").withColumn("_blocks", F.ceil(F.col("_m") / BLOCK).cast("int"))
    members = written(members.withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).select(F.col("node").alias("_id"), "component", "_m", "_blocks", "_block"), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), as_bytes(text_col).alias("_text"))
    texts = maybe_in(texts, members, "_id").join(members.select("_id"), "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            sets = [shingle_set(x.as_py(), seen).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["_id", "_set"])

    sets = texts.mapInArrow(hashed, "_id long, _set binary").join(members, "_id")
    # a block meets itself and every other: (i, j) with i <= j; small neighbourhoods share a task
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    met = sets.select("*", other).withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other"))
    total = members.count()
    tasks = max(1, -(-total // BLOCK))
    key = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string")).otherwise(F.concat_ws("-", F.lit("b"), F.col("component").cast("string"), F.col("_i").cast("string"), F.col("_j").cast("string")))
    met = met.select(key.alias("_task"), "component", "_id", "_set", (F.col("_block") != F.col("_i")).cast("int").alias("_side"))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in part.groupby("component", sort=False):
            g = g.sort_values("_id")
            links += forest_of_links(g["_id"].tolist(), [np.frombuffer(x, dtype="u8") for x in g["_set"]], g["_side"].tolist(), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return met.groupBy("_task").applyInPandas(block, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Documents are linked if 100 * shared >= percent * union of their distinct five-word shingles (A-Z lower-cased,
    words between ASCII white space; fewer words are one shingle). ``component_id`` is the smallest id that links
    reach. Texts without words, null ones too, have no shingles and are linked with nothing. Rows of one id
    share a component if their texts do; of such rows with different texts, one text may be compared for both,
    so ids should be unique. A null id stays null and not kept; an empty table gives an empty table.
    """
    narrow_batches(docs.sparkSession)
    sketches = _sketches(docs, id_col, text_col)
    kinds = sketches.where("_n > 0 AND _id IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.first("_regs").alias("_regs"), F.first("_n").alias("_n"))
    kinds = written(kinds, "classes")
    neighbourhoods = _neighbours(kinds.select("_rep", "_regs", "_n"), percent / 100)
    roots = None
    if neighbourhoods is not None:
        links = written(_confirmed(docs, neighbourhoods, id_col, text_col, percent), "confirmed")
        roots = connected_components(links)
    classes = kinds.select("_digest", "_rep", "_copies")
    classes = classes.join(roots.withColumnRenamed("node", "_rep"), "_rep", "left") if roots is not None else classes.withColumn("component", F.lit(None).cast("long"))
    classes = written(classes.select(F.hex("_digest").alias("_kind"), "_copies", F.coalesce("component", "_rep").alias("component_id")), "components")
    rows = sketches.select("_id", "_n", F.coalesce(F.hex("_digest"), F.concat(F.lit("none"), F.col("_id").cast("string"))).alias("_kind"))
    # a class of one row that is linked with nothing needs no join
    known = attach(rows, classes, "_kind", "_copies", "_id")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return known.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"))
