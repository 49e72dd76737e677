"""Connected components of undirected links, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.sources.scratch import discard, written

#: Links that a task holds at once. A graph with no more is solved by one task, others by rounds of joins until as few are left.
AT_ONCE = 1 << 17


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link; ``component`` is the smallest node that it reaches.

    Each task first leaves a forest of its own links, so no link moves that others of the task stand for. If at most
    AT_ONCE are left, one task hangs every node on its smallest. Else alternating large-star and small-star
    steps (Kiveris et al. 2014): every step hangs nodes on the smallest neighbour, so the number of steps grows with
    the logarithm of the longest path. Minima are summed up in
    each task before they move, links are written after each round, and only counts reach the driver. Null ends and links of a node with itself are ignored, repeated links count once.
    """
    rows = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    rows = rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows = written(_stars(rows, with_roots=False), "links")
    kind = links.schema[a].dataType
    while (n := rows.count()) > AT_ONCE and not _is_forest_of_stars(rows):
        # large star: every larger neighbour hangs on the smallest of a node and its neighbours
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of those
        before, large = rows, written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        rows = least.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        rows = written(rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
        discard(before, large)  # the next round reads this one's table alone
    if n <= AT_ONCE:
        out = _stars(rows.coalesce(1), with_roots=True).select(F.col("u").alias("node"), F.col("v").alias("component"))
    else:
        roots = rows.select(F.col("v").alias("node")).distinct()
        out = rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    return out.select(F.col("node").cast(kind), F.col("component").cast(kind))


def _is_forest_of_stars(rows: DataFrame) -> bool:
    """Whether each larger end has one link, to a node that is never a larger end itself."""
    links, ends = rows.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
    return links == ends and rows.join(rows.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def smallest_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of 0..n-1 reaches by the links ``(u, v)``."""
    up = np.arange(n)
    while (apart := up[u] != up[v]).any():
        # both ends are roots here: the larger one hangs on the smallest that it is linked with
        u, v = u[apart], v[apart]
        np.minimum.at(up, np.maximum(up[u], up[v]), np.minimum(up[u], up[v]))
        while (up[up] != up).any():
            up = up[up]
    return up


def _stars(rows: DataFrame, with_roots: bool) -> DataFrame:
    """``(u, v)``: of each AT_ONCE links that a task reads, every node and the smallest that it reaches; ``with_roots`` those too that reach no smaller one."""

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in _at_once(batches):
            ends = [c.to_numpy(zero_copy_only=False) for c in (links.column(0).combine_chunks(), links.column(1).combine_chunks())]
            nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
            up = smallest_reached(*at.reshape(2, -1), len(nodes))
            out = np.arange(len(nodes)) if with_roots else np.flatnonzero(up != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[x], links.schema.field(0).type) for x in (out, up[out])], names=["u", "v"])

    return rows.mapInArrow(hang, rows.schema)


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for whole in batches:
        for batch in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
            if n + batch.num_rows > AT_ONCE:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def add_links(components: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``components`` of a graph after more ``links``: what is joined is as many rows as there are new links, not old ones."""
    side = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    named = links.select(F.col(a).alias("a"), F.col(b).alias("b")).join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = named.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
    merged = connected_components(between)
    roots = merged.select(F.col("node").alias("component"), F.col("component").alias("_root"))
    moved = components.join(roots, "component", "left").select("node", F.coalesce("_root", "component").alias("component"))
    return moved.unionByName(merged.join(components.select("node"), "node", "left_anti").select("node", "component"))
