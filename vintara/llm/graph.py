"""Connected components of a large edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import cut

#: Edges that one task joins on its own before the shuffled rounds.
LOCAL_EDGES = 100_000


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of one task as stars: each node with the smallest node it reaches by them. Bounded pieces are joined at a time."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = np.arange(len(nodes))
        x, y = at[: len(a)], at[len(a) :]
        while True:
            low = np.minimum(root[x], root[y])
            if (root[x] == low).all() and (root[y] == low).all():
                break
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        other = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= 2 * LOCAL_EDGES:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` (longs); component is the smallest node reachable.

    Each task first joins the edges it holds, a bounded number; edges that all fit one such task are
    then done. Otherwise rounds of the large-star and small-star steps follow until no edge changes:
    each node's larger, then smaller, neighbours are hung on its smallest one. Minima are
    pre-aggregated before the shuffle and joined back, so a node with very many neighbours is never
    gathered. Every round is written to the checkpoint folder. Self-loops and null ends are ignored;
    no edges give no rows.
    """
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        tasks = max(1, -(-e.count() // LOCAL_EDGES))
        e = e.coalesce(tasks).mapInArrow(local_stars, "a long, b long")
        if tasks == 1:
            e = cut(e)
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a")
        e = cut(e.select("a", F.col("m").alias("b")).union(e.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops).distinct()
