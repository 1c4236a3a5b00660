"""Connected components of an edge table by alternating large and small stars; those of few edges by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Scratch

#: Edges that one task takes at most, 16 bytes each; the rounds of a small graph would cost more than they spread.
ALONE = 200_000


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node of each one's component: roots hook to lesser neighbouring roots, then paths are cut short, until no edge joins two roots."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        nodes, labels = least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.record_batch({"node": pa.array(nodes), "label": pa.array(labels)})


def components(edges: DataFrame, scratch: Scratch, alone: int = ALONE) -> DataFrame:
    """``edges``: (u long, v long). Returns (node, label): every node that has an edge, and its component's least node.

    Large star: each node links its larger neighbours to the least of its neighbourhood.
    Small star: each node links its smaller neighbours and itself to the least of them.
    Both keep the components; in a logarithm of the longest path's steps the edges are stars.
    Nothing is collected; each step is written to the shared folder. Null ends, loops and repeats are dropped; no edge gives no row.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.count() <= alone:
        return scratch.save(now.coalesce(1).mapInArrow(_alone, "node long, label long"))
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _least(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).distinct()
        later = scratch.save(small)
        scratch.drop(now)
        now = later
        reached = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(reached) == state:
            break
        state = tuple(reached)
    stars = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return scratch.save(stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
