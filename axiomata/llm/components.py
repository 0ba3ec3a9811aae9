"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomata.llm.tables import Scratch

#: Links that one task contracts at a time.
PER_TASK = 1_000_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of some links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while True:  # straight to the root
            jump = after[after]
            if (jump == after).all():
                break
            after = jump
        if (after == root).all():
            return nodes, nodes[root]
        root = after


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if got:
        nodes, root = labels(np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got]))
        moved = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], names=["u", "v"])


def components(links: DataFrame, scratch: Scratch, per_task: int = PER_TASK) -> DataFrame:
    """(id, root) of every node of ``links`` (a, b) that isn't the smallest of its component.

    Tasks contract up to ``per_task`` links each. Between rounds every node takes its smallest
    parent, its other parents are linked to that one, and parents are replaced by theirs, which
    halves distances; a hot root is only ever the large side of a join. Ends when no parent has
    a parent.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = scratch.keep(links.select(u, v).where("u <> v").distinct())
    while True:
        n = edges.count()
        parts = max(1, -(-n // per_task))
        dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts, "u")
        edges = scratch.keep(dealt.mapInArrow(_contracted, "u long, v long").distinct())
        if parts == 1:
            break
        parents = edges.groupBy("u").agg(F.min("v").alias("p"))
        several = edges.join(parents, "u").where("v <> p").limit(1).count()
        chained = edges.join(parents.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not several and not chained:
            break
        up = edges.join(parents, "u")
        linked = up.select("u", F.col("p").alias("v")).unionByName(up.where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v")))
        above = parents.select(F.col("u").alias("v"), F.col("p").alias("pp"))
        jumped = linked.join(above, "v", "left").select("u", F.coalesce("pp", "v").alias("v"))
        edges = scratch.keep(jumped.where("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
