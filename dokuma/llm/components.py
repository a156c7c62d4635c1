"""Connected components of a link table: union-find over the links that meet in a task, and jumps to the
parent's parent between tasks, in turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import trimmed
from dokuma.session import forget, stage

#: Links that a task settles at a time.
HELD = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (u, v) but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _settled(links: DataFrame, held: int) -> DataFrame:
    """u, v: stars (u > v) with the same components as the links (u, v) of each task; never more than these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, n = [], [], 0

        def out() -> pa.RecordBatch:
            u, v = stars(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for lo in range(0, batch.num_rows, held):
                part = batch.slice(lo, held)
                us.append(part.column(0).to_numpy(zero_copy_only=False))
                vs.append(part.column(1).to_numpy(zero_copy_only=False))
                n += part.num_rows
                if n >= held:
                    yield out()
                    us, vs, n = [], [], 0
        if n:
            yield out()

    return links.mapInArrow(trimmed(run), "u long, v long")


def components(links: DataFrame, rounds: int = 60, held: int = HELD) -> DataFrame:
    """node, root of every node that some link (a, b) names; root is the least node of its component.

    A task settles what it holds, `held` links at a time, so that a node has one parent for each such part and no
    node's links must be in one place. Links then meet by child, where further parents become links of
    their own, and jump to their parent's least parent by a join on the parent. A parent of very many links is a
    skewed side, which AQE splits, as the next shuffle by child does away with the join's order. The number
    of links never grows. Links of a node with itself, repeated and reversed links are allowed; no links
    give an empty table.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stage(_settled(_settled(links.select(u, v).where("u <> v"), held).repartition("u"), held), "links")
    for _ in range(rounds):
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
        above = edges.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("v"), "w")
        jumped = edges.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        last, edges = edges, stage(_settled(jumped.repartition("u"), held), "links")
        forget(last)
    else:
        raise RuntimeError("the components have not settled")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
