"""Connected components by contraction, for graphs of any degree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plexframe.session import Scratch

#: Edges that one task contracts in memory at a time.
CHUNK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) that connect what the edges (a, b) connect."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all() and (root[a] == root[b]).all():
            break
    away = np.flatnonzero(root != np.arange(len(names)))
    return names[away], names[root[away]]


def _local(batches):
    """Replaces a partition's edges by star edges, chunk by chunk."""
    held: list[pa.RecordBatch] = []
    n = 0

    def flush():
        table = pa.Table.from_batches(held)
        a, b = forest(table["a"].to_numpy(), table["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            held = [flush()]
            n = held[0].num_rows
            if n >= CHUNK // 2:
                yield held.pop()
                n = 0
    if held:
        yield flush()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node that an edge (a, b) of longs touches; the component is its smallest node.

    Every round contracts each partition's edges to stars, points each
    node to the smallest neighbour, jumps along the pointers and renames the
    edges by them, until no edge joins two components. Nulls and loops
    link nothing.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    links = scratch.write(links.mapInArrow(_local, "a long, b long"), "edges")
    names: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        up = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "up")
        while True:  # pointer jumping; a pointer only leads to smaller nodes
            jump = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))
            done = scratch.write(jump, "jump")
            still = up.join(done.withColumnRenamed("up", "now"), "node").where("up != now").isEmpty()
            scratch.drop(up)
            up = done
            if still:
                break
        to = lambda c: up.select(F.col("node").alias(c), F.col("up").alias("n" + c))
        renamed = links.join(to("a"), "a").join(to("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).where("a != b").distinct()
        last, links = links, scratch.write(renamed.mapInArrow(_local, "a long, b long"), "edges")
        scratch.drop(last)
        if names is None:
            names = up
            continue
        last, names = names, scratch.write(names.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up", "left").select("node", F.coalesce("next", "up").alias("up")), "names")
        scratch.drop(last, up)
    scratch.drop(links)
    if names is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    out = names.select("node", F.col("up").alias("component"))
    out._scratch_path = names._scratch_path
    return out
