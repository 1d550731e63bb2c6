"""Connected components of a distributed edge list by alternating star contraction, of a short list in one task.

A round of star contraction has ten shuffles or so, and for each the driver keeps a thread of a pool of 1,024 until it was
idle for a minute. Where edges are few, rounds are short, and threads pile up in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm._spark import discard
from tarnsearch.llm._spark import settle_tidy as settle

SHORT = 1 << 20  # edges that one task takes


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node's greater neighbours go to its least neighbour. small: a node and its lesser ones do."""
    if large:
        pairs = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = pairs.join(least, F.col("a") == F.col("node"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def least_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all the edges (a, b): roots go under lesser ones that an edge joins them to, till none is left."""
    found = [x for x in batches if x.num_rows]
    if not found:
        return
    ends = pa.concat_arrays([x.column(k) for k in range(2) for x in found]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    names, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = root = np.arange(len(order))
    a, b = rank[ends.indices.to_numpy()].reshape(2, -1)
    while ((x := root[a]) != (y := root[b])).any():
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    out = pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], ["node", "component"])
    yield from (out.slice(at, 1 << 14) for at in range(0, out.num_rows, 1 << 14))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in the edges (a, b); a component is named by its least node.

    Loops and repeated edges don't matter. Up to SHORT edges go to one task. Of more, each round is written to the shared
    folder; O(log^2 n) rounds are needed.
    """
    now = settle(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    if now.count() <= SHORT:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(least_nodes, f"node {kind}, component {kind}")
    digest = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = digest(now)
    for _ in range(rounds):
        if not before[0]:
            break
        last, now = now, settle(_stars(_stars(now, True), False))
        discard(last)
        after = digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
