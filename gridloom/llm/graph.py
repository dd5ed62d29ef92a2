"""Connected components by alternating large-star and small-star steps, all in DataFrames. Before the
first and after each, every task draws its own links together in bounded batches, which takes most
of the steps that paths would need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Large: every larger neighbour of a node links to the node's least
    neighbour (or itself). Small: every smaller neighbour and the node itself do."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable by these links) of the nodes that are not the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while ((u := label[x]) != (v := label[y])).any():
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _drawn_together(batches, most: int = 1 << 20):
    """Of about ``most`` links at a time, a link from each node to the least that it reaches."""

    def emit(parts):
        a, b = _least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts, held = [], 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += len(batch)
        if held >= most:
            yield emit(parts)
            parts, held = [], 0
    if parts:
        yield emit(parts)


def _state(edges: DataFrame) -> tuple:
    """Changes whenever a step changes the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long), component being the least
    node reachable. Self-links and repeated edges are harmless; no edges give no rows. Each step
    is written to the shared folder. Nodes without edges are for the caller to add."""
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    now = written(links.mapInArrow(_drawn_together, "a long, b long").distinct(), "cc")
    before = _state(now)
    for _ in range(max_steps):
        if not before[0]:
            break
        now = written(_star(written(_star(now, True), "cc"), False).mapInArrow(_drawn_together, "a long, b long").distinct(), "cc")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
