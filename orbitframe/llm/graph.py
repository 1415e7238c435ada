"""Connected components over an edge table, without bringing any of it to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import HOT_ROWS, hot_join, materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, component long)``.

    ``component`` is the smallest node reachable. Nodes without an edge do not
    appear; loops and repeated edges are harmless; null ends are ignored; no
    edges give no rows. Alternates large-star and small-star steps: each is one
    map-side-combined ``min`` per node and one equi-join. The minima of hubs are
    broadcast to their edges (``common.hot_join``), so no task gets all
    neighbours of one node. Every round is written to the shared folder; rounds
    grow with the logarithm of the longest path.
    """
    down = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    current = materialize(down, "cc")
    state = _state(current)
    while state[0]:
        step = materialize(_small_star(_large_star(current, state[0]), state[0]), "cc")
        after = _state(step)
        release(current)
        current = step
        if after == state:
            break
        state = after
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)),
    ).first()
    return (row[0], int(row[1]))


def _least(edges: DataFrame, ends: DataFrame, count: int) -> DataFrame:
    """``edges`` with ``m``, the smallest other end that ``ends`` gives their ``u``; of ``count`` rows at most, about."""
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if count <= HOT_ROWS:
        return edges.join(least.drop("n"), "u")
    return hot_join(edges, least, ["u"], count)


def _large_star(down: DataFrame, count: int) -> DataFrame:
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = both.where("v > u")
    return _least(up, both, 2 * count).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(down: DataFrame, count: int) -> DataFrame:
    joined = _least(down, down, count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(down.groupBy("u").agg(F.min("v").alias("v"))).distinct()


# ------------------------------------------------------- inside one task


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labelled sets of ``a[i]`` and ``b[i]`` in place; a set's label is its smallest member."""
    parent = np.arange(len(label))
    while True:
        x, y = parent[label[a]], parent[label[b]]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (jump := parent[parent]).tobytes() != parent.tobytes():
            parent = jump
    label[:] = parent[label]


def merge_matrix(label: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join ``left[i]`` and ``right[j]`` wherever ``near[i, j]``, a spanning part of the links at a time."""
    while (near := near & (label[left][:, None] != label[right][None, :])).any():
        rows, cols = near.any(axis=1), near.any(axis=0)
        a = np.concatenate([left[rows], left[near.argmax(axis=0)[cols]]])
        b = np.concatenate([right[near.argmax(axis=1)[rows]], right[cols]])
        merge_labels(label, a, b)
