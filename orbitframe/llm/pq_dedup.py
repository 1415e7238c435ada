"""Embedding near-duplicates by product quantisation and exact rerank.

Unit vectors go to the inverted list of their nearest coarse centroid; what is
left of them is coded by subspace. A vector asks every list that can hold a
neighbour: with r the distance of the wanted cosine, a neighbour's list has its
bisector to the vector's own centroid within r of the vector. In a list, the
asymmetric table distance to a code and the length of what the code misses rule
out members; the rest are compared exactly. So the quantisers, fitted on a
bounded sample, decide the cost and not the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import hot_join, materialize
from orbitframe.llm.graph import connected_components, merge_matrix

#: Vectors that the quantisers are fitted on, about, and how many for each list: the documented bound, 65,536 at most.
SAMPLE, PER_LIST = 20_000, 16
#: Distinct vectors a coarse list should hold, and how many lists there may be; beyond 2 million vectors of one label lists grow.
LIST_ROWS = 512
MOST_LISTS = 4096
SUBSPACES = 8
CODEWORDS = 32
#: Members and askers that one task compares; larger lists are cut into tile pairs.
TILE = 4096
#: Askers of one block of the comparison.
BLOCK = 512
SLACK = 1e-6


def _unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / top
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        mine = (c @ x.T - (c * c).sum(axis=1, keepdims=True) / 2).argmax(axis=0)
        n = np.bincount(mine, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, mine, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Quantizer:
    """Coarse centroids of one dimension and codebooks of the residuals' subspaces."""

    centroids: np.ndarray
    books: list[np.ndarray]
    parts: list[slice]

    @classmethod
    def fit(cls, vectors: np.ndarray, lists: int) -> Quantizer:
        rng = np.random.default_rng(9)
        x = _unit(vectors)
        centroids = _kmeans(x, lists, rng)
        rest = x - centroids[((x @ centroids.T) - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)]
        edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        parts = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        return cls(centroids, [_kmeans(rest[:, p], CODEWORDS, rng) for p in parts], parts)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own list, and all lists that can hold a vector within ``radius``."""
        c = self.centroids
        square = 1 + (c * c).sum(axis=1) - 2 * x @ c.T
        own = square.argmin(axis=1)
        apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0)) if len(c) <= 64 else _distances(c)
        far = (square - square[np.arange(len(x)), own][:, None]) > 2 * (radius + SLACK) * apart[own] + SLACK
        return own, [np.flatnonzero(~row) for row in far]

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and how far the coded residual is from the true one."""
        codes = np.empty((len(rest), len(self.books)), np.uint8)
        missed = np.zeros(len(rest))
        for m, (book, part) in enumerate(zip(self.books, self.parts, strict=True)):
            mine = rest[:, part]
            codes[:, m] = ((mine @ book.T) - (book * book).sum(axis=1) / 2).argmax(axis=1)
            missed += ((mine - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(missed)

    def table_distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances ``(asker, member)``: one table per asker and subspace, looked up by code."""
        out = np.zeros((len(rest), len(codes)))
        for m, (book, part) in enumerate(zip(self.books, self.parts, strict=True)):
            mine = rest[:, part]
            square = (mine * mine).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * mine @ book.T
            out += np.maximum(square, 0)[:, codes[:, m]]
        return np.sqrt(out)


def _distances(c: np.ndarray) -> np.ndarray:
    square = (c * c).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square - 2 * c @ c.T, 0))


def _usable(vec: Column) -> Column:
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vec, lambda x: x != 0), F.lit(False))


def _fit(classes: DataFrame, sizes: dict[int, tuple[int, int]]) -> dict[int, Quantizer]:
    """A quantiser per dimension; lists as many as the largest label fills, since only equal labels are compared."""
    total = sum(n for n, _ in sizes.values())
    wanted = max([SAMPLE, *(PER_LIST * min(MOST_LISTS, most // LIST_ROWS) for _, most in sizes.values())])
    width = 1 << 40
    h = F.pmod(F.xxhash64("label", "vec", F.lit("pq")), F.lit(width))
    rows = classes.where(h < min(width, -(-width * wanted // max(total, 1)))).select("dim", "vec").collect()
    out = {}
    for dim, (_, most) in sizes.items():
        mine = sorted(r["vec"] for r in rows if r["dim"] == dim)
        if mine:
            out[dim] = Quantizer.fit(np.array(mine, float), min(MOST_LISTS, max(1, most // LIST_ROWS)))
        else:  # too few to be drawn: one list, no codes
            out[dim] = Quantizer(np.zeros((1, dim)), [np.zeros((1, dim))], [slice(0, dim)])
    return out


def _index(models: dict[int, Quantizer], radius: float):
    """Adds ``own``, the vector's list, and ``lists``, those of its probes that do not come before it.

    Of two lists the vectors of the earlier ask the later one, so every pair
    across lists meets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _unit(np.stack(rows.column("vec").to_numpy(zero_copy_only=False)).astype(float))
                own, lists = models[int(dim)].probes(x, radius)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("node", "label", "dim", "n", "vec")), pa.array(own.astype(np.int32)), pa.array([p[p >= o].astype(np.int32) for p, o in zip(lists, own, strict=True)], pa.list_(pa.int32()))],
                    ["node", "label", "dim", "n", "vec", "own", "lists"],
                )

    return run


def compare_list(model: Quantizer, coarse: int, askers: np.ndarray, members: np.ndarray, cosine: float, radius: float) -> Iterator[tuple[int, np.ndarray]]:
    """``(first asker, near)`` by blocks of askers; ``near[i, j]`` is exact."""
    center = model.centroids[coarse]
    unit = _unit(members)
    codes, missed = model.encode(unit - center)
    lengths = np.sqrt((members * members).sum(axis=1))
    for at in range(0, len(askers), BLOCK):
        q = askers[at : at + BLOCK]
        maybe = model.table_distances(_unit(q) - center, codes) <= radius + missed + SLACK
        near = np.zeros(maybe.shape, bool)
        rows, cols = maybe.any(axis=1), maybe.any(axis=0)
        if rows.any():
            a, b = q[rows], members[cols]
            exact = (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * lengths[cols])
            near[np.ix_(rows, cols)] = (exact >= cosine) & maybe[np.ix_(rows, cols)]
        yield at, near


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two rows of equal, non-null label link if the cosine of their vectors, in
    double precision, is ``cosine`` or more. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id reachable, ``kept``
    marks the row of that id.

    Rows with a null label or id, or a vector that is null, empty, zero or holds
    null or non-finite components, link with nothing and keep their own id;
    vectors of different lengths do not link; rows of one label and vector are
    one class, so any number of copies costs one comparison; rows that repeat an
    id count like others: they link by their own vectors, not by the id. An empty
    table gives no rows; other columns are ignored.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(F.col("vec"))
    classes = materialize(
        rows.where(usable).groupBy("label", "vec").agg(F.min("vec_id").cast("long").alias("first"), F.count("*").alias("n")).withColumns({"dim": F.size("vec"), "node": F.monotonically_increasing_id()}),
        "pq-classes",
    )
    per_label = classes.groupBy("dim", "label").agg(F.count("*").alias("n"))
    sizes = {r["dim"]: (r["n"], r["most"]) for r in per_label.groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    models = classes.sparkSession.sparkContext.broadcast(_fit(classes, sizes))
    kind = dict(classes.dtypes)["label"]
    shape = f"node long, label {kind}, dim int, n long, vec {dict(classes.dtypes)['vec']}, own int, lists array<int>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _index(models.value, radius)(batches)

    placed = materialize(classes.mapInArrow(index, shape), "pq-index")
    cells = placed.groupBy("label", "dim", F.col("own").alias("list")).agg(F.count("*").alias("m"))
    tiled = materialize(cells.withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int")).drop("m"), "pq-cells")
    key = ["label", "dim", "list"]
    asking = placed.select("node", "label", "dim", "n", "vec", F.lit(True).alias("asks"), "own", F.explode("lists").alias("list"))
    holding = placed.select("node", "label", "dim", "n", "vec", F.lit(False).alias("asks"), "own", F.col("own").alias("list"))
    # A member lies in one tile of its cell, an asker in one too; every pair of tiles is a group.
    tile = F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int")
    all_tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    dealt = (
        asking.unionByName(holding)
        .join(tiled, key)
        .withColumn("at", F.explode(F.transform(all_tiles, lambda t: F.when(F.col("asks"), F.struct(t.alias("a"), tile.alias("b"))).otherwise(F.struct(tile.alias("a"), t.alias("b"))))))
        .select(*key, "at", "node", "n", "vec", "asks", "own")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        coarse, dim = int(pdf["list"].iloc[0]), int(pdf["dim"].iloc[0])
        asks, held = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if asks.empty or held.empty:
            return pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        names, place = np.unique(np.concatenate([asks["node"], held["node"]]), return_inverse=True)
        left, right = place[: len(asks)], place[len(asks) :]
        label, links = np.arange(len(names)), np.zeros(len(names), np.int64)
        counts = held["n"].to_numpy()
        foreign = asks["n"].to_numpy() * (asks["own"].to_numpy() != coarse)
        askers, members = (np.stack(x["vec"]).astype(float) for x in (asks, held))
        for at, near in compare_list(models.value[dim], coarse, askers, members, cosine, radius):
            mine = left[at : at + len(near)]
            near &= mine[:, None] != right[None, :]
            links[mine] += near @ counts
            links[right] += foreign[at : at + len(near)] @ near  # members that did not ask back
            merge_matrix(label, near, mine, right)
        out = np.flatnonzero((links > 0) | (label != np.arange(len(names))))
        return pd.DataFrame({"node": names[out], "links": links[out], "root": names[label[out]]})

    found = materialize(dealt.groupBy(*key, "at").applyInPandas(compare, "node long, links long, root long"), "pq-links")
    reached = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    # The smallest id of each component; only linked classes have one that is not their own.
    ends = materialize(reached.join(classes.select("node", "first"), "node"), "pq-ends")
    least = materialize(ends.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")), "pq-components")
    labelled = hot_join(ends.select("node", "component"), least, ["component"], ends.count()).select("node", "least")
    named = classes.join(linked, "node", "left").join(labelled, "node", "left")
    known = named.select(
        "label",
        "vec",
        "n",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("least", "first").alias("component_id"),
    )
    known = materialize(known, "pq-known")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = hot_join(rows.where(usable), known, ["label", "vec"], total).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
