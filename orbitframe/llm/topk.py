"""Exact maximum-inner-product search with a KD-tree in every shard.

Shards are spatial: medians of a bounded sample split the space into cells, and
every cell knows the tight box of all its vectors. A query first searches the
cell whose box promises most; its k-th score then decides which other boxes are
worth asking, the most promising before the rest. In a shard, medians split the
vectors further into boxes with tight bounds; a query walks them best first and
stops where the largest score a box can hold is below the k-th it has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm.common import blocks_for, materialize

#: Vectors of a cell, about, and queries of a block: what one task holds at a time.
CELL_ROWS = 1024
QUERY_ROWS = 8192
LEAF_ROWS = 256
#: Cells at most; a cell of more than ``SHARD_ROWS`` vectors (or a share of all, in very large tables) is several shards.
MOST_CELLS = 4096
SHARD_ROWS = 2048
MOST_SHARDS = 1 << 14
#: Bytes of vectors that a shard may hold, and that the sample for the splits may bring to the driver.
SHARD_BYTES = 1 << 25
#: Vectors that the splits are taken from, for each cell.
PER_CELL = 16
#: Cells that a query asks before its k-th score is looked at again.
SECOND_LOOK = 8
LARGEST = 2**63 - 1


# ----------------------------------------------------------------- in a shard


@dataclass
class KdTree:
    """Nodes in arrays; a leaf has no left child and holds ``order[start:stop]``."""

    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    order: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF_ROWS) -> KdTree:
        order = np.arange(len(points))
        low, high, left, right, start, stop = [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            mine = points[order[a:b]]
            low.append(mine.min(axis=0))
            high.append(mine.max(axis=0))
            start.append(a)
            stop.append(b)
            left.append(-1)
            right.append(-1)
            return len(low) - 1

        stack = [node(0, len(points))]
        while stack:
            i = stack.pop()
            a, b = start[i], stop[i]
            wide = high[i] - low[i]
            if b - a <= leaf or not wide.any():
                continue
            axis, middle = int(wide.argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(points[order[a:b], axis], middle)]
            left[i], right[i] = node(a, a + middle), node(a + middle, b)
            stack += [left[i], right[i]]
        return cls(np.array(low), np.array(high), *(np.array(x) for x in (left, right, start, stop)), order)

    def ceilings(self, queries: np.ndarray) -> np.ndarray:
        """``(query, node)``: no inner product with a point in the node's box is above it."""
        return ceilings(queries, self.low, self.high)


def ceilings(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``(query, box)``: bounds of inner products, widened by what the sums of doubles may round off."""
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        size = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
        out = top + size * ((queries.shape[1] + 4) * 2.0**-52)
    return np.where(np.isnan(out), np.inf, out)


def scores_of(points: np.ndarray, q: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of integers held as doubles, exact at any size, clipped to longs; and which were clipped.

    ``size`` bounds the products and their sum. Below 2**53 sums of doubles are
    exact, below 2**62 sums of longs; what is larger is summed in whole numbers
    of Python.
    """
    if size < 2**53:
        return (points @ q).astype(np.int64), np.zeros(len(points), bool)
    if size < 2**62:
        return points.astype(np.int64) @ q.astype(np.int64), np.zeros(len(points), bool)
    parts = [int(x) for x in q]
    exact = [sum(int(x) * y for x, y in zip(p, parts, strict=True)) for p in points]
    clipped = [min(max(s, -LARGEST - 1), LARGEST) for s in exact]
    return np.array(clipped, np.int64), np.array([c != s for c, s in zip(clipped, exact, strict=True)], bool)


def _few_copies(tree: KdTree, ids: np.ndarray, k: int, leaf: int) -> None:
    """Of equal vectors that fill a whole leaf only ``k + 1`` ids can ever be among a query's best: the smallest."""
    for i in np.flatnonzero((tree.left < 0) & (tree.stop - tree.start > leaf)):
        rows = tree.order[tree.start[i] : tree.stop[i]]
        few = rows[np.unique(ids[rows], return_index=True)[1][: k + 1]]
        tree.order[tree.start[i] : tree.start[i] + len(few)] = few
        tree.stop[i] = tree.start[i] + len(few)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, known: list, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query the ids, scores and clip marks of its ``k`` best ids that score ``known`` or more, smaller ids first in ties.

    Points that repeat an id are one candidate with its best score. ``known`` is
    minus infinity where nothing is known yet.
    """
    tree = KdTree.build(points, LEAF_ROWS)
    _few_copies(tree, ids, k, LEAF_ROWS)
    reach = np.maximum(np.abs(tree.low), np.abs(tree.high)).max(axis=1, initial=0) * max(points.shape[1], 1)
    found = []
    for q, me, least, ceiling in zip(queries, own, known, tree.ceilings(queries), strict=True):
        best_ids, best, over = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        size = np.abs(q).max(initial=0) * reach
        heap = [(-ceiling[0], 0)]
        while heap:
            bound, i = heapq.heappop(heap)
            if -bound < least:
                break
            if tree.left[i] >= 0:
                for child in (tree.left[i], tree.right[i]):
                    if ceiling[child] >= least:
                        heapq.heappush(heap, (-ceiling[child], child))
                continue
            rows = tree.order[tree.start[i] : tree.stop[i]]
            scores, clipped = scores_of(points[rows], q, size[i])
            good = (scores >= least) & (ids[rows] != me)
            if not good.any():
                continue
            best_ids = np.concatenate([best_ids, ids[rows][good]])
            best = np.concatenate([best, scores[good]])
            over = np.concatenate([over, clipped[good]])
            order = np.lexsort((best_ids, ~best))  # ~ turns the order of longs round and cannot overflow
            keep = order[np.sort(np.unique(best_ids[order], return_index=True)[1])][:k]
            best_ids, best, over = best_ids[keep], best[keep], over[keep]
            if len(best) == k:
                least = max(least, int(best[-1]))
        found.append((best_ids, best, over))
    return found


# --------------------------------------------------------------- over shards


@dataclass
class Cells:
    """Median splits of one length of vectors; a node without a left child is a cell, numbered by ``left``'s complement."""

    axis: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def split(cls, sample: np.ndarray, cells: int) -> Cells:
        axis, at, left, right = [0], [0.0], [-1], [-1]
        heap, leaves = [(-len(sample), 0)], {0: np.arange(len(sample))}
        while heap and len(leaves) < cells:
            _, i = heapq.heappop(heap)
            rows = leaves[i]
            mine = sample[rows]
            wide = mine.max(axis=0) - mine.min(axis=0) if len(rows) > 1 else np.zeros(1)
            if not wide.max(initial=0) > 0:
                continue
            axis[i] = int(wide.argmax())
            values = mine[:, axis[i]]
            middle = np.partition(values, len(rows) // 2)[len(rows) // 2]
            at[i] = float(middle if middle > values.min() else values[values > middle].min())
            del leaves[i]
            for side, part in ((left, rows[values < at[i]]), (right, rows[values >= at[i]])):
                side[i] = len(axis)
                leaves[side[i]] = part
                heapq.heappush(heap, (-len(part), side[i]))
                axis.append(0)
                at.append(0.0)
                left.append(-1)
                right.append(-1)
        for cell, i in enumerate(sorted(leaves)):
            left[i] = ~cell
        return cls(np.array(axis), np.array(at), np.array(left), np.array(right))

    def place(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while len(open_ := np.flatnonzero(self.left[node] >= 0)):
            here = node[open_]
            low = points[open_, self.axis[here]] < self.at[here]
            node[open_] = np.where(low, self.left[here], self.right[here])
        return ~self.left[node]


@dataclass
class Boxes:
    """Of one length of vectors: each cell's number, tight box and number of shards."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shards: np.ndarray

    def route(self, queries: np.ndarray, ids: np.ndarray, known: list, first: int, last: int | None) -> Iterator[tuple[int, int, int]]:
        """``(query, cell, shard)`` for the cells ranked ``first`` to ``last`` by their bounds that can reach ``known``.

        Rank 0 has two parts: its first shard, drawn by the query's id, is asked
        in the first round (``last`` is 0), the others in the second.
        """
        tops = ceilings(queries, self.low, self.high)
        for q, (top, least, drawn) in enumerate(zip(tops, known, ids.tolist(), strict=True)):
            order = np.lexsort((self.cell, -top))
            home = drawn % self.shards[order[0]]
            if last == 0:
                yield q, self.cell[order[0]], home
                continue
            for rank in range(first, len(order) if last is None else min(last, len(order))):
                at = order[rank]
                if top[at] < least:
                    break
                yield from ((q, self.cell[at], s) for s in range(self.shards[at]) if rank or s != home)


def _usable(vec: Column) -> Column:
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _whole(scale: int):
    """Component -> its integer as a double: doubles beyond 2**52 are whole, and a long would not hold the largest."""

    def one(x: Column) -> Column:
        y = x * scale
        plain = F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
        return F.when(F.abs(y) < float("inf"), plain).otherwise(F.raise_error(F.lit("topk: a scaled component is beyond the range of doubles")).cast("double"))

    return one


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def _split_space(points: DataFrame) -> tuple[dict[int, Cells], int]:
    """Splits by length of vectors, from a bounded sample drawn by hash; and how many vectors a shard may hold."""
    total, width = points.agg(F.count("*"), F.coalesce(F.avg("dim"), F.lit(1.0))).first()
    room = max(1, int(SHARD_BYTES // (8 * width)))
    cells = max(1, min(MOST_CELLS, blocks_for(total, CELL_ROWS), room // PER_CELL))
    span = 1 << 40
    chosen = F.pmod(F.xxhash64("id", "vec", F.lit("cells")), F.lit(span)) < min(span, -(-span * cells * PER_CELL // max(total, 1)))
    drawn: dict[int, list] = {}
    for dim, vec in sorted(points.where(chosen).select("dim", "vec").collect()) if cells > 1 else ():
        drawn.setdefault(dim, []).append(vec)
    count = sum(map(len, drawn.values()))
    splits = {dim: Cells.split(np.array(vs), max(1, cells * len(vs) // count)) for dim, vs in drawn.items()}
    return splits, min(room, max(SHARD_ROWS, blocks_for(total, MOST_SHARDS)))


def _place(points: DataFrame, splits: dict[int, Cells]) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch):
                cells = shared.value[dim].place(_matrix(rows.column("vec"))) if dim in shared.value else np.zeros(rows.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.astype(np.int32))], [*rows.schema.names, "cell"])

    return points.mapInArrow(run, "id long, vec array<double>, dim int, cell int")


def _boxes(placed: DataFrame, splits: dict[int, Cells], shard_rows: int) -> dict[int, Boxes]:
    """The tight box of every cell: one a task and cell, then one a cell. As bounded as the number of cells."""
    shape = "dim int, cell int, n long, low array<double>, high array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for dim, rows in _by_dim(batch):
                points, cells = _matrix(rows.column("vec")), rows.column("cell").to_numpy(zero_copy_only=False)
                order = np.argsort(cells, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(cells[order]) > 0])
                low, high = np.minimum.reduceat(points[order], starts), np.maximum.reduceat(points[order], starts)
                for cell, n, a, b in zip(cells[order][starts], np.diff(np.r_[starts, len(order)]), low, high, strict=True):
                    was = held.get((dim, int(cell)))
                    held[dim, int(cell)] = [n, a, b] if was is None else [was[0] + n, np.minimum(was[1], a), np.maximum(was[2], b)]
        if held:
            columns = zip(*((dim, cell, n, a, b) for (dim, cell), (n, a, b) in held.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["dim", "cell", "n", "low", "high"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = np.stack(pdf["low"]).min(axis=0), np.stack(pdf["high"]).max(axis=0)
        return pd.DataFrame({"dim": pdf["dim"][:1], "cell": pdf["cell"][:1], "n": [pdf["n"].sum()], "low": [low], "high": [high]})

    known = placed.where(F.col("dim").isin(list(splits)))
    rows = known.mapInArrow(partial, shape).groupBy("dim", "cell").applyInPandas(whole, shape).collect() if splits else []
    out = {}
    for dim in splits:
        mine = sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["cell"])
        out[dim] = Boxes(np.array([r["cell"] for r in mine]), np.array([r["low"] for r in mine]), np.array([r["high"] for r in mine]), np.array([blocks_for(r["n"], shard_rows) for r in mine]))
    return out


def _asks(queries: DataFrame, boxes: dict[int, Boxes], first: int, last: int | None) -> DataFrame:
    """Queries, once for each shard that they ask: ``dim, cell, shard, id, vec, known``."""
    shared = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch):
                if dim in shared.value:
                    known = [-np.inf if x is None else x for x in rows.column("known").to_pylist()]
                    hits = list(shared.value[dim].route(_matrix(rows.column("vec")), rows.column("id").to_numpy(zero_copy_only=False), known, first, last))
                else:  # a length too rare to be drawn is one shard
                    hits = [(q, 0, 0) for q in range(rows.num_rows)] if last == 0 else []
                for at in range(0, len(hits), QUERY_ROWS):
                    at_q, cell, shard = (np.array(x) for x in zip(*hits[at : at + QUERY_ROWS], strict=True))
                    taken = rows.take(pa.array(at_q))
                    yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("id", "vec", "dim", "known")), pa.array(cell.astype(np.int32)), pa.array(shard.astype(np.int32))], ["id", "vec", "dim", "known", "cell", "shard"])

    return queries.select("id", "vec", "dim", "known").mapInArrow(run, "id long, vec array<double>, dim int, known long, cell int, shard int")


def _look(k: int):
    def look(mine: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or asks.empty:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64), "over": np.empty(0, bool)})
        own = asks["id"].to_numpy()
        known = [int(x) if some else -np.inf for some, x in zip(asks["some"], asks["known"], strict=True)]
        hits = search(np.stack(mine["vec"]), mine["id"].to_numpy(), np.stack(asks["vec"]), own, known, k)
        ids, scores, over = (np.concatenate(x) for x in zip(*hits, strict=True))
        return pd.DataFrame({"query_id": np.repeat(own, [len(i) for i, _, _ in hits]), "vec_id": ids, "score": scores, "over": over})

    return look


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = hits.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "over")).alias("s")).select("query_id", "vec_id", "s.*")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the exact ``k`` best other vectors of each query.

    Queries are the ids divisible by ``every``. Components x count as
    ``floor(scale * x)``, x as double; the score is their integer inner product,
    exact at any size; ties go to the smaller id; a query with fewer candidates
    gets all. A score among a query's best that no long can hold is an error, and
    so is a scaled component that no double can hold.

    Rows with a null id, a null or empty vector, or a null or non-finite component
    take no part. Vectors of another length than the query's are no candidates.
    Rows that repeat an id are one candidate with its best score, and never a
    candidate of their own id; as a query, the smallest of their vectors counts.
    An empty table gives no rows; other columns are ignored.

    Every query asks the shards of the cell of its highest bound, then those of the
    next ``SECOND_LOOK`` cells, then all others, each time only cells whose bound
    reaches its k-th score. Broadcast are splits and boxes of ``MOST_CELLS`` cells
    at most. A shard is sent once for every ``QUERY_ROWS`` queries that ask it.
    """
    wide = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = wide.where(F.col("id").isNotNull() & _usable(F.col("vec")))
    points = materialize(usable.select("id", F.transform("vec", _whole(scale)).alias("vec"), F.size("vec").alias("dim")).distinct(), "topk-points")
    splits, shard_rows = _split_space(points)
    placed = materialize(_place(points, splits), "topk-placed")
    boxes = _boxes(placed, splits, shard_rows)
    counts = [(d, int(c), int(n)) for d, b in boxes.items() for c, n in zip(b.cell, b.shards, strict=True) if n > 1]
    sizes = F.broadcast(points.sparkSession.createDataFrame(counts, "dim int, cell int, shards int"))  # MOST_CELLS rows at most
    placed_shards = placed.join(sizes, ["dim", "cell"], "left").withColumn("shard", F.pmod(F.xxhash64("id"), F.coalesce("shards", F.lit(1))).cast("int"))
    asking = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vec", "dim")).alias("v"))
    queries = materialize(asking.select("id", "v.*"), "topk-queries")
    key = ["dim", "cell", "shard"]

    def ask(known: DataFrame, first: int, last: int | None) -> DataFrame:
        asks = materialize(_asks(known, boxes, first, last), "topk-asks")
        asked = materialize(asks.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("blocks")), "topk-asked")
        mine = placed_shards.join(asked, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        theirs = asks.join(asked, key).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
        cells = [*key, "block"]
        hits = mine.select(*cells, "id", "vec").groupBy(*cells).cogroup(theirs.select(*cells, "id", "vec", F.coalesce("known", F.lit(0)).alias("known"), F.col("known").isNotNull().alias("some")).groupBy(*cells))
        return hits.applyInPandas(_look(k), "query_id long, vec_id long, score long, over boolean")

    def with_known(best: DataFrame) -> DataFrame:
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("known"))
        return queries.join(kth, queries["id"] == kth["query_id"], "left")

    most = max([len(b.cell) for b in boxes.values()], default=1)
    best = _best(ask(queries.withColumn("known", F.lit(None).cast("long")), 0, 0), k)
    rounds = [(0, 1 + SECOND_LOOK), (1 + SECOND_LOOK, None)][: 0 if most == 1 and not counts else 1 if most <= 1 + SECOND_LOOK else 2]
    for first, last in rounds:
        so_far = materialize(best, "topk-best")
        best = _best(so_far.drop("rank").unionByName(ask(with_known(so_far), first, last)), k)
    score = F.when(F.col("over"), F.raise_error(F.lit("topk: a score is beyond the range of longs")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
