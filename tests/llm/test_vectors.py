"""Search and near-duplicates of embeddings."""

import numpy as np
import pytest

from orbitframe.llm import pq_dedup, topk

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def rows_of(rng, n, dim=6, copies=40):
    base = rng.standard_normal((n, dim)).astype(np.float32)
    base[:copies] = base[0]
    base[copies : 2 * copies] += 0
    rows = [(int(i), [float(x) for x in v], int(i % 3)) for i, v in enumerate(base)]
    rows += [(9001, None, 0), (9002, [], 0), (9003, [1.0, None], 0), (9004, [NAN] * dim, 1), (9005, [INF] * dim, 1), (9006, [0.0] * dim, 2), (None, [1.0] * dim, 0), (9007, rows[1][1], None), (9008, [1.0, 2.0], 0), (3, rows[3][1], rows[3][2])]
    return rows


def brute_topk(rows, every, k):
    seen = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        seen.setdefault(i, []).append(tuple(int(np.floor(1024 * np.float64(x))) for x in v))
    out = []
    for q in sorted(i for i in seen if i % every == 0):
        mine = min(seen[q])
        scored = [(-max(sum(a * b for a, b in zip(mine, v, strict=True)) for v in vs if len(v) == len(mine)), i) for i, vs in seen.items() if i != q and any(len(v) == len(mine) for v in vs)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(params=[(1024, 2048), (40, 25), (4, 8)])
def layout(request, monkeypatch):
    """One cell, many cells, cells of several shards, more cells than two rounds ask."""
    for name, value in zip(("CELL_ROWS", "SHARD_ROWS"), request.param, strict=True):
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)


def test_top_k_of_odd_rows(spark, layout):
    rows = rows_of(np.random.default_rng(5), 300)
    df = spark.createDataFrame(rows, VECTORS).withColumnsRenamed({"label": "shard"})
    got = topk.top_k(df, every=10, k=7).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute_topk(rows, 10, 7)


def test_repeated_ids_leave_room_for_others(spark, layout):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6)], 0) for i in range(200)]
    for i in (0, 3, 14, 57):
        far = 20 * np.array(rows[i][1])
        rows += [(i, [float(np.float32(x)) for x in far + c * rng.standard_normal(6)], 0) for c in [0.0] * 12 + [0.5] * 12]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), every=10, k=7).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute_topk(rows, 10, 7)


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (100, [2.0], 0), (7, [0.5], 0)], VECTORS)
    assert [tuple(r) for r in topk.top_k(df).orderBy("query_id", "rank").collect()] == [(0, 1, 100, 2048 * 1024), (0, 2, 7, 512 * 1024), (100, 1, 0, 2048 * 1024), (100, 2, 7, 2048 * 512)]
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_scores_are_exact_at_any_size(spark, layout):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(256)], 0) for i in range(60)]
    rows += [(100 + i, [3e5 * (i % 4 + 1), *[0.25 * (i % 3)] * 255], 0) for i in range(40)]
    # Scores around 2**60 that differ in their last bits, and ties there.
    rows += [(200 + i, [float(2.0**19), float(2.0**18 + (i % 5) * 2.0**-6), *[0.0] * 254], 0) for i in range(40)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=20, k=7).orderBy("query_id", "rank").collect()
    want = brute_topk(rows, 20, 7)
    assert max(abs(t[3]) for t in want) > 2**53
    assert [tuple(r) for r in got] == want
    assert topk.top_k(spark.createDataFrame([(0, [3e5, 0.0], 0), (1, [3e5, 0.0], 0), (2, [1.0, 0.0], 0)], VECTORS), every=2, k=1).orderBy("query_id").collect()[0]["vec_id"] == 1


def test_a_score_beyond_longs_is_an_error(spark):
    rows = [(0, [1e7, 0.0], 0), (1, [1e30, 0.0], 0), (2, [2.0, 5.0], 0)]
    with pytest.raises(Exception, match="beyond the range of longs"):
        topk.top_k(spark.createDataFrame(rows, VECTORS), every=100, k=1).collect()
    low = [(0, [1e7, 0.0], 0), (1, [-1e30, 0.0], 0), (2, [2.0, 5.0], 0)]
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame(low, VECTORS), every=100, k=1).collect()] == [(0, 1, 2, int(1e7) * 1024 * 2048)]
    with pytest.raises(Exception, match="beyond the range of longs"):
        topk.top_k(spark.createDataFrame(low, VECTORS), every=100, k=2).collect()


def test_queries_ask_few_shards(spark, monkeypatch):
    """In clustered vectors the rows dealt grow far less than queries times shards."""
    monkeypatch.setattr(topk, "CELL_ROWS", 32)
    dealt = {}
    real = topk._asks
    for n in (1000, 4000):
        rng = np.random.default_rng(1)
        centers = 4 * rng.standard_normal((n // 25, 8))
        rows = [(i, [float(np.float32(x)) for x in centers[i % len(centers)] + 0.2 * rng.standard_normal(8)], 0) for i in range(n)]
        seen = []

        def counting(*a, seen=seen):
            out = real(*a)
            seen.append(out)
            return out

        monkeypatch.setattr(topk, "_asks", counting)
        got = topk.top_k(spark.createDataFrame(rows, VECTORS), every=10, k=5).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == brute_topk(rows, 10, 5)
        dealt[n] = sum(a.count() for a in seen)
    all_pairs = (4000 / 1000) ** 2
    assert dealt[4000] / dealt[1000] < 0.6 * all_pairs, dealt
    print("asks:", dealt, "of", {n: n // 10 * (n // 32) for n in dealt})


def test_boxes_bound_every_point():
    rng = np.random.default_rng(0)
    points, queries = rng.integers(-50, 50, (400, 5)).astype(float), rng.integers(-50, 50, (20, 5)).astype(float)
    tree = topk.KdTree.build(points, 16)
    scores = queries @ points.T
    for i, top in enumerate(tree.ceilings(queries).T):
        mine = tree.order[tree.start[i] : tree.stop[i]]
        assert (scores[:, mine].max(axis=1) <= top + 1e-9).all()


def brute_links(rows, cosine):
    ids = [i for i, _, _ in rows]
    ok = [i is not None and lab is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                near[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            low = min([label[a], *(label[b] for b in np.flatnonzero(near[a]))])
            changed |= low != label[a]
            label[a] = low
    comp = {}
    for a in range(n):
        if ok[a]:
            comp[label[a]] = min(comp.get(label[a], ids[a]), ids[a])
    return [(ids[a], int(near[a].sum()), comp[label[a]] if ok[a] else ids[a]) for a in range(n)]


@pytest.mark.parametrize("lists,tile", [(512, 4096), (10, 16)])
def test_links_equal_brute_force(spark, monkeypatch, lists, tile):
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", lists)
    monkeypatch.setattr(pq_dedup, "TILE", tile)
    rng = np.random.default_rng(6)
    rows = rows_of(rng, 240)
    center = rng.standard_normal(6)
    rows += [(2000 + i, [float(np.float32(x)) for x in center + 0.12 * rng.standard_normal(6)], 1) for i in range(120)]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("vec_id", "vid")
    got = pq_dedup.near_duplicates(df, 0.98, id_col="vid").collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=key) == sorted(brute_links(rows, 0.98), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_no_vectors(spark):
    assert pq_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    alone = pq_dedup.near_duplicates(spark.createDataFrame([(4, [1.0, 0.0], 1), (5, None, 1)], VECTORS)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in alone) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_repeated_ids_are_vectors_of_their_own(spark, monkeypatch):
    from orbitframe.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.001], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 0), *[(4 + i, [5.0, 5.0], 1) for i in range(9)]]
    got = pq_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    key = lambda t: (t[0], t[1])
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=key) == sorted(brute_links(rows, 0.98), key=key)
    assert [r["n_links"] for r in got if r["vec_id"] == 1] == [1, 1]


def test_codes_never_rule_out_a_neighbour():
    rng = np.random.default_rng(7)
    x = pq_dedup._unit(rng.standard_normal((500, 16)))
    model = pq_dedup.Quantizer.fit(x, 12)
    own, lists = model.probes(x, 0.5)
    rest = x - model.centroids[own]
    codes, missed = model.encode(rest)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i, j in np.argwhere(apart <= 0.5):
        assert own[j] in lists[i]
        seen = model.table_distances((x[i] - model.centroids[own[j]])[None], codes[j][None])[0, 0]
        assert seen <= apart[i, j] + missed[j] + 1e-9
