"""SimHash near-duplicates, compared bit plane by bit plane.

Texts become fingerprints of majority bits over XXH64 shingle hashes. Distinct
fingerprints meet in buckets of equal bit blocks; inside a bucket they are
stored vertically (one machine word holds the same bit of 64 fingerprints) and
the distances of 64 pairs are counted at once by carry-save adders. A block of
comparisons is dropped as soon as every pair in it exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from orbitframe.llm.common import hot_join, materialize, release, small_batches
from orbitframe.llm.graph import connected_components, merge_labels, merge_matrix

SEED = 42
#: Fingerprints of a bucket that one task compares with one another; larger buckets are cut into tile pairs.
TILE = 16384
#: Rows of the vertical blocks.
BLOCK = 1024
#: A bucket should hold about so many unrelated fingerprints at most; more bits join the key beyond that.
BUCKET = 4096
#: Shingles whose bits are counted in one go.
CHUNK = 1 << 16
#: Buckets up to so many rows are compared pair by pair, larger ones by bit planes.
FEW = 256
#: Distinct shingles of a group that one task confirms with one another; larger groups are cut into tile pairs.
GROUP = 500_000
#: Bits of the filter that rows pass before they move to meet a table of keys: so many bits at every size, 4 MB.
FILTER_BITS = 1 << 24


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words (or of all words, if fewer), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    pairs = zip(starts, ends[shingle - 1 :], strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(starts))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits; bytes of a word are added side by side."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        lanes = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        full = len(lanes) // 255 * 255
        if full:
            sums = lanes[:full].reshape(-1, 255, 8).sum(axis=1)
            total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += lanes[full:].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def _remix(hashes: np.ndarray, round_: int) -> np.ndarray:
    """Another 64-bit hash from the first (splitmix64 finaliser)."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * round_) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, words: int = 1) -> list[int]:
    """Majority bits as signed 64-bit words; all zero for a text without words."""
    return _majority(shingle_hashes(text, shingle), words)


def _majority(hashes: np.ndarray, words: int) -> list[int]:
    out = []
    for k in range(words):
        counts = _bit_counts(_remix(hashes, k) if k else hashes)
        bits = (2 * counts > len(hashes)).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, w0 .. w{words-1}`` of each row; a null text counts as an empty one."""
    return _printed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle, words)


def _printed(picked: DataFrame, shingle: int, words: int) -> DataFrame:
    """``..., text`` -> ``..., w0 .. w{words-1}``."""
    small_batches(picked.sparkSession)
    names = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([fingerprint(t.as_py(), shingle, words) for t in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(words))], [*batch.schema.names[:-1], *names])

    kept = ", ".join(f"{name} {kind}" for name, kind in picked.dtypes[:-1])
    return picked.mapInArrow(run, kept + "".join(f", {w} long" for w in names))


# ------------------------------------------------------------ vertical compare


def _planes(fps: np.ndarray) -> np.ndarray:
    """``(n, words)`` uint64 -> ``(bits, n / 64)`` uint64: one row per bit, rows of fingerprints along it."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    wide = np.zeros((packed.shape[0], -(-n // 64) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above ``radius``."""
    more, same = over.copy(), ~np.zeros_like(over)
    for level in reversed(range(len(counter))):
        if radius >> level & 1:
            same &= counter[level]
        else:
            more |= same & counter[level]
            same &= ~counter[level]
    return more


def within_radius(queries: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray:
    """``(q, b)`` booleans: which fingerprints of ``block`` are within ``radius`` bits of each query."""
    n = len(block)
    planes = _planes(block)
    bits = np.unpackbits(queries.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    masks = (np.uint64(0) - bits.T.astype(np.uint64))[:, :, None]
    rows = np.arange(len(queries))
    shape = (len(queries), planes.shape[1])
    levels = max(3, radius.bit_length())
    counter = [np.zeros(shape, np.uint64) for _ in range(levels)]
    over = np.zeros(shape, np.uint64)
    for at in range(0, len(planes), 4):
        d0, d1, d2, d3 = (planes[at + i] ^ masks[at + i] for i in range(4))
        ones, twos = counter[0], counter[1]
        half = ones ^ d0
        carry_a = (ones & d0) | (half & d1)
        ones = half ^ d1
        half = ones ^ d2
        carry_b = (ones & d2) | (half & d3)
        counter[0] = half ^ d3
        half = twos ^ carry_a
        carry = (twos & carry_a) | (half & carry_b)
        counter[1] = half ^ carry_b
        for level in range(2, levels):
            counter[level], carry = counter[level] ^ carry, counter[level] & carry
        over |= carry
        if at % 16 == 12:
            alive = (~_exceeds(counter, over, radius)).any(axis=1)
            left = int(alive.sum())
            if not left:
                return np.zeros((len(queries), n), bool)
            if left < 0.7 * len(alive):
                rows, over, masks = rows[alive], over[alive], masks[:, alive]
                counter = [c[alive] for c in counter]
    near = ~_exceeds(counter, over, radius)
    out = np.zeros((len(queries), n), bool)
    out[rows] = np.unpackbits(near.view(np.uint8), axis=1, count=n, bitorder="little").astype(bool)
    return out


def link_sorted(bucket: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Labels of rows sorted by bucket: blocks are compared with themselves and with later ones of the same bucket."""
    n = len(fps)
    label = np.arange(n)
    for i in range(0, n, BLOCK):
        stop = min(i + BLOCK, n)
        for j in range(i, n, BLOCK):
            if j > i and bucket[j] != bucket[stop - 1]:
                break
            near = within_radius(fps[i:stop], fps[j : j + BLOCK], radius)
            left, right = np.arange(i, stop), np.arange(j, min(j + BLOCK, n))
            merge_matrix(label, near, left, right)
    return label


def _link_batches(batches: Iterator[pa.RecordBatch], words: int, radius: int, link=link_sorted) -> Iterator[pa.RecordBatch]:
    """Rows ``node, bucket, w..`` sorted by bucket -> spanning edges; whole buckets at a time."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        label = link(rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64), radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rows[moved, 0]), pa.array(rows[label[moved], 0])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        if sum(map(len, held)) < 4 * BLOCK:
            continue
        rows = np.concatenate(held)
        other = np.flatnonzero(rows[:, 1] != rows[-1, 1])
        last = int(other[-1]) + 1 if len(other) else 0
        held = [rows[last:]]
        if last:
            yield flush(rows[:last])
    if held:
        yield flush(np.concatenate(held))


# -------------------------------------------------------------------- plan


def block_keys(words: int, radius: int, distinct: int, bands: int | None) -> list[list[tuple[int, int, int]]]:
    """Bit blocks ``(word, from, width)`` that make up each bucket key.

    Without ``bands`` the keys are complete: 64 bits fall into ``radius + j``
    blocks, of which any near pair agrees on ``j``; ``j`` grows with the number
    of fingerprints until unrelated ones are at most ``BUCKET`` in a bucket.
    With ``bands`` each word gives that many single-block keys.
    """
    if bands:
        width = 64 // bands
        return [[(w, b * width, width)] for w in range(words) for b in range(bands)]
    assert words == 1, "complete keys are for 64 bits"
    agree = 1
    while True:
        parts = radius + agree
        cuts = [round(64 * i / parts) for i in range(parts + 1)]
        if distinct / 2 ** (64 * agree // parts) <= BUCKET or agree == 4:
            blocks = [(0, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
            return [list(some) for some in combinations(blocks, agree)]
        agree += 1


def _key(blocks: list[tuple[int, int, int]]) -> Column:
    key = F.lit(0).cast("long")
    for word, start, width in blocks:
        piece = F.shiftrightunsigned(F.col(f"w{word}"), start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key = F.shiftleft(key, width).bitwiseOR(piece)
    return key


def near_edges(classes: DataFrame, radius: int, bands: int | None = None) -> DataFrame:
    """``node, w..``, distinct by their words -> ``a, b``: spanning edges of the pairs within ``radius``.

    Buckets beyond ``TILE`` classes are cut into tile pairs that separate tasks
    compare. Only spanning edges leave a task.
    """
    cols = [c for c in classes.columns if c != "node"]
    keys = block_keys(len(cols), radius, classes.count(), bands)
    bucket = F.array(*[F.xxhash64(F.lit(i), _key(k)) for i, k in enumerate(keys)])
    placed = classes.select("node", F.explode(bucket).alias("bucket"), *cols)
    counted = placed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    tiled = materialize(counted.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "simhash-buckets")
    dealt = _tiles(placed.join(tiled, "bucket")).select("node", "bucket", *cols)
    words = len(cols)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _link_batches(it, words, radius), "a long, b long")


def near_components(prints: DataFrame, radius: int = 4, bands: int | None = None) -> DataFrame:
    """``doc_id, w..`` -> the same rows with ``component_id``.

    Rows of equal fingerprints are one class before anything is compared, so a
    group of copies of any size costs one fingerprint; the node of a class is its
    smallest id. Classes that share an id are linked too. ``component_id`` is the
    smallest id reachable over links, itself included, and null where no row of
    the component has an id. Classes of a large share of all rows are broadcast
    to them (``common.hot_join``), so no task gets all copies of one text.
    """
    cols = [c for c in prints.columns if c != "doc_id"]
    total, top = prints.agg(F.count("*"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()
    if top > 1 << 62:
        raise ValueError("ids beyond 2**62 leave no numbers for texts without an id")
    grouped = prints.groupBy(*cols).agg(F.min("doc_id").cast("long").alias("first"), F.count("*").alias("n"))
    nameless = F.lit(top + 1) + F.monotonically_increasing_id()  # behind all ids, so that any id is smaller
    classes = materialize(grouped.withColumn("node", F.coalesce("first", nameless)), "simhash-classes")
    # Ids of several texts: one row each, next to none as a rule.
    some = F.xxhash64(*cols)
    many = materialize(prints.where("doc_id is not null").groupBy("doc_id").agg(F.min(some).alias("a"), F.max(some).alias("b")).where("a <> b").select("doc_id"), "simhash-ids")
    shared = prints.join(many, "doc_id").distinct().join(classes.select("node", *cols), cols).select(F.col("doc_id").cast("long").alias("a"), F.col("node").alias("b"))
    reached = connected_components(near_edges(classes.select("node", *cols), radius, bands).unionByName(shared))
    component = F.coalesce("component", "node")
    labelled = materialize(classes.join(reached, "node", "left").select(*cols, "n", F.when(component <= top, component).alias("component_id")), "simhash-labels")
    return hot_join(prints, labelled, cols, total).select(*prints.columns, "component_id")


# ------------------------------------------------------- exact confirmation


def _draws(bits: int, bands: int, draws: int) -> np.ndarray:
    """``(draws * bands, width)``: the bits of each key; the bands of one draw share none."""
    width = bits // bands
    return np.concatenate([np.random.default_rng([SEED, d]).permutation(bits)[: bands * width].reshape(bands, width) for d in range(draws)])


def drawn_keys(fps: np.ndarray, bands: int, draws: int) -> np.ndarray:
    """``(n, bands * draws)`` keys of ``(n, words)`` fingerprints; keys of different bands differ."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    picked = _draws(bits.shape[1], bands, draws)
    out = np.empty((len(fps), len(picked)), np.int64)
    for i, at in enumerate(picked):
        out[:, i] = bits[:, at] @ (1 << np.arange(len(at), dtype=np.int64)) | i << 32
    return out


def link_pairs(bucket: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Labels of rows sorted by bucket, linked inside buckets only: pair by pair in small ones, by planes in large ones."""
    n = len(fps)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.empty(0, int)
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= FEW, sizes)
    at, step = np.flatnonzero(small), 1
    while len(at := at[at + step < n]) and len(at := at[bucket[at] == bucket[at + step]]):
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]).sum(axis=1, dtype=np.int64) <= radius]
        merge_labels(label, near, near + step)
        step += 1
    for a, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        label[a : a + size] = a + link_sorted(bucket[a : a + size], fps[a : a + size], radius)
    return label


def link_sets(sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    """Labels of sorted distinct hash arrays, linked where the exact Jaccard similarity is ``jaccard`` or more.

    Two sets that similar share one of the first ``n - ceil(jaccard * n) + 1``
    hashes of each, so only pairs that do are counted out, and of these only
    such as no earlier link has joined. Empty sets are equal.
    """
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(x) for x in sets], np.int64)
    empty = np.flatnonzero(sizes == 0)
    label[empty] = empty[:1].sum()
    heads = [x[: len(x) - int(np.ceil(jaccard * len(x) - 1e-9)) + 1] for x in sets]
    hashes = np.concatenate([np.empty(0, np.uint64), *heads])
    owner = np.repeat(np.arange(n), [len(h) for h in heads])
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    for i, head in enumerate(heads):
        spans = zip(np.searchsorted(hashes, head), np.searchsorted(hashes, head, "right"), strict=True)
        others = np.concatenate([np.empty(0, np.int64), *(owner[a:b] for a, b in spans if b - a > 1)])
        others = np.unique(others[(others < i) & (label[others] != label[i])])
        others = others[np.minimum(sizes[others], sizes[i]) >= jaccard * np.maximum(sizes[others], sizes[i]) - 1e-9]
        while len(others):
            j, others = others[0], others[1:]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= jaccard * (sizes[i] + sizes[j] - both) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
                others = others[label[others] != low]
    return label


def _confirm_batches(batches: Iterator[pa.RecordBatch], shingle: int, jaccard: float) -> Iterator[pa.RecordBatch]:
    """Rows ``node, bucket, text`` sorted by bucket -> spanning edges of confirmed pairs; one bucket at a time."""
    nodes: list[int] = []
    sets: list[np.ndarray] = []
    bucket = None

    def flush() -> pa.RecordBatch:
        ids, label = np.array(nodes, np.int64), link_sets(sets, jaccard)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    for batch in batches:
        for node, at, text in zip(*batch.columns, strict=True):
            if at.as_py() != bucket:
                if len(nodes) > 1:
                    yield flush()
                bucket, nodes, sets = at.as_py(), [], []
            nodes.append(node.as_py())
            sets.append(np.unique(shingle_hashes(text.as_py(), shingle)))
    if len(nodes) > 1:
        yield flush()


def _set_prints(picked: DataFrame, shingle: int, words: int) -> DataFrame:
    """``key, doc_id, text`` -> ``key, doc_id, w0 .., set, n``: fingerprint, digest and size of the set of shingles."""
    small_batches(picked.sparkSession)
    names = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(2)]
            rows = np.array([_majority(x, words) for x in sets], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(words)),
                    pa.array([xxh128_digest(x.tobytes(), SEED) for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()),
                ],
                ["key", "doc_id", *names, "set", "n"],
            )

    return picked.mapInArrow(run, "key binary, doc_id long, " + ", ".join(f"{w} long" for w in names) + ", set binary, n long")


def key_plan(bits: int, bands: int, draws: int, distinct: int, jaccard: float) -> tuple[int, int]:
    """Bands and draws for ``distinct`` sets: as given while buckets hold ``BUCKET`` unrelated ones at most, then wider keys.

    Of wider keys there are as many more as a pair of similarity ``jaccard``
    needs to be found with the same chance: its sets agree on a bit with the
    chance ``1 - angle / pi`` of the angle of cosine ``2 j / (1 + j)``.
    """
    width = bits // bands
    wide = max(width, int(np.ceil(np.log2(max(distinct, 1) / BUCKET))))
    if wide == width:
        return bands, draws
    fewer = bits // wide
    same = 1 - np.arccos(2 * jaccard / (1 + jaccard)) / np.pi
    keys = bands * draws * np.log1p(-(same**width)) / np.log1p(-(same ** (bits // fewer)))
    return fewer, int(np.ceil(keys / fewer))


def _candidate_edges(prints: DataFrame, radius: int, bands: int, draws: int) -> DataFrame:
    """``a, b``: spanning edges of ``node, w..`` (distinct nodes) whose fingerprints share a key and are within ``radius``.

    Rows move once, to their buckets; only buckets beyond ``TILE`` are counted out
    and cut.
    """
    cols = [c for c in prints.columns if c != "node"]
    words = len(cols)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            keys = drawn_keys(np.ascontiguousarray(fps), bands, draws)
            lists = pa.ListArray.from_arrays(np.arange(len(fps) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    schema = "node long, " + ", ".join(f"{c} long" for c in cols)
    placed = prints.select("node", *cols).mapInArrow(keyed, schema + ", keys array<long>").select("node", F.explode("keys").alias("bucket"), *cols)
    counted = placed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    large = materialize(counted.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "simhash-buckets")
    sized = placed.join(large, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = _tiles(sized).select("node", "bucket", *cols)
    # Sorted by node too, the links of a bucket lead to its smallest node: those of a group are mostly the same in all its buckets.
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(lambda it: _link_batches(it, words, radius, link_pairs), "a long, b long")


def _tiles(rows: DataFrame) -> DataFrame:
    """``node, bucket, tiles, ..``: rows of a bucket of several tiles go to every pair of tiles that has theirs."""
    tile = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.xxhash64("bucket", F.least(j, tile), F.greatest(j, tile)))
    return rows.withColumn("bucket", F.explode(F.when(F.col("tiles") == 1, F.array("bucket")).otherwise(pairs)))


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """16 bytes that rows of one id and text share."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))


def _confirmed_edges(sets: DataFrame, texts: DataFrame, cols: list[str], shingle: int, radius: int, bands: int, draws: int, jaccard: float) -> DataFrame:
    """``a, b``: spanning edges of the nodes of ``sets`` whose shingles have Jaccard similarity ``jaccard`` or more.

    Fingerprints of the sets only choose candidates: whatever is reachable over
    ``radius`` and the keys is one group, and inside a group every pair that can
    still join two components is counted exactly (on 64-bit shingle hashes). A
    group beyond ``GROUP`` shingles is confirmed in tile pairs, so all its pairs
    meet in some task.
    """
    classes = materialize(sets.groupBy(*cols).agg(F.min("node").alias("node")).select("node", *cols), "simhash-classes")
    bands, draws = key_plan(64 * len(cols), bands, draws, classes.count(), jaccard)
    reached = connected_components(_candidate_edges(classes, radius, bands, draws))
    named = sets.join(classes.withColumnRenamed("node", "class"), cols).join(reached.withColumnRenamed("node", "class"), "class", "left")
    grouped = materialize(named.select("node", "n", F.col("rep.key").alias("key"), F.coalesce("component", "class").alias("bucket")), "simhash-groups")
    sizes = grouped.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("k > 1")
    tiles = sizes.select("bucket", F.col("k").alias("n"), F.greatest(F.ceil(F.col("total") / GROUP), F.lit(1)).cast("int").alias("tiles"))
    members = materialize(hot_join(grouped.select("node", "key", "bucket"), tiles, ["bucket"], grouped.count()), "simhash-members")
    some = _passed(texts, _key_bits(members)).where("_set").drop("_set")
    dealt = _tiles(some.join(members, "key")).select("node", "bucket", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _confirm_batches(it, shingle, jaccard), "a long, b long")


def without_near_copies(
    docs: DataFrame,
    shingle: int = 4,
    words: int = 1,
    radius: int = 4,
    bands: int | None = None,
    draws: int = 1,
    jaccard: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of each component of the texts of ``docs``, columns unchanged: that of the smallest id, ids before none.

    With ``jaccard`` links are pairs of shingle sets of that similarity or more,
    counted exactly (``_confirmed_edges``), else fingerprints within the radius.
    Texts decide, not ids: rows of one id and different texts are different
    documents; of rows equal in id and text one stays. Null texts are empty ones,
    and texts without words are copies of one another. An empty table stays empty.

    Decisions are made on 16 bytes a row; a text moves only where a bit filter
    says that it may have to be confirmed, dropped or made single.
    """
    key = _row_keys(docs, id_col, text_col)
    picked = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cols = [f"w{k}" for k in range(words)]
    printed = _printed(picked, shingle, words) if jaccard is None else _set_prints(picked, shingle, words)
    prints = materialize(printed, "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("rep")
    sets = materialize(prints.groupBy(*[c for c in prints.columns if c not in ("key", "doc_id")]).agg(first).withColumn("node", F.monotonically_increasing_id()), "simhash-sets")
    if jaccard is None:
        edges = near_edges(sets.select("node", *cols), radius, bands)
    else:
        edges = _confirmed_edges(sets, picked.select("key", "text"), cols, shingle, radius, bands or 1, draws, jaccard)
    linked = connected_components(edges)
    best = sets.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("rep").alias("rep"))
    keepers = best.select(F.col("rep.key").alias("key"), F.lit(True).alias("stays"))
    decided = prints.groupBy("key").agg(F.count("*").alias("rows")).join(keepers, "key", "left").where("stays is null or rows > 1")
    decided = materialize(decided.select("key", F.col("stays").isNotNull().alias("one")), "simhash-decided")
    release(prints)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _passed(docs.select(key.alias("key"), whole.alias("row")), _key_bits(decided))
    some = rows.where("_set").drop("_set")
    once = some.join(decided.where("one").select("key"), "key", "left_semi").dropDuplicates(["key"])
    kept = rows.where("not _set").drop("_set").unionByName(some.join(decided.select("key"), "key", "left_anti")).unionByName(once)
    return kept.select("row.*")


def _key_bits(keys: DataFrame) -> DataFrame:
    """``word, bits``: one bit of ``FILTER_BITS`` for each of the keys, in words of 64."""
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    marks = keys.select(place.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    return materialize(marks.groupBy("word").agg(F.bit_or("bit").alias("bits")), "simhash-bits")


def _passed(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``_set``: whether the key's bit is. Where it is not, the key is not among those marked, and the row need not move."""
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    placed = rows.withColumn("_at", place).withColumn("word", F.shiftright("_at", 6))
    found = placed.join(F.broadcast(words), "word", "left")  # FILTER_BITS / 64 rows at most
    hit = F.expr("coalesce(shiftright(bits, cast(_at & 63 as int)) & 1, 0L) = 1")
    return found.withColumn("_set", hit).select(*rows.columns, "_set")


def simhash_components(
    docs: DataFrame,
    shingle: int = 4,
    words: int = 1,
    radius: int = 4,
    bands: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, w0 .., component_id`` for each row of ``docs``.

    A-Z are lowered, words split at ASCII white space, shingles keep repeats;
    fewer words than ``shingle`` make one shingle, none make fingerprint zero,
    which links like any other. Null texts are empty texts. Rows that share an
    id are in one component. An empty table gives no rows; columns other than
    the two named are ignored.

    With the defaults every pair of fingerprints within ``radius`` is found.
    With ``bands`` keys, 64 * ``words`` bits: complete up to ``bands * words - 1``
    differing bits, then with the chance that some band agrees.
    """
    prints = materialize(fingerprints(docs, shingle, words, id_col, text_col), "simhash-prints")
    return near_components(prints, radius, bands)
