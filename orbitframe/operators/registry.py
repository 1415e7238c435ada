"""Temporal windows over positions, change counts, splits and epoch sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import constants as K


def position_months(observations: DataFrame, key: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``key, months``: the sorted distinct months of each position."""
    return observations.groupBy(*key).agg(F.sort_array(F.collect_set("month_idx")).alias("months"))


def complete_positions(patches: DataFrame, masks: DataFrame, key: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Positions all of whose months have a mask."""
    joined = patches.join(masks.select(*key, "month_idx").distinct().withColumn("_m", F.lit(1)), [*key, "month_idx"], "left")
    return joined.groupBy(*key).agg(F.sort_array(F.collect_set("month_idx")).alias("months"), F.count("_m").alias("n_masks"), F.count("*").alias("n_patches")).where("n_masks = n_patches").select(*key, "months")


def eligible(positions: DataFrame, n: int = K.WINDOW_MONTHS, gap: int = K.MIN_MONTH_GAP) -> DataFrame:
    """Enough months over a long enough span; the span is of the whole series."""
    last, first = F.element_at("months", -1), F.element_at("months", 1)
    return (
        positions.where((F.size("months") >= n) & (last - first >= gap))
        .withColumn("first_month", first)
        .withColumn("last_month", last)
        .withColumn("month_gap", last - first)
    )


def sliding_windows(positions: DataFrame, n: int = K.WINDOW_MONTHS) -> DataFrame:
    """Every run of ``n`` consecutive available months: ``window_idx, window_months``."""
    starts = F.sequence(F.lit(0), F.size("months") - n)
    runs = F.transform(starts, lambda i: F.struct(i.alias("window_idx"), F.slice("months", i + 1, F.lit(n)).alias("window_months")))
    return positions.where(F.size("months") >= n).withColumn("_w", F.explode(runs)).select(*positions.columns, "_w.*")


def even_windows(positions: DataFrame, n: int = K.WINDOW_MONTHS) -> DataFrame:
    """One window of ``n`` months spread evenly: half-even rounding, repeats dropped, the last month fills up."""
    step = (F.size("months") - 1) / float(max(1, n - 1))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step).cast("int")))
    picked = F.transform(at, lambda i: F.get("months", i))
    filled = F.concat(picked, F.array_repeat(F.element_at("months", -1), F.lit(n) - F.size(picked)))
    return positions.where(F.size("months") >= n).withColumn("window_idx", F.lit(0)).withColumn("window_months", filled)


def first_windows(positions: DataFrame, n: int = K.WINDOW_MONTHS) -> DataFrame:
    """The first ``n`` months, without the rule on the span."""
    return positions.where(F.size("months") >= n).withColumn("window_idx", F.lit(0)).withColumn("window_months", F.slice("months", 1, n))


def change_pixels(windows: DataFrame, footprints: DataFrame, key: tuple[str, ...] = ("city",)) -> DataFrame:
    """Windows with ``change_pixels`` between their first and last month, and ``has_change``.

    ``footprints`` is ``key, month_idx, y, x, footprint``. Only the two months
    of a window are joined, on the pixel.
    """
    ends = windows.select(*key, "window_idx", F.element_at("window_months", 1).alias("m0"), F.element_at("window_months", -1).alias("m1"))
    first = footprints.select(*key, F.col("month_idx").alias("m0"), "y", "x", F.col("footprint").alias("f0"))
    last = footprints.select(*key, F.col("month_idx").alias("m1"), "y", "x", F.col("footprint").alias("f1"))
    pairs = ends.join(first, [*key, "m0"]).join(last, [*key, "m1", "y", "x"])
    counted = pairs.groupBy(*key, "window_idx").agg(F.sum((F.col("f0") != F.col("f1")).cast("long")).alias("change_pixels"))
    return windows.join(counted, [*key, "window_idx"]).withColumn("has_change", F.col("change_pixels") > 0)


def build_registry(patches: DataFrame, masks: DataFrame, footprints: DataFrame, key: tuple[str, ...] = ("city",), n: int = K.WINDOW_MONTHS, gap: int = K.MIN_MONTH_GAP, sliding: bool = True) -> DataFrame:
    """The whole registry: complete positions, gates, windows, change."""
    gated = eligible(complete_positions(patches, masks, key), n, gap)
    return change_pixels(sliding_windows(gated, n) if sliding else even_windows(gated, n), footprints, key)


def month_paths(patches: DataFrame, key: tuple[str, ...] = ("pos",), path: str = "path") -> DataFrame:
    """``key, paths``: a map from month to file."""
    entry = F.struct("month_idx", F.col(path))
    return patches.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("paths"))


# --------------------------------------------------------------- sampling


def city_splits(cities: list[str], ratios: tuple[float, float, float] = K.SPLIT, seed: int = K.SAMPLE_SEED) -> dict[str, list[str]]:
    """Cities shuffled by a seeded stream and cut by whole counts; the rest is the test split."""
    assert abs(sum(ratios) - 1) < 1e-6
    order = sorted(cities)
    random.Random(seed).shuffle(order)
    a = int(len(order) * ratios[0])
    b = a + int(len(order) * ratios[1])
    return {"train": order[:a], "val": order[a:b], "test": order[b:]}


def _mixed(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def epoch_sample(registry: DataFrame, key: tuple[str, ...], size: int = K.EPOCH_SAMPLES, changed_share: float = K.CHANGED_SHARE, epoch: int = 0) -> DataFrame:
    """Windows of one epoch with their ``place`` in it.

    ``int(size * changed_share)`` changed windows, going round again if there
    are too few; the rest unchanged, not refilled. No changed windows give none.
    Order and choice are by a hash of the epoch and the key. Ranks are counted
    in hash ranges, so no task sorts a whole class alone.
    """
    want = int(size * changed_share)
    ranked = _rank(registry.withColumn("_h", _mixed(epoch, *key)), key)
    quota = F.when(F.col("has_change"), F.lit(want)).otherwise(F.lit(size - want))
    times = F.when(F.col("has_change"), F.ceil((quota - F.col("_rank") + 1) / F.col("_n"))).otherwise(F.when(F.col("_rank") <= quota, 1).otherwise(0))
    chosen = ranked.withColumn("_times", F.greatest(times, F.lit(0)).cast("int")).where("_times > 0").withColumn("cycle", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return _rank(chosen.withColumn("_h", _mixed(epoch + 1, *key, "cycle")).withColumn("_all", F.lit(True)), (*key, "cycle"), "_all").withColumn("place", F.col("_rank") - 1).drop("_h", "_rank", "_n", "_times", "_all")


def _rank(rows: DataFrame, key: tuple[str, ...], by: str = "has_change", parts: int = 64) -> DataFrame:
    """``_rank`` by ``_h`` within ``by`` and its size ``_n``: counts of hash ranges first, order inside a range next."""
    cut = rows.withColumn("_part", F.shiftright(F.shiftright("_h", 1) + F.lit(1 << 62), 57).cast("int"))
    sizes = cut.groupBy(by, "_part").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(by)
    before = sizes.withColumn("_before", F.sum("_k").over(w.orderBy("_part")) - F.col("_k")).withColumn("_n", F.sum("_k").over(w)).drop("_k")
    inside = Window.partitionBy(by, "_part").orderBy("_h", *key)
    return cut.join(before, [by, "_part"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside)).drop("_part", "_before")


def batches(sample: DataFrame, size: int, drop_last: bool = True) -> DataFrame:
    """``batch_idx`` by place; an incomplete last batch goes where ``drop_last``."""
    numbered = sample.withColumn("batch_idx", F.floor(F.col("place") / size).cast("long"))
    if not drop_last:
        return numbered
    full = numbered.groupBy("batch_idx").agg(F.count("*").alias("_n")).where(F.col("_n") == size).select("batch_idx")
    return numbered.join(full, "batch_idx", "left_semi")


def cached(registry: DataFrame, table_path: str, *snapshot: Column) -> DataFrame:
    """The registry, written once under a key of what it was made from and read back after that."""
    spark = registry.sparkSession
    key = spark.range(1).select(F.substring(F.md5(F.concat_ws("|", *snapshot)), 1, 10)).first()[0]
    path = f"{table_path}/{key}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        registry.write.mode("overwrite").parquet(path)
    return spark.read.schema(registry.schema).parquet(path)
