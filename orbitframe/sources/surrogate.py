"""Raster views over the driver's tables: deterministic, dense, the same in Spark and DuckDB.

They stand in for imagery in queries and tests. Integer sums only, so the order
of rows cannot matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITIES, MONTHS, SIDE = 5, 14, 16
#: Parameters that fit 16 x 16 scenes cut into 4 x 4 patches.
#: Patches of labels that need an interior are larger.
LABEL_PATCH = 8
PATCH, MIN_USABLE, MIN_PIF, MIN_LAB, SPECTRAL = 4, 60, 5, 10, 110.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``city, month_idx, y, x, r, g, b, a``, all int; a missing cell is black with alpha 0."""
    line, supp = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "supplier")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    cells = (
        line.join(supp, line["l_suppkey"] == supp["s_suppkey"])
        .groupBy(
            (F.col("s_nationkey") % CITIES).cast("int").alias("city"),
            F.floor(month / 6).cast("int").alias("month_idx"),
            (F.col("l_partkey") % SIDE).cast("int").alias("y"),
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % SIDE).cast("int").alias("x"),
        )
        .agg(
            (F.sum(F.floor("l_extendedprice")) % 256).cast("int").alias("r"),
            (F.sum(F.col("l_partkey") * 37 + F.col("l_orderkey")) % 256).cast("int").alias("g"),
            (F.sum(F.col("l_orderkey") * 11 + F.col("l_linenumber") * 53) % 256).cast("int").alias("b"),
        )
    )
    axis = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    grid = spark.range(CITIES).select(F.col("id").cast("int").alias("city"))
    for name, n in (("month_idx", MONTHS), ("y", SIDE), ("x", SIDE)):
        grid = grid.withColumn(name, F.explode(axis(n)))
    hole = (F.floor(F.col("y") / 4) * 4 + F.floor(F.col("x") / 4) + F.col("month_idx") + F.col("city")) % 9 == 0
    return grid.join(cells, ["city", "month_idx", "y", "x"], "left").select(
        "city", "month_idx", "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("r", "g", "b")], F.when(F.col("r").isNull() | hole, 0).otherwise(255).alias("a")
    )


def scenes(spark: SparkSession) -> DataFrame:
    """``city, month_idx, file`` of every scene, one file name a month."""
    grid = spark.range(CITIES).select(F.col("id").cast("int").alias("city")).withColumn("month_idx", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
    year = F.lit(2018) + F.floor(F.col("month_idx") / 12).cast("int")
    return grid.withColumn("file", F.format_string("mosaic_monthly__%d_%02d_c%02d.tif", year, F.col("month_idx") % 12 + 1, F.col("city")))


def unusable(px: DataFrame) -> DataFrame:
    """Usable-data masks that some scenes have: ``city, month_idx, y, x, value``."""
    return px.where((F.col("city") + F.col("month_idx")) % 3 == 0).where("city < 3").select("city", "month_idx", "y", "x", (F.col("b") > 230).cast("int").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, month_idx``: positions observed at some months (from users and days)."""
    ev = _table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("pos"), (F.dayofmonth("ts") - 1).alias("month_idx")).distinct()


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, channel, px, z, y``: 64 predictions and truths of each vector."""
    emb = _table(spark, sf_dir, "embeddings")
    truth = F.col("z") + F.when(F.col("label") % 2 == 0, 0.05).otherwise(-0.05) > 0
    return (
        emb.select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 3).cast("int").alias("channel"), "label", F.posexplode("embedding").alias("px", "v"))
        .withColumn("z", F.col("v").cast("double"))
        .select("sample", "channel", "px", "z", truth.cast("int").alias("y"))
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads with quarter-pixel corners, one for every part: ``city, month_idx, poly_id, ring`` (array of points)."""
    part = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cx, cy = (F.col("p_partkey") * 7 % 14 + 1), (F.col("p_partkey") * 11 % 14 + 1)
    w, h = (F.col("p_size") % 4 + 1), (F.floor(F.col("p_size") / 4) % 4 + 1)
    point = lambda x, y: F.struct((x).cast("double").alias("x"), (y).cast("double").alias("y"))
    ring = F.array(
        point(cx - w + 0.25, cy - h + 0.25), point(cx + w - 0.25, cy - h + 0.75), point(cx + w + 0.25, cy + h - 0.25), point(cx - w - 0.25, cy + h + 0.25), point(cx - w + 0.25, cy - h + 0.25)
    )
    return part.select((k % CITIES).cast("int").alias("city"), (F.floor(k / CITIES) % MONTHS).cast("int").alias("month_idx"), F.col("p_partkey").alias("poly_id"), ring.alias("ring"))


# ------------------------------------------------------------ DuckDB forms

PIXELS_SQL = f"""
cells as (
  select s_nationkey % {CITIES} as city, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) // 6 as month_idx,
         l_partkey % {SIDE} as y, (l_orderkey * 7 + l_linenumber) % {SIDE} as x,
         sum(cast(floor(l_extendedprice) as bigint)) % 256 as r, sum(l_partkey * 37 + l_orderkey) % 256 as g,
         sum(l_orderkey * 11 + l_linenumber * 53) % 256 as b
  from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3, 4),
px as materialized (
  select cast(c.i as int) as city, cast(m.i as int) as month_idx, cast(yy.i as int) as y, cast(xx.i as int) as x,
         cast(coalesce(k.r, 0) as int) as r, cast(coalesce(k.g, 0) as int) as g, cast(coalesce(k.b, 0) as int) as b,
         case when k.r is null or ((yy.i // 4) * 4 + xx.i // 4 + m.i + c.i) % 9 = 0 then 0 else 255 end as a
  from range({CITIES}) c(i), range({MONTHS}) m(i), range({SIDE}) yy(i), range({SIDE}) xx(i)
  left join cells k on k.city = c.i and k.month_idx = m.i and k.y = yy.i and k.x = xx.i)"""

QUALITY_SQL = """
q as materialized (
  select *, cloud or shadow or veg as combined from (
    select *, not cloud and r + g + b < 120 and 30 * b > 11 * (r + g + b) as shadow, 10 * (g - r) > g + r as veg
    from (select *, r + g + b > 600 as cloud from px)))"""

SCENES_SQL = f"""
scene as (
  select cast(c.i as int) as city, cast(m.i as int) as month_idx,
         printf('mosaic_monthly__%d_%02d_c%02d.tif', 2018 + m.i // 12, m.i % 12 + 1, c.i) as file
  from range({CITIES}) c(i), range({MONTHS}) m(i))"""

SERIES_SQL = "series as (select distinct user_id as pos, cast(day(ts) - 1 as int) as month_idx from events)"

LOGITS_SQL = """
logits as (
  select sample, channel, px, z, case when z + case when label % 2 = 0 then 0.05::double else -0.05::double end > 0 then 1 else 0 end as y
  from (select vec_id as sample, cast(vec_id % 3 as int) as channel, label, cast(generate_subscripts(embedding, 1) - 1 as int) as px,
               cast(unnest(embedding) as double) as z from embeddings))"""

POLYGONS_SQL = f"""
poly as (
  select cast(p_partkey % {CITIES} as int) as city, cast((p_partkey // {CITIES}) % {MONTHS} as int) as month_idx, p_partkey as poly_id,
         p_partkey * 7 % 14 + 1 as cx, p_partkey * 11 % 14 + 1 as cy, p_size % 4 + 1 as w, (p_size // 4) % 4 + 1 as h
  from part),
ring as (
  select city, month_idx, poly_id, cast(i as int) as seq,
         cast(case i when 0 then cx - w + 0.25 when 1 then cx + w - 0.25 when 2 then cx + w + 0.25 when 3 then cx - w - 0.25 else cx - w + 0.25 end as double) as x,
         cast(case i when 0 then cy - h + 0.25 when 1 then cy - h + 0.75 when 2 then cy + h - 0.25 when 3 then cy + h + 0.25 else cy - h + 0.25 end as double) as y
  from poly, range(5) t(i)),
edge as (
  select a.city, a.month_idx, a.poly_id, a.seq, a.x as x1, a.y as y1, b.x as x2, b.y as y2
  from ring a join ring b on a.poly_id = b.poly_id and b.seq = a.seq + 1)"""
