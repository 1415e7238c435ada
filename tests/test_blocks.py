"""Block storage and reprojection."""

import numpy as np
from pyspark.sql import functions as F

from orbitframe.operators import align, blocks, mask
from orbitframe.sources import surrogate


def test_window_read_prunes(spark, sf_dir, tmp_path):
    px = surrogate.pixels(spark, sf_dir).where("city < 2 and month_idx < 2")
    cut = blocks.cut(align.to_scenes(px), 6)
    blocks.write_blocks(cut, str(tmp_path / "b"))
    window = blocks.read_window(spark, str(tmp_path / "b"), (1, 2), (0, 0), ("r",)).where("city = 1")
    assert window.count() == 4 and "g" not in window.columns
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "brow" in plan.split("PushedFilters")[1]
    back = blocks.to_pixels(spark.read.schema(cut.schema).parquet(str(tmp_path / "b")).select(cut.columns), 6)
    assert back.exceptAll(px.select(back.columns)).isEmpty() and back.count() == px.count()


def test_quality_payload_equals_pixels(spark, sf_dir):
    px = surrogate.pixels(spark, sf_dir).where("city = 2 and month_idx = 4")
    row = blocks.mask_payloads(blocks.cut(align.to_scenes(px), 16)).first()
    got = np.frombuffer(row["quality"], np.uint8)
    want = mask.quality_masks(px).orderBy("y", "x").select(*[F.col(c).cast("int") for c in ("cloud", "shadow", "veg")]).toPandas()
    assert (got == want["cloud"] + 2 * want["shadow"] + 4 * want["veg"]).all()


def test_reproject_only_what_needs_it(spark):
    t = (0.5, 0.0, 10.0, 0.0, -0.5, 50.0)
    band = bytearray([7]) * 16
    rows = [(0, 0, 4, 4, band, band, band, band, 4326, t), (0, 1, 4, 4, band, band, band, band, 3857, t)]
    schema = f"{align.SCENE}, epsg int, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    df = spark.createDataFrame(rows, schema)
    assert [r["month_idx"] for r in df.where(align.needs_reprojection()).collect()] == [0]
    out = {r["month_idx"]: r for r in align.reproject(df).collect()}
    assert out[0]["epsg"] == 3857 and out[0]["height"] > 4 and set(out[0]["r"]) == {7}
    assert out[1]["transform"]["a"] == 0.5 and out[1]["height"] == 4
