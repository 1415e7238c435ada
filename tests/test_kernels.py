"""Kernels on hand-made rasters, and their agreement with the expressions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.functions import pixel as P
from orbitframe.operators import align, kernels, mask, reproject
from orbitframe.sources import surrogate

masks = st.integers(0, 2**64 - 1).map(lambda n: np.array([n >> i & 1 for i in range(64)]).reshape(8, 8))


def test_cloud_edges():
    one = lambda *v: [np.array([[x]], np.uint8) for x in v]
    assert not kernels.quality(*one(200, 200, 200))["cloud"][0, 0]
    assert kernels.quality(*one(200, 200, 201))["cloud"][0, 0]


def test_integer_predicates_equal_the_float_ones():
    r, g = np.meshgrid(np.arange(256), np.arange(256))
    want = (g - r) / (g + r + 1e-6) > K.VEGETATION_INDEX
    assert (kernels.quality(r, g, np.zeros_like(r))["veg"] == want).all()
    b = np.arange(256)[None, :]
    for total in range(120):
        part = b[b <= total]
        rest = total - part
        red = rest // 2
        got = kernels.quality(red, rest - red, part)["shadow"]
        mean = np.float32(total) / np.float32(3)
        ratio = part.astype(np.float32) / (mean + np.float32(1e-6))
        assert (got == ((mean < K.SHADOW_DARK) & (ratio > K.SHADOW_BLUE_RATIO))).all()


def test_block_masks_equal_pixel_masks(spark, sf_dir):
    px = surrogate.pixels(spark, sf_dir).where("city = 1 and month_idx = 3")
    rows = mask.quality_masks(px).toPandas()
    got = kernels.quality(rows["r"].to_numpy(), rows["g"].to_numpy(), rows["b"].to_numpy())
    for name, value in got.items():
        assert (rows[name].to_numpy() == value).all()


def test_scene_rows_round_trip(spark, sf_dir):
    px = surrogate.pixels(spark, sf_dir).where("city = 0 and month_idx < 2")
    back = align.to_pixels(align.to_scenes(px))
    assert back.exceptAll(px.select(back.columns)).isEmpty() and back.count() == px.count()


def test_edge_pad_repeats_the_last_row():
    band = np.arange(12, dtype=np.uint8).reshape(3, 4)
    out = kernels.edge_pad(band, 5)
    assert out.shape == (5, 5) and (out[3] == out[2]).all() and (out[:, 4] == out[:, 3]).all()
    assert kernels.edge_pad(np.zeros((7, 9)), 5).shape == (7, 9)


def test_cubic_keeps_constants_and_sums_to_one():
    assert np.allclose(kernels.cubic_weights(16, 64).sum(axis=1), 1)
    assert (kernels.resize_cubic(np.full((8, 8), 77, np.uint8), 32, 32) == 77).all()


def test_phase_shift_finds_a_roll():
    rng = np.random.default_rng(0)
    ref = rng.integers(0, 255, (32, 40))
    assert kernels.phase_shift(ref, np.roll(ref, (3, -5), (0, 1))) == (-3, 5)


def _two(dy, dx):
    out = np.zeros((16, 16), int)
    out[4:6, 4:6] = 1
    out[4 + dy : 6 + dy, 4 + dx : 6 + dx] = 1
    return out


def test_contact_of_two_buildings():
    assert kernels.contact(_two(0, 5)).any()
    assert kernels.contact(_two(5, 0)).any()
    assert not kernels.contact(_two(5, 5)).any()  # neither rows nor columns in common
    single = np.zeros((16, 16), int)
    single[4:8, 4:8] = 1
    assert not kernels.contact(single).any()


def brute_contact(mask, radius):
    """Pair by pair and pixel by pixel."""
    label = kernels.components(mask)
    spots = {n: np.argwhere(label == n) for n in np.unique(label) if n >= 0}
    out = np.zeros(mask.shape, bool)
    names = sorted(spots)
    for p in names:
        for q in names:
            if p >= q:
                continue
            (a0, a1), (c0, c1) = (spots[p].min(axis=0)[0], spots[p].max(axis=0)[0]), (spots[p].min(axis=0)[1], spots[p].max(axis=0)[1])
            (b0, b1), (d0, d1) = (spots[q].min(axis=0)[0], spots[q].max(axis=0)[0]), (spots[q].min(axis=0)[1], spots[q].max(axis=0)[1])
            for y, x in np.argwhere(label < 0):
                if np.abs(spots[p] - [y, x]).max(axis=1).min() > radius or np.abs(spots[q] - [y, x]).max(axis=1).min() > radius:
                    continue
                if max(a0, b0) <= min(a1, b1):
                    out[y, x] |= max(a0, b0) <= y <= min(a1, b1) and min(c0, d0) <= x <= max(c1, d1)
                elif max(c0, d0) <= min(c1, d1):
                    out[y, x] |= max(c0, d0) <= x <= min(c1, d1) and min(a0, b0) <= y <= max(a1, b1)
    return out


@given(st.integers(0, 2**100 - 1), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_contact_equals_pairs(bits, radius):
    rng = np.random.default_rng(bits)
    mask = (rng.random((10, 11)) < rng.uniform(0.05, 0.5)).astype(int)
    assert (kernels.contact(mask, radius) == brute_contact(mask, radius)).all()


def test_labels_of_a_large_scene():
    rng = np.random.default_rng(0)
    small = rng.random((64, 64)) < 0.25
    big = np.kron(small, np.ones((16, 16), int))

    distance = kernels.squared_distance(big)
    assert distance.max() < 4 * (2 * 1024) ** 2 and (distance > 0).sum() == big.sum()
    found = kernels.contact(big, 9)
    assert found.any() and not (found & big.astype(bool)).any()


def test_groups_are_powers_of_two():
    from orbitframe.operators import network

    assert [network.groups_for(n) for n in (64, 48, 24, 6, 32)] == [32, 16, 8, 2, 32]
    with pytest.raises(ValueError):
        network.groups_for(7)


def test_hue_saturation_value():
    import colorsys

    from orbitframe.operators import augment

    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (9, 9, 3)).astype(np.uint8)
    image[0] = [[10, 10, 10]] * 9
    assert np.abs(augment.shift_hsv(image, 0, 0, 0).astype(int) - image).max() <= 1
    got = augment.shift_hsv(image, 7.0, 15.0, -9.0)
    for y in range(9):
        for x in range(9):
            h, s, v = colorsys.rgb_to_hsv(*(image[y, x] / 255.0))
            want = colorsys.hsv_to_rgb((h + 7 / 180) % 1, min(max(s + 15 / 255, 0), 1), min(max(v - 9 / 255, 0), 1))
            assert np.abs(got[y, x] - 255 * np.array(want)).max() <= 1.01


def test_photometric_patches_follow_their_key(spark, sf_dir):
    from orbitframe.operators import augment, tile

    px = tile.chip(surrogate.pixels(spark, sf_dir).where("city < 2 and month_idx < 3"), 8)
    made = augment.photometric_patches(px).orderBy("city", "month_idx", "y", "x").toPandas()
    again = augment.photometric_patches(px.repartition(5)).orderBy("city", "month_idx", "y", "x").toPandas()
    other = augment.photometric_patches(px, epoch=1).orderBy("city", "month_idx", "y", "x").toPandas()
    assert made.equals(again) and not made.equals(other) and made[["r", "g", "b"]].stack().between(0, 255).all()


def test_watershed_split_of_a_patch(spark, sf_dir):
    """Every patch's labels: one for each peak's flood, kept components only."""
    from orbitframe.plans import catalogue

    rows = catalogue.QUERIES["watershed_split"](spark, sf_dir).toPandas()
    keep = catalogue.QUERIES["watershed_keep_wide"](spark, sf_dir).toPandas()
    both = rows.merge(keep, on=["city", "month_idx", "prow", "pcol", "y", "x"], suffixes=("", "_keep"))
    assert len(both) == len(rows) and ((both["watershed"] > 0) == (both["watershed_keep"] > 0)).all()


def test_border_does_not_erode():
    full = np.zeros((8, 8), int)
    full[:, :4] = 1
    edge = kernels.boundary(full)
    assert not edge[:, 0].any() and edge[:, 2:4].all()


def test_watershed_drops_what_has_no_interior_peak():
    image = np.zeros((16, 16), int)
    image[0:2, 0:16] = 1
    image[6:11, 6:11] = 1
    kept = kernels.watershed_keep(image)
    assert not kept[0:2].any() and kept[6:11, 6:11].all()


@given(masks)
@settings(max_examples=60, deadline=None)
def test_label_properties(m):
    foot = m.astype(bool)
    assert not (kernels.contact(m) & foot).any()
    assert not (kernels.boundary(m) & ~foot).any()
    assert not (kernels.watershed_keep(m) & ~foot).any()
    split = kernels.watershed_split(m)
    assert ((split > 0) == kernels.watershed_keep(m)).all()
    brute = np.zeros((8, 8), int)
    back = np.argwhere(~foot)
    if len(back):
        for y in range(8):
            for x in range(8):
                brute[y, x] = ((back - [y, x]) ** 2).sum(axis=1).min()
        assert (kernels.squared_distance(m) == brute).all()


def test_rasterize_and_clip():
    square = np.array([[1.25, 1.25], [4.75, 1.25], [4.75, 3.75], [1.25, 3.75], [1.25, 1.25]])
    out = kernels.rasterize([square], 6, 6)
    assert out.sum() == 6 and out[1:4, 1:5].sum() == 6 or out.any()
    assert kernels.clip_ring([(0, 0), (4, 0), (4, 4), (0, 4)], (2, 2, 6, 6)) != []
    assert kernels.clip_ring([(0, 0), (1, 0), (1, 1)], (2, 2, 6, 6)) == []


def test_mercator_round_trip():
    lon, lat = np.array([-71.3, 10.0]), np.array([42.1, -33.0])
    x, y = kernels.mercator(lon, lat)
    back = kernels.unmercator(x, y)
    assert np.allclose(back[0], lon) and np.allclose(back[1], lat)
    band = np.full((6, 6), 9, np.uint8)
    (out,), t = reproject.to_mercator([band], (0.01, 0, 10.0, 0, -0.01, 50.0), 4326)
    assert (out == 9).all() and t[0] == -t[4]


def test_zones_against_known_points():
    # Published pairs of degrees and zone metres.
    east, north = reproject.to_zone(np.array([-79.387139]), np.array([43.642567]), 17, False)
    assert abs(east[0] - 630084) < 1 and abs(north[0] - 4833439) < 1
    east, north = reproject.to_zone(np.array([9.0]), np.array([0.0]), 32, False)
    assert abs(east[0] - 500000) < 1e-6 and abs(north[0]) < 1e-6
    # The arc of the meridian from the equator to 45 degrees is 4984944.378 m long.
    assert abs(reproject.to_zone(np.array([9.0]), np.array([45.0]), 32, False)[1][0] / 0.9996 - 4984944.378) < 0.01
    rng = np.random.default_rng(4)
    lon, lat = rng.uniform(-3.5, 3.5, 200) + 147, rng.uniform(-84, 84, 200)
    for south in (False, True):
        back = reproject.from_zone(*reproject.to_zone(lon, lat, 55, south), 55, south)
        assert np.allclose(back[0], lon, atol=1e-9) and np.allclose(back[1], lat, atol=1e-9)
    assert reproject.zone_of(32755) == (55, True) and reproject.zone_of(3857) is None and reproject.zone_of(32661) is None


@pytest.mark.parametrize("epsg", [4326, 32633, 32755])
def test_reprojected_pixels_equal_plain_sampling(epsg):
    rng = np.random.default_rng(5)
    band = rng.integers(0, 256, (23, 31)).astype(np.uint8)
    t = (0.001, 0.0, 14.0, 0.0, -0.001, 51.0) if epsg == 4326 else (30.0, 0.0, 480_000.0, 0.0, -30.0, 5_700_000.0)
    (out,), made = reproject.to_mercator([band], t, epsg)
    assert (out > 0).mean() > 0.8 and out.size >= band.size * 0.9
    for y, x in zip(rng.integers(0, out.shape[0], 60), rng.integers(0, out.shape[1], 60), strict=True):
        lon, lat = kernels.unmercator(np.array(made[2] + (x + 0.5) * made[0]), np.array(made[5] + (y + 0.5) * made[4]))
        east, north = (lon, lat) if epsg == 4326 else reproject.to_zone(lon, lat, *reproject.zone_of(epsg))
        col, row = (float(east) - t[2]) / t[0], (float(north) - t[5]) / t[4]
        if not (0 <= col < 31 and 0 <= row < 23):
            assert out[y, x] == 0
            continue
        total = 0.0
        for r in (int(np.floor(row - 0.5)), int(np.floor(row - 0.5)) + 1):
            for c in (int(np.floor(col - 0.5)), int(np.floor(col - 0.5)) + 1):
                weight = (1 - abs(row - 0.5 - r)) * (1 - abs(col - 0.5 - c))
                total += weight * band[min(max(r, 0), 22), min(max(c, 0), 30)]
        assert abs(int(out[y, x]) - total) <= 0.5 + 1e-6


def test_unknown_systems_are_an_error():
    for epsg in (None, 2154, 32661):
        with pytest.raises(ValueError, match="EPSG"):
            reproject.to_mercator([np.zeros((2, 2), np.uint8)], (1.0, 0, 0, 0, -1.0, 0), epsg)


def test_lab_round_trip(spark):
    px = spark.createDataFrame([(10, 200, 30), (0, 0, 0), (255, 255, 255), (128, 64, 250)], "r int, g int, b int")
    lab = P.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    back = px.select("r", "g", "b", *[c.alias(n) for c, n in zip(P.lab_to_rgb(*lab), "xyz", strict=True)]).toPandas()
    assert np.allclose(back[["r", "g", "b"]].to_numpy(), back[["x", "y", "z"]].to_numpy(), atol=0.3)
