"""Queries over pixels: masks, normalisation, tiling, labels, alignment."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.functions import pixel as P
from orbitframe.operators import align, augment, blocks, labels, mask, normalize, tile
from orbitframe.sources import surrogate as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None, *views: str):
    """Registers a query under its name, with an oracle over the given views."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            head = "with recursive " if "union\n" in oracle or "recursive" in oracle else "with "
            ORACLES[f.__name__] = (head + ",\n".join(v.strip() for v in views) + "\n" + oracle.replace("recursive ", "")) if views else oracle
        return f

    return add


PX, Q = S.PIXELS_SQL, S.QUALITY_SQL


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.quality_masks(S.pixels(spark, sf_dir))


# ------------------------------------------------------------------ masks


@_query(
    """
select city, month_idx, count(*) as n_px, count(*) filter (cloud) as n_cloud, count(*) filter (shadow) as n_shadow, count(*) filter (veg) as n_veg,
       count(*) filter (combined) as n_combined, count(*) filter (not combined) as n_usable,
       100.0::double * count(*) filter (cloud) / count(*) as pct_cloud, 100.0::double * count(*) filter (shadow) / count(*) as pct_shadow,
       100.0::double * count(*) filter (veg) / count(*) as pct_veg, 100.0::double * count(*) filter (combined) / count(*) as pct_combined
from q group by city, month_idx""",
    PX,
    Q,
)
def quality_summary(spark, sf_dir):
    return mask.quality_summary(_quality(spark, sf_dir))


@_query("select city, month_idx, y, x, cloud, shadow, veg, combined from q", PX, Q)
def mask_pixels(spark, sf_dir):
    return _quality(spark, sf_dir).select("city", "month_idx", "y", "x", "cloud", "shadow", "veg", "combined")


@_query(
    """
, grouped as (
  select city, month_idx, grouping(city) as g_city, grouping(month_idx) as g_month, count(*) as n_px, count(*) filter (combined) as n_combined from q group by rollup(city, month_idx))
select coalesce(city, -1) as city, coalesce(month_idx, -1) as month_idx, cast(g_city as int) as g_city, cast(g_month as int) as g_month, n_px, n_combined from grouped""",
    PX,
    Q,
)
def quality_rollup(spark, sf_dir):
    rolled = _quality(spark, sf_dir).rollup("city", "month_idx")
    out = rolled.agg(F.grouping("city").cast("int").alias("g_city"), F.grouping("month_idx").cast("int").alias("g_month"), F.count("*").alias("n_px"), F.count_if("combined").alias("n_combined"))
    whole = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("city", "month_idx")]
    return out.select(*whole, "g_city", "g_month", "n_px", "n_combined")


_UDM = """
udm as (select city, month_idx, y, x, case when b > 230 then 1 else 0 end as value from px where (city + month_idx) % 3 = 0 and city < 3)"""


@_query(
    """
select p.city, p.month_idx, max(case when u.value is null then 0 else 1 end) as external, count(*) filter (coalesce(u.value > 0, p.r + p.g + p.b > 600)) as n_cloud
from px p left join udm u using (city, month_idx, y, x) group by p.city, p.month_idx""",
    PX,
    _UDM,
)
def cloud_priority_udm(spark, sf_dir):
    px = S.pixels(spark, sf_dir)
    udm = S.unusable(px)
    quality = mask.quality_masks(px, udm)
    have = udm.select("city", "month_idx").distinct().withColumn("external", F.lit(1))
    counted = quality.groupBy("city", "month_idx").agg(F.count_if("cloud").alias("n_cloud"))
    return counted.join(have, ["city", "month_idx"], "left").select("city", "month_idx", F.coalesce("external", F.lit(0)).alias("external"), "n_cloud")


def _mask_files(spark):
    return S.scenes(spark).where("(city + month_idx) % 3 = 0 and city < 3").select("city", F.col("file").alias("mask_file"))


_MATCH = """
mfile as (select city, file as mask_file from scene where (city + month_idx) % 3 = 0 and city < 3)"""


@_query(
    """
select city, month_idx, file, mask_file from (
  select s.*, m.mask_file, row_number() over (partition by s.city, s.month_idx order by case when replace(s.file, '.tif', '') = replace(m.mask_file, '.tif', '') then 0 else 1 end, m.mask_file) as n
  from scene s left join mfile m on m.city = s.city and (contains(replace(s.file, '.tif', ''), replace(m.mask_file, '.tif', '')) or contains(replace(m.mask_file, '.tif', ''), substr(replace(s.file, '.tif', ''), 1, 20))))
where n = 1""",
    S.SCENES_SQL,
    _MATCH,
)
def udm_match_lenient(spark, sf_dir):
    return mask.match_masks(S.scenes(spark), _mask_files(spark), strict=False)


@_query(
    """
select s.city, s.month_idx, s.file, m.mask_file from scene s left join mfile m on m.city = s.city and regexp_extract(s.file, '(\\d{4}_\\d{2})', 1) = regexp_extract(m.mask_file, '(\\d{4}_\\d{2})', 1)""",
    S.SCENES_SQL,
    _MATCH,
)
def udm_match_strict(spark, sf_dir):
    return mask.match_masks(S.scenes(spark), _mask_files(spark), strict=True)


# ---------------------------------------------------------- normalisation

_LONG = """
long as (
  select city, month_idx, y, x, not combined as usable, band, v from q, lateral (values ('r', r), ('g', g), ('b', b)) t(band, v))"""
_STATS = """
sums as (
  select city, month_idx, band, count(*) filter (usable) as n, coalesce(cast(sum(cast(v as bigint)) filter (usable) as bigint), 0) as s1,
         coalesce(cast(sum(cast(v as bigint) * v) filter (usable) as bigint), 0) as s2 from long group by all),
stats as (
  select city, month_idx, band, n, case when n >= 10 then s1 / n::double else 0.0::double end as mean,
         case when n >= 10 then sqrt((n * s2 - s1 * s1)::double / (n::double * n::double)) + 1e-8 else 1.0::double end as std from sums)"""


@_query("select city, month_idx, band, n, round(mean, 9) as mean, round(std, 9) as std from stats", PX, Q, _LONG, _STATS)
def band_stats(spark, sf_dir):
    return normalize.band_stats(_quality(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@_query(
    f"""
, usable_r as (select city, month_idx, n from stats where band = 'r'),
moved as (
  select l.city, l.month_idx, l.y, l.x, l.band,
         case when l.month_idx = 0 or u.n < {S.MIN_USABLE} then l.v
              else cast(trunc(greatest(least((l.v - s.mean) / s.std * f.std + f.mean, 255.0::double), 0.0::double)) as int) end as v
  from long l join stats s using (city, month_idx, band) join stats f on f.city = l.city and f.band = l.band and f.month_idx = 0
  join usable_r u on u.city = l.city and u.month_idx = l.month_idx)
select city, month_idx, y, x, max(v) filter (band = 'r') as r, max(v) filter (band = 'g') as g, max(v) filter (band = 'b') as b from moved group by city, month_idx, y, x""",
    PX,
    Q,
    _LONG,
    _STATS,
)
def zscore_normalize(spark, sf_dir):
    return normalize.zscore_normalize(_quality(spark, sf_dir), S.MIN_USABLE).select("city", "month_idx", "y", "x", "r", "g", "b")


_PAIRS = """
pairs as materialized (
  select m.city, m.month_idx, m.y, m.x, m.band, f.v as ref, m.v as mov from long m join long f
    on f.city = m.city and f.y = m.y and f.x = m.x and f.band = m.band and f.month_idx = 0
  where m.month_idx > 0 and m.usable and f.usable),
p30 as (select city, month_idx, band, count(*) as n_pairs, quantile_cont(abs(ref - mov)::double, 0.3) as p30 from pairs group by all),
pif as (select p.* from pairs p join p30 using (city, month_idx, band) where ref + mov between 120 and 380 and abs(ref - mov) <= p30 + 1e-9)"""


@_query("select city, month_idx, band, n_pairs, round(p30, 6) as p30 from p30", PX, Q, _LONG, _PAIRS)
def pif_percentile(spark, sf_dir):
    return normalize.difference_percentile(normalize.reference_pairs(_quality(spark, sf_dir))).withColumn("p30", F.round("p30", 6))


_FIT = f"""
psum as (
  select city, month_idx, band, count(*) as n, sum(mov::bigint)::double as sx, sum(ref::bigint)::double as sy, sum(mov::bigint * mov)::double as sxx, sum(mov::bigint * ref)::double as sxy,
         min(mov) as lo, max(mov) as hi from pif group by all),
fit as (
  select city, month_idx, band, n, slope, case when flat then 0.0::double else (sy - slope * sx) / n end as intercept
  from (select *, n < {S.MIN_PIF} or lo = hi as flat, case when n < {S.MIN_PIF} or lo = hi then 1.0::double else (n * sxy - sx * sy) / (n * sxx - sx * sx) end as slope from psum))"""


@_query("select city, month_idx, band, n, round(slope, 9) as slope, round(intercept, 7) as intercept from fit", PX, Q, _LONG, _PAIRS, _FIT)
def pif_regression(spark, sf_dir):
    fitted = normalize.pif_regression(_quality(spark, sf_dir), S.MIN_PIF)
    return fitted.withColumns({"slope": F.round("slope", 9), "intercept": F.round("intercept", 7)})


@_query(
    """
, moved as (
  select l.city, l.month_idx, l.y, l.x, l.band, cast(trunc(greatest(least(coalesce(slope, 1.0::double) * v + coalesce(intercept, 0.0::double), 255.0::double), 0.0::double)) as int) as v
  from long l left join fit using (city, month_idx, band))
select city, month_idx, band, count(*) as n, cast(sum(v) as bigint) as total from moved group by all""",
    PX,
    Q,
    _LONG,
    _PAIRS,
    _FIT,
)
def pif_apply(spark, sf_dir):
    quality = _quality(spark, sf_dir)
    out = normalize.long_bands(normalize.pif_apply(quality, normalize.pif_regression(quality, S.MIN_PIF)))
    return out.groupBy("city", "month_idx", "band").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("total"))


@_query(
    f"""
, z as (select city, month_idx, y, x, r + 1 as r, g as g, b as b from px where month_idx % 2 = 1)
select p.city, p.month_idx, p.y, p.x, coalesce(z.r, p.r) as r, coalesce(z.g, p.g) as g, coalesce(z.b, p.b) as b from px p left join z using (city, month_idx, y, x)""",
    PX,
)
def prefer_corrected(spark, sf_dir):
    px = S.pixels(spark, sf_dir)
    return normalize.prefer(px.where("month_idx % 2 = 1").withColumn("r", F.col("r") + 1), px)


_M = K.RGB_TO_XYZ
_LAB = "".join(
    [
        """
lin as (
  select *, """,
        ", ".join(f"case when {c} / 255.0::double > 0.04045 then pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) else {c} / 255.0::double / 12.92 end as l{c}" for c in K.BANDS),
        """ from q),
xyz as (
  select *, """,
        ", ".join(f"({m[0]} * lr + {m[1]} * lg + {m[2]} * lb)::double / {w} as t{i}" for i, (m, w) in enumerate(zip(_M, K.WHITE, strict=True))),
        """ from lin),
ff as (
  select *, """,
        ", ".join(f"case when t{i} > 0.008856 then cbrt(t{i}) else 7.787 * t{i} + 16.0::double / 116.0 end as f{i}" for i in range(3)),
        """ from xyz),
lab as (
  select city, month_idx, y, x, combined, 116.0::double * f1 - 16.0 as l, 500.0::double * (f0 - f1) as a_, 200.0::double * (f1 - f2) as b_ from ff)""",
    ]
)
_LABSTATS = f"""
labstats as (
  select city, month_idx, """ + ", ".join(
    f"case when count(*) filter (not combined) >= {S.MIN_LAB} then {fn}({c}) filter (not combined) else {fn}({c}) end{more} as {c}_{n}"
    for c in ("l", "a_", "b_")
    for fn, n, more in (("avg", "mean", ""), ("stddev_pop", "std", " + 1e-8"))
) + " from lab group by city, month_idx)"


@_query("select city, month_idx, " + ", ".join(f"round({c}_{s}, 5) as {c}_{s}" for c in ("l", "a_", "b_") for s in ("mean", "std")) + " from labstats", PX, Q, _LAB, _LABSTATS)
def lab_stats(spark, sf_dir):
    stats = normalize.lab_stats(_quality(spark, sf_dir), S.MIN_LAB)
    return stats.withColumns({c: F.round(c, 5) for c in stats.columns if c not in ("city", "month_idx")})


@_query(
    """
select l.city, l.month_idx, """
    + ", ".join(f"round(avg((l.{c} - s.{c}_mean) / s.{c}_std * f.{c}_std + f.{c}_mean), 4) as {n}" for c, n in (("l", "l"), ("a_", "a"), ("b_", "b")))
    + """
from lab l join labstats s using (city, month_idx) join labstats f on f.city = l.city and f.month_idx = 0 group by l.city, l.month_idx""",
    PX,
    Q,
    _LAB,
    _LABSTATS,
)
def lab_match(spark, sf_dir):
    matched = normalize.lab_match(_quality(spark, sf_dir), S.MIN_LAB)
    return matched.groupBy("city", "month_idx").agg(*[F.round(F.avg(f"lab_{c}"), 4).alias(c) for c in ("l", "a", "b")])


# ----------------------------------------------------------------- tiling

_PATCHES = f"""
patches as materialized (
  select city, month_idx, y // {S.PATCH} as prow, x // {S.PATCH} as pcol, count(*) as n_px, count(*) filter (a = 0) as n_transparent, cast(sum(r + g + b) as bigint) as brightness
  from px group by all)"""


def _patches(spark, sf_dir):
    return tile.patch_summary(S.pixels(spark, sf_dir), S.PATCH)


@_query("select city, month_idx, prow, pcol, n_px, n_transparent from patches where n_transparent / n_px::double > 0.9", PX, _PATCHES)
def alpha_filter(spark, sf_dir):
    return _patches(spark, sf_dir).where(tile.mostly_nodata()).select(*tile.PATCH, "n_px", "n_transparent")


@_query(f"select city, month_idx, prow, pcol, brightness >= 3 * {S.SPECTRAL} * n_px as has_buildings from patches", PX, _PATCHES)
def spectral_gate(spark, sf_dir):
    return _patches(spark, sf_dir).select(*tile.PATCH, tile.spectral_buildings(S.SPECTRAL).alias("has_buildings"))


def _draw_values(n: int) -> str:
    stream = random.Random(K.SAMPLE_SEED)
    return ", ".join(f"({k + 1}, {stream.random()!r}::double)" for k in range(n))


_PICKED = f"""
gated as (select *, n_transparent / n_px::double > 0.9 as nodata, brightness >= 3 * {S.SPECTRAL} * n_px as has_buildings from patches),
draws(k, u) as (values {_draw_values(S.MONTHS * 16)}),
numbered as (
  select *, case when not nodata and not has_buildings then row_number() over (partition by city, not nodata and not has_buildings order by month_idx, prow, pcol) end as k from gated),
picked as (
  select n.*, case when nodata then 'nodata' when has_buildings then 'building' when u < 0.1 then 'background' else 'sampled_out' end as keep_reason from numbered n left join draws using (k))"""


def _picked(spark, sf_dir):
    return tile.select_patches(_patches(spark, sf_dir), exact=True, spectral=S.SPECTRAL)


@_query("select city, month_idx, prow, pcol, cast(coalesce(k, 0) as int) as k, keep_reason from picked", PX, _PATCHES, _PICKED)
def background_sample_exact(spark, sf_dir):
    return _picked(spark, sf_dir).select(*tile.PATCH, F.coalesce("k", F.lit(0)).cast("int").alias("k"), "keep_reason")


@_query(
    """
select city, count(*) as n_patches, count(*) filter (keep_reason = 'nodata') as n_nodata, count(*) filter (keep_reason = 'building') as n_building,
       count(*) filter (keep_reason = 'background') as n_background, count(*) filter (keep_reason = 'sampled_out') as n_sampled_out
from picked group by city""",
    PX,
    _PATCHES,
    _PICKED,
)
def chip_summary(spark, sf_dir):
    return tile.chip_summary(_picked(spark, sf_dir))


@_query(None)
def background_sample_hash(spark, sf_dir):
    """The scalable default: draws by a hash of the patch's key."""
    return tile.kept(tile.select_patches(_patches(spark, sf_dir), spectral=S.SPECTRAL)).select(*tile.PATCH, "keep_reason")


@_query(
    """
select printf('c%02d_x', city) as city_id, printf('c%02d_m%02d_r%02d_c%02d.tif', city, month_idx, prow, pcol) as name, printf('c%02d', city) as city_back,
       month_idx as month_back, cast(prow as int) as row_back, cast(pcol as int) as col_back,
       printf('c%02d_m%02d_r%02d_c%02d_watershed.png', city, month_idx, prow, pcol) as mask from patches""",
    PX,
    _PATCHES,
)
def patch_names(spark, sf_dir):
    rows = _patches(spark, sf_dir).withColumn("city_id", F.format_string("c%02d_x", "city"))
    named = rows.withColumn("name", P.patch_name(P.short_city(F.col("city_id")), F.col("month_idx"), F.col("prow"), F.col("pcol")))
    back = named.withColumn("p", P.parse_patch(F.col("name")))
    fbc = P.mask_name(F.concat(F.substring_index("name", ".", 1), F.lit("_fbc.png")))
    return back.select("city_id", "name", F.col("p.city").alias("city_back"), F.col("p.month_idx").alias("month_back"), F.col("p.prow").alias("row_back"), F.col("p.pcol").alias("col_back"), fbc.alias("mask"))


@_query("select city, month_idx, file, cast(row_number() over (partition by city order by file) - 1 as int) as place, regexp_extract(file, '(\\d{4}_\\d{2})', 1) as month_name from scene", S.SCENES_SQL)
def scene_listing(spark, sf_dir):
    listed = mask.month_index(S.scenes(spark).withColumn("given", F.col("month_idx")).drop("month_idx"))
    return listed.select("city", F.col("given").alias("month_idx"), "file", F.col("month_idx").alias("place"), P.month_name(F.col("file")).alias("month_name"))


_GEO = f"""
placed as (
  select p.*, prow * {S.PATCH} as row_offset_px, pcol * {S.PATCH} as col_offset_px, city * 1000.5 + pcol * {S.PATCH} * 1.25::double as c, 5000.25 - month_idx * 10 + prow * {S.PATCH} * -1.25::double as f from patches p),
bounded as (
  select *, c as left_, c + {S.PATCH} * 1.25::double as right_, f as top_, f + {S.PATCH} * -1.25::double as bottom_ from placed)"""


def _placed(spark, sf_dir):
    return tile.patch_bounds(_patches(spark, sf_dir), tile.scene_transform(S.scenes(spark)), S.PATCH)


@_query(
    "select city, month_idx, cast(prow as int) as prow, cast(pcol as int) as pcol, round_even(left_, 2) as left_, round_even(right_, 2) as right_, round_even(top_, 2) as top_, round_even(bottom_, 2) as bottom_ from bounded",
    PX,
    _PATCHES,
    _GEO,
)
def patch_bounds(spark, sf_dir):
    return _placed(spark, sf_dir).select(*tile.PATCH, *[F.col(f"bounds.{s}").alias(f"{s}_") for s in ("left", "right", "top", "bottom")])


@_query(
    f"""
select printf('c%02d', city) || '_' || printf('%02d-%02d-%02d', month_idx, prow, pcol) as k,
       to_json(struct_pack(patch_id := printf('c%02d_m%02d_r%02d_c%02d.tif', city, month_idx, prow, pcol), city_id := printf('c%02d_x', city), city_id_short := printf('c%02d', city),
         month_idx := month_idx, month_name := regexp_extract(s.file, '(\\d{{4}}_\\d{{2}})', 1), "row" := prow, col := pcol, patch_size_px := {S.PATCH}, row_offset_px := row_offset_px, col_offset_px := col_offset_px,
         bounds_epsg3857 := struct_pack("left" := round_even(left_, 2), "right" := round_even(right_, 2), top := round_even(top_, 2), bottom := round_even(bottom_, 2)), pipeline_version := '1.0'))::varchar as sidecar
from bounded join scene s using (city, month_idx)""",
    PX,
    _PATCHES,
    S.SCENES_SQL,
    _GEO,
)
def sidecar_json(spark, sf_dir):
    files = S.scenes(spark)
    rows = _placed(spark, sf_dir).join(files, ["city", "month_idx"]).withColumn("city_id", F.format_string("c%02d_x", "city")).withColumn("month_name", P.month_name(F.col("file")))
    made = tile.sidecars(rows, S.PATCH)
    key = F.concat(F.format_string("c%02d", "city"), F.lit("_"), F.format_string("%02d-%02d-%02d", "month_idx", "prow", "pcol"))
    return made.select(key.alias("k"), F.to_json("sidecar").alias("sidecar"))


# ----------------------------------------------------------------- labels

_RASTER = """
burnt as (
  select p.city, p.month_idx, p.y, p.x, e.poly_id from px p join edge e on e.city = p.city and e.month_idx = p.month_idx
  where (e.y1 > p.y + 0.5) <> (e.y2 > p.y + 0.5) and p.x + 0.5 < (e.x2 - e.x1) * (p.y + 0.5 - e.y1) / (e.y2 - e.y1) + e.x1
  group by all having count(*) % 2 = 1)"""


@_query(
    "select p.city, p.month_idx, p.y, p.x, case when exists (select 1 from burnt b where b.city = p.city and b.month_idx = p.month_idx and b.y = p.y and b.x = p.x) then 1 else 0 end as footprint from px p",
    PX,
    S.POLYGONS_SQL,
    _RASTER,
)
def rasterize_footprint(spark, sf_dir):
    px = S.pixels(spark, sf_dir).select("city", "month_idx", "y", "x")
    return labels.rasterize(px, S.polygons(spark, sf_dir))


@_query(
    f"""
, grid as (select cast(r.i as int) as prow, cast(c.i as int) as pcol from range(4) r(i), range(4) c(i)),
hull as (select city, month_idx, poly_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from ring group by all)
select distinct city, month_idx, prow, pcol from hull, grid
where x0 <= (pcol + 1) * {S.PATCH} and x1 >= pcol * {S.PATCH} and y0 <= (prow + 1) * {S.PATCH} and y1 >= prow * {S.PATCH}""",
    S.POLYGONS_SQL,
)
def polygon_patch_boxes(spark, sf_dir):
    return labels.patch_touch(S.polygons(spark, sf_dir), S.PATCH, 4).select("city", "month_idx", "prow", "pcol").distinct()


@_query(None)
def polygon_patch_semijoin(spark, sf_dir):
    """Patches that a polygon really meets, after clipping."""
    return labels.polygon_patches(S.polygons(spark, sf_dir), S.PATCH, 4)


_FP = "fp as materialized (select city, month_idx, y, x, case when r >= 140 then 1 else 0 end as footprint from px)"


def _footprint(spark, sf_dir):
    return S.pixels(spark, sf_dir).select("city", "month_idx", "y", "x", (F.col("r") >= 140).cast("int").alias("footprint"))


def _patched(spark, sf_dir, size: int) -> DataFrame:
    return tile.chip(_footprint(spark, sf_dir), size)


def _fp_by(size: int) -> str:
    return f"""fp as materialized (
  select city, month_idx, y // {size} as prow, x // {size} as pcol, y, x, case when r >= 140 then 1 else 0 end as footprint from px)"""


_AT = ["city", "month_idx", "prow", "pcol", "y", "x"]
_ROW = "cast({0}.prow as int) as prow, cast({0}.pcol as int) as pcol"
_SAME = "{0}.city = {1}.city and {0}.month_idx = {1}.month_idx and {0}.prow = {1}.prow and {0}.pcol = {1}.pcol"


def _reach(steps: str, size: int) -> str:
    """Pixels that reach each other inside a patch, by union-find's plain form."""
    return f"""
reach(city, month_idx, prow, pcol, k, j) as (
  select city, month_idx, prow, pcol, y * 16 + x, y * 16 + x from fp where footprint = 1
  union
  select r.city, r.month_idx, r.prow, r.pcol, r.k, f.y * 16 + f.x from reach r join fp f on {_SAME.format("f", "r")} and f.footprint = 1 and {steps}),
comp as materialized (
  select city, month_idx, prow, pcol, k // 16 as y, k % 16 as x, min(j) // 16 % {size} * {size} + min(j) % 16 % {size} as label from reach group by city, month_idx, prow, pcol, k)"""


_EIGHT = "abs(f.y - r.j // 16) <= 1 and abs(f.x - r.j % 16) <= 1"
_FOUR = "abs(f.y - r.j // 16) + abs(f.x - r.j % 16) <= 1"


def _label_queries(size: int, tail: str) -> None:
    """The label channels of patches of ``size`` pixels."""
    views = (PX, _fp_by(size))

    def add(name: str, run, oracle: str, *more: str) -> None:
        def query(spark, sf_dir):
            return run(_patched(spark, sf_dir, size))

        query.__name__ = name + tail
        _query(oracle, *views, *more)(query)

    add(
        "boundary_mask",
        lambda px: labels.boundary(px).select(*_AT, "boundary"),
        f"""
select a.city, a.month_idx, {_ROW.format("a")}, a.y, a.x, a.footprint * (1 - min(b.footprint)) as boundary from fp a join fp b
  on {_SAME.format("a", "b")} and b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2
group by a.city, a.month_idx, a.prow, a.pcol, a.y, a.x, a.footprint""",
    )
    add(
        "components",
        labels.component_labels,
        f"select f.city, f.month_idx, {_ROW.format('f')}, f.y, f.x, cast(coalesce(label, -1) as bigint) as label from fp f left join comp using (city, month_idx, prow, pcol, y, x) /* recursive */",
        _reach(_EIGHT, size),
    )
    add(
        "contact_mask",
        labels.contact,
        f"""/* recursive */
select f.city, f.month_idx, {_ROW.format("f")}, f.y, f.x, cast(max(case when c.y is null then 0 else 1 end) as bigint) as contact
from fp f left join clipped c using (city, month_idx, prow, pcol, y, x) group by all""",
        _reach(_EIGHT, size),
        f"""
wide as materialized (
  select distinct c.city, c.month_idx, c.prow, c.pcol, c.label, f.y, f.x from comp c join fp f on {_SAME.format("f", "c")} and f.y between c.y - 3 and c.y + 3 and f.x between c.x - 3 and c.x + 3),
box as (select city, month_idx, prow, pcol, label, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from comp group by all),
clipped as (
  select distinct a.city, a.month_idx, a.prow, a.pcol, a.y, a.x
  from wide a join wide b using (city, month_idx, prow, pcol, y, x) join box p on {_SAME.format("p", "a")} and p.label = a.label
  join box q on {_SAME.format("q", "a")} and q.label = b.label join fp f on {_SAME.format("f", "a")} and f.y = a.y and f.x = a.x
  where a.label < b.label and f.footprint = 0 and case
    when greatest(p.y0, q.y0) <= least(p.y1, q.y1)
    then a.y between greatest(p.y0, q.y0) and least(p.y1, q.y1) and a.x between least(p.x0, q.x0) and greatest(p.x1, q.x1)
    else a.x between greatest(p.x0, q.x0) and least(p.x1, q.x1) and a.y between least(p.y0, q.y0) and greatest(p.y1, q.y1) end)""",
    )
    add(
        "watershed_keep",
        labels.watershed,
        f"""/* recursive */
select f.city, f.month_idx, {_ROW.format("f")}, f.y, f.x,
       cast(case when c.label is not null and (c.city, c.month_idx, c.prow, c.pcol, c.label) in (select (city, month_idx, prow, pcol, label) from seed) then 1 else 0 end as bigint) as watershed
from fp f left join comp c using (city, month_idx, prow, pcol, y, x)""",
        _reach(_FOUR, size),
        f"""
near as (
  select f.city, f.month_idx, f.prow, f.pcol, f.y, f.x, min((f.y - z.y) * (f.y - z.y) + (f.x - z.x) * (f.x - z.x)) as d
  from fp f join fp z on {_SAME.format("z", "f")} and z.footprint = 0 group by all),
edt as materialized (
  select f.city, f.month_idx, f.prow, f.pcol, f.y, f.x, case when f.footprint = 0 then 0 else coalesce(d, 9999) end as d from fp f left join near using (city, month_idx, prow, pcol, y, x)),
peak as (
  select a.city, a.month_idx, a.prow, a.pcol, a.y, a.x from edt a join edt b on {_SAME.format("b", "a")} and b.y between a.y - 3 and a.y + 3 and b.x between a.x - 3 and a.x + 3
  where a.y % {size} between 3 and {size - 4} and a.x % {size} between 3 and {size - 4} group by a.city, a.month_idx, a.prow, a.pcol, a.y, a.x, a.d having a.d > 0 and a.d = max(b.d)),
seed as materialized (select distinct city, month_idx, prow, pcol, label from peak join comp using (city, month_idx, prow, pcol, y, x))""",
    )


# Patches of the surrogate's size, and larger ones, which have an interior for peaks.
_label_queries(S.PATCH, "")
_label_queries(S.LABEL_PATCH, "_wide")


@_query(None)
def watershed_split(spark, sf_dir):
    """A label for each building, touching ones divided."""
    return labels.watershed(_patched(spark, sf_dir, S.LABEL_PATCH), split=True)


@_query(
    """
select city, count(*) as n_sidecars, count(*) filter (not present) as n_missing, count(*) filter (present) as n_written, count(*) filter (present and not filled) as n_empty
from (select p.city, p.n_transparent * 4 < p.n_px as present, max(footprint) = 1 as filled
      from patches p join fp using (city, month_idx, prow, pcol) group by p.city, p.month_idx, p.prow, p.pcol, p.n_transparent, p.n_px)
group by city""",
    PX,
    _PATCHES,
    _fp_by(S.PATCH),
)
def mask_summary(spark, sf_dir):
    """Sidecars whose patch exists get masks; the others are counted."""
    patches = _patches(spark, sf_dir)
    flagged = labels.present_sidecars(patches.select(*tile.PATCH), patches.where("n_transparent * 4 < n_px"))
    return labels.mask_summary(flagged, _patched(spark, sf_dir, S.PATCH))


@_query(None)
def photometric_patches(spark, sf_dir):
    """Every patch under drawn brightness, noise, gamma, blur, dropout and colour."""
    return augment.photometric_patches(tile.chip(S.pixels(spark, sf_dir), S.LABEL_PATCH))


# -------------------------------------------------------------- alignment

_SHIFTS = """
shifted as (
  select city, month_idx, case when dr * dr + dc * dc > 900 then 0 else dr end as drow, case when dr * dr + dc * dc > 900 then 0 else dc end as dcol, dr * dr + dc * dc > 900 as large_shift
  from (select city, month_idx, (city * 7 + month_idx * 5) % 45 - 22 as dr, (city * 3 + month_idx * 11) % 45 - 22 as dc from scene where month_idx > 0
        union all select city, month_idx, 0, 0 from scene where month_idx = 0))"""


@_query(
    """
select city, month_idx, drow, dcol, large_shift, city * 1000.5 + dcol * 1.25::double as c, 5000.25 - month_idx * 10 + drow * -1.25::double as f,
       case when month_idx = 0 then 'reference' when drow <> 0 or dcol <> 0 then 'shifted' else 'no_shift' end as status from shifted""",
    S.SCENES_SQL,
    _SHIFTS,
)
def shift_apply(spark, sf_dir):
    return _shifted(spark).select("city", "month_idx", "drow", "dcol", "large_shift", F.col("transform.c").alias("c"), F.col("transform.f").alias("f"), "status")


def _shifted(spark) -> DataFrame:
    first = F.col("month_idx") == 0
    rows = tile.scene_transform(S.scenes(spark)).withColumns(
        {
            "drow": F.when(first, 0).otherwise((F.col("city") * 7 + F.col("month_idx") * 5) % 45 - 22),
            "dcol": F.when(first, 0).otherwise((F.col("city") * 3 + F.col("month_idx") * 11) % 45 - 22),
        }
    )
    return align.apply_shifts(rows)


@_query(
    """
select city, count(*) as n_scenes, count(*) filter (month_idx > 0 and (drow <> 0 or dcol <> 0)) as n_shifted, count(*) filter (month_idx > 0 and drow = 0 and dcol = 0) as n_no_shift,
       count(*) filter (large_shift) as n_refused, round(max(sqrt(drow * drow + dcol * dcol)), 9) as most from shifted group by city""",
    S.SCENES_SQL,
    _SHIFTS,
)
def shift_summary(spark, sf_dir):
    return align.shift_summary(_shifted(spark)).withColumn("most", F.round("most", 9))


@_query("select p.city, p.month_idx, cast(t.i as int) as y, cast(u.i as int) as x, p.r from px p, range(24) t(i), range(24) u(i) where p.y = (2 * t.i + 1) * 16 // 48 and p.x = (2 * u.i + 1) * 16 // 48", PX)
def resize_nearest(spark, sf_dir):
    return align.nearest_pixels(S.pixels(spark, sf_dir), 16, 24).select("city", "month_idx", "y", "x", "r")


@_query("select p.city, p.month_idx, cast(t.i as int) as y, cast(u.i as int) as x, p.r, p.a from px p, range(20) t(i), range(20) u(i) where p.y = least(t.i, 15) and p.x = least(u.i, 15)", PX)
def edge_pad(spark, sf_dir):
    scenes = align.to_scenes(S.pixels(spark, sf_dir))
    return align.to_pixels(align.pad_scenes(scenes, 20)).select("city", "month_idx", "y", "x", "r", "a")


@_query(None)
def resize_cubic(spark, sf_dir):
    """Edge-padded and resampled to four times the size."""
    return align.to_pixels(align.upsample(align.to_scenes(S.pixels(spark, sf_dir)), 64, 16)).groupBy("city", "month_idx").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("g").alias("g"))


@_query("select city, month_idx, cast(case when month_idx = 0 then 0 else -(month_idx % 5 - 2) end as int) as drow, cast(case when month_idx = 0 then 0 else -(month_idx % 7 - 3) end as int) as dcol from scene", S.SCENES_SQL)
def phase_shift(spark, sf_dir):
    """Month 0 rolled by a known shift each month: the registration must find it."""
    px = S.pixels(spark, sf_dir).where("month_idx = 0").drop("month_idx")
    months = S.scenes(spark).select("city", "month_idx")
    dy, dx = F.when(F.col("month_idx") == 0, 0).otherwise(F.col("month_idx") % 5 - 2), F.when(F.col("month_idx") == 0, 0).otherwise(F.col("month_idx") % 7 - 3)
    rolled = px.join(months, "city").withColumns({"y": F.pmod(F.col("y") + dy, F.lit(16)).cast("int"), "x": F.pmod(F.col("x") + dx, F.lit(16)).cast("int")})
    return align.phase_shifts(align.to_scenes(rolled.select("city", "month_idx", "y", "x", "r", "g", "b", "a")))


# ----------------------------------------------------------- augmentation


@_query(
    "select city, month_idx, y, x, "
    + ", ".join(f"round(({b} / 255.0::double - {K.CHANNEL_MEAN[i]}) / {K.CHANNEL_STD[i]}, 9) as {b}" for i, b in enumerate(K.BANDS))
    + " from px",
    PX,
)
def normalize_rgb(spark, sf_dir):
    px = augment.normalized(S.pixels(spark, sf_dir))
    return px.select("city", "month_idx", "y", "x", *[F.round(b, 9).alias(b) for b in K.BANDS])


@_query(
    """
, turned as (
  select city, month_idx, month_idx % 2 = 1 as fh, city % 2 = 1 as fv, month_idx % 4 as turns, (city + month_idx) % 3 = 0 as tr, y, x, r from px),
f as (select *, case when fh then 15 - x else x end as x1, case when fv then 15 - y else y end as y1 from turned),
g as (select *, case turns when 1 then 15 - x1 when 2 then 15 - y1 when 3 then x1 else y1 end as y2, case turns when 1 then y1 when 2 then 15 - x1 when 3 then 15 - y1 else x1 end as x2 from f)
select city, month_idx, case when tr then x2 else y2 end as y, case when tr then y2 else x2 end as x, r from g""",
    PX,
)
def augment_d4(spark, sf_dir):
    px = S.pixels(spark, sf_dir).withColumns(
        {"flip_h": F.col("month_idx") % 2 == 1, "flip_v": F.col("city") % 2 == 1, "turns": F.col("month_idx") % 4, "transposed": (F.col("city") + F.col("month_idx")) % 3 == 0}
    )
    return augment.apply_geometry(px, 16).select("city", "month_idx", "y", "x", "r")


# ------------------------------------------------------------- block form


def _blocks(spark, sf_dir):
    return blocks.cut(align.to_scenes(S.pixels(spark, sf_dir)), S.PATCH)


@_query(ORACLES["quality_summary"])
def block_quality_summary(spark, sf_dir):
    return blocks.summarize(blocks.mask_counts(_blocks(spark, sf_dir)))


@_query(ORACLES["band_stats"])
def block_band_stats(spark, sf_dir):
    return blocks.stats(blocks.histograms(_blocks(spark, sf_dir))).withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@_query(ORACLES["zscore_normalize"])
def block_zscore_normalize(spark, sf_dir):
    cut = _blocks(spark, sf_dir)
    moved = blocks.rescale(cut, blocks.stats(blocks.histograms(cut)), S.MIN_USABLE)
    return blocks.to_pixels(moved, S.PATCH).select("city", "month_idx", "y", "x", "r", "g", "b")


# ------------------------------------------------------------ label lookup


@_query(
    """
, lab as (select city, 'labels_' || replace(regexp_extract(file, '(\\d{4}_\\d{2})', 1), '_', case when city % 2 = 0 then '_' else '' end) || '_' || k || '.geojson' as label_file
  from scene, (values ('b'), ('a')) t(k) where month_idx % 4 <> 3)
select s.city, s.month_name, min(l.label_file) as label_file
from (select city, regexp_extract(file, '(\\d{4}_\\d{2})', 1) as month_name from scene) s
left join lab l on l.city = s.city and contains(replace(l.label_file, '_', ''), replace(s.month_name, '_', '')) group by s.city, s.month_name""",
    S.SCENES_SQL,
)
def month_label_file(spark, sf_dir):
    months = S.scenes(spark).withColumn("month_name", P.month_name(F.col("file")))
    plain = F.when(F.col("city") % 2 == 0, F.col("month_name")).otherwise(F.replace("month_name", F.lit("_"), F.lit("")))
    files = months.where("month_idx % 4 <> 3").withColumn("k", F.explode(F.array(F.lit("b"), F.lit("a"))))
    named = files.select("city", F.concat(F.lit("labels_"), plain, F.lit("_"), "k", F.lit(".geojson")).alias("label_file"))
    return tile.label_file(months.select("city", "month_name"), named)
