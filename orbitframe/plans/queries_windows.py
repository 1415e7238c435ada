"""Queries over time and predictions: registries, sampling, metrics, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.functions import pixel as P
from orbitframe.operators import metrics, registry
from orbitframe.plans import orchestrate
from orbitframe.plans.queries_imagery import _footprint, _FP
from orbitframe.sources import surrogate as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = ("with " + ",\n".join(v.strip() for v in views) + "\n" + oracle) if views else oracle
        return f

    return add


_MONTHS = "months as (select pos, list_sort(list(distinct month_idx)) as months from series group by pos)"
_GATED = "gated as (select *, months[1] as first_month, months[-1] as last_month, months[-1] - months[1] as month_gap from months where len(months) >= 5 and months[-1] - months[1] >= 12)"


def _gated(spark, sf_dir):
    return registry.eligible(registry.position_months(S.series(spark, sf_dir)))


@_query(
    "select pos, first_month, last_month, month_gap, cast(i as int) as window_idx, array_to_string(months[i + 1 : i + 5], ',') as window_months from (select *, unnest(range(len(months) - 4)) as i from gated)",
    S.SERIES_SQL,
    _MONTHS,
    _GATED,
)
def registry_sliding(spark, sf_dir):
    out = registry.sliding_windows(_gated(spark, sf_dir))
    return out.select("pos", "first_month", "last_month", "month_gap", "window_idx", F.array_join("window_months", ",").alias("window_months"))


@_query(
    """
, idx as (select pos, months, list_distinct(list_transform([0, 1, 2, 3, 4], lambda i: cast(round_even(i * ((len(months) - 1) / 4.0::double), 0) as int))) as picks from gated)
select pos, array_to_string(list_concat(list_transform(list_sort(picks), lambda i: months[i + 1]), list_transform(range(5 - len(picks)), lambda i: months[-1])), ',') as window_months from idx""",
    S.SERIES_SQL,
    _MONTHS,
    _GATED,
)
def registry_even(spark, sf_dir):
    return registry.even_windows(_gated(spark, sf_dir)).select("pos", F.array_join("window_months", ",").alias("window_months"))


@_query("select pos, array_to_string(months[1:5], ',') as window_months from months where len(months) >= 5", S.SERIES_SQL, _MONTHS)
def registry_first_n(spark, sf_dir):
    return registry.first_windows(registry.position_months(S.series(spark, sf_dir))).select("pos", F.array_join("window_months", ",").alias("window_months"))


_WIN = """
win as (select c.i as city, w.i as window_idx, w.i as m0, w.i + 4 as m1 from range(5) c(i), range(10) w(i))"""


def _windows(spark):
    rows = S.scenes(spark).select(F.col("city").alias("pos"), "month_idx")
    gated = registry.eligible(registry.position_months(rows))
    return registry.sliding_windows(gated).withColumnRenamed("pos", "city")


_CHANGE = """
change as (
  select w.city, w.window_idx, cast(sum(case when a.footprint <> b.footprint then 1 else 0 end) as bigint) as change_pixels
  from win w join fp a on a.city = w.city and a.month_idx = w.m0 join fp b on b.city = w.city and b.month_idx = w.m1 and b.y = a.y and b.x = a.x group by w.city, w.window_idx)"""


@_query("select cast(city as int) as city, cast(window_idx as int) as window_idx, change_pixels, change_pixels > 0 as has_change from change", S.PIXELS_SQL, _FP, _WIN, _CHANGE)
def change_pixels(spark, sf_dir):
    return registry.change_pixels(_windows(spark), _footprint(spark, sf_dir)).select("city", "window_idx", "change_pixels", "has_change")


@_query(
    "select cast(w.city as int) as city, 0 as first_month, 13 as last_month, 13 as month_gap, cast(w.window_idx as int) as window_idx, array_to_string(range(m0, m1 + 1), ',') as window_months, change_pixels, change_pixels > 0 as has_change from win w join change using (city, window_idx) where w.city <> 3",
    S.PIXELS_SQL,
    _FP,
    _WIN,
    _CHANGE,
)
def full_registry(spark, sf_dir):
    """Complete positions, gates, windows and change in one: city 3 has a month without a mask and drops out."""
    patches = S.scenes(spark).select("city", "month_idx")
    made = registry.build_registry(patches, patches.where("city <> 3 or month_idx <> 5"), _footprint(spark, sf_dir))
    return made.select("city", "first_month", "last_month", "month_gap", "window_idx", F.array_join("window_months", ",").alias("window_months"), "change_pixels", "has_change")


@_query(
    """
select s.pos, array_to_string(list_sort(list(distinct s.month_idx)), ',') as months from series s
group by s.pos having count(*) = count(*) filter ((s.pos * 7 + s.month_idx) % 11 <> 0 or s.pos % 2 = 0)""",
    S.SERIES_SQL,
)
def positions_complete_masks(spark, sf_dir):
    rows = S.series(spark, sf_dir)
    masks = rows.where("(pos * 7 + month_idx) % 11 <> 0 or pos % 2 = 0")
    return registry.complete_positions(rows, masks).select("pos", F.array_join("months", ",").alias("months"))


@_query(None)
def stratified_epoch(spark, sf_dir):
    """One epoch of windows: 70 % changed, going round again, the rest unchanged, batched by eight."""
    windows = registry.sliding_windows(_gated(spark, sf_dir)).withColumn("has_change", (F.col("pos") + F.col("window_idx")) % 5 != 0)
    sample = registry.epoch_sample(windows, ("pos", "window_idx"), size=2000)
    return registry.batches(sample, 8).select("place", "batch_idx", "pos", "window_idx", "cycle", "has_change")


@_query("select has_change, case when has_change then 1400 else least(n, 600) end as n_taken from (select (pos + i) % 5 <> 0 as has_change, count(*) as n from (select *, unnest(range(len(months) - 4)) as i from gated) group by 1)", S.SERIES_SQL, _MONTHS, _GATED)
def epoch_quotas(spark, sf_dir):
    windows = registry.sliding_windows(_gated(spark, sf_dir)).withColumn("has_change", (F.col("pos") + F.col("window_idx")) % 5 != 0)
    sample = registry.epoch_sample(windows, ("pos", "window_idx"), size=2000)
    return sample.groupBy("has_change").agg(F.count("*").alias("n_taken"))


@_query(None)
def city_split(spark, sf_dir):
    """Cities dealt to train, val and test by a seeded shuffle."""
    names = [r[0] for r in S.scenes(spark).select(F.format_string("c%02d", "city")).distinct().collect()]
    parts = registry.city_splits(names)
    return spark.createDataFrame([(split, i, c) for split, cities in parts.items() for i, c in enumerate(cities)], "split string, place int, city string")


# ---------------------------------------------------------------- metrics

_SWEEP = ", ".join(f"({t}::double, {P.logit(t)!r}::double)" for t in K.SWEEP)
_CONF = f"""
thr(threshold, cut) as (values {_SWEEP}),
conf as (
  select threshold, count(*) filter (z > cut and y = 1) as tp, count(*) filter (z > cut and y = 0) as fp, count(*) filter (z <= cut and y = 1) as fn from logits, thr group by threshold)"""


def _ratio_sql(top: str) -> str:
    return f"""select threshold, tp, fp, fn, round((tp + {top}) / (tp + fp + fn + 1e-6::double), 9) as iou, round((2 * tp + {top}) / (2 * tp + fp + fn + 1e-6::double), 9) as f1,
       round((tp + {top}) / (tp + fp + 1e-6::double), 9) as precision, round((tp + {top}) / (tp + fn + 1e-6::double), 9) as recall from conf"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@_query(_ratio_sql("1e-6::double") + " where threshold = 0.5", S.LOGITS_SQL, _CONF)
def confusion_train_eps(spark, sf_dir):
    return _rounded(metrics.ratios(metrics.confusion(S.logits(spark, sf_dir)), both=True), "iou", "f1", "precision", "recall")


@_query(_ratio_sql("0.0::double") + " where threshold = 0.45", S.LOGITS_SQL, _CONF)
def confusion_eval_eps(spark, sf_dir):
    return _rounded(metrics.ratios(metrics.confusion(S.logits(spark, sf_dir), (K.SEG_THRESHOLD,)), both=False), "iou", "f1", "precision", "recall")


@_query(_ratio_sql("1e-6::double"), S.LOGITS_SQL, _CONF)
def threshold_sweep(spark, sf_dir):
    return _rounded(metrics.ratios(metrics.confusion(S.logits(spark, sf_dir), K.SWEEP)), "iou", "f1", "precision", "recall")


@_query("select threshold, round((2 * tp + 1e-6::double) / (2 * tp + fp + fn + 1e-6::double), 9) as f1 from conf order by f1 desc, threshold limit 1", S.LOGITS_SQL, _CONF)
def best_threshold(spark, sf_dir):
    return _rounded(metrics.best_threshold(metrics.ratios(metrics.confusion(S.logits(spark, sf_dir), K.SWEEP))), "f1")


_BARS = {
    "iou": "({h}.tp + {top}) / ({h}.tp + {h}.fp + {h}.fn + 1e-6::double)",
    "f1": "(2 * {h}.tp + {top}) / (2 * {h}.tp + {h}.fp + {h}.fn + 1e-6::double)",
    "precision": "({h}.tp + {top}) / ({h}.tp + {h}.fp + 1e-6::double)",
    "recall": "({h}.tp + {top}) / ({h}.tp + {h}.fn + 1e-6::double)",
}


def _counts_of(head: str, channel: int, threshold: float) -> str:
    cut = f"{P.logit(threshold)!r}::double"
    return f"{head} as (select count(*) filter (z > {cut} and y = 1) as tp, count(*) filter (z > {cut} and y = 0) as fp, count(*) filter (z <= {cut} and y = 1) as fn from logits where channel = {channel})"


def _bars_of(head: str, names: tuple[str, ...], top: str) -> str:
    return ", ".join(f"round({_BARS[n].format(h=head, top=top)}, 9) as {head}_{n}" for n in names)


def _head(spark, sf_dir, channel: int):
    return S.logits(spark, sf_dir).where(F.col("channel") == channel)


@_query(f"select {_bars_of('seg', tuple(_BARS), '0.0::double')}, {_bars_of('chg', tuple(_BARS), '0.0::double')} from seg, chg", S.LOGITS_SQL, _counts_of("seg", 0, K.SEG_THRESHOLD), _counts_of("chg", 1, K.CHANGE_THRESHOLD))
def evaluation_pass(spark, sf_dir):
    """One row of test scores over all pixels of two heads."""
    out = metrics.evaluation(_head(spark, sf_dir, 0), _head(spark, sf_dir, 1))
    return _rounded(out, *out.columns)


@_query(
    f"select l.loss, {_bars_of('change', ('iou', 'f1'), '1e-6::double')}, {_bars_of('seg', ('iou', 'f1'), '1e-6::double')} from change, seg, (select round(avg(loss), 7) as loss from batch) l",
    S.LOGITS_SQL,
    _counts_of("change", 1, K.TRAIN_THRESHOLD),
    _counts_of("seg", 0, K.TRAIN_THRESHOLD),
    "batch as (select sample // 8 as batch, avg((1 - y) * z + ln(1 + exp(-abs(z))) + greatest(-z, 0.0::double)) as loss from logits group by 1)",
)
def validation_pass(spark, sf_dir):
    """One row of a validation pass: mean loss of batches of eight, IoU and F1 of two heads."""
    cross = metrics.bce(F.col("z"), F.col("y"), F.lit(1.0))
    losses = S.logits(spark, sf_dir).groupBy(F.floor(F.col("sample") / 8).alias("batch")).agg(F.avg(cross).alias("loss"))
    out = metrics.validation(losses, _head(spark, sf_dir, 1), _head(spark, sf_dir, 0))
    return _rounded(out.withColumn("loss", F.round("loss", 7)), *out.columns[1:])


_LOSS = """
cross_ as (
  select channel, avg((1 - y) * z + (1 + (w - 1) * y) * (ln(1 + exp(-abs(z))) + greatest(-z, 0.0::double))) as bce
  from logits join (values (0, 4.1::double), (1, 10.0::double), (2, 10.0::double)) t(channel, w) using (channel) group by channel),
dsum as (select sample, channel, sum(y / (1 + exp(-z))) as both_, sum(1 / (1 + exp(-z))) as p, sum(y) as y from logits group by all),
dice as (select channel, avg(1 - (2 * both_ + 1.0::double) / (p + y + 1.0::double)) as dice from dsum group by channel),
loss as (select channel, bce, dice, 0.5 * bce + 0.5 * dice as loss from cross_ join dice using (channel))"""


@_query("select channel, round(bce, 7) as bce, round(dice, 7) as dice, round(loss, 7) as loss from loss", S.LOGITS_SQL, _LOSS)
def dice_bce(spark, sf_dir):
    out = metrics.channel_losses(S.logits(spark, sf_dir))
    return out.withColumns({c: F.round(c, 7) for c in ("bce", "dice", "loss")})


@_query("select round(sum(w * loss) / sum(w), 7) as fbc, round(1.0 * sum(w * loss) / sum(w) + 1.0 * 0.25::double + 0.4 * 0.5::double, 7) as total from loss join (values (0, 1.0::double), (1, 3.0::double), (2, 3.0::double)) t(channel, w) using (channel)", S.LOGITS_SQL, _LOSS)
def multi_task_loss(spark, sf_dir):
    fbc = metrics.weighted_loss(metrics.channel_losses(S.logits(spark, sf_dir)))
    total = metrics.multi_task(F.col("loss"), F.lit(0.25), F.lit(0.5))
    return fbc.select(F.round("loss", 7).alias("fbc"), F.round(total, 7).alias("total"))


@_query(
    "select cast(step as int) as step, round(case when step < 50 then (step + 1) / 50.0::double else 0.5 * (1 + cos(pi() * least(1.0::double, (step - 50) / 950.0::double))) end, 9) as factor from range(1100) t(step)"
)
def lr_schedule(spark, sf_dir):
    steps = spark.range(1100).select(F.col("id").cast("int").alias("step"))
    return steps.withColumn("factor", F.round(P.cosine_schedule(F.col("step"), 50, 1000), 9))


# ------------------------------------------------------------ orchestration

_DONE = """
counts as (select city, s.step, cast((city * 5 + s.step * 7) % 20 as bigint) as n_out from (select distinct city from scene), (select cast(i as int) as step from range(1, 6) t(i)) s)"""


def _outputs(spark):
    cities = S.scenes(spark).select("city").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return cities.withColumn("n_out", ((F.col("city") * 5 + F.col("step") * 7) % 20).cast("long"))


@_query("select city, step from counts where n_out < 14", S.SCENES_SQL, _DONE)
def resume_antijoin(spark, sf_dir):
    """Steps still to run: those without as many outputs as the city has scenes."""
    wanted = S.scenes(spark).groupBy("city").agg(F.count("*").alias("n_scenes"))
    return orchestrate.pending(wanted, _outputs(spark), steps=5)


@_query(
    """
select city, count(*) as n_steps, count(*) filter (n_out >= 14) as n_done, cast(sum(n_out) as bigint) as n_out,
       round(100.0::double * count(*) filter (n_out >= 14) / count(*), 6) as pct_done, printf('%d:%02d', cast(sum(n_out) * 10 as bigint) // 60, cast(sum(n_out) * 10 as bigint) % 60) as took
from counts group by city""",
    S.SCENES_SQL,
    _DONE,
)
def city_progress(spark, sf_dir):
    log = _outputs(spark).withColumns({"status": F.when(F.col("n_out") >= 14, "ok").otherwise("failed"), "seconds": F.col("n_out") * 10.0})
    return orchestrate.progress(log).select("city", "n_steps", "n_done", "n_out", F.round("pct_done", 6).alias("pct_done"), "took")
