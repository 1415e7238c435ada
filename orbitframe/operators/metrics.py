"""Confusion counts, ratios, threshold sweeps and losses over predicted pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.functions import pixel as P


def confusion(pred: DataFrame, thresholds: tuple[float, ...] = (K.TRAIN_THRESHOLD,), by: tuple[str, ...] = ()) -> DataFrame:
    """``threshold, tp, fp, fn`` of ``z`` (logit) against ``y``: all thresholds in one pass of conditional sums."""
    sums = []
    for i, t in enumerate(thresholds):
        hit = F.col("z") > P.logit(t)
        sums += [F.count_if(hit & (F.col("y") == 1)).alias(f"tp{i}"), F.count_if(hit & (F.col("y") == 0)).alias(f"fp{i}"), F.count_if(~hit & (F.col("y") == 1)).alias(f"fn{i}")]
    wide = pred.groupBy(*by).agg(*sums) if by else pred.agg(*sums)
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)])
    return wide.select(*by, F.explode(each).alias("c")).select(*by, "c.*")


def ratios(counts: DataFrame, eps: float = 1e-6, both: bool = True) -> DataFrame:
    """IoU, F1, precision, recall; ``both`` adds eps above and below the bar, else only below."""
    top = eps if both else 0.0
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "iou": (tp + top) / (tp + fp + fn + eps),
            "f1": (2 * tp + top) / (2 * tp + fp + fn + eps),
            "precision": (tp + top) / (tp + fp + eps),
            "recall": (tp + top) / (tp + fn + eps),
        }
    )


def best_threshold(swept: DataFrame, default: float = K.TRAIN_THRESHOLD) -> DataFrame:
    """The threshold of the highest F1, the lowest in ties; the default where no F1 is positive."""
    top = swept.where("f1 > 0").agg(F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b"))
    return top.select(F.coalesce("b.threshold", F.lit(default)).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def evaluation(seg: DataFrame, change: DataFrame, seg_threshold: float = K.SEG_THRESHOLD, change_threshold: float = K.CHANGE_THRESHOLD) -> DataFrame:
    """One row of test scores: IoU, F1, precision and recall of the last month's footprint and of the change, over all pixels.

    Both inputs are ``z`` (logit) and ``y``. A ratio has its epsilon below the bar only.
    """
    names = ("iou", "f1", "precision", "recall")
    one = lambda pred, t, head: ratios(confusion(pred, (t,)), both=False).select(*[F.col(n).alias(f"{head}_{n}") for n in names])
    return one(seg, seg_threshold, "seg").crossJoin(one(change, change_threshold, "chg"))  # one row each


def validation(losses: DataFrame, change: DataFrame, footprint: DataFrame, threshold: float = K.TRAIN_THRESHOLD) -> DataFrame:
    """One row of a validation pass: the mean of the batches' ``loss``, and IoU and F1 of change and footprint."""
    one = lambda pred, head: ratios(confusion(pred, (threshold,))).select(F.col("iou").alias(f"{head}_iou"), F.col("f1").alias(f"{head}_f1"))
    loss = losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))
    return loss.crossJoin(one(change, "change")).crossJoin(one(footprint, "seg"))  # one row each


def last_epochs(history: DataFrame, n: int, order: str = "epoch", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The last ``n`` epochs of each run."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return history.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def softplus_negative(z: Column) -> Column:
    """``log(1 + exp(-z))`` without overflow."""
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))


def bce(z: Column, y: Column, pos_weight: Column) -> Column:
    return (1 - y) * z + (1 + (pos_weight - 1) * y) * softplus_negative(z)


def dice_by_channel(pred: DataFrame, smooth: float = 1.0) -> DataFrame:
    """``sample, channel, dice_loss``: sums per map first, then one ratio each."""
    p, y = P.sigmoid(F.col("z")), F.col("y")
    sums = pred.groupBy("sample", "channel").agg(F.sum(p * y).alias("both"), F.sum(p).alias("p"), F.sum(y).alias("y"))
    return sums.select("sample", "channel", (1 - (2 * F.col("both") + smooth) / (F.col("p") + F.col("y") + smooth)).alias("dice_loss"))


def channel_losses(pred: DataFrame, pos_weights: tuple[float, ...] = K.POS_WEIGHTS) -> DataFrame:
    """``channel, bce, dice, loss``: half weighted cross entropy, half Dice."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in pos_weights]), F.col("channel") + 1)
    cross = pred.groupBy("channel").agg(F.avg(bce(F.col("z"), F.col("y"), weight)).alias("bce"))
    dice = dice_by_channel(pred).groupBy("channel").agg(F.avg("dice_loss").alias("dice"))
    return cross.join(dice, "channel").withColumn("loss", 0.5 * F.col("bce") + 0.5 * F.col("dice"))


def weighted_loss(channels: DataFrame, weights: tuple[float, ...] = K.CHANNEL_WEIGHTS) -> DataFrame:
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("channel") + 1)
    return channels.agg((F.sum(w * F.col("loss")) / F.sum(w)).alias("loss"))


def multi_task(fbc: Column, change: Column, aux: Column | None = None, w_fbc: float = 1.0, w_change: float = 1.0, w_aux: float = K.AUX_WEIGHT) -> Column:
    total = w_fbc * fbc + w_change * change
    return total if aux is None else total + w_aux * aux


def finite(rows: DataFrame, column: str = "loss") -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")))


def running_mean(history: DataFrame, value: str = "loss", order: str = "step", by: tuple[str, ...] = ("run",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("running_mean", F.avg(value).over(w))


def best_so_far(history: DataFrame, value: str = "change_iou", order: str = "epoch", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Marks epochs that strictly beat all earlier ones: where a checkpoint would be kept."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(w)
    return history.withColumn("is_best", F.coalesce(F.col(value) > best, F.lit(True)))


Scorer = Callable[[pd.DataFrame], pd.Series]


def predict(tensors: DataFrame, scorer: Scorer, out: str = "z") -> DataFrame:
    """A model over batches of rows: any function from a frame to one logit array per row."""
    schema = ", ".join(f"`{n}` {t}" for n, t in tensors.dtypes) + f", {out} array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: scorer(pdf)})

    return tensors.mapInPandas(run, schema)
