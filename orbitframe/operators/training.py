"""Training of the change network: synchronous steps whose gradients are Spark aggregates.

The loss of a batch is a mean over its windows, so its gradient is one too: every
task adds up the gradients of its windows, chunks of the sums are added up by
key, and the driver sees one vector of the model's size a step. Windows are
dealt to batches once, by a hash, and written by batch; an epoch reads the
batches in an order of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.operators import metrics
from orbitframe.operators.gradients import Traced, value_of
from orbitframe.operators.network import F32, ChangeNetwork, Weights

#: Values of the gradient in one row, and windows that go forward at once.
CHUNK, MICRO = 1 << 16, 2


class TracedWeights(Weights):
    """Weights whose use is traced; all must be there already."""

    def __init__(self, values: dict[str, np.ndarray]):
        super().__init__()
        self.values = values
        self.traced = {k: Traced(v) for k, v in values.items()}

    def __call__(self, name: str, *shape: int, fill: float | None = None) -> Traced:
        return self.traced[name]


def _dice_and_cross(z, y: np.ndarray, pos_weight: float):
    """Half cross entropy, half Dice of (batch, channel, rows, columns); Dice per map."""
    cross = ((1 - y) * z + (1 + F32(pos_weight - 1) * y) * np.logaddexp(-z, F32(0))).mean()
    p = 1 / (1 + np.exp(-z))
    both, total = (p * y).sum(axis=(2, 3)), p.sum(axis=(2, 3)) + y.sum(axis=(2, 3))
    return 0.5 * cross + 0.5 * (1 - ((2 * both + 1) / (total + 1)).mean())


def network_loss(out: dict, fbc: np.ndarray, change: np.ndarray, fbc_channels: int, change_pos_weight: float, w_fbc: float = 1.0, w_change: float = 1.0):
    """The multi-task loss of the network's outputs, auxiliary heads at ``K.AUX_WEIGHT``; traced if these are."""
    weights = K.CHANNEL_WEIGHTS if fbc_channels == 3 else K.CHANNEL_WEIGHTS[:1]

    def segment(z):
        each = [w * _dice_and_cross(z[:, i::fbc_channels], fbc[:, i::fbc_channels], K.POS_WEIGHTS[i]) for i, w in enumerate(weights)]
        return sum(each) / sum(weights)

    total = w_fbc * segment(out["fbc"]) + w_change * _dice_and_cross(out["change"], change, change_pos_weight)
    if "aux_fbc" in out:
        total = total + K.AUX_WEIGHT * w_fbc * segment(out["aux_fbc"])
    if "aux_change" in out:
        total = total + K.AUX_WEIGHT * w_change * _dice_and_cross(out["aux_change"], change, change_pos_weight)
    return total


def drawn_network(config: K.TrainConfig, channels: int = 3, seed: int = 0) -> ChangeNetwork:
    """A network with all its weights drawn."""
    net = ChangeNetwork(config.n_months, config.fbc_channels, config.base, seed)
    net.forward(np.zeros((1, config.n_months * channels, 16, 16), F32), side=True)
    return net


def loss_gradient(values: dict[str, np.ndarray], config: K.TrainConfig, images: np.ndarray, fbc: np.ndarray, change: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of a batch and its gradient by all weights, as one vector in the order of their names."""
    net = ChangeNetwork(config.n_months, config.fbc_channels, config.base)
    net.weights = TracedWeights(values)
    loss = network_loss(net.forward(images, side=True), fbc, change, config.fbc_channels, config.change_pos_weight)
    loss.backward()
    traced = net.weights.traced
    flat = [np.zeros(v.size) if traced[k].grad is None else traced[k].grad.ravel() for k, v in sorted(values.items())]
    return float(value_of(loss)), np.concatenate(flat).astype(F32)


def _arrays(pdf: pd.DataFrame, side: int) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(0, len(pdf), MICRO):
        part = pdf.iloc[at : at + MICRO]
        yield tuple(np.stack(part[c].to_list()).reshape(len(part), -1, side, side).astype(F32) for c in ("image", "fbc", "change"))


def batch_gradient(batch: DataFrame, values: dict[str, np.ndarray], config: K.TrainConfig, side: int) -> tuple[float, int, np.ndarray]:
    """Mean loss, windows and mean gradient of ``batch(image, fbc, change)``; no window gives nothing to add."""
    shared = batch.sparkSession.sparkContext.broadcast(values)
    shape = "chunk int, part binary, windows long, loss double"

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, windows, loss = None, 0, 0.0
        for pdf in frames:
            for images, fbc, change in _arrays(pdf, side):
                one, grad = loss_gradient(shared.value, config, images, fbc, change)
                total = len(images) * grad.astype(np.float64) + (0 if total is None else total)
                windows, loss = windows + len(images), loss + len(images) * one
        if windows:
            for i, at in enumerate(range(0, len(total), CHUNK)):
                yield pd.DataFrame({"chunk": [i], "part": [total[at : at + CHUNK].tobytes()], "windows": [windows], "loss": [loss]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        part = sum(np.frombuffer(b) for b in pdf["part"])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [part.tobytes()], "windows": [pdf["windows"].sum()], "loss": [pdf["loss"].sum()]})

    parts = batch.select("image", "fbc", "change").mapInPandas(sums, shape)
    rows = sorted(parts.groupBy("chunk").applyInPandas(added, shape).collect())
    shared.unpersist()
    if not rows:
        return 0.0, 0, np.zeros(sum(v.size for v in values.values()))
    n = rows[0]["windows"]
    return rows[0]["loss"] / n, n, np.concatenate([np.frombuffer(r["part"]) for r in rows]) / n


def rate_factor(step: int, warmup: int, total: int) -> float:
    """``pixel.cosine_schedule`` of one step."""
    if step < warmup:
        return (step + 1) / max(1, warmup)
    return 0.5 * (1 + np.cos(np.pi * min(1.0, (step - warmup) / max(1, total - warmup))))


class AdamW:
    """Adam with decoupled decay on one flat vector."""

    def __init__(self, size: int):
        self.mean, self.square, self.step = np.zeros(size), np.zeros(size), 0

    def update(self, vector: np.ndarray, grad: np.ndarray, rate: float, decay: float) -> np.ndarray:
        self.step += 1
        self.mean = 0.9 * self.mean + 0.1 * grad
        self.square = 0.999 * self.square + 0.001 * grad**2
        size = np.sqrt(self.square / (1 - 0.999**self.step)) + 1e-8
        return vector * (1 - rate * decay) - rate * (self.mean / (1 - 0.9**self.step)) / size


def clipped(grad: np.ndarray, most: float) -> np.ndarray:
    """The gradient, shortened to the norm ``most`` where it is longer."""
    return grad * min(1.0, most / (float(np.linalg.norm(grad)) + 1e-6))


def _named(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    names = sorted(like)
    cuts = np.cumsum([like[k].size for k in names])[:-1]
    return {k: part.reshape(like[k].shape).astype(F32) for k, part in zip(names, np.split(vector, cuts), strict=True)}


def save_state(spark: SparkSession, path: str, arrays: dict[str, np.ndarray], notes: dict) -> None:
    """Arrays by name, one row each, and a row of notes; ``path`` may be in any store."""
    rows = [(k, list(v.shape), v.dtype.str, v.tobytes(), None) for k, v in arrays.items()] + [(None, None, None, None, json.dumps(notes))]
    spark.createDataFrame(rows, "name string, shape array<int>, kind string, data binary, notes string").repartition(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    rows = spark.read.parquet(path).collect()
    arrays = {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in rows if r["name"] is not None}
    return arrays, next(json.loads(r["notes"]) for r in rows if r["notes"] is not None)


def _complete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def validate(windows: DataFrame, net: ChangeNetwork, config: K.TrainConfig, side: int) -> DataFrame:
    """``metrics.validation`` of ``windows(image, fbc, change)``: of the change, and of the footprint of every month."""
    shared = windows.sparkSession.sparkContext.broadcast(net)
    kept = slice(None, None, config.fbc_channels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for images, fbc, change in _arrays(pdf, side):
                out = shared.value.forward(images)
                loss = float(network_loss(out, fbc, change, config.fbc_channels, config.change_pos_weight))
                maps = {"zc": out["change"], "yc": change, "zf": out["fbc"][:, kept], "yf": fbc[:, kept]}
                yield pd.DataFrame({"loss": [loss] * len(images), **{k: list(v.reshape(len(images), -1).astype(float)) for k, v in maps.items()}})

    said = windows.select("image", "fbc", "change").mapInPandas(run, "loss double, zc array<double>, yc array<double>, zf array<double>, yf array<double>")
    pixels = lambda z, y: said.select(F.explode(F.arrays_zip(F.col(z).alias("z"), F.col(y).alias("y"))).alias("p")).select("p.z", F.col("p.y").cast("int").alias("y"))
    return metrics.validation(said.select("loss"), pixels("zc", "yc"), pixels("zf", "yf"), config.threshold)


def train(windows: DataFrame, held: DataFrame, config: K.TrainConfig, side: int, folder: str, key: tuple[str, ...], seed: int = 0, until: int | None = None) -> DataFrame:
    """Trains on ``windows(*key, image, fbc, change)``, keeps states in ``folder``, returns the history by epoch.

    A batch has about ``config.batch_size`` windows (a hash of the key deals
    them); one whose loss or gradient is not finite is skipped and counted. After every
    epoch the state is written to one of two places in turn, so a run that is
    started again goes on from the last whole one; ``best`` has the weights of
    the highest ``change_iou``. ``until`` ends a run early. Without windows
    nothing is learnt. Gradients of lost executors are computed anew.
    """
    spark = windows.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(4 * MICRO))
    try:
        return _train(spark, windows, held, config, side, folder.rstrip("/"), key, seed, until)
    finally:
        spark.conf.set(setting, before)


def _deal(spark: SparkSession, windows: DataFrame, folder: str, batch_size: int, key: tuple[str, ...]) -> list[int]:
    """Writes the windows by batch, once; returns the batches that have any."""
    path = f"{folder}/batches"
    if not _complete(spark, path):
        batches = max(1, -(-windows.count() // batch_size))
        dealt = windows.select("image", "fbc", "change", F.pmod(F.xxhash64(*key), F.lit(batches)).alias("batch"))
        dealt.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(path)
    return sorted(r[0] for r in spark.read.parquet(path).select("batch").distinct().collect())


def _train(spark: SparkSession, windows: DataFrame, held: DataFrame, config: K.TrainConfig, side: int, folder: str, key: tuple[str, ...], seed: int, until: int | None) -> DataFrame:
    first = windows.select(F.size("image").alias("n")).first()
    net = drawn_network(config, (first["n"] if first else 3 * config.n_months * side**2) // (config.n_months * side**2), seed)
    like = net.weights.values
    vector = np.concatenate([like[k].ravel() for k in sorted(like)]).astype(np.float64)
    adam, history, start = AdamW(len(vector)), [], 1
    whole = [load_state(spark, f"{folder}/last-{k}") for k in (0, 1) if _complete(spark, f"{folder}/last-{k}")]
    if whole:
        arrays, notes = max(whole, key=lambda s: s[1]["epoch"])
        vector, adam.mean, adam.square, adam.step = arrays["vector"], arrays["mean"], arrays["square"], notes["step"]
        history, start = notes["history"], notes["epoch"] + 1
    batches = _deal(spark, windows, folder, config.batch_size, key) if first else []
    for epoch in range(start, min(config.epochs, until or config.epochs) + 1):
        running, steps, skipped, rate = 0.0, 0, 0, 0.0
        for b in np.random.default_rng((seed, epoch)).permutation(batches):
            batch = spark.read.parquet(f"{folder}/batches").where(F.col("batch") == int(b))
            loss, _, grad = batch_gradient(batch, _named(vector, like), config, side)
            rate = config.learning_rate * rate_factor(adam.step, config.warmup_epochs * len(batches), config.epochs * len(batches))
            if not (np.isfinite(loss) and np.isfinite(grad).all()):
                skipped += 1
                continue
            vector = adam.update(vector, clipped(grad, config.gradient_clip), rate, config.weight_decay)
            running, steps = running + loss, steps + 1
        net.weights.values = _named(vector, like)
        scores = validate(held, net, config, side).first().asDict()
        best = scores["change_iou"] > max([h["change_iou"] for h in history], default=-1.0)
        history.append({"epoch": epoch, "train_loss": running / max(steps, 1), **scores, "rate": float(rate), "skipped": skipped, "is_best": best})
        if best:
            save_state(spark, f"{folder}/best", net.weights.values, {"epoch": epoch, **config.model_settings()})
        save_state(spark, f"{folder}/last-{epoch % 2}", {"vector": vector, "mean": adam.mean, "square": adam.square}, {"epoch": epoch, "step": adam.step, "history": history})
    shape = "epoch int, train_loss double, loss double, change_iou double, change_f1 double, seg_iou double, seg_f1 double, rate double, skipped int, is_best boolean"
    names = [part.split()[0] for part in shape.split(", ")]
    return spark.createDataFrame([tuple(h[n] for n in names) for h in history], shape)
