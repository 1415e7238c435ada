"""What the trained scorers share: activations, Adam, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

F32 = np.float32

#: Labelled texts of more bytes are not drawn for a fit; scoring reads texts of any length.
SAMPLE_BYTES = 1 << 17


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(1) / (F32(1) + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Dense parameters by name; tables are updated in the touched rows only."""

    def __init__(self, rate: float, decay: float = 0.0):
        self.rate, self.decay, self.step = rate, decay, 0
        self.mean: dict[str, np.ndarray] = {}
        self.square: dict[str, np.ndarray] = {}

    def _state(self, name: str, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if name not in self.mean:
            self.mean[name], self.square[name] = np.zeros_like(like), np.zeros_like(like)
        return self.mean[name], self.square[name]

    def update(self, values: dict[str, np.ndarray], grads: dict[str, np.ndarray], rows: dict[str, np.ndarray] | None = None) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, grad in grads.items():
            mean, square = self._state(name, values[name])
            at = (rows or {}).get(name, slice(None))
            mean[at] = 0.9 * mean[at] + 0.1 * grad
            square[at] = 0.999 * square[at] + 0.001 * grad * grad
            values[name][at] -= (scale * mean[at] / (np.sqrt(square[at]) + 1e-8) + self.rate * self.decay * values[name][at]).astype(values[name].dtype)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: dict[int, int], salt: str) -> tuple[DataFrame, dict[int, int]]:
    """``key, target, text`` of about ``per_class[y]`` labelled documents of each class y, and how many labels y has.

    ``labels`` has ``key, target``, ``docs`` has ``key, text``. The labels are
    drawn first, by a hash of the key, so reruns agree; what is left is bounded
    by ``per_class`` and is sent to the documents, whose texts stay where they are.
    A key gives one text however often it is repeated, the smallest of at most
    ``SAMPLE_BYTES`` bytes, so rows and bytes of the result are both bounded.
    """
    width = 1 << 40
    rows = labels.where(F.col("target").isin(*per_class)).select("key", "target").distinct()
    sizes = {r[0]: r[1] for r in rows.groupBy("target").agg(F.count("*")).collect()}
    share = {y: min(width, -(-width * per_class[y] // n)) for y, n in sizes.items()} or {0: 0}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    drawn = rows.where(F.pmod(F.xxhash64(F.col("key"), F.lit(salt)), F.lit(width)) < limit[F.col("target")])
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    return short.join(F.broadcast(drawn), "key").groupBy("key", "target").agg(F.min("text").alias("text")), sizes
