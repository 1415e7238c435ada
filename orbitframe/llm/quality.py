"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by its letters,
signs and repetitions and encoded; gated attention learned from document labels
weighs the passages; the weighted representation is scored. Encoder, attention
and score are trained together, in numpy, by back-propagation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import fresh, small_batches
from orbitframe.llm.nn import F32, Adam, labelled_sample, sigmoid

PASSAGE_WORDS = 64
#: Labelled documents of each class that the fit sees, about: its documented bound.
SAMPLE = {0: 1500, 1: 3000}
HIDDEN, GATE = 24, 12
#: Signs counted by themselves; other bytes fall into the classes below.
SIGNS = b"!?.,;:|#*$%&@=<>/\\_-\"'()[]{}"
_UPPER, _LOWER, _DIGIT, _BLANK, _WIDE, _OTHER = range(6)
CLASSES = 6 + len(SIGNS)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for kind, first, last in ((_UPPER, "A", "Z"), (_LOWER, "a", "z"), (_DIGIT, "0", "9")):
        out[ord(first) : ord(last) + 1] = kind
    out[32] = _BLANK
    out[128:] = _WIDE
    for i, sign in enumerate(SIGNS):
        out[sign] = 6 + i
    return out


_CLASS = _byte_classes()
FEATURES = CLASSES + 10


def passages(text: str | None) -> np.ndarray:
    """``(passages, FEATURES)`` of a whole text; a text without words is one passage of zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES), F32)
    starts = np.arange(0, n, PASSAGE_WORDS)
    owner = np.arange(n) // PASSAGE_WORDS
    sizes = np.diff(np.append(starts, n)).astype(F32)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    cuts = np.append(0, ends[np.append(starts[1:], n) - 1])
    cuts[-1] = len(joined)
    spread = np.repeat(np.arange(len(starts)) * CLASSES, np.diff(cuts))
    counts = np.bincount(spread + _CLASS[joined], minlength=len(starts) * CLASSES).reshape(-1, CLASSES)
    total = counts.sum(axis=1, keepdims=True)
    ids = np.fromiter(map(hash, words), np.int64, n)
    same = np.append(False, ids[1:] == ids[:-1])
    pairs = np.append(ids[:-1] * 31 + ids[1:], 0)
    order = np.lexsort((ids, owner))
    repeated = np.zeros(n, bool)
    repeated[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    mean = lambda x: np.add.reduceat(x.astype(F32), starts) / sizes
    square = np.sqrt(np.maximum(mean(lengths**2) - mean(lengths) ** 2, 0))
    lines = raw.count(b"\n") / n
    extra = [
        np.log1p(sizes),
        np.full(len(starts), np.log1p(n)),
        mean(lengths) / 10,
        square / 10,
        mean(same),
        mean(repeated),
        mean(_seen_before(ids)),
        mean(_seen_before(pairs)),
        np.full(len(starts), lines),
        np.arange(len(starts)) / len(starts),
    ]
    shares = np.sqrt(counts / total)
    return np.concatenate([shares, np.stack(extra, axis=1)], axis=1).astype(F32)


def _seen_before(x: np.ndarray) -> np.ndarray:
    """Whether a value occurred earlier in the document."""
    out = np.ones(len(x), bool)
    out[np.unique(x, return_index=True)[1]] = False
    return out


@dataclass
class AttentionMil:
    """Encoder, gated attention and scorer; features are standardised by ``mean`` and ``spread``."""

    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, features: np.ndarray, rate: float, rng: np.random.Generator) -> AttentionMil:
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(F32)
        zero = lambda k: np.zeros(k, F32)
        prior = np.clip(rate, 0.01, 0.99)
        p = {"W": draw(FEATURES, HIDDEN), "b": zero(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.array([np.log(prior / (1 - prior))], F32)}
        return cls(features.mean(axis=0), features.std(axis=0) + 0.02, p)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``x`` has the passages of all bags in order; ``starts`` where each bag begins."""
        p = self.p
        f = np.clip((x - self.mean) / self.spread, -8, 8).astype(F32)
        h = np.tanh(f @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"f": f, "h": h, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "y": sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, o = self.p, self.forward(x, starts)
        dy = ((o["y"] - target) / len(target)).astype(F32)
        dz = np.repeat(dy[:, None] * p["c"], o["sizes"], axis=0)
        da = (dz * o["h"]).sum(axis=1)
        de = o["a"] * (da - np.repeat(np.add.reduceat(o["a"] * da, starts), o["sizes"]))
        dts = de[:, None] * p["w"]
        dt = dts * o["s"] * (1 - o["t"] ** 2)
        ds = dts * o["t"] * o["s"] * (1 - o["s"])
        dh = o["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - o["h"] ** 2)
        return {"W": o["f"].T @ du, "b": du.sum(axis=0), "V": o["h"].T @ dt, "U": o["h"].T @ ds, "w": (o["t"] * o["s"]).T @ de, "c": o["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        bags = [passages(t) for t in texts]
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)["y"].astype(float)


def train(bags: list[np.ndarray], target: np.ndarray, epochs: int = 30, batch: int = 64, seed: int = 8) -> AttentionMil:
    """Fit on the sampled documents; no documents give a model that scores 0.5 everywhere."""
    rng = np.random.default_rng(seed)
    if not bags:
        return AttentionMil.fresh(np.zeros((1, FEATURES), F32), 0.5, rng)
    model = AttentionMil.fresh(np.concatenate(bags), float(target.mean()), rng)
    adam = Adam(0.01, decay=1e-3)
    for epoch in range(epochs):
        adam.rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            starts = np.cumsum([0, *(len(bags[i]) for i in some[:-1])])
            adam.update(model.p, model.gradients(np.concatenate([bags[i] for i in some]), starts, target[some]))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> AttentionMil:
    """From ``docs(key, text)`` and ``labels(key, target)`` with target 0 or 1; another or null target teaches nothing.

    The classes are drawn up to ``sample`` and weigh as they were drawn; scores
    are moved back to the rate of all labels.
    """
    drawn, rates = labelled_sample(docs, labels, sample, "quality")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passages(t.as_py()).astype(F32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("target"), pa.array(rows, pa.binary())], ["key", "target", "bag"])

    kinds = dict(drawn.dtypes)
    got = drawn.mapInArrow(describe, f"key {kinds['key']}, target {kinds['target']}, bag binary").collect()
    got.sort(key=lambda r: (str(r["key"]), r["target"], r["bag"]))
    bags = [np.frombuffer(r["bag"], F32).reshape(-1, FEATURES) for r in got]
    target = np.array([r["target"] for r in got], F32)
    model = train(bags, target)
    if len(rates) == 2 and 0 < target.sum() < len(target):
        odds = lambda one, zero: np.log(one / zero)
        model.p["d"] += F32(odds(rates[1], rates[0]) - odds(target.sum(), len(target) - target.sum()))
    return model


def score(docs: DataFrame, model: AttentionMil, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a double column ``into`` from 0 to 1; null and empty texts are scored as one empty passage.

    All passages of a text of any length count; equal texts score alike, whatever
    their ids; an empty table stays empty. Other columns stay as they are: where
    ``docs`` has a column of the name, underscores are added to ``into``.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            all_texts = texts.where(texts.notna(), None).tolist()
            parts = [shared.value.score(all_texts[i : i + 256]) for i in range(0, len(all_texts), 256)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return docs.withColumn(fresh(docs, into), run(F.col(text_col)))
