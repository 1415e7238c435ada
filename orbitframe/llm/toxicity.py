"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector, if training saw it more than once, and as the
mean of vectors of its hashed character n-grams. Windows of words overlap by
half; each is read in both directions by gated recurrent units, pooled by
attention and scored; a document's score is that of its most toxic window.
Trained in numpy: the windows that decide a document are chosen by the model
itself, epoch by epoch.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import fresh, small_batches
from orbitframe.llm.nn import F32, Adam, labelled_sample, sigmoid

#: Labelled documents of each class that the fit sees, about, and the words it may keep: its documented bounds.
SAMPLE = {0: 1600, 1: 800}
PRESENTATIONS = 22_000
VOCABULARY = 50_000
WINDOW, STRIDE = 32, 16
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 12, 12, 10, 12
GRAMS = 1 << 16
GRAM_SIZES = (3, 4, 5)
#: Distinct words a worker remembers, and windows it runs at once.
REMEMBERED = 150_000
WINDOWS = 4096

_PLAIN = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalpha() else i if i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lowered words of letters; signs, digits and white space separate them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and where each word's begin; words are marked at both ends."""
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(joined))
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, buckets = [], []
    code = joined.copy()
    for n in range(2, max(GRAM_SIZES) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ joined[n - 1 :]
        if n in GRAM_SIZES:
            inside = place[: len(code)] + n <= ends[: len(code)]
            mixed = code[inside] * np.uint32(0x9E3779B1)
            buckets.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(GRAMS - 1))
            owners.append(owner[: len(code)][inside])
    owners, buckets = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return buckets[order], np.append(0, np.cumsum(counts))


def windows_of(n: int) -> np.ndarray:
    """First words of the overlapping windows that cover ``n`` words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


@dataclass
class BiGru:
    """All parameters; ``vocabulary`` maps kept words to rows of ``E``, of which row 0 is zero."""

    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], rng: np.random.Generator) -> BiGru:
        draw = lambda a, b, g=1.0: (g * rng.standard_normal((a, b)) / np.sqrt(a)).astype(F32)
        p = {
            "E": np.zeros((len(vocabulary) + 1, WORD_DIM), F32),
            "G": np.zeros((GRAMS, GRAM_DIM), F32),
            "W": draw(WORD_DIM + GRAM_DIM, 6 * HIDDEN, 2.0),
            "b": np.zeros(6 * HIDDEN, F32),
            "Uf": draw(HIDDEN, 3 * HIDDEN),
            "Ub": draw(HIDDEN, 3 * HIDDEN),
            "A": draw(2 * HIDDEN, ATTENTION),
            "v": draw(ATTENTION, 1)[:, 0],
            "o": draw(2 * HIDDEN, 1)[:, 0],
            "c": np.full(1, -1.0, F32),
        }
        return cls(vocabulary, p)

    # Words -> inputs of the gates.

    def describe(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``E``, n-gram buckets and offsets, and the input vectors of distinct words."""
        rows = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        grams, at = gram_ids(words)
        counts = np.diff(at)
        mean, some = np.zeros((len(words), GRAM_DIM), F32), counts > 0
        mean[some] = np.add.reduceat(self.p["G"][grams], at[:-1][some]) / counts[some, None].astype(F32) if some.any() else 0
        return rows, grams, at, np.concatenate([self.p["E"][rows], mean], axis=1)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty((0, 6 * HIDDEN), F32)
        return self.describe(words)[3] @ self.p["W"] + self.p["b"]

    # Windows -> logits. ``x`` is (time, window, 6 * hidden), ``mask`` (time, window).

    def _read(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: list | None) -> np.ndarray:
        steps, n = mask.shape
        h = np.zeros((n, HIDDEN), F32)
        out = np.empty((steps, n, HIDDEN), F32)
        for t in reversed(range(steps)) if backward else range(steps):
            g = h @ u
            zr = sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            after = h + m * (1 - z) * (new - h)
            if keep is not None:
                keep.append((t, h, z, r, new, g[:, 2 * HIDDEN :]))
            h = out[t] = after
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        steps = ([], []) if keep is not None else (None, None)
        h = np.concatenate(
            [self._read(x[..., : 3 * HIDDEN], mask, p["Uf"], False, steps[0]), self._read(x[..., 3 * HIDDEN :], mask, p["Ub"], True, steps[1])], axis=2
        )
        s = np.tanh(h @ p["A"])
        e = s @ p["v"] + (mask - 1) * F32(1e4)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = (a[..., None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"h": h, "s": s, "a": a, "pooled": pooled, "steps": steps}
        return pooled @ p["o"] + p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross entropy, by parameter and by gate input."""
        p, k = self.p, {}
        logit = self.forward(x, mask, k)
        dy = ((sigmoid(logit) - target) / len(target)).astype(F32)
        grads = {"o": k["pooled"].T @ dy, "c": dy.sum(keepdims=True)}
        dpool = dy[:, None] * p["o"]
        da = (dpool[None] * k["h"]).sum(axis=2)
        de = k["a"] * (da - (k["a"] * da).sum(axis=0))
        ds = de[..., None] * p["v"] * (1 - k["s"] ** 2)
        grads |= {"v": np.einsum("tna,tn->a", k["s"], de), "A": np.einsum("tnh,tna->ha", k["h"], ds)}
        dh = k["a"][..., None] * dpool[None] + ds @ p["A"].T
        dx = np.empty_like(x)
        for name, side, steps in (("Uf", 0, k["steps"][0]), ("Ub", 1, k["steps"][1])):
            dx_side, grads[name] = self._unread(steps, mask, dh[..., side * HIDDEN : (side + 1) * HIDDEN], p[name])
            dx[..., side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN] = dx_side
        return grads, dx

    @staticmethod
    def _unread(steps: list, mask: np.ndarray, dout: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx = np.zeros((*mask.shape, 3 * HIDDEN), F32)
        du = np.zeros_like(u)
        carry = np.zeros(dout.shape[1:], F32)
        for t, h, z, r, new, gn in reversed(steps):
            d = carry + dout[t]
            m = mask[t][:, None]
            dz = d * m * (h - new) * z * (1 - z)
            dn = d * m * (1 - z) * (1 - new**2)
            dr = dn * gn * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ dg
            carry = d * (1 - m * (1 - z)) + dg @ u.T
        return dx, du


def _gather(table: np.ndarray, ids: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-major inputs, mask and word places of windows that begin at ``first`` and end before ``stop``."""
    place = first[None, :] + np.arange(WINDOW)[:, None]
    mask = place < stop[None, :]
    word = ids[np.minimum(place, len(ids) - 1)]
    return table[word], mask.astype(F32), word


class Scorer:
    """Runs a model over texts; remembers the gate inputs of the words it has met."""

    def __init__(self, model: BiGru):
        self._model = model
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._table = np.empty((0, 6 * HIDDEN), F32)
        self._used = 0

    def _places(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        new = list({w for w in words if w not in known})
        if new:
            if self._used + len(new) > REMEMBERED:
                self._forget()
                known, new = self._known, list(set(words))
            if self._used + len(new) > len(self._table):
                grown = np.empty((max(2 * len(self._table), self._used + len(new), 4096), 6 * HIDDEN), F32)
                grown[: self._used] = self._table[: self._used]
                self._table = grown
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                self._table[self._used : self._used + len(part)] = self._model.inputs(part)
                known.update(zip(part, range(self._used, self._used + len(part)), strict=True))
                self._used += len(part)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _logits(self, words: list[bytes], first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        ids = self._places(words)
        out = np.empty(len(first), F32)
        for at in range(0, len(first), WINDOWS):
            x, mask, _ = _gather(self._table, ids, first[at : at + WINDOWS], stop[at : at + WINDOWS])
            out[at : at + WINDOWS] = self._model.forward(x, mask)
        return out

    def window_logits(self, documents: list[list[bytes]]) -> list[np.ndarray]:
        """Logits of all windows of each document; a document without words has one, of an empty window."""
        starts = [windows_of(len(d)) for d in documents]
        base = np.cumsum([0, *map(len, documents)])
        first = np.concatenate([s + b for s, b in zip(starts, base, strict=False)])
        stop = np.repeat(base[1:], [len(s) for s in starts])
        words = [w for d in documents for w in d] or [b""]
        found = self._logits(words, first, stop)
        return np.split(found, np.cumsum([len(s) for s in starts])[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, held, size = [], [], 0
        for text in texts:
            words = words_of(text)
            held.append(words)
            size += len(words)
            if size > 200_000:
                out += [x.max() for x in self.window_logits(held)]
                held, size = [], 0
        if held:
            out += [x.max() for x in self.window_logits(held)]
        return sigmoid(np.array(out, F32)).astype(float)


def train(documents: list[list[bytes]], target: np.ndarray, batch: int = 64, seed: int = 3) -> BiGru:
    """Fit on sampled documents; in the first epochs on any of their windows, then on those that decide.

    Few documents are gone over more often, so that the steps are alike.
    """
    epochs = int(np.clip(PRESENTATIONS // max(len(documents), 1), 9, 60))
    rng = np.random.default_rng(seed)
    df = Counter(w for d in documents for w in set(d))
    kept = sorted((w for w, n in df.items() if n > 1), key=lambda w: (-df[w], w))[:VOCABULARY]
    model = BiGru.fresh({w: i + 1 for i, w in enumerate(kept)}, rng)
    if not documents or target.min() == target.max():
        return model
    adam = Adam(0.01)
    for epoch in range(epochs):
        adam.rate = 0.012 * (1 - epoch / epochs) + 0.001
        picks = _choose(model, documents, target, epoch, rng)
        for at in range(0, len(picks), batch):
            _learn(model, adam, documents, target, picks[at : at + batch])
    return model


def _choose(model: BiGru, documents: list[list[bytes]], target: np.ndarray, epoch: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    picks: list[tuple[int, int]] = []
    if epoch < 2:
        for i, d in enumerate(documents):
            starts = windows_of(len(d))
            picks += [(i, int(s)) for s in rng.choice(starts, min(len(starts), 4), replace=False)]
    else:
        scorer = Scorer(model)
        for a in range(0, len(documents), 200):
            for i, found in enumerate(scorer.window_logits(documents[a : a + 200]), a):
                top = np.argsort(-found)[: 1 if target[i] else 2]
                picks += [(i, int(t) * STRIDE) for t in top]
    return [picks[i] for i in rng.permutation(len(picks))]


def _learn(model: BiGru, adam: Adam, documents: list[list[bytes]], target: np.ndarray, picks: list[tuple[int, int]]) -> None:
    texts = [documents[i][s : s + WINDOW] for i, s in picks]
    distinct = sorted({w for t in texts for w in t}) or [b""]
    index = {w: i for i, w in enumerate(distinct)}
    rows, grams, at, vectors = model.describe(distinct)
    ids = np.array([index[w] for t in texts for w in t] or [0])
    base = np.cumsum([0, *map(len, texts)])
    x, mask, word = _gather(vectors @ model.p["W"] + model.p["b"], ids, base[:-1], base[1:])
    grads, dx = model.gradients(x, mask, target[[i for i, _ in picks]])
    dp = np.zeros((len(distinct), 6 * HIDDEN), F32)
    np.add.at(dp, word[mask > 0], dx[mask > 0])
    grads |= {"W": vectors.T @ dp, "b": dp.sum(axis=0)}
    dv = dp @ model.p["W"].T
    known = np.flatnonzero(rows)
    grads["E"] = dv[known, :WORD_DIM]
    used, back = np.unique(grams, return_inverse=True)
    dg = np.zeros((len(used), GRAM_DIM), F32)
    np.add.at(dg, back, np.repeat(dv[:, WORD_DIM:] / np.maximum(np.diff(at), 1)[:, None].astype(F32), np.diff(at), axis=0))
    grads["G"] = dg
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    if norm > 5:
        grads = {k: g * F32(5 / norm) for k, g in grads.items()}
    adam.update(model.p, grads, {"E": rows[known], "G": used})


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> BiGru:
    """From ``docs(key, text)`` and ``labels(key, target)``; a target other than 0 and 1 teaches nothing.

    With one class only, or none, the model is untrained and scores alike.
    """
    drawn = labelled_sample(docs, labels, sample, "toxicity")[0].collect()
    drawn.sort(key=lambda r: (zlib.crc32(str(r["key"]).encode()), r["target"], r["text"] or ""))
    return train([words_of(r["text"]) for r in drawn], np.array([r["target"] for r in drawn], F32))


def score(docs: DataFrame, model: BiGru, text_col: str = "text", into: str = "toxicity_score") -> DataFrame:
    """``docs`` with a double column ``into`` from 0 to 1: the most toxic of all overlapping windows.

    Null, empty and wordless texts are one empty window; texts of any length
    are read whole; equal texts score alike, whatever their ids; an empty table
    stays empty. Other columns stay as they are: where ``docs`` has a column of
    the name, underscores are added to ``into``.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.where(texts.notna(), None).tolist()))

    return docs.withColumn(fresh(docs, into), run(F.col(text_col)))
