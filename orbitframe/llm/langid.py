"""Language identification by nearest centroid over TF-IDF character n-grams.

A text is a vector of hashed letter n-grams (n = 1, 2, 3, words padded with a
space), damped, weighted by inverse document frequency and normalised. Every
language has several centroids from spherical k-means; a text takes the
language of the centroid of highest cosine and is rejected where even that one
is farther away than held-out texts of that language and length are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import fresh, small_batches

#: Buckets of hashed n-grams.
BUCKETS = 1 << 13
#: Training texts per language that k-means sees: the documented bound of the fit.
SAMPLE_PER_LANGUAGE = 600
CENTROIDS = 3
#: Texts of its language that a centroid must own, and starts of the clustering.
LEAST_SHARE, STARTS = 0.05, 3
#: Texts of a batch whose vectors are held at once.
ROWS = 128
#: A text is rejected where its cosine is below this share of a low quantile of held-out cosines of its language and length.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.02
#: Held-out texts that a language needs in a length class for a quantile of its own.
REJECT_TEXTS = 50
_LENGTHS = np.array([8, 32, 128, 512, 2048])
_BREAK = re.compile(r"[\W\d_]+")
#: Letters of a long text that are counted at a time.
_PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def gram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts by bucket of the n-grams of the lowered letters of a whole text, and how many there are."""
    counts = np.zeros(BUCKETS, np.int64)
    total = 0
    seen = np.array([32], np.uint32)  # what the n-grams of the next piece reach back to
    for piece in _pieces(text or ""):
        letters = _BREAK.sub(" ", piece.lower()).strip()
        if not letters:
            continue
        codes = np.concatenate([seen, np.frombuffer((letters + " ").encode("utf-32-le", "surrogatepass"), np.uint32)])
        two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]
        three = (two[:-1] * np.uint32(0x85EBCA6B)) ^ codes[2:]
        for k, grams in enumerate((codes[1:-1], two[len(seen) - 1 :], three)):
            mixed = (grams + np.uint32(k)) * np.uint32(0xC2B2AE35)
            mixed ^= mixed >> np.uint32(15)
            counts += np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(19), minlength=BUCKETS)
        total += len(codes) - len(seen) + (not total)
        seen = codes[-2:]
    return counts, total


def _pieces(text: str) -> Iterator[str]:
    """A long text by pieces that end behind a word, so that counts are those of the whole."""
    at = 0
    while len(text) - at > _PIECE:
        gap = _BREAK.search(text, at + _PIECE)
        if not gap:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:]


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [gram_counts(t) for t in texts]
    return _weigh(np.array([c for c, _ in found]).reshape(len(texts), BUCKETS), idf), np.array([n for _, n in found])


@dataclass
class CentroidModel:
    """``centroids`` rows are unit vectors of ``languages[owner[row]]``; ``floors`` are cosines by language and length class."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (``und`` without a letter), score from 0 to 1, and whether the distance rejects it."""
        names: list[str] = []
        scores, rejected = [], []
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            x, sizes = _vectors(part, self.idf)
            cosine = x @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(part)), best]
            floor = self.floors[self.owner[best], np.searchsorted(_LENGTHS, sizes, "right")]
            real = np.array([has_letter(t) for t in part], bool)
            names += [self.languages[self.owner[b]] if r else "und" for b, r in zip(best, real, strict=True)]
            scores.append(np.where(real, np.clip(top, 0, 1), 0.0))
            rejected.append(~real | (top < floor))
        empty = np.empty(0)
        return names, np.concatenate([empty, *scores]), np.concatenate([empty, *rejected]).astype(bool)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all training texts each bucket occurs; partial sums are made on executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += gram_counts(text.as_py())[0] > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BUCKETS), -1)), pa.array(np.append(seen, n))], ["bucket", "n"])

    parts = train.select("text").mapInArrow(count, "bucket long, n long")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    n = 0
    for bucket, seen in rows:
        if bucket < 0:
            n = seen
        else:
            out[bucket] = seen
    return out, n


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; a cluster of less than ``LEAST_SHARE`` of the texts starts again amid the largest.

    Seeds are drawn by their distance from those before; of ``STARTS`` starts the
    closest fit counts. Odd texts alone make no centroid: clusters that stay too
    small are left out.
    """
    best, fit_ = None, -np.inf
    least = LEAST_SHARE * len(x)
    for _ in range(STARTS):
        c = x[rng.integers(len(x), size=1)]
        while len(c) < min(k, len(x)):
            apart = np.maximum(1 - (x @ c.T).max(axis=1), 1e-9)
            c = np.concatenate([c, x[rng.choice(len(x), p=apart / apart.sum(), size=1)]])
        for turn in range(15):
            mine = (x @ c.T).argmax(axis=1)
            sizes = np.bincount(mine, minlength=len(c))
            sums = np.array([x[mine == i].sum(axis=0) for i in range(len(c))])
            for i in np.flatnonzero(sizes < least) if turn < 10 else ():
                sums[i] = x[rng.choice(np.flatnonzero(mine == sizes.argmax()))]
            c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        near = x @ c.T
        sizes = np.bincount(near.argmax(axis=1), minlength=len(c))
        kept = sizes >= least if (sizes >= least).any() else sizes == sizes.max()
        value = near[:, kept].max(axis=1).sum()
        if value > fit_:
            best, fit_ = c[kept], value
    return best


def _sample(rows: DataFrame, sample: int) -> list[tuple[str, int, np.ndarray]]:
    """``(lang, n-grams, counts)`` of about ``sample`` texts a language: those of the smallest hashes of the key.

    A key gives one text a language, its smallest, however often it is repeated;
    rows without a key are told apart by their texts.
    """
    width = 1 << 40
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    share = {k: min(width, -(-width * sample // n)) for k, n in sizes.items()}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    mixed = F.when(F.col("key").isNull(), F.xxhash64("text", F.lit("langid"))).otherwise(F.xxhash64("key", F.lit("langid")))
    hashed = rows.withColumn("h", F.pmod(mixed, F.lit(width))).where(F.col("h") < limit[F.col("lang")])
    drawn = hashed.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, h, text in zip(*batch.columns, strict=True):
                if not has_letter(text.as_py()):
                    continue
                counts, total = gram_counts(text.as_py())
                used = np.flatnonzero(counts)
                out.append((lang.as_py(), h.as_py(), total, used.astype(np.uint16).tobytes(), counts[used].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "h", "total", "used", "counts"), zip(*out, strict=True) if out else [[]] * 5, strict=True)), schema=shape)

    shape = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("total", pa.int64()), ("used", pa.binary()), ("counts", pa.binary())])
    got = drawn.select("lang", "h", "text").mapInArrow(counted, "lang string, h long, total long, used binary, counts binary").collect()
    found = []
    for row in sorted(got, key=lambda r: (r["lang"], r["h"], r["used"], r["counts"])):
        counts = np.zeros(BUCKETS, np.uint32)
        counts[np.frombuffer(row["used"], np.uint16)] = np.frombuffer(row["counts"], np.uint32)
        found.append((row["lang"], row["total"], counts))
    return found


def fit(train: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> CentroidModel:
    """From ``train(key, text, lang)``: frequencies over all rows, centroids from about ``sample`` texts a language.

    The sample is drawn by a hash of the key, so reruns agree. Rows of null text
    or language and texts without a letter teach nothing; without any training
    row every text is ``und``.
    """
    small_batches(train.sparkSession)
    rows = train.where("text is not null and lang is not null")
    seen, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.05)
    got = _sample(rows, sample)
    languages = sorted({lang for lang, _, _ in got})
    if not languages:
        return CentroidModel(["und"], idf, np.zeros((1, BUCKETS), np.float32), np.zeros(1, int), np.zeros((1, len(_LENGTHS) + 1)))
    owner, centers, sims, sizes, names = [], [], [], [], []
    rng = np.random.default_rng(5)
    for i, lang in enumerate(languages):
        x = _weigh(np.array([c for name, _, c in got if name == lang]), idf)
        c = _cluster(x, centroids, rng)
        owner += [i] * len(c)
        centers.append(c)
        sims.append(_held_out(x, centroids, rng))
        sizes += [size for name, size, _ in got if name == lang]
        names += [i] * len(x)
    floors = _floors(np.concatenate(sims), np.array(sizes), np.array(names), len(languages))
    return CentroidModel(languages, idf, np.concatenate(centers).astype(np.float32), np.array(owner), floors)


def _held_out(x: np.ndarray, centroids: int, rng: np.random.Generator) -> np.ndarray:
    """The cosine of every text with centroids of the half of its language that it is not in."""
    half = np.arange(len(x)) % 2
    if len(x) < 2:
        return np.ones(len(x))
    out = np.empty(len(x))
    for side in (0, 1):
        out[half == side] = (x[half == side] @ _cluster(x[half != side], centroids, rng).T).max(axis=1)
    return out


def _floors(similarity: np.ndarray, sizes: np.ndarray, names: np.ndarray, languages: int) -> np.ndarray:
    """``(language, length class)``: a share of a low quantile of held-out cosines.

    A language of few texts in a class takes the quantile of all languages in
    it; a class without examples takes the next shorter one's.
    """
    classes = np.searchsorted(_LENGTHS, sizes, "right")
    out = np.zeros((languages, len(_LENGTHS) + 1))
    for k in range(1, out.shape[1]):  # the first has too few letters to tell
        for i in range(languages):
            mine = similarity[(classes == k) & (names == i)]
            if len(mine) < REJECT_TEXTS:
                mine = similarity[classes == k]
            out[i, k] = REJECT_SHARE * np.quantile(mine, REJECT_QUANTILE) if len(mine) else out[i, k - 1]
    return out


def identify(docs: DataFrame, model: CentroidModel, text_col: str = "text", into: str = "lang_found") -> DataFrame:
    """``docs`` with a struct column ``into``: ``lang string, score double, rejected boolean``.

    Null texts and texts without a letter are ``und``, score 0, rejected. Ties
    go to the language that sorts first. All other columns stay as they are:
    where ``docs`` has a column of the name, underscores are added to ``into``.
    Repeated rows and ids are rows like others; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, rejected = shared.value.predict(texts.where(texts.notna(), None).tolist())
            yield pd.DataFrame({"lang": names, "score": scores, "rejected": rejected})

    # Not to be repeated: a filter on the result reads the column instead of predicting again.
    return docs.withColumn(fresh(docs, into), predict.asNondeterministic()(F.col(text_col)))
