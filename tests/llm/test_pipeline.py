"""The corpus pipeline, stage by stage, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from orbitframe.llm import simhash
from orbitframe.llm.pii import Pseudonymizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, "123 456", None, None, 7), (None, "text without an id but words", "en", None, 1)]
    return base.unionByName(spark.createDataFrame(odd, DOCS)).withColumns({"lang_found": F.lit(1), "pii_found": F.lit(2)})


def test_stages(spark, sf_dir, tmp_path):
    docs = corpus(spark, sf_dir)
    frames = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames.append(docs.toPandas())
    start, language, unique, private, mixed, packed = frames
    gone = set(start["doc_id"].dropna()) - set(language["doc_id"].dropna())
    assert {9001, 9002, 9003} <= gone and len(gone) <= 6 and language["lang"].notna().all()
    # Exact copies go, the smallest id of each stays.
    first = language.dropna(subset=["doc_id"]).groupby("text")["doc_id"].min()
    assert unique["text"].is_unique and set(unique["doc_id"].dropna()) <= set(first)
    sets = {d: shingles(t) for d, t in zip(language["doc_id"], language["text"], strict=True) if d == d}
    kept = set(unique["doc_id"].dropna())
    for d in set(sets) - kept:
        assert max(jaccard(sets[d], sets[k]) for k in sets if k != d and k in sets) > 0.6
    back = Pseudonymizer(corpus_pipeline.PII_KEY, back=True)
    texts = dict(zip(unique["doc_id"], unique["text"], strict=True))
    assert all(back.text(t)[0] == texts[d] for d, t in zip(private["doc_id"], private["text"], strict=True) if d == d)
    words = lambda frame: frame["text"].map(lambda t: len(t.split())).sum()
    assert abs(words(mixed) / (1.5 * words(private)) - 1) < 0.02
    assert mixed.groupby("doc_id").size().max() <= 2
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    one = packed.drop_duplicates("doc_id").set_index("doc_id")["doc_tokens"]
    assert packed["length"].sum() == sum(one[d] * n for d, n in mixed.dropna(subset=["doc_id"]).groupby("doc_id").size().items()) + packed[packed["doc_id"].isna()]["length"].sum()


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_run_and_empty(spark, sf_dir, tmp_path):
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    again = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(whole) == len(again) > 500 and np.array_equal(np.sort(whole["ids_crc32"]), np.sort(again["ids_crc32"]))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def edited(rng, words, share):
    """``words`` with the tail replaced, so that about ``share`` of the 5-word shingles stay in common with them."""
    n = len(words) - 4
    same = 2 * share / (1 + share) * n
    cut = len(words) - round(n - same)
    return [*words[:cut], *(f"x{v}" for v in rng.integers(0, 10**9, len(words) - cut))]


def test_near_copies_are_exact_in_both_directions(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 2000)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(160):
        words = [f"w{v}" for v in rng.integers(0, 10**9, int(rng.integers(60, 400)))]
        copies = [words] + [edited(rng, words, rng.uniform(0.7, 0.9)) for _ in range(1 + (i % 40 == 0) * 12)]
        rows += [(len(rows) + k, " ".join(c)) for k, c in enumerate(copies)]
    sets = [shingles(t) for _, t in rows]
    comp, close, apart = list(range(len(rows))), 0, 0
    for a in range(len(rows)):
        for b in range(a):
            alike = jaccard(sets[a], sets[b])
            close, apart = close + (0.8 <= alike < 0.85), apart + (0.7 <= alike < 0.8)
            if alike >= 0.8 and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    assert close > 40 and apart > 40
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == set(comp)


def test_wider_keys_find_as_many():
    """Beyond some ten million sets keys grow, and their number with them."""
    same = 1 - np.arccos(2 * 0.8 / 1.8) / np.pi
    chance = lambda bands, draws: 1 - (1 - same ** (256 // bands)) ** (bands * draws)
    assert simhash.key_plan(256, 21, 3, 10**6, 0.8) == (21, 3)
    for distinct in (10**8, 10**9, 10**10):
        bands, draws = simhash.key_plan(256, 21, 3, distinct, 0.8)
        assert distinct / 2 ** (256 // bands) <= simhash.BUCKET and chance(bands, draws) > 0.9998
        assert simhash.drawn_keys(np.zeros((2, 4), np.uint64), bands, draws).shape == (2, bands * draws)


def test_link_sets_equals_all_pairs():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(0, 12))).astype(np.uint64)) for _ in range(300)]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if c == high else c for c in label]
    assert simhash.link_sets(sets, 0.8).tolist() == label
