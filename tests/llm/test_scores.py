"""Trained scorers: gradients, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.llm import entries, nn, quality, toxicity

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "!!! 123 ..."), (5, "word"), (5, "word"), (None, "no id"), (7, "idiot word " * 60_000), (8, "x" * 300_000)]


def numeric(f, values, at, step=1e-5):
    old = values[at]
    values[at] = old + step
    up = f()
    values[at] = old - step
    down = f()
    values[at] = old
    return (up - down) / (2 * step)


@pytest.fixture
def doubles(monkeypatch):
    for module in (nn, quality, toxicity):
        monkeypatch.setattr(module, "F32", np.float64)


def entropy(logit, target):
    return np.mean(np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - logit * target)


def test_gradients_of_the_recurrent_net(doubles):
    rng = np.random.default_rng(0)
    model = toxicity.BiGru.fresh({}, rng)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x = rng.standard_normal((6, 5, 6 * toxicity.HIDDEN))
    mask = (rng.random((6, 5)) < 0.8).astype(float)
    mask[0] = 1
    target = np.array([1.0, 0, 1, 0, 0])
    loss = lambda: entropy(model.forward(x, mask), target)
    grads, dx = model.gradients(x, mask, target)
    for name in ("Uf", "Ub", "A", "v", "o", "c"):
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in model.p[name].shape)
            assert np.isclose(numeric(loss, model.p[name], at), grads[name][at], atol=1e-7)
    for _ in range(12):
        at = tuple(int(rng.integers(0, n)) for n in x.shape)
        assert np.isclose(numeric(loss, x, at), dx[at], atol=1e-7)


def test_gradients_of_the_attention_net(doubles):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((9, quality.FEATURES))
    model = quality.AttentionMil.fresh(x, 0.5, rng)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    starts, target = np.array([0, 1, 5]), np.array([1.0, 0, 1])
    loss = lambda: entropy(model.forward(x, starts)["z"] @ model.p["c"] + model.p["d"], target)
    grads = model.gradients(x, starts, target)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in value.shape)
            assert np.isclose(numeric(loss, value, at), grads[name][at], atol=1e-6), name


@pytest.mark.parametrize("name,target,least", [("op3_toxicity", "toxic", 0.92), ("op8_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, sf_dir, name, target, least):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = entries.QUERIES[name](spark, sf_dir).join(labels, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(held) > 40 and (held["predicted"] == held[target]).mean() >= least
    assert rows["score"].between(0, 1).all()


def test_toxicity_of_odd_rows(spark):
    texts = [(i, ("you idiot scum " if i % 3 == 0 else "") + "plain words of a text " * (i % 9 + 1)) for i in range(90)]
    docs = spark.createDataFrame(texts, "key long, text string")
    labels = docs.select("key", (F.col("key") % 3 == 0).cast("int").alias("target"))
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(1, None), (999, 1), (None, 0)], "key long, target int")))
    odd = spark.createDataFrame(ODD, DOCS).withColumn("target", F.lit(1))
    rows = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(odd, model).collect()}
    assert rows[1] == rows[2] == rows[3] == rows[4] and rows[7] > 0.5 > rows[5]
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels.limit(0)).p["o"].shape == (2 * toxicity.HIDDEN,)


def test_a_late_window_counts():
    rng = np.random.default_rng(2)
    docs = [toxicity.words_of("calm words here " * 20 + ("scum idiot " if i % 2 else "")) for i in range(60)]
    scorer = toxicity.Scorer(toxicity.train(docs, np.array([i % 2 for i in range(60)], np.float32)))
    long = "calm words here " * 700
    low, high = scorer.scores([long, long + "scum idiot " + long])
    assert low < 0.5 < high and rng is not None
    assert toxicity.windows_of(0).tolist() == [0] and toxicity.windows_of(49).tolist() == [0, 16, 32]


def test_quality_of_odd_rows(spark):
    texts = [(i, "GO!! NOW!! " * 30 if i % 3 == 0 else " ".join(f"w{(i * 7 + k * k) % 501}" for k in range(120))) for i in range(90)]
    docs = spark.createDataFrame(texts, "key long, text string")
    labels = docs.select("key", (F.col("key") % 3 != 0).cast("int").alias("target"))
    model = quality.fit(docs, labels)
    scored = {r["key"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    assert all((s > 0.5) == (k % 3 != 0) for k, s in scored.items())
    odd = spark.createDataFrame(ODD, DOCS).withColumn("target", F.lit(1))
    rows = {r["doc_id"]: r["quality_score"] for r in quality.score(odd, model).collect()}
    assert len(rows) == 8 and rows[1] == rows[2] == rows[3]
    assert quality.score(odd.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), labels.limit(0)).score([None]).shape == (1,)


def test_columns_of_the_same_name_stay(spark):
    docs = spark.createDataFrame([(1, "some words", 5)], "doc_id long, text string, mine int")
    rng = np.random.default_rng(1)
    made = toxicity.score(docs.withColumnRenamed("mine", "toxicity_score"), toxicity.BiGru.fresh({}, rng))
    assert made.columns[-2:] == ["toxicity_score", "toxicity_score_"] and made.first()["toxicity_score"] == 5
    made = quality.score(docs.withColumnRenamed("mine", "quality_score"), quality.train([], np.empty(0)))
    assert made.columns[-2:] == ["quality_score", "quality_score_"] and made.first()["quality_score"] == 5


def plain_sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_op8_equals_a_plain_forward_pass(spark, sf_dir):
    """The score of every document, computed passage by passage with loops."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"), F.col("quality").alias("target"))
    model = quality.fit(docs.withColumnRenamed("doc_id", "key"), labels)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    p = {k: v.astype(float) for k, v in model.p.items()}
    for doc_id, text in docs.collect():
        hs, es = [], []
        for x in quality.passages(text):
            h = np.tanh(np.clip((x - model.mean) / model.spread, -8, 8) @ p["W"] + p["b"])
            hs.append(h)
            es.append((np.tanh(h @ p["V"]) * plain_sigmoid(h @ p["U"])) @ p["w"])
        a = np.exp(np.array(es) - max(es))
        z = (a / a.sum()) @ np.array(hs)
        assert abs(got[doc_id] - plain_sigmoid(z @ p["c"] + p["d"][0])) < 1e-3


def test_op3_equals_a_plain_forward_pass(spark, sf_dir):
    """The score of every document, window by window and word by word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").limit(150)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"), F.col("toxic").alias("target"))
    model = toxicity.fit(docs.withColumnRenamed("doc_id", "key"), labels)
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(docs, model).collect()}
    p, n = {k: v.astype(float) for k, v in model.p.items()}, toxicity.HIDDEN

    def run(xs, u):
        h, out = np.zeros(n), []
        for x in xs:
            back = h @ u
            z, r = plain_sigmoid(x[:n] + back[:n]), plain_sigmoid(x[n : 2 * n] + back[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * back[2 * n :])
            out.append(h)
        return out

    for doc_id, text in docs.collect():
        words = toxicity.words_of(text)
        logits = []
        for at in toxicity.windows_of(len(words)):
            xs = list(model.inputs(words[at : at + toxicity.WINDOW]).astype(float))
            if not xs:
                logits.append(p["c"][0])
                continue
            f, b = run([x[: 3 * n] for x in xs], p["Uf"]), run([x[3 * n :] for x in xs][::-1], p["Ub"])[::-1]
            hs = np.concatenate([np.array(f), np.array(b)], axis=1)
            e = np.tanh(hs @ p["A"]) @ p["v"]
            a = np.exp(e - e.max())
            logits.append((a / a.sum()) @ hs @ p["o"] + p["c"][0])
        assert abs(got[doc_id] - plain_sigmoid(max(logits))) < 2e-3


def test_passages_cover_the_whole_text():
    bag = quality.passages("a " * 200)
    assert len(bag) == 4 and quality.passages(None).shape == (1, quality.FEATURES)


def test_a_repeated_key_or_a_long_text_does_not_swell_the_sample(spark):
    from orbitframe.llm import langid, nn

    docs = [(1, "b")] * 50 + [(1, "a"), (2, "c" * (nn.SAMPLE_BYTES + 1)), (3, None), (4, "d"), (None, "e")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 7), (None, 1)], "key long, target int")
    drawn, _ = nn.labelled_sample(spark.createDataFrame(docs, "key long, text string"), labels, {0: 10, 1: 10}, "salt")
    assert sorted((r["key"], r["target"], r["text"]) for r in drawn.collect()) == [(1, 1, "a"), (3, 0, None)]
    rows = spark.createDataFrame([(1, "one text", "x")] * 40 + [(None, f"text {c}", "x") for c in "abc"], "key long, text string, lang string")
    assert len(langid._sample(rows, 100)) == 4
