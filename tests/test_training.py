"""Derivatives against differences, distributed gradients against one batch, and a short run with a restart."""

import numpy as np
import pytest

from orbitframe.functions import constants as K
from orbitframe.operators import network, training
from orbitframe.operators.gradients import Traced

SIDE = 16
CONFIG = K.TrainConfig(n_months=2, fbc_channels=3, base=4, batch_size=4, epochs=4, warmup_epochs=1, learning_rate=5e-3)


def _windows(n: int, config: K.TrainConfig = CONFIG):
    """Dark images with bright blocks; one block appears in the last month."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        image = rng.normal(0, 0.1, (config.n_months, 3, SIDE, SIDE))
        mask = np.zeros((config.n_months, config.fbc_channels, SIDE, SIDE))
        y, x = rng.integers(0, SIDE - 6, 2)
        mask[:, 0, 2:6, 3:8] = 1
        mask[-1, 0, y : y + 6, x : x + 6] = 1
        image += 2 * mask[:, :1]
        out.append((i, image.ravel().tolist(), mask.ravel().tolist(), np.abs(mask[-1, 0] - mask[0, 0]).ravel().tolist()))
    return out


def _stacked(rows):
    return [np.stack([r[k] for r in rows]).reshape(len(rows), -1, SIDE, SIDE).astype(np.float32) for k in (1, 2, 3)]


def _frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, image array<float>, fbc array<float>, change array<float>").repartition(parts, "id")


def test_derivatives_equal_differences():
    net = training.drawn_network(CONFIG)
    images, fbc, change = _stacked(_windows(2))
    values = {k: v.astype(np.float64) for k, v in net.weights.values.items()}

    def loss(v):
        traced = network.ChangeNetwork(CONFIG.n_months, CONFIG.fbc_channels, CONFIG.base)
        traced.weights = training.TracedWeights(v)
        out = traced.forward(images, side=True)
        return traced, training.network_loss(out, fbc, change, 3, 7.0), out

    traced, total, out = loss(values)
    for name, plain in net.forward(images, side=True).items():
        assert np.allclose(out[name].value, plain, atol=1e-3), name
    total.backward()
    rng = np.random.default_rng(1)
    for name, v in values.items():
        direction = rng.standard_normal(v.shape)
        step = 1e-6 / np.linalg.norm(direction)
        ends = [float(loss(values | {name: v + s * step * direction})[1].value) for s in (1, -1)]
        grad = traced.weights.traced[name].grad
        got = 0.0 if grad is None else float((grad * direction).sum())
        assert np.isclose(got, (ends[0] - ends[1]) / (2 * step), rtol=2e-3, atol=2e-4), name


def test_what_has_no_derivative_is_refused():
    with pytest.raises(TypeError):
        np.sin(Traced(np.ones(2)))
    with pytest.raises(TypeError):
        np.cumsum(np.sort(Traced(np.ones(2))))


def test_gradients_of_tasks_add_up(spark):
    rows = _windows(5)
    values = training.drawn_network(CONFIG).weights.values
    loss, n, grad = training.batch_gradient(_frame(spark, rows), values, CONFIG, SIDE)
    want_loss, want = training.loss_gradient(values, CONFIG, *_stacked(rows))
    assert n == 5 and np.isclose(loss, want_loss, rtol=1e-4)
    assert np.allclose(grad, want, atol=1e-4 + 1e-3 * np.abs(want).max())
    empty = training.batch_gradient(_frame(spark, rows).where("id < 0"), values, CONFIG, SIDE)
    assert empty[1] == 0 and not empty[2].any()


def test_step_rules():
    assert np.isclose(np.linalg.norm(training.clipped(np.full(100, 3.0), 0.5)), 0.5)
    assert np.allclose(training.clipped(np.full(4, 0.01), 0.5), 0.01)
    after = training.AdamW(2).update(np.array([1.0, -1.0]), np.array([2.0, 0.0]), 0.1, 0.01)
    assert np.allclose(after, [0.999 - 0.1, -0.999])
    assert [training.rate_factor(s, 2, 4) for s in range(3)] == [0.5, 1.0, 1.0] and training.rate_factor(9, 2, 4) == 0


def test_a_run_learns_and_goes_on_where_it_stopped(spark, tmp_path):
    rows = _windows(8)
    rows[0] = (0, [float("nan")] * len(rows[0][1]), *rows[0][2:])
    data, held = _frame(spark, rows), _frame(spark, _windows(12)[8:])
    run = lambda where, **kw: training.train(data, held, CONFIG, SIDE, str(tmp_path / where), ("id",), **kw).collect()
    whole = run("a")
    assert [r["epoch"] for r in whole] == [1, 2, 3, 4] and all(r["skipped"] == 1 for r in whole)
    assert whole[-1]["loss"] < whole[0]["loss"] and whole[0]["is_best"]
    run("b", until=2)
    again = run("b")
    assert [r["epoch"] for r in again] == [1, 2, 3, 4]
    assert np.allclose([r["loss"] for r in again], [r["loss"] for r in whole], rtol=1e-3)
    arrays, notes = training.load_state(spark, str(tmp_path / "a" / "best"))
    net = training.drawn_network(CONFIG)
    assert net.weights.restore(arrays) == ([], []) and notes["base"] == CONFIG.base
