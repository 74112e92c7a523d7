import numpy as np
import pandas as pd
import pytest

from gridcast.operators import models, tuning, windows
from gridcast.sources import sinks


@pytest.mark.parametrize("kind", models.KINDS)
def test_gradients_match_finite_differences(kind):
    rng = np.random.default_rng(3)
    spec = models.Spec(kind, units=5, layers=2, dropout=0.0)
    x, y = rng.standard_normal((7, 4)), rng.standard_normal((7, 3))
    w = {k: a + 0.1 * rng.standard_normal(a.shape) for k, a in models.init(spec, 4, 3).items()}
    loss = lambda: float(np.mean((models.forward(spec, w, x)[0] - y) ** 2))
    p, cache = models.forward(spec, w, x)
    grads = models.backward(spec, w, cache | {"mask": 1.0}, 2 * (p - y) / p.size)
    assert set(grads) == set(w)
    for name, a in w.items():
        for at in [tuple(rng.integers(0, s) for s in a.shape) for _ in range(4)]:
            old, h = a[at], 1e-6
            a[at] = old + h
            up = loss()
            a[at] = old - h
            down = loss()
            a[at] = old
            assert np.isclose((up - down) / (2 * h), grads[name][at], atol=1e-6), (name, at)


def test_cells_equal_one_step_of_the_full_cells():
    rng = np.random.default_rng(4)
    sig = lambda v: 1 / (1 + np.exp(-v))
    x = rng.standard_normal((6, 4))
    for kind in ("lstm", "gru", "rnn"):
        spec = models.Spec(kind, units=5, dropout=0.0)
        w = {k: rng.standard_normal(a.shape) for k, a in models.init(spec, 4, 2).items()}
        h0, c0, u = np.zeros((6, 5)), np.zeros((6, 5)), rng.standard_normal((5, 5))
        pre = {g[1:]: x @ w[g] + w["b" + g[1:]] for g in w if g[0] == "W" and g != "Wy"}
        if kind == "rnn":
            h = np.tanh(pre["h"] + h0 @ u)
        elif kind == "lstm":
            c = sig(h0 @ u) * c0 + sig(pre["i"] + h0 @ u) * np.tanh(pre["g"] + h0 @ u)
            h = sig(pre["o"] + h0 @ u) * np.tanh(c)
        else:
            z, r = sig(pre["z"] + h0 @ u), sig(pre["r"] + h0 @ u)
            h = z * h0 + (1 - z) * np.tanh(pre["a"] + r * (h0 @ u + w["c"]))
        assert np.allclose(models.forward(spec, w, x)[0], h @ w["Wy"] + w["by"])


@pytest.mark.parametrize("kind", models.KINDS)
def test_training_learns_and_is_repeatable(kind):
    rng = np.random.default_rng(5)
    x = rng.random((400, 6))
    y = x[:, :2] * 0.5 + x[:, 3:5] * 0.3
    spec = models.Spec(kind, units=16, layers=1, dropout=0.05, epochs=12, batch=16)
    a, b = (models.train(spec, x[:300], y[:300], x[300:], y[300:]) for _ in range(2))
    assert a.history == b.history and a.history[-1]["rmse"] < 0.6 * a.history[0]["rmse"] and a.history[-1]["val_nrmse"] > 0


def test_search_scoring_and_storage(spark, tmp_path):
    rows = [("a", s, 1000 * k + j, float(np.sin(j / 3))) for k, s in enumerate(("train", "val", "test")) for j in range(60)]
    w = windows.sliding_windows(spark.createDataFrame(rows, "i string, split string, pos long, y double"), 6, 2)
    grid = tuning.trial_grid(spark, "mlp", 3)
    assert grid.collect() == tuning.trial_grid(spark, "mlp", 3).collect() and tuning.trial_grid(spark, "gru").count() == 20
    history = tuning.run_trials(grid.unionByName(tuning.trial_grid(spark, "rnn", 2)), w, epochs=2).toPandas()
    assert history.groupby("model").trial.nunique().to_dict() == {"mlp": 3, "rnn": 2}
    best = {r["model"]: r for r in tuning.best_trial(spark.createDataFrame(history)).collect()}
    last = history[(history.metric == "val_nrmse") & (history.epoch == 1)]
    assert all(best[m]["value"] == last[last.model == m].value.min() for m in ("mlp", "rnn"))
    fitted = models.train(models.Spec(units=8, epochs=2), *models.sample_matrices(w, "train"), *models.sample_matrices(w, "val"))
    scored = models.score(w.filter("split = 'test'"), fitted).collect()
    assert len(scored) == 53
    for r in scored:
        assert np.allclose(r["yp"], models.forward(fitted.spec, fitted.weights, np.array([r["x"]]))[0][0])
    sinks.write_model(spark, models.model_rows("m", fitted), f"file://{tmp_path}/model")
    back = models.model_of(fitted.spec, sinks.read_model(spark, f"file://{tmp_path}/model", "m"))
    assert all(np.array_equal(back.weights[k], a) for k, a in fitted.weights.items())


def test_registered_search_is_the_whole_grid(spark):
    from gridcast.plans.registry import QUERIES

    history = QUERIES["train_history"](spark, "/root/testdata/sf0.001").toPandas()
    trials = {(t["model"], t["trial"]): t["epochs"] for kind in models.KINDS for t in tuning.trial_grid(spark, kind).collect()}
    assert len(trials) == 80 and (history.groupby(["model", "trial"]).epoch.nunique().to_dict()) == trials


def test_sarima_recovers_known_processes(spark):
    from gridcast.operators import sarima

    trend = np.arange(200) * 3.0 + 5
    assert np.allclose(sarima.forecast(trend, sarima.Order((1, 1, 0)), 4), trend[-1] + 3.0 * np.arange(1, 5))
    season = np.tile([1.0, 5.0, 2.0, 8.0], 60)
    assert np.allclose(sarima.forecast(season, sarima.Order((0, 0, 0), (0, 1, 0, 4)), 6), season[:6])
    assert np.allclose(sarima.forecast(season, sarima.Order((0, 0, 0), (1, 0, 0, 4)), 6), season[:6])
    rng = np.random.default_rng(2)
    e, x = rng.standard_normal(5000), np.zeros(5000)
    for t in range(1, 5000):
        x[t] = 0.7 * x[t - 1] + e[t] + 0.4 * e[t - 1]
    want = 0.7 * x[-1] + 0.4 * e[-1]
    assert abs(sarima.forecast(x, sarima.Order((1, 0, 1)), 1)[0] - want) < 0.1
    assert sarima.Order((1, 0, 1), (1, 0, 0, 24)).lags(0) == [1, 24, 25]
    assert sarima.forecast(np.array([4.0, 2.0]), sarima.Order((2, 0, 1)), 3).tolist() == [2.0] * 3
    df = spark.createDataFrame([(k, p, float(season[p] * k)) for k in (1, 2) for p in range(240)], "i long, pos long, y double")
    got = {(r["i"], r["step"]): r["yp"] for r in sarima.forecast_series(df, sarima.Order((0, 0, 0), (0, 1, 0, 4)), 2).collect()}
    assert np.isclose(got[2, 1], 10.0) and len(got) == 4


def test_sarima_fits_the_whole_series(spark):
    from gridcast.operators import sarima

    rng = np.random.default_rng(8)
    e, x = rng.standard_normal(50_000), np.zeros(50_000)
    for t in range(1, len(x)):  # a sharp change well before the last 20,000 positions
        x[t] = (0.9 if t < 30_000 else -0.5) * x[t - 1] + e[t]
    design = np.column_stack([np.ones(len(x) - 1), x[:-1]])
    c = np.linalg.lstsq(design, x[1:], rcond=None)[0]
    rows = pd.DataFrame({"i": 1, "pos": np.arange(len(x)), "y": x})
    got = sarima.forecast_series(spark.createDataFrame(rows), sarima.Order((1, 0, 0)), 1).collect()
    assert np.isclose(got[0]["yp"], c[0] + c[1] * x[-1])
    # a moving average, against designs in one piece
    long, z = 11, x
    design = np.column_stack([np.ones(len(z) - long), *(z[long - k : len(z) - k] for k in range(1, long + 1))])
    r = np.zeros(len(z))
    r[long:] = z[long:] - design @ np.linalg.lstsq(design, z[long:], rcond=None)[0]
    design = np.column_stack([np.ones(len(z) - long - 1), z[long:-1], r[long:-1]])
    c = np.linalg.lstsq(design, z[long + 1 :], rcond=None)[0]
    last = z[-1] - design[-1] @ c
    assert np.isclose(sarima.forecast(z, sarima.Order((1, 0, 1)), 1)[0], c @ [1.0, z[-1], last])


def test_report(spark):
    from gridcast.operators.forecasts import report

    text = report(spark.createDataFrame([("b", 0.5, None), ("a", 1 / 3, 2.0)], "model string, rmse double, nrmse double"))
    assert text.split() == ["model", "rmse", "nrmse", "a", "0.3333", "2.0000", "b", "0.5000", "-"]


@pytest.mark.parametrize("block", [10_000, 7])
def test_training_on_all_windows_against_numpy(spark, block):
    rng = np.random.default_rng(2)
    spec = models.Spec("gru", units=5, epochs=3, batch=4)
    data = [(k % 3, k, "train" if k < 120 else "val", rng.random(6).tolist(), rng.random(2).tolist()) for k in range(150)]
    df = spark.createDataFrame(data, "i long, win_idx long, split string, x array<double>, y array<double>").repartition(4)
    fitted = models.train_on(df, spec, block=block)
    blocks = -(-120 // block)
    number = {(r["i"], r["win_idx"]): r["b"] for r in df.selectExpr("i", "win_idx", f"pmod(xxhash64(i, win_idx), {blocks}) AS b").collect()}
    own = [[r for r in sorted(data) if r[2] == "train" and number[r[0], r[1]] == b] for b in range(blocks)]
    w = models.init(spec, 6, 2)
    state, t = (w, *({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))), 0
    for epoch in range(3):
        ends, steps = [], []
        for b, rows in enumerate(own):
            if rows:
                copy = tuple({k: a.copy() for k, a in part.items()} for part in state)
                steps.append(models._epoch(spec, copy, t, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.random.default_rng([spec.seed, epoch, b])))
                ends.append((len(rows), copy))
        state = tuple({k: sum(n * end[part][k] for n, end in ends) / 120 for k in w} for part in range(3))
        t = max(steps)
    for k in w:
        assert np.allclose(fitted.weights[k], state[0][k], atol=1e-12)
    x, y = (np.array([r[c] for r in data if r[2] == "val"]) for c in (3, 4))
    span = np.ptp([r[4] for r in data if r[2] == "train"])
    want = models.scores(y, models.forward(spec, state[0], x)[0], span)
    assert len(fitted.history) == 3 and all(abs(fitted.history[-1][f"val_{k}"] - v) < 1e-9 for k, v in want.items())


def test_retrain_takes_the_parameters_of_a_trial(spark):
    trial = tuning.trial_grid(spark, "rnn", 2).collect()[1]
    rows = [(0, k, "train", [0.1 * k] * 3, [0.2]) for k in range(20)]
    fitted = tuning.retrain(spark.createDataFrame(rows, "i long, win_idx long, split string, x array<double>, y array<double>"), trial.__class__(**(trial.asDict() | {"epochs": 2})))
    assert fitted.spec.kind == "rnn" and fitted.spec.units == trial["units"] and len(fitted.history) == 2
