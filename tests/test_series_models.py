"""Hand values and independent versions of the trajectory, model and scoring operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as M
from tidemark.operators import scoring as C
from tidemark.operators import series as S

SERIES = "unit long, event_index long, value double"


def walk(n, seed, unit=1):
    v = 50 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n))
    return [(unit, i, float(x)) for i, x in enumerate(v)], v


def points(df):
    return {(r["origin"], r["horizon"]): r["point"] for r in df.collect()}


def test_mase_is_strict(rows):
    scored = rows([("m", 1, u, p, a) for u, p, a in (("a", 1.0, 3.0), ("a", 2.0, 6.0), ("b", 1.0, 2.0), ("c", None, 1.0), ("d", 1.0, 2.0))], "model string, horizon int, unit string, point double, actual double")
    m = C.with_mase(C.unit_metrics(scored), rows([("a", 1.5), ("b", 0.0), ("c", 1.0)], "unit string, scale double"))
    assert {r["unit"]: r["mase"] for r in m.collect()} == {"a": 2.0, "b": None, "c": None, "d": None}
    assert C.macro(m, ["mase"]).collect()[0]["macro_mase"] is None
    assert C.macro(m.filter("unit = 'a'"), ["mase"]).collect()[0]["macro_mase"] == 2.0


def test_window_models_equal_polyfit(rows):
    data, v = walk(20, 0)
    s = rows(data, SERIES)
    lin = points(M.predictions(s, "m", M.local_linear(3), 4, [1, 2]))
    exp = points(M.predictions(s, "m", M.exponential(4), 4, [1, 2]))
    drift = points(M.predictions(s, "m", M.global_drift(), 4, [1, 2]))
    assert set(lin) == {(o, h) for o in range(3, 20) for h in (1, 2) if o + h < 20}
    for o, h in lin:
        b, a = np.polyfit(range(3), v[o - 2 : o + 1], 1)
        assert lin[o, h] == pytest.approx(a + b * (2 + h))
        b, a = np.polyfit(range(4), np.log(v[o - 3 : o + 1]), 1)
        assert exp[o, h] == pytest.approx(math.exp(a + b * (3 + h)))
        assert drift[o, h] == pytest.approx(v[o] + h * (v[o] - v[0]) / o)


def test_future_suffix_changes_nothing(rows):
    data, v = walk(30, 1)
    other = data[:20] + [(1, i, 1e6) for i in range(20, 30)]
    for model in (M.last_value, M.global_drift, lambda: M.local_linear(4), lambda: M.exponential("all")):
        a, b = (points(M.predictions(rows(d, SERIES), "m", model(), 4, [1])) for d in (data, other))
        assert all(a[k] == b[k] for k in a if k[0] < 19)
    for f in (M.rls_predictions, lambda s, h, c: M.particle_predictions(s, h, c)):
        a, b = (points(f(rows(d, SERIES), [1], 4)) for d in (data, other))
        assert all(a[k] == b[k] for k in a if k[0] < 19)


def test_exponential_needs_positive_values(rows):
    data = [(1, i, x) for i, x in enumerate([1.0, 2.0, 0.0, 3.0, 4.0, 5.0, 6.0, 7.0])]
    got = points(M.predictions(rows(data, SERIES), "m", M.exponential(4), 4, [1]))
    assert [k for k in got if got[k] is None] == [(3, 1), (4, 1), (5, 1)]


def test_kalman_equals_matrix_form():
    _, v = walk(15, 2)
    machine = M.Kalman(0.7, 1e-2, 1e-4, 1.0)
    got = []
    for y in v:
        machine.feed(y)
        got.append(machine.points([1, 3]))
    f, h = np.array([[1, 1], [0, 1.0]]), np.array([1.0, 0])
    x, p = np.array([v[0], v[1] - v[0]]), 10 * 0.49 * np.eye(2)
    for i in range(1, 15):
        x, p = f @ x, f @ p @ f.T + 0.49 * np.diag([1e-2, 1e-4])
        k = p @ h / (h @ p @ h + 0.49)
        x = x + k * (v[i] - h @ x)
        p = p - np.outer(k, h @ p)
        assert got[i] == pytest.approx([x[0] + x[1], x[0] + 3 * x[1]])


def test_ridge_equals_direct_fit(rows):
    units = [walk(14, s, s)[0] for s in range(30)]
    s = rows([r for u in units for r in u], SERIES)
    fold = {r["unit"]: r["f"] for r in s.select("unit", M.fold_of("unit", 4).alias("f")).distinct().collect()}
    got = {(r["unit"], r["origin"]): r["point"] for r in M.ridge_predictions(s, window=3, alpha=1.0, horizon=1, context=4, folds=4).collect()}
    for f in set(fold.values()):
        x, y, w = [], [], []
        for u in range(30):
            if fold[u] == f:
                continue
            v = np.array([r[2] for r in units[u]])
            o = range(3, 13)
            for i in o:
                x.append([v[i], i, v[i - 1] - v[i - 2], v[i] - v[i - 1]])
                y.append(v[i + 1] - v[i])
                w.append(1 / len(o))
        x, y, w = np.array(x), np.array(y), np.array(w)
        mu = np.average(x, axis=0, weights=w)
        sd = np.sqrt(np.average((x - mu) ** 2, axis=0, weights=w))
        z, ym = (x - mu) / sd, np.average(y, weights=w)
        beta = np.linalg.solve(z.T @ (w[:, None] * z) + np.eye(4), z.T @ (w * (y - ym)))
        for u in range(30):
            if fold[u] == f:
                v = np.array([r[2] for r in units[u]])
                for i in range(3, 13):
                    q = (np.array([v[i], i, v[i - 1] - v[i - 2], v[i] - v[i - 1]]) - mu) / sd
                    assert got[u, i] == pytest.approx(v[i] + ym + q @ beta)


def test_systematic_resampling_counts():
    w = np.array([0.5, 0.25, 0.25, 0.0])
    assert np.bincount(M.systematic(w, 0.5), minlength=4).tolist() == [2, 1, 1, 0]


def test_strict_missing_values(rows):
    scored = rows([("m", 1, 1, 1.0, 2.0), ("m", 1, 1, None, 2.0), ("m", 1, 2, 1.0, 4.0), ("m", 1, 2, 3.0, 4.0)], "model string, horizon int, unit long, point double, actual double")
    u = {r["unit"]: r for r in C.unit_metrics(scored).collect()}
    assert u[1]["mae"] is None and u[1]["metric_status"] == "NA_planned_failure" and u[1]["failed_count"] == 1
    assert u[2]["mae"] == 2.0 and u[2]["rmse"] == pytest.approx(math.sqrt(5))
    m = C.macro(C.unit_metrics(scored), ["mae"]).collect()[0]
    assert m["macro_mae"] is None and m["failed_count"] == 1 and m["planned_count"] == 4


def test_skill_statuses(rows):
    m = rows([("last_value", 1, 1, 2.0), ("x", 1, 1, 1.0), ("last_value", 1, 2, 0.0), ("x", 1, 2, 1.0), ("x", 1, 3, None)], "model string, horizon int, unit long, mae double")
    got = {(r["model"], r["unit"]): (r["skill"], r["comparison_status"]) for r in C.with_skill(m).collect()}
    assert got["x", 1] == (0.5, "OK") and got["x", 2][1] == "NA_zero_baseline" and got["x", 3][1] == "NA_failed"


def test_first_config_within_tolerance_wins(rows):
    e = rows([("g", "a", 1, 1.0), ("g", "b", 2, 1.0 - 1e-16), ("g", "c", 3, 0.5), ("g", "d", 4, 0.5), ("g", "e", 5, None)], "grp string, config string, config_order long, score double")
    assert [(r["config"], r["score"]) for r in C.select_config(e).collect()] == [("c", 0.5)]


def test_interval_labels(rows):
    df = rows([("u", i, float(i), x) for i, x in enumerate([0.0, 5.0, None, 21.0, 3.0])] + [("v", 0, 0.5, 1.0)], "unit string, event_index long, time_h double, c double")
    got = {r["unit"]: r for r in S.interval_labels(df, {"e": ("c", 20.0)}).collect()}
    assert (got["u"]["lower_time_h"], got["u"]["upper_time_h"], got["u"]["first_crossing_index"]) == (2.0, 3.0, 3)
    assert got["v"]["status"] == "right_censored" and got["v"]["censor_time_h"] == 0.5


def test_budget_fails_and_never_cuts(rows):
    df = rows([(i,) for i in range(5)], "a long")
    assert C.budget(df, 5).count() == 5
    with pytest.raises(ValueError):
        C.budget(df, 4)


def test_ratios_do_not_spread_non_finite(rows):
    df = rows([(10.0, float("nan")), (None, 50.0), (20.0, 100.0)], "capacity_loss_pct double, esr_increase_pct double")
    got = S.derived_ratios(df).select(F.round("capacity_ratio", 6), F.round("soh_esr_inverse", 6), F.round("composite_health_margin", 6)).collect()
    assert [tuple(r) for r in got] == [(0.9, None, None), (None, round(1 / 1.5, 6), None), (0.8, 0.5, 0.0)]
