import numpy as np
import pytest

from tidemark.operators import actions as A
from tidemark.operators import candidates as C

SERIES = "unit long, event_index long, value double"


def walk(n, seed, unit):
    v = 50 + 0.5 * np.arange(n) + np.cumsum(np.random.default_rng(seed).normal(0, 0.2, n))
    return [(unit, i, float(x)) for i, x in enumerate(v)], v


def test_prefix_features(rows):
    data, v = walk(12, 0, 1)
    got = {r["origin"]: r for r in C.prefix_features(rows(data, SERIES), 2).collect()}
    assert sorted(got) == list(range(4, 10))
    for o, r in got.items():
        p = v[: o + 1]
        assert r["global_slope"] == pytest.approx(np.polyfit(range(o + 1), p, 1)[0])
        assert r["local_slope"] == pytest.approx(np.polyfit(range(5), p[-5:], 1)[0])
        assert r["curvature"] == pytest.approx(p[-1] - 2 * p[-2] + p[-3])
        assert (r["local_min"], r["local_max"], r["n_seen"], r["actual"]) == (pytest.approx(p[-5:].min()), pytest.approx(p[-5:].max()), o + 1, pytest.approx(v[o + 2]))


@pytest.mark.parametrize("kind", ["elastic_net", "boosted"])
def test_direct_models_beat_last_value_on_a_trend(rows, kind):
    data = [r for u in range(12) for r in walk(25, u, u)[0]]
    got = C.direct_predictions(rows(data, SERIES), kind, folds=2, iterations=10).collect()
    assert len(got) == 12 * 20
    err = np.mean([abs(r["point"] - r["actual"]) for r in got])
    last = {(u, i): v for u, i, v in data}
    assert err < np.mean([abs(last[r["unit"], r["origin"]] - r["actual"]) for r in got])


@pytest.mark.parametrize("kind", ["theta", "holt"])
def test_smoothing_sees_only_the_prefix(rows, kind):
    data, _ = walk(30, 3, 1)
    other = data[:20] + [(1, i, -1e5) for i in range(20, 30)]
    a, b = ({(r["origin"], r["horizon"]): r["point"] for r in C.smoothing_predictions(rows(d, SERIES), kind, [1, 2], 4).collect()} for d in (data, other))
    assert a and all(a[k] == b[k] for k in a if k[0] < 20 and k in b)


def test_theta_of_a_line_follows_half_its_slope():
    machine = C.Theta()
    for y in np.arange(40.0):
        machine.feed(y)
    a, b = machine.points([1, 2])
    assert b - a == pytest.approx(0.5)


def test_permissions(spark):
    space = A.action_space(A.base_actions(spark, list("abcdef"), [f"w{i}" for i in range(5)]))
    n = {r["arm"]: r["count"] for r in C.permitted_actions(space).groupBy("arm").count().collect()}
    assert n == {"H1": 6, "RF1": 5, "RC1": 8, "ACT1": 19, "IF1": 19, "ACT_COMP96": 96}


def test_late_and_second_results_never_replace(rows):
    att = rows([("a", "1", 1, 5, 9, True, "A"), ("a", "2", 2, 3, 9, True, "late try"), ("b", "1", 1, 10, 9, True, "B"), ("c", "1", 1, None, 9, None, None), ("d", "1", 1, 2, 9, False, "D")], "slot string, attempt string, started_at long, finished_at long, deadline long, valid boolean, value string")
    fb = rows([(s, "F") for s in "abcde"], "slot string, fallback_value string")
    got = {r["slot"]: (r["reason"], r["value"]) for r in C.committed(att, fb).collect()}
    assert got == {"a": ("VERIFIED_RESPONSE", "A"), "b": ("LATE_RESPONSE", "F"), "c": ("PROVIDER_FAILURE", "F"), "d": ("INVALID_RESPONSE", "F"), "e": ("NOT_STARTED", "F")}
