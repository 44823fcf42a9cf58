import numpy as np
import pytest

from tidemark.operators import regrid as R

SCHEMA = "tab int, unit string, member string, row_key long, ev long, t double, m0 double, m1 double, m2 double, cadence double, slot string"


def grid(rows, data, plans=(("m", 2.0),)):
    got = R.onto_grid(rows(data, SCHEMA), rows(list(plans), "member string, cadence double"))
    return sorted(map(tuple, got.collect()))


def reading(key, t, v, unit="u", member="m", tab=0):
    return (tab, unit, member, key, key, t, v, None, None, 9.0, "clash")


def test_slots_and_missing_flags(rows):
    data = [reading(1, 0.2, 1.0), reading(2, 2.9, 2.0), reading(3, 8.1, float("inf")), reading(4, 12.0, None), reading(5, None, 5.0), reading(2, 2.9, 2.0)]
    got = [(g[3], g[6]) for g in grid(rows, data) if g[2] == 0]
    assert got == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0)]


def test_negative_times_and_halves(rows):
    got = [(g[3], g[6]) for g in grid(rows, [reading(1, -3.0, 1.0), reading(2, 1.0, 1.0)]) if g[2] == 0]
    assert got == [(-1, 1), (0, 0), (1, 1)]


def test_fill_follows_a_line_with_growing_doubt(rows):
    rng = np.random.default_rng(0)
    data = [reading(i, 2.0 * i, float(5 + 0.3 * i + rng.normal(0, 0.02))) for i in range(60) if not 25 <= i < 35]
    got = {g[3]: g for g in grid(rows, data) if g[2] == 0}
    assert [s for s in got if got[s][6] == 0] == list(range(25, 35))
    assert all(abs(got[s][4] - (5 + 0.3 * s)) < 0.2 for s in got)
    assert got[30][5] > got[10][5] > 0


def check_blocks(rows, monkeypatch, data, block=128):
    whole = grid(rows, data)
    monkeypatch.setattr(R, "BLOCK", block)
    parts = grid(rows, data)
    assert [(g[2], g[3], g[6]) for g in whole] == [(g[2], g[3], g[6]) for g in parts]
    a, b = (np.array([g[4:6] for g in x if g[2] == 0], float) for x in (whole, parts))
    assert np.isfinite(a).all() and b == pytest.approx(a, rel=1e-6, abs=1e-6)


def test_blocks_agree_with_whole(rows, monkeypatch):
    rng = np.random.default_rng(1)
    check_blocks(rows, monkeypatch, [reading(i, 2.0 * i + rng.uniform(-0.9, 0.9), float(rng.normal())) for i in range(700) if i % 9])


def test_blocks_agree_over_a_long_gap(rows, monkeypatch):
    """Whole blocks without any reading, and an outlier at the edge of one."""
    rng = np.random.default_rng(2)
    at = [i for i in range(1601) if i <= 100 or i >= 1500]
    data = [reading(i, 2.0 * i, float(0.01 * i + rng.normal(0, 0.01) + (5 if i in (64, 1500) else 0))) for i in at]
    check_blocks(rows, monkeypatch, data, 64)


def test_blocks_agree_on_dense_readings(rows, monkeypatch):
    rng = np.random.default_rng(3)
    data = [reading(i, 0.1 * i + rng.uniform(0, 0.05), float(np.sin(i / 90) + rng.normal(0, 0.05))) for i in range(1500)]
    check_blocks(rows, monkeypatch, data, 16)


def test_blocks_begin_before_the_first_reading(rows, monkeypatch):
    data = [reading(i, 2.0 * i, None if i < 150 else float(i % 3)) for i in range(300)]
    check_blocks(rows, monkeypatch, data, 64)


def test_units_without_plan_and_empty(rows):
    assert grid(rows, []) == []
    assert grid(rows, [reading(1, 1.0, 1.0, member="other")]) == []
    assert grid(rows, [reading(1, 1.0, 1.0, member=None)]) == []


def test_smoother_equals_dense_gaussian():
    """Level posterior of a tiny series against the joint Gaussian solved at once."""
    t = np.array([0.0, 1.0, 2.5, 3.0])
    y = np.array([1.0, np.nan, 2.0, 1.5])
    r, q = 0.5, 0.2
    n = len(t)
    p11 = 0.3
    level, var = R.smooth(t[:, None], y[:, None], np.full((n, 1), r), np.array([r]), np.array([q]), np.array([[1.0, 0.0, 100 * r + 1e-12, 0.0, p11]]).T, np.zeros((5, 1)))
    cov = np.zeros((2 * n, 2 * n))
    mean = np.zeros(2 * n)
    mean[0] = 1.0
    cov[:2, :2] = np.diag([100 * r + 1e-12, p11])
    for k in range(1, n):
        dt = t[k] - t[k - 1]
        f = np.array([[1, dt], [0, 1]])
        a, b = slice(2 * k - 2, 2 * k), slice(2 * k, 2 * k + 2)
        mean[b] = f @ mean[a]
        cov[b, : 2 * k] = f @ cov[a, : 2 * k]
        cov[: 2 * k, b] = cov[b, : 2 * k].T
        cov[b, b] = f @ cov[a, a] @ f.T + np.array([[q * dt**3 / 3 + 1e-6 * r * dt, q * dt**2 / 2], [q * dt**2 / 2, q * dt]])
    seen = [0, 4, 6]
    gain = cov[:, seen] @ np.linalg.inv(cov[np.ix_(seen, seen)] + r * np.eye(3))
    post = mean + gain @ (y[[0, 2, 3]] - mean[seen])
    left = cov - gain @ cov[seen]
    assert level[:, 0] == pytest.approx(post[::2], rel=1e-6)
    assert var[:, 0] == pytest.approx(np.diag(left)[::2], rel=1e-6)
