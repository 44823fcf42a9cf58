import numpy as np
import pytest

from tidemark.operators import anomalies as A

SCHEMA = "tab int, unit string, member string, row_key long, ev long, t double, m0 double, m1 double, m2 double, block long, core string"


def series(v, tab=0, unit="u", start=0):
    return [(tab, unit, "m", start + i, i, float(i), x, None, None, 7, "clash") for i, x in enumerate(v)]


def flags(rows, data):
    return {(r["row_key"], r["kind"]) for r in A.faulty_readings(rows(data, SCHEMA)).collect()}


def noise(n, seed=0, scale=0.1):
    return np.round(10 + np.cumsum(np.full(n, 0.01)) + np.random.default_rng(seed).normal(0, scale, n), 4).tolist()


def test_spike_stuck_and_bounds(rows):
    v = noise(300)
    v[50] += 8.0
    v[100:103] = [x - 9.0 for x in v[100:103]]
    v[150:160] = [v[150]] * 10
    v[200], v[201], v[202] = 150.0, float("inf"), -30.0
    got = flags(rows, series(v))
    want = {(50, "spike")} | {(i, "spike") for i in range(100, 103)} | {(i, "stuck") for i in range(150, 160)} | {(i, "out_of_range") for i in (200, 201, 202)}
    assert got == want


def test_lasting_change_is_sound(rows):
    v = noise(200, 1)
    v = v[:100] + [x + 8 for x in v[100:]]
    assert flags(rows, series(v)) == set()


def test_opposite_spikes_and_run_of_seven(rows):
    v = noise(200, 2)
    v[80] += 9.0
    v[81] -= 9.0
    v[120:127] = [v[120]] * 7
    assert flags(rows, series(v)) == {(80, "spike"), (81, "spike")}


def test_nulls_are_no_readings_and_repeats_count_once(rows):
    v = noise(120, 3)
    v[60] += 7.0
    data = series([None if i % 10 == 5 else x for i, x in enumerate(v)])
    assert flags(rows, data + data[50:70]) == {(60, "spike")}


def test_long_series_equals_one_block(rows, monkeypatch):
    v = noise(3000, 4)
    for i in (511, 512, 1024, 2047):
        v[i] += 9.0
    v[1530:1545] = [v[1530]] * 15
    whole = flags(rows, series(v))
    monkeypatch.setattr(A, "BLOCK", 512)
    monkeypatch.setattr(A, "MARGIN", 64)
    assert flags(rows, series(v)) == whole
    assert len(whole) == 19


def test_scatter_is_the_unit_s_in_every_block(rows, monkeypatch):
    r = np.random.default_rng(7)
    v = np.r_[r.normal(10, 0.1, 2048), r.normal(10, 0.001, 512), r.normal(10, 0.1, 512), r.normal(10, 1.0, 512)]
    v[2300] += 0.5  # ordinary by the unit's scatter, not by its stretch's
    v[3400] = v[[3399, 3401]].max() + 1.6  # a spike by the unit's scatter, not by its stretch's
    v[3399] = v[3401]
    v[1020:1030] = v[1020]
    whole = flags(rows, series(v.tolist()))
    monkeypatch.setattr(A, "BLOCK", 512)
    monkeypatch.setattr(A, "MARGIN", 64)
    assert flags(rows, series(v.tolist())) == whole
    assert (3400, "spike") in whole and not any(2048 <= i < 2560 for i, _ in whole)


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_scatters_equal_whole_series(rows, monkeypatch, digits):
    monkeypatch.setattr(A, "BLOCK", 64)
    monkeypatch.setattr(A, "MARGIN", 32)
    told = []
    keep = A.scatters
    monkeypatch.setattr(A, "scatters", lambda steps: told.append(keep(steps)) or told[-1])
    r = np.random.default_rng(8)
    v = np.round(r.normal(10, 0.3, 701), digits)
    v[100:130], v[300], v[400:520] = v[100], 5000.0, v[400]
    w = np.full(200, 3.0) + np.where(np.arange(200) % 50 == 7, 0.5, 0.0)
    flags(rows, series(v.tolist()) + series(w.tolist(), unit="w", start=2000))
    got = {x["unit"]: x["s"] for x in told[0].collect()}
    want = {k: A.scatter(x[A.calm_readings(x, *A.BOUNDS["capacity_loss_pct"])]) for k, x in (("u", v), ("w", w))}
    assert {k: np.nan if x is None else x for k, x in got.items()} == pytest.approx({k: x for k, x in want.items() if k in got}, nan_ok=True)
    assert all(np.isnan(want[k]) for k in want.keys() - got.keys())


def test_empty_short_and_null_series(rows):
    assert flags(rows, []) == set()
    assert flags(rows, series([None, None])) == set()
    assert flags(rows, series([5.0])) == set()
    assert flags(rows, series([5.0, 500.0])) == {(1, "out_of_range")}


def test_posteriors_equal_enumeration_of_paths(monkeypatch):
    monkeypatch.setattr(A, "SEGMENT", [(1, 1)])
    monkeypatch.setattr(A, "FIRST_STUCK", 2)
    monkeypatch.setattr(A, "STATES", 4)
    monkeypatch.setattr(A, "STUCK_RUN", 2)
    monkeypatch.setattr(A, "MOVES", A._moves())
    monkeypatch.setattr(A, "ENDS", np.array([1.0, 1.0, 0.0, 1.0]))
    rng = np.random.default_rng(0)
    series_ = [(rng.random((n, 4)) + 0.01, np.arange(n) == hard) for n, hard in ((4, 2), (1, -1), (3, -1), (5, 0))]
    for (e, hard), got in zip(series_, A.posteriors(series_), strict=True):
        used = e[~hard]
        n = len(used)
        total = np.zeros((n, 4))
        for code in range(4**n):
            path = [(code // 4**k) % 4 for k in range(n)]
            p = A.MOVES[0, path[0]] * used[0, path[0]] * A.ENDS[path[-1]]
            for k in range(1, n):
                p *= A.MOVES[path[k - 1], path[k]] * used[k, path[k]]
            for k in range(n):
                total[k, path[k]] += p
        total /= total.sum(axis=1, keepdims=True)
        assert got[~hard] == pytest.approx(np.c_[total[:, 0], total[:, 1], total[:, 2] + total[:, 3], np.zeros(n)])
        assert got[hard].tolist() == [[0, 0, 0, 1]] * int(hard.sum())


def test_the_model_decides(rows, monkeypatch):
    """With another price of spikes or another steepness other readings are flagged: no rule stands behind the posterior."""
    v = noise(200, 9)
    s = A.scatter(np.array(v))
    v[60] = max(v[59], v[61]) + 9.0 * s
    v[59] = v[61]
    assert flags(rows, series(v)) == set()
    monkeypatch.setattr(A, "SPIKE_SCATTERS", 8.0)
    _, hard = A.emissions(np.array(v), -20, 100)
    assert A.posteriors([A.emissions(np.array(v), -20, 100)])[0][60, A.SPIKE] > 0.99 and not hard.any()


def test_sparse_measure_in_blocks_by_rank(rows, monkeypatch):
    """A measure read at every hundredth event, with a stuck run across the edge of a block."""
    monkeypatch.setattr(A, "BLOCK", 64)
    monkeypatch.setattr(A, "MARGIN", 16)
    v = noise(300, 10)
    v[60:68] = [v[60]] * 8
    v[128] += 9.0
    data = [(0, "u", "m", i, 100 * i, float(i), x, None, None, 7, "clash") for i, x in enumerate(v)]
    more = [(0, "u", "m", 10_000 + i, i, float(i), None, 1.0 + i // 7 % 5, None, 7, "clash") for i in range(0, 3000, 7)]
    assert flags(rows, data + more + data[50:70]) == {(i, "stuck") for i in range(60, 68)} | {(128, "spike")}


def test_numbers_run_over_ranges_of_a_series(rows, spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    data = series(noise(500, 11)) + series(noise(40, 12), unit="w", start=1000)
    got = {(r["unit"], r["row_key"]): r["rank"] for r in A.ranked(rows(data + data[100:200], SCHEMA)).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {("u", i): i for i in range(500)} | {("w", 1000 + i): i for i in range(40)}


def test_very_unlike_units_keep_their_own_scale(rows):
    a, b = noise(150, 5, 0.01), noise(150, 6, 2.0)
    a[70] += 1.0
    b[70] += 1.0
    got = flags(rows, series(a, unit="fine") + series(b, unit="rough", start=1000))
    assert got == {(70, "spike")}
