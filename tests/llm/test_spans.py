import random

import numpy as np
import pytest

from tidemark.llm import spans as S

SCHEMA = "gid long, row_pos long, status_code long, time_us long, voltage_v double, current_ma double, capacity_mah double, a long, core string, h1 string"


def recs(groups):
    return [(g, i, s, s, 0.0 if s % 2 else -0.0, float(s) if s else None, 1.0, 1, "clash", "") for g, seq in groups.items() for i, s in enumerate(seq)]


def brute(groups, least):
    out = set()
    for a in groups:
        for b in groups:
            if a >= b:
                continue
            x, y = groups[a], groups[b]
            for i in range(len(x)):
                for j in range(len(y)):
                    if x[i] == y[j] and not (i and j and x[i - 1] == y[j - 1]):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= least:
                            out.add((a, i, b, j, n))
    return out


def found(rows, groups, least, extra=()):
    return sorted(map(tuple, S.shared_runs(rows(recs(groups) + list(extra), SCHEMA), least).collect()))


def planted(seed):
    r = random.Random(seed)
    groups = {g: [r.randint(0, 10**6) for _ in range(r.randint(0, 150))] for g in range(8)}
    for _ in range(10):
        a, b = r.sample(range(8), 2)
        if len(groups[a]) > 40:
            i = r.randint(0, len(groups[a]) - 40)
            k = r.randint(0, len(groups[b]))
            groups[b] = groups[b][:k] + groups[a][i : i + r.randint(6, 40)] + groups[b][k:]
    return groups


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_brute_force(rows, seed):
    g = planted(seed)
    assert found(rows, g, 8) == sorted(brute(g, 8))


def test_periodic_content_and_whole_copies(rows):
    g = {1: [1, 2, 3] * 15, 2: [1, 2, 3] * 12, 3: list(range(50)), 4: list(range(50)), 5: [7] * 20, 6: [7] * 18}
    assert found(rows, g, 8) == sorted(brute(g, 8))


def test_exact_length_gap_and_repeats(rows):
    base = list(range(100, 140))
    g = {1: base[:8], 2: base[:8], 3: base[:7]}
    data = recs(g)
    assert found(rows, g, 8, data[:5]) == [(1, 0, 2, 0, 8)]
    holed = [r for r in data if not (r[0] == 2 and r[1] == 4)]
    assert S.shared_runs(rows(holed, SCHEMA), 8).count() == 0


def test_blocks_do_not_matter(rows, monkeypatch):
    g = planted(5)
    whole = found(rows, g, 8)
    monkeypatch.setattr(S, "BLOCK", 16)
    assert found(rows, g, 8) == whole == sorted(brute(g, 8))


def test_full_sketch_loses_nothing(rows, monkeypatch):
    """With one counter for everything every window passes the first pass; the second still decides exactly."""
    g = planted(6)
    monkeypatch.setattr(S, "_cells", lambda h1, h2, row, width: np.zeros(len(h1), np.int64))
    assert found(rows, g, 8) == sorted(brute(g, 8))


def test_empty_and_null_keys(rows):
    assert found(rows, {}, 8) == []
    assert found(rows, {1: list(range(20))}, 8, [(None, 0, 1, 1, 1.0, 1.0, 1.0, 1, "", ""), (2, None, 1, 1, 1.0, 1.0, 1.0, 1, "", "")]) == []


@pytest.mark.parametrize("least", [1, 2, 5, 8, 31, 32])
def test_rolling_equals_sum(least):
    r = np.random.default_rng(least)
    t = r.integers(0, 2**63, 70).astype(np.uint64)
    m = int(S.MULTIPLIERS[0])
    want = [sum(int(t[i + j]) * pow(m, least - 1 - j, 2**64) for j in range(least)) % 2**64 for i in range(70 - least + 1)]
    assert S.rolling(t, least, S.MULTIPLIERS[0])[: len(want)].tolist() == want


def test_share(rows):
    base = list(range(60))
    g = {1: base, 2: base[10:30], 3: base[20:50] + [999], 4: [5]}
    df = rows(recs(g), SCHEMA)
    got = {r["gid"]: (r["n_rows"], r["n_shared"]) for r in S.shared_share(df, 8).collect()}
    assert got == {1: (60, 40), 2: (20, 20), 3: (31, 30), 4: (1, 0)}


def test_share_equals_runs_over_blocks(rows, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    r = random.Random(4)
    base = [r.randint(0, 10**6) for _ in range(90)]
    g = {1: base, 2: base[5:33] + [1, 2] + base[33:60], 3: [r.randint(0, 10**6) for _ in range(50)] + base[40:52], 4: base[80:]}
    df = rows(recs(g), SCHEMA)
    want = {k: set() for k in g}
    for x in S.shared_runs(df, 8).collect():
        want[x["gid_a"]] |= set(range(x["start_a"], x["start_a"] + x["n_rows"]))
        want[x["gid_b"]] |= set(range(x["start_b"], x["start_b"] + x["n_rows"]))
    got = {x["gid"]: x["n_shared"] for x in S.shared_share(df, 8).collect()}
    assert got == {k: len(v) for k, v in want.items()} and got[1] > 50
    assert S.shared_share(df.limit(0), 8).count() == 0
