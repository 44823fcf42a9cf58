import random

import pytest

from tidemark.operators import asof

CH = "entity string, place double, known double, change_id long, block string"
EV = "rid string, entity string, bound double, at double, salt string"


def brute(changes, events):
    out = {}
    for rid, e, bound, at, _ in events:
        if e is None or bound is None or at is None:
            continue
        ok = [(p, k, c) for q, p, k, c, _ in changes if q == e and p is not None and k is not None and k == k and p <= bound and k <= at]
        if ok:
            out[rid] = max(ok)[2]
    return out


@pytest.mark.parametrize(("width", "seed"), [(1.0, 1), (4.0, 2), (1000.0, 3)])
def test_equals_brute_force(rows, width, seed):
    """Narrow blocks force every level; changes known late, ties, repeats and nulls are in."""
    r = random.Random(seed)
    n = lambda lo, hi: r.choice([None, float("nan")]) if r.random() < 0.03 else float(r.randint(lo, hi))
    changes = [(r.choice(["a", "b", None]), n(0, 900), n(0, 60), i, "x") for i in range(150)]
    changes += changes[:20]
    events = [(str(i), r.choice(["a", "b", "c", None]), n(0, 950), n(0, 70), "x") for i in range(300)]
    clean = [c for c in changes if c[1] is not None and c[1] == c[1]]
    clean_e = [e for e in events if None not in e[:4] and e[2] == e[2] and e[3] == e[3]]
    got = {x["rid"]: x["change_id"] for x in asof.known_at(rows(changes, CH), rows(events, EV), width).collect()}
    assert got == brute(clean, clean_e)


def test_hot_block_is_salted(rows, monkeypatch):
    monkeypatch.setattr(asof, "HOT_EVENTS", 10)
    changes = [("a", float(i), float(i), i, "") for i in range(20)]
    events = [(str(i), "a", float(i % 20), 30.0, "") for i in range(100)]
    got = {x["rid"]: x["change_id"] for x in asof.known_at(rows(changes, CH), rows(events, EV), 1000.0).collect()}
    assert got == {str(i): i % 20 for i in range(100)}


def test_ties_go_to_place_then_time_then_id(rows):
    changes = [("a", 1.0, 5.0, 1, ""), ("a", 1.0, 6.0, 2, ""), ("a", 1.0, 6.0, 3, ""), ("a", 2.0, 9.0, 4, "")]
    events = [("x", "a", 2.0, 5.0, ""), ("y", "a", 2.0, 8.0, ""), ("z", "a", 2.0, 9.0, ""), ("w", "a", 0.5, 9.0, "")]
    got = {x["rid"]: x["change_id"] for x in asof.known_at(rows(changes, CH), rows(events, EV), 10.0).collect()}
    assert got == {"x": 1, "y": 3, "z": 4}


def test_empty(rows):
    assert asof.known_at(rows([], CH), rows([("x", "a", 1.0, 1.0, "")], EV), 1.0).count() == 0
    assert asof.known_at(rows([("a", 1.0, 1.0, 1, "")], CH), rows([], EV), 1.0).count() == 0
