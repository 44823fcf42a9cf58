import random
from collections import Counter

import pytest

from tidemark.llm import components as C

MARKS = "unit string, mark string, salt string, n long"


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(rows, seed):
    r = random.Random(seed)
    edges = [(f"u{r.randint(0, 80):03d}", f"u{r.randint(0, 80):03d}") for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {x["unit"]: x["group_key"] for x in C.components(rows(edges + edges[:5], "u string, v string")).collect()}
    assert got == union_find(edges)


def test_long_chain_needs_few_rounds(rows, monkeypatch):
    order = list(range(300))
    random.Random(2).shuffle(order)
    edges = [(f"u{a:03d}", f"u{b:03d}") for a, b in zip(order, order[1:])]
    monkeypatch.setattr(C, "MAX_ROUNDS", 14)
    got = C.components(rows(edges, "u string, v string")).collect()
    assert len(got) == 300 and {x["group_key"] for x in got} == {"u000"}


def test_marks_with_a_hot_mark_nulls_and_repeats(rows):
    marks = [(f"u{i:03d}", "hot", "x", 1) for i in range(90)] + [("a", "m1", "x", 1), ("b", "m1", "x", 1), ("b", "m2", "x", 1), ("c", "m2", "x", 1), ("d", None, "x", 1), (None, "m1", "x", 1), ("e", "m9", "x", 1)]
    got = {x["unit"]: x["group_key"] for x in C.components(C.links(rows(marks + marks[:9], MARKS))).collect()}
    assert got == {f"u{i:03d}": "u000" for i in range(90)} | dict.fromkeys("abc", "a")


def test_empty(rows):
    assert C.components(C.links(rows([], MARKS))).count() == 0


def test_subset_is_closest():
    r = random.Random(3)
    for _ in range(150):
        sizes = {r.randint(1, 30): r.randint(1, 5) for _ in range(r.randint(1, 6))}
        target = r.randint(0, sum(s * n for s, n in sizes.items()))
        took = C.subset(sizes, target)
        sums = {0}
        for s, n in sizes.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        assert all(0 <= took[s] <= sizes[s] for s in sizes)
        assert abs(sum(s * n for s, n in took.items()) - target) == min(abs(x - target) for x in sums)


def test_pool_keeps_large_corpora_bounded(monkeypatch):
    monkeypatch.setattr(C, "POOL_BITS", 2000)
    sizes = {1: 50_000, 3: 20_000, 700: 3}
    q = C.quotas(sizes)
    total = sum(s * n for s, n in sizes.items())
    for name in ("validation", "test"):
        assert abs(sum(s * n for s, n in q[name].items()) / total - 0.15) < 1e-3
    assert all(q["validation"][s] + q["test"][s] <= sizes[s] for s in sizes)


def test_one_component_holds_a_third_of_all_rows():
    sizes = {10_000_000: 1, 3: 6_666_667}
    total = sum(s * n for s, n in sizes.items())
    for took in C.quotas(sizes).values():
        assert abs(sum(s * n for s, n in took.items()) - 0.15 * total) <= 1.5


@pytest.mark.parametrize("bits", [1, 16, 64])
def test_pooled_choice_is_closest(monkeypatch, bits):
    monkeypatch.setattr(C, "POOL_BITS", bits)
    r = random.Random(5)
    for _ in range(300):
        top = r.choice([6, 30])
        sizes = {r.randint(1, top) * r.choice([1, 2, 6]): r.randint(1, 40) for _ in range(r.randint(1, 6))} | ({r.randint(200, 900): 1} if r.random() < 0.5 else {})
        target = r.randint(0, sum(s * n for s, n in sizes.items()))
        took = C.closest(sizes, target)
        reach = 1
        for s, n in sizes.items():
            for _ in range(n):
                reach |= reach << s
        best = min(abs(x - target) for x in range(reach.bit_length()) if reach >> x & 1)
        assert all(0 <= took[s] <= sizes[s] for s in sizes)
        assert abs(sum(s * n for s, n in took.items()) - target) == best


def test_groups_share_a_split_and_shares_are_met(rows):
    r = random.Random(4)
    units = [(f"u{i:04d}", r.randint(1, 5)) for i in range(400)] + [("big", 300), ("zero", None), (None, 7)]
    edges = [(f"u{i:04d}", f"u{i + 1:04d}") for i in range(0, 200, 3)]
    groups = C.components(rows(edges, "u string, v string"))
    got = C.split_units(rows(units, "unit string, n long"), groups).collect()
    assert len(got) == 402 and len({x["unit"] for x in got}) == 402
    by_group = {}
    for x in got:
        by_group.setdefault(x["group_key"], set()).add(x["split"])
    assert all(len(s) == 1 for s in by_group.values())
    total = sum(x["n"] for x in got)
    rows_of = Counter()
    for x in got:
        rows_of[x["split"]] += x["n"]
    assert abs(rows_of["validation"] - 0.15 * total) <= 1 and abs(rows_of["test"] - 0.15 * total) <= 1
    assert {x["unit"]: x["split"] for x in C.split_units(rows(units[::-1], "unit string, n long"), groups).collect()} == {x["unit"]: x["split"] for x in got}


def test_split_of_nothing(rows):
    assert C.split_units(rows([], "unit string, n long"), rows([], "unit string, group_key string")).count() == 0


def test_bitsets_stay_small_beside_giant_components():
    import tracemalloc

    for sizes in ({3: 10**6, 2 * 10**9: 1}, {3: 10**9, 3 * 10**9: 2}, {k: 1 for k in range(1, 2500)}):
        tracemalloc.start()
        given = C.quotas(sizes)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200_000_000
        total = sum(s * n for s, n in sizes.items())
        fits = [s for s in sizes if s <= 0.15 * total]
        for name in ("validation", "test"):
            assert abs(sum(s * n for s, n in given[name].items()) - round(0.15 * total)) <= max(fits) or sum(s * sizes[s] for s in fits) < 0.15 * total
