from tidemark.operators import orphans as O

REFS = "table_name string, row_id long, ref_key string, seq long, period string"
RECS = "ref_key string, born long, gone long, born_again string"


def found(groups):
    return sorted((r["table_name"], i) for r in groups.collect() for i in r["row_ids"])


def test_intervals_merge_and_nulls_never_stand(rows):
    recs = rows([("a", 1, 5, ""), ("a", 3, 8, ""), ("a", 10, None, ""), ("b", None, None, ""), (None, 1, 2, ""), ("c", 4, 4, ""), ("a", 1, 5, "")], RECS)
    got = sorted(map(tuple, O.standing_intervals(recs).collect()))
    assert got == [("a", 1, 8), ("a", 10, O.FOREVER)]


def test_edges_of_standing(rows):
    recs = rows([("a", 5, 9, "")], RECS)
    refs = rows([("t", i, "a", s, "2025-01") for i, s in enumerate([4, 5, 8, 9, None])], REFS)
    got = found(O.orphan_groups(O.reference_groups(refs), O.standing_intervals(recs)))
    assert got == [("t", 0), ("t", 3), ("t", 4)]


def test_heavy_key_repeats_and_nulls_equal_brute_force(rows):
    """A third of all rows names one key; result equals the definition row by row."""
    import random

    r = random.Random(1)
    recs = [(f"k{i}", r.randint(0, 50), r.choice([None, r.randint(20, 99)]), "x") for i in range(60)] + [("hot", b, b + 3, "x") for b in range(0, 60, 7)]
    refs = [("t", i, "hot" if i % 3 == 0 else r.choice([f"k{r.randint(0, 80)}", None]), r.choice([None, *range(80)]), r.choice(["2025-01", None])) for i in range(900)]
    refs += refs[:40]
    want = sorted({(t, i) for t, i, k, s, _ in refs if k is not None and not any(k == q and s is not None and b <= s and (g is None or s < g) for q, b, g, _ in recs)})
    groups = O.reference_groups(rows(refs, REFS))
    assert found(O.orphan_groups(groups, O.standing_intervals(rows(recs, RECS)))) == want


def test_salted_branch_gives_the_same(rows, monkeypatch):
    recs = rows([("hot", b, b + 2, "") for b in range(0, 40, 5)] + [("k", 0, None, "")], RECS)
    refs = rows([("t", i, "hot", i % 41, "p") for i in range(300)] + [("t", 1000, "k", 3, "p")], REFS)
    plain = found(O.orphan_groups(O.reference_groups(refs), O.standing_intervals(recs)))
    monkeypatch.setattr(O, "HEAVY_INTERVALS", 2)
    assert found(O.orphan_groups(O.reference_groups(refs), O.standing_intervals(recs))) == plain
    assert ("t", 2) in plain and ("t", 0) not in plain


def test_empty_tables(rows):
    none = rows([], REFS)
    assert O.orphan_groups(O.reference_groups(none), O.standing_intervals(rows([], RECS))).count() == 0
    refs = rows([("t", 1, "a", 1, "p")], REFS)
    assert found(O.orphan_groups(O.reference_groups(refs), O.standing_intervals(rows([], RECS)))) == [("t", 1)]


def test_id_spelling(rows):
    df = rows([(" SHA256:AB ",), ("ab",), ("sha256:sha256:ab",), ("x ab",)], "prediction_id string")
    assert [r[0] for r in df.select(O.record_id("prediction_id")).collect()] == ["ab", "ab", "sha256:ab", "x ab"]
