from tidemark.operators import scoring

SCHEMA = "family string, config string, config_order long, horizon int, unit string, mae double"


def run(rows, data):
    return {(r["outer_test_unit"], r["config"]): (r["status"], r["inner_macro_mae"], r["selected"]) for r in scoring.nested_selection(rows(data, SCHEMA)).collect()}


def test_scores_leave_the_fold_s_unit_out(rows):
    mae = {"a": {"u": 1.0, "v": 2.0, "w": 9.0}, "b": {"u": 3.0, "v": 1.0, "w": None}}
    got = run(rows, [("f", c, i, 1, u, x) for i, c in enumerate(mae) for u, x in mae[c].items()])
    assert got == {
        ("u", "a"): ("OK", 5.5, True), ("u", "b"): ("FAIL", None, False), ("v", "a"): ("OK", 5.0, True), ("v", "b"): ("FAIL", None, False),
        ("w", "a"): ("OK", 1.5, True), ("w", "b"): ("OK", 2.0, False),
    }


def test_ties_go_to_the_first_and_nothing_is_taken_where_all_failed(rows):
    tie = run(rows, [("f", c, i, 1, u, 2.0) for i, c in ((1, "z"), (2, "a")) for u in "uv"])
    assert [k for k, x in sorted(tie.items()) if x[2]] == [("u", "z"), ("v", "z")]
    assert not any(x[2] for x in run(rows, [("f", "a", 1, 1, u, None) for u in "uvw"]).values())
    assert not any(x[2] for x in run(rows, [("f", "a", 1, 1, "u", 1.0)]).values())
    assert run(rows, []) == {}
