import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.operators import verify as V


def test_snapshot_hash_equals_bytes(rows):
    data = [("b", 1, 2.5, 9), ("a", 2, float("nan"), 9), ("a", 1, -0.0, 9), (None, 1, 1.0, 9), ("a", 3, 1e300, 9)]
    got = {r["unit"]: (r["n_values"], r["snapshot_hash"]) for r in V.snapshot_hash(rows(data, "unit string, place int, value double, clash int"), "unit", "place", "value", "training", "t").collect()}

    def want(unit, values):
        h = hashlib.sha256(b'{"role":"training","target":"t"}' + b"\x00unit\x00" + unit.encode() + b"\x00shape\x00" + f"[{len(values)}]".encode() + b"\x00values\x00")
        h.update(struct.pack(f"<{len(values)}d", *values))
        return len(values), h.hexdigest()

    assert got == {"a": want("a", [-0.0, float("nan"), 1e300]), "b": want("b", [2.5])}
    assert V.snapshot_hash(rows([], "unit string, place int, value double"), "unit", "place", "value", "r", "t").count() == 0


def test_identity_equals_canonical_json(rows):
    ints = {"context_event_steps", "horizon_event_steps", "origin_event_index_0based", "seed"}
    one = {k: i if k in ints else f"é\"{k}" for i, k in enumerate(V.IDENTITY)}
    df = rows([tuple(one[k] for k in V.IDENTITY)], ", ".join(f"{k} {'long' if k in ints else 'string'}" for k in V.IDENTITY))
    text = json.dumps(one, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert V.identity_hash(df).collect()[0]["identity_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_zip_and_order(rows):
    a = rows([("g", 1, "x"), ("g", 2, "y"), ("g", 3, None), ("h", 1, "z")], "g string, o int, item string")
    b = rows([("g", 1, "x"), ("g", 2, "q"), ("g", 3, None), ("g", 4, "r")], "g string, o int, item string")
    assert sorted(map(tuple, V.zip_mismatches(a, b, "g", ["o"], ["o"], "item").collect()), key=str) == [("g", 1, "y", "q"), ("g", 3, None, "r"), ("h", 0, "z", None)]
    rows_ = rows([("g", 1, 5, 1), ("g", 2, 5, 1), ("g", 3, 4, 9), ("g", 4, None, 1), ("g", 5, 4, 0)], "g string, p int, k int, l int")
    assert sorted(r["p"] for r in V.order_violations(rows_, "g", "p", ["k", "l"]).collect()) == [3, 4]
    with pytest.raises(ValueError, match="unsorted"):
        V.require_empty(V.order_violations(rows_, "g", "p", ["k"]), "unsorted")
    V.require_empty(V.order_violations(rows_.limit(0), "g", "p", ["k"]), "unsorted")


def test_gates_and_fleet(rows):
    t = rows([(1,), (None,)], "x int")
    assert [V.gate_row(df, "G", "t", F.col("x").isNull(), ["fit_allowed"]).collect()[0]["status"] for df in (t, t.filter("x = 1"), t.limit(0))] == ["FAIL", "PASS", "BLOCKED"]
    assert V.gate_row(t, "G", "t", F.col("x").isNull(), ["fit_allowed"]).collect()[0]["fit_allowed"] is False
    r = rows([("a", 1), ("b", 2)], "k string, n long")
    assert [V.fleet_summary(df, "k", ["n"], 2).collect()[0]["status"] for df in (r, r.union(r.limit(1)), r.limit(1))] == ["COMPLETE", "INCOMPLETE", "INCOMPLETE"]


def test_jsonl_chain_trusts_nothing_stored(rows):
    df = rows([(1, "a", "x"), (1, "b", None), (1, "c", 'q"é'), (2, "a", "y")], "chain long, at string, v string")
    chained = ledger.with_chain(df, "chain", ["at"])
    lines = V.jsonl_lines(chained)
    assert V.jsonl_problems(lines, df.schema, "chain", ledger.GENESIS).count() == 0
    bad = lines.withColumn("line", F.when(F.col("line").contains('"at":"b"'), F.replace("line", F.lit('"v":null'), F.lit('"v":"z"'))).when(F.col("line").contains('"chain":2'), F.concat(F.lit(" "), "line")).otherwise(F.col("line")))
    got = sorted((r["chain"], r["row_number"], r["bad_text"], r["bad_link"], r["bad_hash"]) for r in V.jsonl_problems(bad, df.schema, "chain", ledger.GENESIS).collect())
    assert got == [(1, 2, False, False, True), (2, 1, True, False, False)]


def test_bundles(rows):
    number = lambda k, p, a, m, z: {"key": k, "status": "NUMERIC", "point": p, "lower": a, "median": m, "upper": z}
    body = lambda *f, v="1": json.dumps({"schema_version": v, "forecasts": list(f)})
    responses = {
        "ok": body(number("a", 1, 0, 1, 2), {"key": "r", "status": "RUL_NA"}),
        "na": body({"key": "a", "status": "RUL_NA"}, {"key": "r", "status": "RUL_NA", "point": 1}),
        "order": body(number("a", 3, 0, 1, 2), number("r", 1, 0, 1, 2)),
        "twice": body(number("a", 1, 0, 1, 2), number("a", 1, 0, 1, 2), number("z", 1, 0, 1, 2)),
        "limits": body(number("a", 1, 0, 1, 99), number("r", 1, 0, 1, None)),
        "version": body(number("a", 1, 0, 1, 2), v="2"),
        "text": "no json",
    }
    planned = rows([(i, k, k == "r", 0.0, 10.0) for i in responses for k in "ar"], "response_id string, key string, is_rul boolean, low double, high double")
    got = {tuple(r) for r in V.bundle_problems(rows(list(responses.items()), "response_id string, body string"), planned, "1").collect()}
    assert got == {
        ("na", "a", "RUL_NA_NOT_ALLOWED"), ("na", "r", "RUL_NA_WITH_NUMBERS"), ("order", "a", "NOT_ORDERED"), ("twice", "a", "DUPLICATE_KEY"), ("twice", "z", "UNKNOWN_KEY"), ("twice", "r", "MISSING_KEY"),
        ("limits", "a", "OUT_OF_LIMITS"), ("limits", "r", "NOT_FINITE"), ("version", None, "BAD_RESPONSE"), ("text", None, "BAD_RESPONSE"),
    }


def test_differences_and_finish(rows):
    a, b = rows([(1, "x"), (1, "x"), (2, None)], "i int, s string"), rows([("x", 1), (None, 2), (None, 2)], "s string, i int")
    assert tuple(V.differences(a, b).collect()[0]) == (3, 3, 1, 1)
    t = rows([("2025-01-01 00:00:00", 1.5), ("2025-01-01 00:00:00", float("nan")), ("2025-01-01 00:00:00", float("inf"))], "s string, sec double").withColumn("at", F.col("s").cast("timestamp"))
    assert str(t.agg(V.inferred_finish(F.col("at"), F.col("sec")).cast("string").alias("f")).collect()[0]["f"]) == "2025-01-01 00:00:01.5"
    q = V.normal_intervals(rows([(10.0, 2.0)], "p double, s double"), "p", "s").collect()
    assert [round(r["quantile"], 4) for r in q] == [6.7103, 7.4369, 8.651, 10.0, 11.349, 12.5631, 13.2897]
