from tidemark.operators import rules as R


def test_leaves_forbidden_and_tainted(rows):
    df = rows([(1, '{"a":{"futureValue":1},"b":["lifeLength"]}'), (2, '{"a":1}'), (3, "no"), (4, None), (5, '{"api_key":"x"}')], "i int, j string")
    found = R.json_leaves(df, "i", "j")
    assert sorted((r["key"], r["path"]) for r in found.filter("key = 1").collect()) == [(1, "$.a"), (1, "$.a.futureValue"), (1, "$.b"), (1, "$.b[0]")]
    assert sorted((r["key"], r["path"]) for r in R.forbidden(found, ["future_value", "life_length"]).collect()) == [(1, "$.a.futureValue"), (1, "$.b[0]")]
    assert [r["key"] for r in R.tainted(found, ["API_KEY"]).collect()] == [5]
    assert found.filter("path is null").count() == 2


def test_schema_subset(rows):
    s = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 1}, "v": {"oneOf": [{"type": "number"}, {"const": None}]}, "l": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"enum": ["x", "y"]}}}, "required": ["k", "v", "l"]}
    texts = ['{"k":1,"v":2.5,"l":["x"]}', '{"k":1,"v":null,"l":["x","y"]}', '{"k":true,"v":1,"l":["x"]}', '{"k":1,"v":1,"l":["x","x"]}', '{"k":1,"v":1}', '{"k":1,"v":"z","l":["x"]}', "{", '{"k":0,"v":1,"l":["x"]}', '{"k":1,"v":1,"l":["q"]}']
    got = [r["schema_error"] for r in R.with_schema_error(rows([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", s).orderBy("i").collect()]
    assert got[:2] == [None, None] and all(got[2:])


def test_selections(rows):
    resp = rows([("r", "a", "x"), ("r", "a", "x"), ("r", "z", "x"), ("s", "a", "x"), ("s", "b", "bad")], "response_id string, key string, action_id string")
    got = sorted(map(tuple, R.selections(resp, rows([("a",), ("b",)], "key string"), rows([("x",)], "action_id string")).collect()))
    assert got == [("r", "a", "DUPLICATE"), ("r", "b", "MISSING_KEY"), ("r", "z", "UNKNOWN_KEY"), ("s", "b", "UNKNOWN_ACTION")]


def test_blockers(rows):
    sch = "key string, identity string, entries long, blockers array<string>"
    a = rows([("a", "h", 3, ["m", "n"]), ("b", "h", 3, ["m"]), ("c", "h", 1, [])], sch)
    b = rows([("a", "h", 3, ["m"]), ("b", "h", 4, ["m"])], sch)
    assert sorted(map(tuple, R.open_blockers(a, b).collect())) == [("a", "n"), ("b", "m")]
    assert {r["blocker"]: r["n_reports"] for r in R.blocker_histogram(a).collect()} == {"m": 2, "n": 1, None: 1}


def test_record_rules_and_pairs(rows):
    df = rows([(1, 1, -5, 1, 1, 1.0, 1.0, 1.0), (None, 1, 1, -1, 1, float("nan"), None, 1.0)], "cycle_no long, step_no long, status_code long, record_number long, time_us long, voltage_v double, current_ma double, capacity_mah double")
    assert [r["problems"] for r in R.record_rules(df).collect()] == [[], ["cycle_no", "record_number", "voltage_v", "current_ma"]]
    h = rows([("i", 0, "h0"), ("i", 1, None), ("i", 2, "h2"), ("i", 3, "h3")], "item_id string, raw_idx int, content string")
    d = rows([("i", 0, "d0"), ("i", 1, "d1"), ("i", 3, "d3")], "item_id string, raw_idx int, content string")
    p = R.replicate_pairs(h, d)
    assert {r["raw_idx"]: r["status"] for r in p.collect()} == {0: "PAIRED", 1: "HEADER_EMPTY", 2: "DATA_EMPTY", 3: "PAIRED"}
    from pyspark.sql import functions as F

    assert sorted((r["raw_idx"], r["rank"], r["n_tied"]) for r in R.replicate_ranks(p.withColumn("t", F.lit(1)), "t").collect()) == [(0, 0, 2), (3, 1, 2)]
    x = rows([(3.0,), (3.5,), (float("inf"),), (None,), (2.0**53 + 2,)], "x double").select(R.exact_integer(F.col("x"))).collect()
    assert [r[0] for r in x] == [True, False, False, False, False]
    t = R.listing_totals(rows([("a/x.XLS", 5, False), ("a", 0, True), ("b.txt", 7, False)], "member string, size long, is_folder boolean"), ["xls"]).collect()[0]
    assert tuple(t) == (2, 1, 12, 1)
