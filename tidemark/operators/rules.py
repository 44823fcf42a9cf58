"""Predicates over records, JSON and reports: forbidden content, shapes, blockers, pairs, totals."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.scalars import snake

MAX_EXACT = float(1 << 53)


def leaves(value, path: str = "$") -> Iterator[tuple[str, str | None, object]]:
    """Every key and scalar of a JSON value: path, key (null for list items), scalar (null for containers)."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield f"{path}.{k}", k, None if isinstance(v, (dict, list)) else v
            if isinstance(v, (dict, list)):
                yield from leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, (dict, list)):
                yield from leaves(v, f"{path}[{i}]")
            else:
                yield f"{path}[{i}]", None, v


def json_leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, path, name, text``: one row per key or scalar of a JSON column; text that is no JSON gives one row with a null path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[column], strict=True):
                try:
                    rows += [(k, p, n, None if v is None else str(v)) for p, n, v in leaves(json.loads(t))]
                except (TypeError, ValueError):
                    rows.append((k, None, None, None))
            yield pd.DataFrame(rows, columns=["key", "path", "name", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(key, column).mapInPandas(run, f"key {kind}, path string, name string, text string")


def forbidden(found: DataFrame, fragments: list[str], patterns: list[str] = ()) -> DataFrame:
    """Rows of ``json_leaves`` whose key or text holds a forbidden fragment (in snake case) or fits a pattern."""
    hit = F.lit(False)
    for c in ("name", "text"):
        for f in fragments:
            hit = hit | F.coalesce(snake(F.col(c)).contains(f), F.lit(False))
        for p in patterns:
            hit = hit | F.coalesce(F.col(c).rlike(p), F.lit(False))
    return found.filter(hit)


def tainted(found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of records that hold any blacklisted key at any depth."""
    return found.filter(F.lower("name").isin([k.lower() for k in keys])).select("key").distinct()


def schema_error(value, schema: dict, depth: int = 0) -> str | None:
    """First violation of a closed schema subset: type, const, enum, exact keys, bounds, items, oneOf; null if none."""
    if depth > 32:
        return "too deep"
    if "oneOf" in schema:
        fits = sum(schema_error(value, s, depth + 1) is None for s in schema["oneOf"])
        return None if fits == 1 else f"fits {fits} of oneOf"
    if "const" in schema and value != schema["const"]:
        return "not the constant"
    if "enum" in schema and value not in schema["enum"]:
        return "not in enum"
    kind = schema.get("type")
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    good = {
        None: True, "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool),
        "integer": isinstance(value, int) and not isinstance(value, bool), "number": is_number, "null": value is None,
    }
    if not good.get(kind, False):
        return f"not {kind}"
    if is_number and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return "out of bounds"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return "number of items"
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            return "repeated items"
        for v in value:
            if "items" in schema and (e := schema_error(v, schema["items"], depth + 1)):
                return e
    if isinstance(value, dict) and "properties" in schema:
        if set(value) != set(schema.get("required", schema["properties"])):
            return "keys differ"
        for k, v in value.items():
            if e := schema_error(v, schema["properties"].get(k, {}), depth + 1):
                return f"{k}: {e}"
    return None


def with_schema_error(df: DataFrame, column: str, schema: dict) -> DataFrame:
    @F.pandas_udf(StringType())
    def check(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            try:
                out.append(schema_error(json.loads(t), schema))
            except (TypeError, ValueError):
                out.append("not JSON")
        return pd.Series(out, dtype=object)

    return df.withColumn("schema_error", check(F.col(column)))


def selections(responses: DataFrame, keys: DataFrame, actions: DataFrame) -> DataFrame:
    """Problems of action selections ``response_id, key, action_id``: DUPLICATE, UNKNOWN_KEY, UNKNOWN_ACTION, MISSING_KEY.

    Every response has to name every key once with an action it may choose.
    """
    dup = responses.groupBy("response_id", "key").count().filter("count > 1").select("response_id", "key", F.lit("DUPLICATE").alias("problem"))
    strange = responses.join(keys, "key", "left_anti").select("response_id", "key", F.lit("UNKNOWN_KEY").alias("problem"))
    no_action = responses.join(actions, "action_id", "left_anti").select("response_id", "key", F.lit("UNKNOWN_ACTION").alias("problem"))
    have = responses.select("response_id", "key").distinct().join(keys, "key", "left_semi").groupBy("response_id").agg(F.collect_set("key").alias("have"))  # a response names a fixed set of keys
    every = keys.agg(F.collect_set("key").alias("every"))
    ids = responses.select("response_id").distinct().join(have, "response_id", "left")
    lacking = ids.crossJoin(F.broadcast(every)).select("response_id", F.explode(F.array_except("every", F.coalesce("have", F.array().cast("array<string>")))).alias("key")).withColumn("problem", F.lit("MISSING_KEY"))  # one row
    return dup.unionByName(strange).unionByName(no_action).unionByName(lacking)


def exact_integer(c: Column) -> Column:
    """Finite, whole and small enough to be exact as a double."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) <= MAX_EXACT) & (F.floor(c) == c), F.lit(False))


def record_rules(df: DataFrame) -> DataFrame:
    """Canonical record rules: ``problems`` lists fields that are null, negative or not finite; status may be negative."""
    tests = [(c, F.col(c).isNull() | (F.col(c) < 0)) for c in ("cycle_no", "step_no", "record_number", "time_us")] + [("status_code", F.col("status_code").isNull())]
    tests += [(c, F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) for c in ("voltage_v", "current_ma", "capacity_mah")]
    return df.withColumn("problems", F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(c)) for c, t in tests]), lambda x: x.isNotNull()))


def open_blockers(first: DataFrame, second: DataFrame) -> DataFrame:
    """``key, blocker`` of the first report that stay: a blocker falls only if both reports agree on identity and counts.

    Both have ``key, identity, entries, blockers``; the second report's ``blockers`` names those it clears.
    """
    s = second.select("key", F.col("identity").alias("i2"), F.col("entries").alias("e2"), F.col("blockers").alias("cleared"))
    j = first.join(s, "key", "left")
    agree = F.coalesce((F.col("identity") == F.col("i2")) & (F.col("entries") == F.col("e2")), F.lit(False))
    left = F.when(agree, F.array_except("blockers", "cleared")).otherwise(F.col("blockers"))
    return j.select("key", F.explode(left).alias("blocker"))


def blocker_histogram(reports: DataFrame) -> DataFrame:
    """Reports per blocker, with those that have none under a null blocker."""
    return reports.select(F.explode_outer("blockers").alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n_reports"))


def replicate_pairs(headers: DataFrame, data: DataFrame) -> DataFrame:
    """Header i with data i of each item by raw place, before any sorting; what is empty on one side is quarantined."""
    h = headers.select("item_id", "raw_idx", F.col("content").alias("header"))
    d = data.select("item_id", "raw_idx", F.col("content").alias("body"))
    status = F.when(F.col("header").isNull() & F.col("body").isNull(), "BOTH_EMPTY").when(F.col("header").isNull(), "HEADER_EMPTY").when(F.col("body").isNull(), "DATA_EMPTY").otherwise("PAIRED")
    return h.join(d, ["item_id", "raw_idx"], "full_outer").withColumn("status", status)


def replicate_ranks(pairs: DataFrame, time: str) -> DataFrame:
    """0-based rank by (time, raw place) of the paired replicates and how many share a time."""
    w = Window.partitionBy("item_id").orderBy(time, "raw_idx")
    p = pairs.filter("status = 'PAIRED'")
    return p.withColumn("rank", F.row_number().over(w) - 1).withColumn("n_tied", F.count("*").over(Window.partitionBy("item_id", time)))


def listing_totals(members: DataFrame, allowed: list[str]) -> DataFrame:
    """Files, folders, bytes and files with an allowed extension of a listing ``member, size, is_folder``."""
    ext = F.lower(F.regexp_extract("member", r"\.([^./]+)$", 1))
    return members.agg(
        F.count_if(~F.col("is_folder")).alias("n_files"), F.count_if("is_folder").alias("n_folders"), F.sum(F.when(~F.col("is_folder"), F.col("size"))).cast("long").alias("n_bytes"),
        F.count_if(~F.col("is_folder") & ext.isin(allowed)).alias("n_allowed"),
    )
