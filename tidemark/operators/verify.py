"""Identities, lineage, order and completeness: what a table must be equal to, and where it is not."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ledger import payload_json

#: The fields of a prediction's identity, and the levels of an interval forecast.
IDENTITY = [
    "code_hash", "config_hash", "context_event_steps", "data_mat_hash", "data_zip_hash", "horizon_event_steps", "model", "origin_event_index_0based", "outer_test_unit", "prefix_hash", "protocol_hash", "seed", "split_hash",
    "target", "train_set_hash", "training_snapshot_hash",
]
LEVELS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
RUL_NA, NUMERIC = "RUL_NA", "NUMERIC"


def identity_hash(rows: DataFrame, name: str = "identity_hash") -> DataFrame:
    """Adds the SHA-256 of the canonical JSON of a prediction's sixteen identity fields; nulls are null in it."""
    kinds = dict(rows.dtypes)
    return rows.withColumn(name, F.sha2(payload_json(IDENTITY, kinds), 256))


def snapshot_hash(rows: DataFrame, unit: str, place: str, value: str, role: str, target: str) -> DataFrame:
    """``unit, n_values, snapshot_hash``: SHA-256 of each unit's series of doubles as it stands.

    The hash covers role and target, the unit, the length and the little-endian bytes of
    the values in order. Rows are sorted by the JVM and pass through one running hash a
    unit, so no series is held in memory. Null values are NaN; units that are null have none.
    """
    head = '{"role":"%s","target":"%s"}' % (role, target)
    n = rows.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count("*").alias("n_values"))
    laid = rows.select(F.col(unit).alias("unit"), F.col(place).alias("place"), F.col(value).cast("double").alias("value")).join(n.withColumnRenamed(unit, "unit"), "unit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, digest, size, out = None, None, 0, []
        for b in batches:
            if not len(b):
                continue
            names, values, counts = b["unit"].to_numpy(), b["value"].to_numpy(dtype="<f8"), b["n_values"].to_numpy()
            edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True])
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if names[a] != here:
                    if digest is not None:
                        out.append((here, size, digest.hexdigest()))
                    here, size = names[a], int(counts[a])
                    digest = hashlib.sha256(head.encode())
                    digest.update(b"\x00unit\x00" + here.encode() + b"\x00shape\x00" + f"[{size}]".encode() + b"\x00values\x00")
                digest.update(values[a:z].tobytes())
            yield pd.DataFrame(out, columns=["unit", "n_values", "snapshot_hash"])
            out = []
        if digest is not None:
            yield pd.DataFrame([(here, size, digest.hexdigest())], columns=["unit", "n_values", "snapshot_hash"])

    return laid.repartition("unit").sortWithinPartitions("unit", "place", "value").mapInPandas(run, "unit string, n_values long, snapshot_hash string")


def lineage_mismatches(rows: DataFrame, key: str, stored: dict[str, Column], again: dict[str, Column]) -> DataFrame:
    """``key, field``: where what a row says about its origin is not what its own columns give. Nulls differ from values."""
    wrong = F.filter(F.array(*[F.when(~stored[k].eqNullSafe(again[k]), F.lit(k)) for k in stored]), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(wrong).alias("field"))


def zip_mismatches(a: DataFrame, b: DataFrame, group: str, order_a: list[str], order_b: list[str], item: str) -> DataFrame:
    """``group, position, left_item, right_item`` where two ordered lists of a group differ or one has ended.

    Places are counted per group; repeated places are told apart by their order columns.
    """
    numbered = lambda df, order, name: df.select(group, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long").alias("position"), F.col(item).alias(name))
    j = numbered(a, order_a, "left_item").join(numbered(b, order_b, "right_item"), [group, "position"], "full_outer")
    return j.filter(~F.col("left_item").eqNullSafe(F.col("right_item")))


def order_violations(rows: DataFrame, group: str, place: str, key: list[str]) -> DataFrame:
    """``group, place`` of rows whose key is smaller than that of the row before them; nulls come first."""
    now = F.struct(*key)
    before = F.lag(now).over(Window.partitionBy(group).orderBy(place))
    return rows.withColumn("_bad", before.isNotNull() & (now < before)).filter("_bad").select(group, place)


def require_empty(problems: DataFrame, what: str) -> None:
    """Raise if there is any row."""
    first = problems.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def gate_row(rows: DataFrame, gate_id: str, scope: str, violation: Column, forbidden: list[str]) -> DataFrame:
    """One row: a gate passes if there are rows and none violates it; what it must never allow is false.

    Columns ``gate_id, scope, status, n_rows, n_violations, evidence`` and one boolean for each of ``forbidden``. A table
    without rows is BLOCKED.
    """
    one = rows.agg(F.count("*").alias("n_rows"), F.count_if(violation).alias("n_violations"))
    status = F.when(F.col("n_rows") == 0, "BLOCKED").when(F.col("n_violations") > 0, "FAIL").otherwise("PASS")
    evidence = F.concat(F.lit('{"n_rows":'), F.col("n_rows").cast("string"), F.lit(',"n_violations":'), F.col("n_violations").cast("string"), F.lit("}"))
    return one.select(F.lit(gate_id).alias("gate_id"), F.lit(scope).alias("scope"), status.alias("status"), "n_rows", "n_violations", evidence.alias("evidence"), *[F.lit(False).alias(f) for f in forbidden])


def eligibility(units: DataFrame, unit: str, targets: dict[str, tuple[Column, str]]) -> DataFrame:
    """``unit, target, status, reason``: each unit is eligible for a target, or the target's reason says why not."""
    each = [F.struct(F.lit(t).alias("target"), F.when(ok, "ELIGIBLE").otherwise("NOT_ELIGIBLE").alias("status"), F.when(~F.coalesce(ok, F.lit(False)), why).alias("reason")) for t, (ok, why) in targets.items()]
    return units.select(unit, F.explode(F.array(*each)).alias("_t")).select(unit, "_t.*")


def fleet_summary(receipts: DataFrame, key: str, sums: list[str], expected: Column | int) -> DataFrame:
    """Sums over receipts, COMPLETE only if there are exactly as many different ones as expected (a number or an aggregate), none twice."""
    wanted = expected if isinstance(expected, Column) else F.lit(expected)
    out = receipts.agg(F.count("*").alias("n_receipts"), F.countDistinct(key).alias("n_members"), *[F.sum(c).cast("long").alias(c) for c in sums], wanted.cast("long").alias("n_expected"))
    whole = (F.col("n_receipts") == F.col("n_expected")) & (F.col("n_members") == F.col("n_expected"))
    return out.withColumn("status", F.when(whole, "COMPLETE").otherwise("INCOMPLETE"))


def jsonl_lines(chained: DataFrame) -> DataFrame:
    """A chained ledger as lines: the payload with its link and its hash, in canonical order of keys."""
    kinds = dict(chained.dtypes)
    fields = [c for c in chained.columns if c not in ("row_number", "row_payload_json")]
    return chained.select("row_number", payload_json(fields, kinds).alias("line"))


def jsonl_problems(lines: DataFrame, schema: T.StructType, chain: str, genesis: str) -> DataFrame:
    """Lines that break their chain: not the canonical text of their own values, a wrong hash, or a link that is not the hash before.

    ``lines`` has ``row_number, line``; ``schema`` are the payload's fields. Nothing stored is trusted: payload and line
    are built anew from the parsed values.
    """
    whole = T.StructType([*schema.fields, T.StructField("prev_row_hash", T.StringType()), T.StructField("row_hash", T.StringType())])
    parsed = lines.withColumn("_v", F.from_json("line", whole, {"mode": "PERMISSIVE"})).select("row_number", "line", "_v.*")
    kinds = dict(parsed.dtypes)
    payload = payload_json([f.name for f in schema.fields], kinds)
    prev = F.coalesce(F.lag("row_hash").over(Window.partitionBy(chain).orderBy("row_number")), F.lit(genesis))
    checked = parsed.withColumns(
        {
            "bad_text": ~F.col("line").eqNullSafe(payload_json([f.name for f in whole.fields], kinds)),
            "bad_link": ~F.col("prev_row_hash").eqNullSafe(prev),
            "bad_hash": ~F.col("row_hash").eqNullSafe(F.sha2(F.concat("prev_row_hash", F.lit("\n"), payload), 256)),
        }
    )
    return checked.filter("bad_text or bad_link or bad_hash").select(chain, "row_number", "bad_text", "bad_link", "bad_hash")


def normal_intervals(points: DataFrame, point: str, scale: str) -> DataFrame:
    """Adds ``level, quantile``: the point plus the normal quantile of each level times the scale."""
    steps = F.array(*[F.struct(F.lit(q).alias("level"), F.lit(NormalDist().inv_cdf(q)).alias("z")) for q in LEVELS])
    return points.withColumn("_s", F.explode(steps)).select("*", F.col("_s.level").alias("level"), (F.col(point) + F.col("_s.z") * F.col(scale)).alias("quantile")).drop("_s")


def inferred_finish(start: Column, seconds: Column) -> Column:
    """Aggregate: when a record ended, by its start and its last finite time; null without one."""
    finite = F.when(~F.isnan(seconds) & (F.abs(seconds) != float("inf")), seconds)
    return F.timestamp_micros((F.unix_micros(F.min(start)) + F.round(F.max(finite) * 1_000_000)).cast("long"))


_BUNDLE = "struct<schema_version:string,forecasts:array<struct<key:string,status:string,point:double,lower:double,median:double,upper:double>>>"


def bundle_problems(responses: DataFrame, planned: DataFrame, version: str) -> DataFrame:
    """``response_id, key, problem``: why a direct forecast response is refused; responses without rows are accepted.

    ``responses`` has ``response_id, body`` (JSON), ``planned`` has ``response_id, key, is_rul, low, high`` with the target's
    limits. Every planned key must be answered once, by four finite numbers in order and within limits, or, for a
    remaining-life target only, by RUL_NA alone.
    """
    r = responses.withColumn("_b", F.from_json("body", _BUNDLE))
    bad = r.filter(F.col("_b").isNull() | ~F.col("_b.schema_version").eqNullSafe(F.lit(version)) | F.col("_b.forecasts").isNull()).select("response_id", F.lit(None).cast("string").alias("key"), F.lit("BAD_RESPONSE").alias("problem"))
    each = r.filter(F.col("_b.schema_version") == version).select("response_id", F.explode("_b.forecasts").alias("_f")).select("response_id", "_f.*")
    counted = each.groupBy("response_id", "key").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("status", "point", "lower", "median", "upper")])
    numbers = ["point", "lower", "median", "upper"]
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    all_finite = finite("point") & finite("lower") & finite("median") & finite("upper")
    none = F.coalesce(*numbers).isNull()
    ordered = (F.col("lower") <= F.col("median")) & (F.col("median") <= F.col("upper")) & F.col("point").between(F.col("lower"), F.col("upper"))
    within = F.coalesce(F.least(*numbers) >= F.col("low"), F.lit(True)) & F.coalesce(F.greatest(*numbers) <= F.col("high"), F.lit(True))
    j = counted.join(planned.withColumn("_p", F.lit(True)), ["response_id", "key"], "full_outer")
    why = (
        F.when(F.col("_p").isNull(), "UNKNOWN_KEY").when(F.col("n").isNull(), "MISSING_KEY").when(F.col("n") > 1, "DUPLICATE_KEY")
        .when((F.col("status") == RUL_NA) & ~F.col("is_rul"), "RUL_NA_NOT_ALLOWED").when((F.col("status") == RUL_NA) & ~none, "RUL_NA_WITH_NUMBERS").when(F.col("status") == RUL_NA, None)
        .when(~F.col("status").eqNullSafe(F.lit(NUMERIC)), "UNKNOWN_STATUS").when(~all_finite, "NOT_FINITE").when(~ordered, "NOT_ORDERED").when(~within, "OUT_OF_LIMITS")
    )
    answered = j.join(bad.select("response_id"), "response_id", "left_anti")
    return bad.unionByName(answered.select("response_id", "key", why.alias("problem")).filter("problem is not null"))


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row ``n_first, n_second, n_only_first, n_only_second`` of two reconstructions of one result, as bags of rows."""
    columns = sorted(first.columns)
    if columns != sorted(second.columns):
        raise ValueError(f"columns differ: {columns} and {sorted(second.columns)}")
    both = first.select(*columns).withColumn("_n", F.lit(1)).unionByName(second.select(*columns).withColumn("_n", F.lit(-1)))
    rows = both.groupBy(*columns).agg(F.count_if(F.col("_n") == 1).alias("a"), F.count_if(F.col("_n") == -1).alias("b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(total("a").alias("n_first"), total("b").alias("n_second"), total(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("n_only_first"), total(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("n_only_second"))
