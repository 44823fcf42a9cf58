"""Queries over identities, lineage, order and completeness, with their SQL checks."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tidemark.operators import chronology, ledger, orphans, verify
from tidemark.plans.audits import BLOCK, records
from tidemark.plans.forecasting_sql import pid, tidy as tidy_sql
from tidemark.runtime import cut, table, tidy


def _predictions(spark, d):
    p = table(spark, d, "prediction_ledger")
    return p.withColumn("prediction_id", orphans.record_id("prediction_id")).withColumn("outer_test_unit", tidy("outer_test_unit")).withColumnRenamed("target_name", "target").distinct()


def prediction_identity(spark, d):
    return verify.identity_hash(_predictions(spark, d)).select("prediction_id", "identity_hash").distinct()


def lineage_recheck(spark, d):
    """Predictions whose stored configuration hash or cutoff is not what their own columns give, with the field."""
    p = _predictions(spark, d)
    stored = {"config_hash": F.col("config_hash"), "cutoff": F.col("causal_cutoff_event_index_0based"), "target_index": F.col("expected_target_event_index_0based")}
    again = {"config_hash": F.sha2("config_json", 256), "cutoff": F.col("origin_event_index_0based"), "target_index": F.col("origin_event_index_0based") + F.col("horizon_event_steps")}
    return verify.lineage_mismatches(p, "prediction_id", stored, again).distinct()


def series_snapshots(spark, d):
    s = table(spark, d, "stress2_events").select(tidy("dataset_unit_key").alias("unit"), "event_index_0based", "row_id", "capacity_loss_pct").distinct()
    s = s.withColumn("place", F.struct("event_index_0based", "row_id"))
    return verify.snapshot_hash(s, "unit", "place", "capacity_loss_pct", "training", "capacity_loss_pct")


def arrival_order(spark, d):
    """Where the order in which a unit's events became available is not the order of the events."""
    e = table(spark, d, "hidden_events").select(tidy("dataset_unit_key").alias("unit"), "event_id", "event_index", "available_at").distinct().filter("event_index is not null and available_at is not null and unit is not null")
    return verify.zip_mismatches(e, e, "unit", ["event_index", "event_id"], ["available_at", "event_index", "event_id"], "event_id")


def order_date_violations(spark, d):
    """Orders of a customer that are dated before the one with the number below theirs."""
    return verify.order_violations(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderdate"])


def data_gates(spark, d):
    never = ["model_fit_allowed", "target_verified"]
    s = table(spark, d, "stress2_events").distinct()
    g = table(spark, d, "record_groups").distinct()
    m = table(spark, d, "maturity_ledger").distinct()
    return (
        verify.gate_row(s, "UNIT_IDENTITY", "stress2_events", F.col("dataset_unit_key").isNull() | (tidy("dataset_unit_key") == ""), never)
        .unionByName(verify.gate_row(g, "GROUP_SIZE", "record_groups", F.col("n_rows").isNull() | (F.col("n_rows") <= 0), never))
        .unionByName(verify.gate_row(m, "LABEL_REFERENCE", "maturity_ledger", F.coalesce(tidy("prediction_id"), F.lit("")) == "", never))
    )


def target_eligibility(spark, d):
    """Units with what they can be scored on."""
    e = table(spark, d, "endpoint_labels").select(tidy("dataset_unit_key").alias("unit"), tidy("endpoint").alias("endpoint"), "lower_time_h", "upper_time_h", "rul_score_eligible").distinct().filter("unit is not null")
    u = e.groupBy("unit").agg(F.bool_or(F.col("upper_time_h").isNotNull()).alias("crossed"), F.bool_or("rul_score_eligible").alias("rul"))
    return verify.eligibility(u, "unit", {"endpoint_time": (F.col("crossed"), "NO_CROSSING_OBSERVED"), "remaining_life": (F.col("rul"), "NOT_SCORE_ELIGIBLE")})


def record_fleet(spark, d):
    """Sums over the receipts of all groups; complete if each listed group has one."""
    r = records(spark, d).groupBy("gid").agg(F.count("*").alias("n_records"), F.count_if(F.col("energy_mwh").isNull()).alias("n_missing_energy"), F.countDistinct("cycle_no").alias("n_cycles"))
    expected = table(spark, d, "record_groups").agg(F.countDistinct("gid").alias("_n"))
    listed = r.crossJoin(F.broadcast(expected))  # one row
    return verify.fleet_summary(listed, "gid", ["n_records", "n_missing_energy", "n_cycles"], F.max("_n"))


def _chain(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return o, cut(ledger.with_chain(o, "o_custkey", ["o_orderkey"]))


def jsonl_chain(spark, d):
    """The order chains written as lines, some of them altered afterwards, and read back from their text alone."""
    o, chained = _chain(spark, d)
    lines = verify.jsonl_lines(chained)
    altered = F.when(F.col("line").contains('"o_orderpriority":"1-URGENT","o_orderstatus":"P"'), F.replace("line", F.lit('"P"'), F.lit('"F"'))).otherwise(F.col("line"))
    return verify.jsonl_problems(lines.withColumn("line", altered), o.schema, "o_custkey", ledger.GENESIS).withColumn("row_number", F.col("row_number").cast("long"))


def chain_seals(spark, d):
    _, chained = _chain(spark, d)
    return ledger.seal(chained, "o_custkey").select("o_custkey", "row_count", "final_row_hash")


def normal_intervals(spark, d):
    """Interval forecasts of all predictions from the spread of their model's points."""
    p = _predictions(spark, d).filter("point_prediction is not null").select("prediction_id", "model", "target", "horizon_event_steps", "point_prediction").distinct()
    s = p.groupBy("model", "target", "horizon_event_steps").agg((F.max("point_prediction") - F.min("point_prediction")).alias("scale"))
    j = p.join(s, ["model", "target", "horizon_event_steps"])
    return verify.normal_intervals(j, "point_prediction", "scale").select("prediction_id", "model", "target", "horizon_event_steps", "level", F.round("quantile", 6).alias("quantile")).distinct()


def inferred_finish(spark, d):
    """When each user's events ended: the start of the first one plus the longest time since."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    first = e.groupBy("user_id").agg(F.min("at").alias("start"))
    j = e.join(first, "user_id").withColumn("seconds", (F.unix_micros("at") - F.unix_micros("start")) / 1e6)
    return j.groupBy("user_id").agg(F.unix_micros(verify.inferred_finish(F.col("start"), F.col("seconds"))).alias("finish_us"))


def direct_bundles(spark, d):
    """One response per unit, model and horizon from the ledger's points; what is refused in them.

    A withdrawn prediction answers RUL_NA, which none of these targets allows; a failed one has no numbers.
    """
    p = _predictions(spark, d).groupBy("prediction_id").agg(*[F.min(c).alias(c) for c in ("outer_test_unit", "model", "target", "horizon_event_steps", "point_prediction", "withdrawn_seq", "origin_event_index_0based")])
    p = p.withColumn("response_id", F.concat_ws("/", "outer_test_unit", "model", "target", "horizon_event_steps", "origin_event_index_0based"))
    gone = F.col("withdrawn_seq").isNotNull()
    number = lambda k: F.when(~gone, F.col("point_prediction") + F.lit(k))
    entry = F.struct(F.col("prediction_id").alias("key"), F.when(gone, verify.RUL_NA).otherwise(verify.NUMERIC).alias("status"), number(0.0).alias("point"), number(-1.0).alias("lower"), number(0.0).alias("median"), number(1.0).alias("upper"))
    body = F.to_json(F.struct(F.lit("1").alias("schema_version"), F.array(entry).alias("forecasts")))
    planned = p.select("response_id", F.col("prediction_id").alias("key"), F.lit(False).alias("is_rul"), F.lit(0.0).alias("low"), F.lit(None).cast("double").alias("high"))
    return verify.bundle_problems(p.select("response_id", body.alias("body")).distinct(), planned, "1").select("key", "problem")


def dual_reconstruction(spark, d):
    """Chronology of whole groups against that merged from fragments."""
    r = records(spark, d)
    whole = chronology.chronology(r).drop("first_key", "last_key")
    merged = chronology.merge_chronology(chronology.chronology(r, block=BLOCK))
    names = [c for c in whole.columns if c in merged.columns]
    return verify.differences(whole.select(*names), merged.select(*names))


QUERIES = {
    f.__name__: f
    for f in (
        prediction_identity, lineage_recheck, series_snapshots, arrival_order, order_date_violations, data_gates, target_eligibility, record_fleet, jsonl_chain, chain_seals, normal_intervals, inferred_finish, direct_bundles,
        dual_reconstruction,
    )
}

_PRED = f"""p as (select distinct * replace ({pid('prediction_id')} as prediction_id, {tidy_sql('outer_test_unit')} as outer_test_unit) from prediction_ledger)"""
_TEXT = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_INT = lambda c: f"coalesce(cast({c} as varchar), 'null')"
_FIELDS = " || ',' || ".join(
    f"""'"{f}":' || {(_INT if f in ('context_event_steps', 'horizon_event_steps', 'origin_event_index_0based', 'seed') else _TEXT)('target_name' if f == 'target' else f)}""" for f in verify.IDENTITY
)
_CHAIN = """o as (
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) as rn,
         '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' as payload from orders),
h(o_custkey, rn, st, pri, hash) as (
  select o_custkey, rn, o_orderstatus, o_orderpriority, sha256(repeat('0', 64) || chr(10) || payload) from o where rn = 1
  union all select o.o_custkey, o.rn, o.o_orderstatus, o.o_orderpriority, sha256(h.hash || chr(10) || o.payload) from o join h on o.o_custkey = h.o_custkey and o.rn = h.rn + 1)"""


def _gate(gate: str, name: str, violation: str) -> str:
    return f"""select '{gate}' as gate_id, '{name}' as scope, case when count(*) = 0 then 'BLOCKED' when count(*) filter (where {violation}) > 0 then 'FAIL' else 'PASS' end as status, count(*) as n_rows,
      count(*) filter (where {violation}) as n_violations, '{{"n_rows":' || count(*) || ',"n_violations":' || count(*) filter (where {violation}) || '}}' as evidence, false as model_fit_allowed, false as target_verified
      from (select distinct * from {name})"""


_LEVELS = ", ".join(f"({q!r}, {NormalDist().inv_cdf(q)!r})" for q in verify.LEVELS)
_SAME = "select count(*) as n from (select distinct gid from instrument_records)"
ORACLE = {
    "prediction_identity": f"with {_PRED} select distinct prediction_id, sha256('{{' || {_FIELDS} || '}}') as identity_hash from p",
    "lineage_recheck": f"""with {_PRED}, b as (select prediction_id, unnest([
        case when config_hash is distinct from sha256(config_json) then 'config_hash' end,
        case when causal_cutoff_event_index_0based is distinct from origin_event_index_0based then 'cutoff' end,
        case when expected_target_event_index_0based is distinct from origin_event_index_0based + horizon_event_steps then 'target_index' end]) as field from p)
      select distinct prediction_id, field from b where field is not null""",
    "arrival_order": f"""with e as (select distinct {tidy_sql('dataset_unit_key')} as unit, event_id, event_index, available_at from hidden_events where event_index is not null and available_at is not null and dataset_unit_key is not null),
      a as (select unit, event_id, row_number() over (partition by unit order by event_index, event_id) - 1 as position from e),
      b as (select unit, event_id, row_number() over (partition by unit order by available_at, event_index, event_id) - 1 as position from e)
      select unit, position, a.event_id as left_item, b.event_id as right_item from a full join b using (unit, position) where a.event_id is distinct from b.event_id""",
    "order_date_violations": """with w as (select o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as b from orders)
      select o_custkey, o_orderkey from w where o_orderdate < b""",
    "data_gates": " union all ".join([
        _gate("UNIT_IDENTITY", "stress2_events", f"coalesce({tidy_sql('dataset_unit_key')}, '') = ''"), _gate("GROUP_SIZE", "record_groups", "coalesce(n_rows, 0) <= 0"),
        _gate("LABEL_REFERENCE", "maturity_ledger", f"coalesce({tidy_sql('prediction_id')}, '') = ''"),
    ]),
    "target_eligibility": f"""with e as (select distinct {tidy_sql('dataset_unit_key')} as unit, upper_time_h, rul_score_eligible from endpoint_labels where dataset_unit_key is not null),
      u as (select unit, bool_or(upper_time_h is not null) as crossed, bool_or(rul_score_eligible) as rul from e group by 1)
      select unit, 'endpoint_time' as target, case when crossed then 'ELIGIBLE' else 'NOT_ELIGIBLE' end as status, case when not coalesce(crossed, false) then 'NO_CROSSING_OBSERVED' end as reason from u
      union all select unit, 'remaining_life', case when rul then 'ELIGIBLE' else 'NOT_ELIGIBLE' end, case when not coalesce(rul, false) then 'NOT_SCORE_ELIGIBLE' end from u""",
    "record_fleet": """with r as (select gid, count(*) as n, count(*) filter (where energy_mwh is null) as m, count(distinct cycle_no) as c from (select distinct * from instrument_records) group by 1), x as (select count(distinct gid) as n_expected from record_groups)
      select count(*) as n_receipts, count(distinct gid) as n_members, cast(sum(n) as bigint) as n_records, cast(sum(m) as bigint) as n_missing_energy, cast(sum(c) as bigint) as n_cycles, max(n_expected) as n_expected,
             case when count(*) = max(n_expected) and count(distinct gid) = max(n_expected) then 'COMPLETE' else 'INCOMPLETE' end as status from r, x""",
    "jsonl_chain": f"with recursive {_CHAIN} select o_custkey, rn as row_number, false as bad_text, false as bad_link, true as bad_hash from h where st = 'P' and pri = '1-URGENT'",
    "chain_seals": f"with recursive {_CHAIN} select o_custkey, count(*) as row_count, max_by(hash, rn) as final_row_hash from h group by 1",
    "normal_intervals": f"""with {_PRED}, q as (select distinct prediction_id, model, target_name as target, horizon_event_steps, point_prediction as pt from p where point_prediction is not null),
      s as (select model, target, horizon_event_steps, max(pt) - min(pt) as scale from q group by 1, 2, 3), z(level, z) as (values {_LEVELS})
      select distinct prediction_id, model, target, horizon_event_steps, cast(level as double) as level, round(pt + z * scale, 6) as quantile from q join s using (model, target, horizon_event_steps), z""",
    "inferred_finish": "select user_id, epoch_us(max(ts)) as finish_us from events group by 1",
    "direct_bundles": f"""with {_PRED}, q as (select prediction_id as key, min(point_prediction) as pt, min(withdrawn_seq) as gone from p group by 1)
      select key, case when gone is not null then 'RUL_NA_NOT_ALLOWED' when pt is null then 'NOT_FINITE' else 'OUT_OF_LIMITS' end as problem from q where gone is not null or pt is null or pt - 1.0 < 0.0""",
    "dual_reconstruction": f"select n as n_first, n as n_second, 0::bigint as n_only_first, 0::bigint as n_only_second from ({_SAME})",
}
