"""Queries over the general training-data operators, with their SQL checks."""

from __future__ import annotations

from tidemark.operators import anomalies, asof, orphans, regrid

QUERIES = {
    "p1_found": orphans.p1_found,
    "p1_orphan_counts": orphans.p1_orphan_counts,
    "p2_found": regrid.p2_found,
    "p2_grid": regrid.p2_grid,
    "p3_found": anomalies.p3_found,
    "p3_flags": anomalies.p3_flags,
    "p4_found": asof.p4_found,
}

_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_KEY = "regexp_replace(lower(trim({0}, " + _CHARS + ")), '^sha256:', '')"
_ORPHANS = f"""
with preds as (
  select distinct {_KEY.format('prediction_id')} as ref_key, prediction_commit_seq as born, withdrawn_seq as gone
  from prediction_ledger),
refs as (
  select 'maturity_ledger' as table_name, row_id, prediction_id, label_available_seq as seq, logged_at from maturity_ledger
  union select 'failure_ledger', row_id, prediction_id, failure_seq, logged_at from failure_ledger),
keyed as (
  select *, {_KEY.format('prediction_id')} as ref_key from refs
  where trim(prediction_id, {_CHARS}) <> ''),
orphans as (
  select * from keyed k where not exists (
    select 1 from preds p where p.ref_key = k.ref_key and p.born <= k.seq and (p.gone is null or p.gone > k.seq)))
"""
_UNIT = "lower(trim({0}, " + _CHARS + "))"

_NEAR = " ".join(
    f"""
  , case when adj{n} is not null and adj{n} > 0 or (side <> 0 and same{n} and lag(side) over w <> side and lead(side, {n}) over w <> side and far{n} > 0) then 1 else 0 end as hit{n}"""
    for n in (1, 2, 3)
)


def _clear(low: str, high: str, before: str, after: str) -> str:
    """By how many scatters a segment clears both limits of a spike, in SQL."""
    return f"least(greatest({low} - greatest({before}, {after}), least({before}, {after}) - {high}) / s - 10.0, 7.5 - abs({before} - {after}) / s)"


def _segment(n: int) -> str:
    ahead = [f"lead(v, {k}) over w" for k in range(1, n)]
    low, high = (f"{f}({', '.join(['v', *ahead])})" if ahead else "v" for f in ("least", "greatest"))
    same = " and ".join(["lead(side, %d) over w is not distinct from side" % k for k in range(1, n)]) or "true"
    inside = f"(lag(v) over w is not null and lead(v, {n}) over w is not null)"
    near = _clear(low, high, "lag(v) over w", f"lead(v, {n}) over w")
    far = _clear(low, high, "calm_before", f"lead(calm_after, {n - 1}) over w")
    return f"case when {inside} then {near} end as adj{n}, case when {inside} then {far} end as far{n}, ({same}) as same{n}"


_FAULTY = f"""
with bounds(m, low, high) as (
  values ('capacity_loss_pct', -20.0, 100.0), ('esr_increase_pct', -60.0, 1000.0), ('capacity_ratio', 0.0, 1.2), ('esr_ratio', 0.4, 11.0), ('case_temp_c', -40.0, 150.0)),
raw as (
  select 'stress2_events' as tab, {_UNIT.format('dataset_unit_key')} as u, event_index_0based as ev, row_id as k,
         unnest([{{'m': 'capacity_loss_pct', 'v': capacity_loss_pct}}, {{'m': 'esr_increase_pct', 'v': esr_increase_pct}}]) as x
  from stress2_events
  union all
  select 'hidden_events', {_UNIT.format('dataset_unit_key')}, event_index, event_id,
         unnest([{{'m': m, 'v': case when coalesce(missingness[m], false) then null else measurements[m] end}} for m in ['capacity_ratio', 'esr_ratio', 'case_temp_c']])
  from hidden_events),
r as (select distinct tab, u, ev, k, x.m as m, x.v as v from raw where u is not null and ev is not null and x.v is not null),
n as (select *, row_number() over w as rn, lag(v) over w as was from r window w as (partition by tab, u, m order by ev, k)),
i as (select *, sum(case when v = was then 0 else 1 end) over (partition by tab, u, m order by rn) as island from n),
q as (
  select i.*, count(*) over (partition by tab, u, m, island) as run, not (isfinite(v) and v between low and high) as hard
  from i join bounds using (m)),
c as (
  select tab, u, m, k, v, rn, abs(v - lag(v) over w) as d, median(v) over (w rows between 5 preceding and 5 following) as middle
  from q where not hard and run < 8 window w as (partition by tab, u, m order by rn)),
s as (
  select tab, u, m, case when median(d) > 0 then median(d) else (median(d) filter (where d > 0)) * least(1.0, 2.0 * (count(d) filter (where d > 0)) / count(d)) end as s
  from c group by tab, u, m),
x as (select c.*, s, case when abs(v - middle) / (1.4826 * s) > 4.0 then sign(v - middle) else 0 end as side from c join s using (tab, u, m) where s > 0),
y as (
  select *, last_value(case when side = 0 then v end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as calm_before,
         first_value(case when side = 0 then v end ignore nulls) over (w rows between 1 following and unbounded following) as calm_after
  from x window w as (partition by tab, u, m order by rn)),
z as (select *, {_segment(1)}, {_segment(2)}, {_segment(3)} from y window w as (partition by tab, u, m order by rn)),
h as (select * {_NEAR} from z window w as (partition by tab, u, m order by rn)),
spikes as (
  select tab, k, m, greatest(hit1, hit2, hit3, coalesce(lag(greatest(hit2, hit3)) over w, 0), coalesce(lag(hit3, 2) over w, 0)) as hit
  from h window w as (partition by tab, u, m order by rn))
"""

ORACLE = {
    "p3_found": _FAULTY + """
select distinct tab as table_name, k as row_key, m as measure_name
from (select tab, k, m from q where hard or run >= 8 union all select tab, k, m from spikes where hit = 1)""",
    "p1_found": _ORPHANS + "select distinct table_name, row_id from orphans",
    "p1_orphan_counts": _ORPHANS + "select table_name, strftime(logged_at, '%Y-%m') as period, count(*) as n_orphans from orphans group by 1, 2",
    "p2_found": f"""
with plan as (select {_UNIT.format('source_member')} as member, max(cadence_h) as cadence from acquisition_plans group by 1),
r as (
  select 'stress2_events' as table_name, {_UNIT.format('dataset_unit_key')} as u, {_UNIT.format('source_member')} as member, aging_time_h as t,
         unnest([{{'m': 'capacity_loss_pct', 'v': capacity_loss_pct}}, {{'m': 'esr_increase_pct', 'v': esr_increase_pct}}]) as x
  from stress2_events
  union all
  select 'hidden_events', {_UNIT.format('dataset_unit_key')}, {_UNIT.format('source_member')}, observed_at,
         unnest([{{'m': m, 'v': case when coalesce(missingness[m], false) then null else measurements[m] end}}
                 for m in ['capacity_ratio', 'esr_ratio', 'case_temp_c']])
  from hidden_events),
s as (select table_name, u, x.m as m, x.v as v, cast(floor(t / cadence + 0.5) as bigint) as slot from r join plan using (member) where t is not null),
ends as (select table_name, u, m, min(slot) as a, max(slot) as z from s group by 1, 2, 3),
grid as (select table_name, u, m, unnest(range(a, z + 1)) as slot from ends),
got as (select distinct table_name, u, m, slot from s where v is not null and isfinite(v))
select table_name, u as dataset_unit_key, m as measure_name, slot from grid anti join got using (table_name, u, m, slot)""",
    "p4_found": f"""
with ev as (select distinct event_id, {_UNIT.format('dataset_unit_key')} as u, event_index, observed_at, available_at from hidden_events),
attrs as (select distinct attr_id, {_UNIT.format('dataset_unit_key')} as u, valid_from_h, known_at_h from unit_attributes),
pr as (select distinct {_UNIT.format('prediction_id')} as rid, {_UNIT.format('outer_test_unit')} as u,
              causal_cutoff_event_index_0based as cutoff, origin_time_h from prediction_ledger),
a as (select 'hidden_events' as table_name, cast(event_id as varchar) as record_key, attr_id as known_id,
             row_number() over (partition by event_id order by valid_from_h desc, known_at_h desc, attr_id desc) as rn
      from ev join attrs using (u) where valid_from_h <= observed_at and known_at_h <= available_at),
b as (select 'prediction_ledger' as table_name, rid as record_key, event_id as known_id,
             row_number() over (partition by rid order by event_index desc, available_at desc, event_id desc) as rn
      from pr join ev using (u) where event_index <= cutoff and available_at <= origin_time_h)
select table_name, record_key, known_id from a where rn = 1
union all select table_name, record_key, known_id from b where rn = 1""",
}
