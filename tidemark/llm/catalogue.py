"""Queries of the problems tagged llm, with their SQL checks where SQL can express them."""

from __future__ import annotations

from tidemark.llm import components, leakage, packing, pii, spans

_TIDY = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))"

QUERIES = {
    "p5_found": spans.p5_found,
    "p5_shares": spans.p5_shares,
    "p6_found": components.p6_found,
    "p6_splits": components.p6_splits,
    "p6_group_splits": components.p6_group_splits,
    "p7_containers": packing.p7_containers,
    "p7_fill": packing.p7_fill,
    "p8_found": leakage.p8_found,
    "p8_leaks": leakage.p8_leaks,
    "p9_found": pii.p9_found,
    "p9_redacted": pii.p9_redacted,
}

_RUNS = """
with r as (
  select distinct gid, row_pos, status_code, time_us, voltage_v + 0.0 as v, current_ma + 0.0 as c, capacity_mah + 0.0 as q from instrument_records),
m as (
  select a.gid as ga, a.row_pos as pa, b.gid as gb, b.row_pos as pb
  from r a join r b on a.status_code = b.status_code and a.time_us = b.time_us and a.v = b.v and a.c = b.c and a.q = b.q and a.gid < b.gid),
i as (select *, pa - row_number() over (partition by ga, gb, pb - pa order by pa) as island from m),
runs as (
  select ga as gid_a, min(pa) as start_a, gb as gid_b, min(pb) as start_b, count(*) as n_rows
  from i group by ga, gb, pb - pa, island having count(*) >= 32)
"""

_LINKED = f"""m as (
  select distinct {_TIDY.format('dataset_unit_key')} as u, k || {_TIDY.format('v')} as mark
  from (select dataset_unit_key, 'p' as k, physical_unit_id as v from stress2_events
        union all select dataset_unit_key, 'g', possible_duplicate_group from stress2_events)
  where {_TIDY.format('v')} not in ('', '-', 'n/a', 'unknown')),
e as (select distinct a.u as a, b.u as b from m a join m b using (mark)),
r(u, w) as (select a, b from e union select r.u, e.b from r join e on r.w = e.a)"""

ORACLE = {
    "p5_found": _RUNS + "select * from runs",
    "p5_shares": _RUNS + """,
covered as (
  select distinct gid, unnest(range(a, a + n_rows)) as row_pos
  from (select gid_a as gid, start_a as a, n_rows from runs union all select gid_b, start_b, n_rows from runs)),
sizes as (select gid, count(distinct row_pos) as n_rows from instrument_records group by gid),
hits as (select gid, count(*) as n_shared from covered group by gid)
select gid, n_rows, coalesce(n_shared, 0) as n_shared, round(coalesce(n_shared, 0) / n_rows, 6) as share
from sizes left join hits using (gid)""",
    "p6_found": f"with recursive {_LINKED} select u as dataset_unit_key, min(w) as group_key from r group by u having count(distinct w) > 1",
    "p6_group_splits": f"""with recursive {_LINKED}, g as (select u, min(w) as key from r group by u),
s as (select distinct {_TIDY.format('dataset_unit_key')} as u from endpoint_labels union select distinct {_TIDY.format('outer_test_unit')} from prediction_ledger)
select coalesce(key, u) as group_key, count(*) as n_units, 1 as n_splits from s left join g using (u) where u is not null group by 1 having count(*) > 1""",
}
