"""SQL checks of ``plans.audits``."""

from __future__ import annotations

from tidemark.plans.forecasting_sql import pid, tidy

REC = "r as (select distinct * from instrument_records)"
_BOTH = "c0 is not null and c1 is not null and s0 is not null and s1 is not null and t0 is not null and t1 is not null and n0 is not null and n1 is not null and u0 is not null and u1 is not null"
_MOVED = "(c0 <> c1 or t0 <> t1 or s0 <> s1)"
COUNTERS = {
    "valid_adjacent_pairs": "true", "record_nonunit": "n1 - n0 <> 1", "record_repeats": "n1 = n0", "record_backwards": "n1 < n0", "record_forward_gaps": "n1 - n0 > 1", "cycle_backwards": "c1 < c0", "step_changes": _MOVED,
    "time_decreases": "u1 < u0", "same_step_time_decreases": f"not {_MOVED} and u1 < u0", "adjacent_duplicate_keys": f"not {_MOVED} and n1 = n0 and u1 = u0",
}
_SUMS = ", ".join(f"count(*) filter (where {_BOTH} and {c}) as {n}" for n, c in COUNTERS.items())
CHRON = f"""{REC}, e as (
  select gid, row_pos, cycle_no as c1, step_no as t1, status_code as s1, record_number as n1, time_us as u1, lag(cycle_no) over w as c0, lag(step_no) over w as t0, lag(status_code) over w as s0, lag(record_number) over w as n0, lag(time_us) over w as u0
  from r window w as (partition by gid order by row_pos))"""
_COUNT = f"""count(*) as n_rows, count(*) filter (where c1 is null or t1 is null or s1 is null or n1 is null or u1 is null) as invalid_key_rows, count(*) filter (where c1 < 0 or t1 < 0 or n1 < 0) as negative_identifier_rows, {_SUMS},
  cast(coalesce(sum(case when {_BOTH} and n1 - n0 > 1 then n1 - n0 - 1 end), 0) as bigint) as missing_record_numbers"""
SEG = f"""{REC}, a as (select *, case when lag(cycle_no) over w = cycle_no and lag(step_no) over w = step_no and lag(status_code) over w = status_code then 0 else 1 end as nw,
    lag(time_us) over w as pt, lag(voltage_v) over w as pv, lag(current_ma) over w as pc, lag(capacity_mah) over w as pq from r window w as (partition by gid order by row_pos)),
  b as (select *, cast(sum(nw) over (partition by gid order by row_pos) - 1 as bigint) as segment from a),
  sg as (select gid as grp, segment, min(cycle_no) as cycle_no, min(step_no) as step_no, min(status_code) as status_code, count(*) as n_rows, min(row_pos) as first_row, max(row_pos) as last_row, min(current_ma + 0.0) as current_min, max(current_ma + 0.0) as current_max,
    count(*) filter (where current_ma > 0) as positive_rows, count(*) filter (where current_ma < 0) as negative_rows, count(*) filter (where current_ma = 0) as zero_rows, count(*) filter (where nw = 0 and time_us < pt) as time_decreases,
    count(*) filter (where nw = 0 and time_us = pt) as equal_time_pairs, count(*) filter (where nw = 0 and voltage_v > pv) as voltage_increases, count(*) filter (where nw = 0 and voltage_v < pv) as voltage_decreases,
    count(*) filter (where nw = 0 and current_ma <> pc) as current_changes, count(*) filter (where nw = 0 and capacity_mah < pq) as charge_decreases, arg_min(time_us, row_pos) as first_time, arg_max(time_us, row_pos) as last_time,
    arg_min(voltage_v, row_pos) as first_voltage, arg_max(voltage_v, row_pos) as last_voltage, arg_max(capacity_mah, row_pos) as last_charge, max(case when row_pos = mx then energy_mwh end) as last_energy, count(*) filter (where energy_mwh is null) as energy_missing_rows
    from (select *, max(row_pos) over (partition by gid, segment) as mx from b) group by 1, 2)"""
SUMM = "su as (select gid as grp, cycle_no, step_no, status_code, count(distinct 1) as n, max(time_us) as st, max(capacity_mah) as sc, max(energy_mwh) as se, arg_min(voltage_v, row_pos) as sfv, arg_max(voltage_v, row_pos) as slv from r group by 1, 2, 3, 4)"
ORD = "o as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders)"
CHAIN = """o as (
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) as rn,
         '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' as payload from orders),
h(o_custkey, o_orderkey, rn, st, pri, payload, prev, hash) as (
  select o_custkey, o_orderkey, rn, o_orderstatus, o_orderpriority, payload, repeat('0', 64), sha256(repeat('0', 64) || chr(10) || payload) from o where rn = 1
  union all select o.o_custkey, o.o_orderkey, o.rn, o.o_orderstatus, o.o_orderpriority, o.payload, h.hash, sha256(h.hash || chr(10) || o.payload) from o join h on o.o_custkey = h.o_custkey and o.rn = h.rn + 1)"""
_V = "array_agg(cast(embedding[i] as double))"
TOK = "k as (select gid as grp, row_pos as pos, row(status_code, time_us, voltage_v + 0.0, current_ma + 0.0, capacity_mah + 0.0) as token from r)"
PAIRS = "f as (select distinct digest, gid as grp, row_offset as pos from fingerprints), fp as (select a.digest, a.grp as grp_a, a.pos as pos_a, b.grp as grp_b, b.pos as pos_b from f a join f b on a.digest = b.digest and a.grp < b.grp)"
_PROFILE = " union all ".join(
    f"select '{c}' as field, count(*) as n_rows, count(*) filter (where {c} is null) as null_count, count(*) filter (where isnan({c})) as nan_count, count(*) filter (where {c} = 'inf'::double) as pos_inf_count, count(*) filter (where {c} = '-inf'::double) as neg_inf_count, "
    f"count(*) filter (where isfinite({c})) as finite_count, min({c}) filter (where isfinite({c})) as min_value, max({c}) filter (where isfinite({c})) as max_value, min(abs({c})) filter (where isfinite({c})) as min_abs, max(abs({c})) filter (where isfinite({c})) as max_abs from p"
    for c in ("aging_time_h", "capacity_loss_pct", "esr_increase_pct", "composite_health_margin")
)
SHINGLES = """w as (select distinct doc_id, i - 1 as pos, ws[i] as token from (select doc_id, string_split(text, ' ') as ws from (select any_value(text) as text, doc_id from documents where doc_id is not null group by doc_id)) cross join lateral unnest(range(1, len(ws) + 1)) as u(i)),
sh as (select doc_id as grp, pos, sha256(array_to_string([token, t1, t2, t3, t4, t5, t6, t7], chr(10))) as digest from (
  select *, lead(token, 1) over v as t1, lead(token, 2) over v as t2, lead(token, 3) over v as t3, lead(token, 4) over v as t4, lead(token, 5) over v as t5, lead(token, 6) over v as t6, lead(token, 7) over v as t7 from w window v as (partition by doc_id order by pos)) where t7 is not null)"""

ORACLE = {
    "chronology_counters": f"with {CHRON} select gid as grp, {_COUNT} from e group by 1",
    "chronology_merge": f"""with {CHRON} select gid as grp, {_COUNT}, cast(max(row_pos // 128) - min(row_pos // 128) as bigint) as block_boundaries,
      count(*) filter (where row_pos % 128 = 0 and row_pos > 0 and {_BOTH} and n1 - n0 <> 1) as nonunit_record_boundaries, count(*) filter (where row_pos % 128 = 0 and row_pos > 0 and not ({_BOTH})) as invalid_key_boundaries from e group by 1""",
    "segment_evidence": f"with {SEG} select * from sg",
    "segment_summary_join": f"""with {SEG}, {SUMM}, g as (select grp, cycle_no, step_no, status_code, count(*) as ns, min(first_time) as ft, min(last_time) as lt, min(last_charge) as lc, min(last_energy) as le, max(energy_missing_rows) as em, min(first_voltage) as fv, min(last_voltage) as lv from sg group by 1, 2, 3, 4)
      select grp, cycle_no, step_no, status_code, case when coalesce(ns, 0) > 1 or coalesce(n, 0) > 1 then 'AMBIGUOUS_KEY' when ns is null then 'SUMMARY_ONLY' when n is null then 'RECORD_ONLY' else 'UNIQUE_KEY_OBSERVATION' end as status, coalesce(ns, 0) as n_segments, coalesce(n, 0) as n_summaries,
      case when ns = 1 and n = 1 then st - lt end as minus_last_time, case when ns = 1 and n = 1 then st - (lt - ft) end as minus_elapsed, round(case when ns = 1 and n = 1 then sc - lc end, 6) as minus_last_charge, round(case when ns = 1 and n = 1 and em = 0 then se - le end, 6) as minus_last_energy,
      round(case when ns = 1 and n = 1 then sfv - fv end, 6) as minus_first_voltage, round(case when ns = 1 and n = 1 then slv - lv end, 6) as minus_last_voltage from g full join su using (grp, cycle_no, step_no, status_code)""",
    "cycle_sign_buckets": f"""with {SEG}, q as (select *, case when positive_rows = n_rows then 'p' when negative_rows = n_rows then 'n' when zero_rows = n_rows then 'z' else 'm' end as sign from sg),
      s as (select grp, cycle_no, count(*) as n_segments, count(*) filter (where sign = 'p') as n_positive, count(*) filter (where sign = 'n') as n_negative, count(*) filter (where sign = 'z') as n_zero, count(*) filter (where sign = 'm') as n_mixed, sum(last_charge) filter (where sign = 'p') as cs, sum(last_charge) filter (where sign = 'n') as ds from q group by 1, 2),
      c as (select gid as grp, cycle_no, max(capacity_mah) filter (where current_ma > 0) as ch, max(capacity_mah) filter (where current_ma < 0) as di from r group by 1, 2)
      select grp, cycle_no, n_segments, n_positive, n_negative, n_zero, n_mixed, 1 as n_summaries, round(ch - cs, 6) as charge_difference, round(di - ds, 6) as discharge_difference from s join c using (grp, cycle_no)""",
    "status_chains": f"""with {REC}, a as (select gid, row_pos, status_code as s, lag(status_code) over (partition by gid order by row_pos) as p from r), b as (select *, lead(s) over (partition by gid order by row_pos) as f from a where p is null or p <> s)
      select p as predecessor, s as status, f as follower, count(*) as n_runs from b group by 1, 2, 3""",
    "time_gap_audit": """with a as (select user_id as grp, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) as g from events), m as (select grp, quantile_cont(g, 0.5) filter (where g > 1e-7) as md from a group by 1)
      select grp, count(*) as n_rows, count(*) filter (where g < -1e-7) as reversal_count, count(*) filter (where abs(g) <= 1e-7) as duplicate_count, count(*) filter (where g > 1e-7 and abs(g - md) > 60) as irregular_gap_count, round(max(md), 3) as median_gap, round(min(g), 3) as min_gap, round(max(g), 3) as max_gap
      from a join m using (grp) group by 1""",
    "cycle_axis_audit": f"""with {REC}, a as (select gid as grp, cycle_no as c, cycle_no - lag(cycle_no) over (partition by gid order by row_pos) as s from r)
      select grp, count(distinct c) as n_distinct, count(*) filter (where s = 0) as repeat_count, count(*) filter (where s < 0) as reversal_count, count(*) filter (where s > 1) as jump_count, max(c) - min(c) + 1 - count(distinct c) as missing_count from a group by 1""",
    "lineitem_axis_audit": """with a as (select l_orderkey as grp, cast(l_linenumber as bigint) as c, l_linenumber - lag(l_linenumber) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey) as s from lineitem)
      select grp, count(distinct c) as n_distinct, count(*) filter (where s = 0) as repeat_count, count(*) filter (where s < 0) as reversal_count, count(*) filter (where s > 1) as jump_count, max(c) - min(c) + 1 - count(distinct c) as missing_count from a group by 1""",
    "finite_profile": f"with p as (select distinct row_id, aging_time_h, capacity_loss_pct, esr_increase_pct, composite_health_margin from stress2_events) {_PROFILE}",
    "missingness_geometry": """with a as (select distinct event_id, [measurements['capacity_ratio'], measurements['esr_ratio'], measurements['case_temp_c']] as v from hidden_events), b as (select event_id as id, list_transform(v, lambda x: x is null or isnan(x)) as m from a),
      c as (select id, m[1]::int as a, m[2]::int as b, m[3]::int as c from b)
      select id, 3 as n_values, a + b + c as n_missing, a + (case when b = 1 and a = 0 then 1 else 0 end) + (case when c = 1 and b = 0 then 1 else 0 end) as n_runs, a + b + c > 0 as any_missing, a + b + c = 3 as all_missing, a <= b and b <= c as finite_prefix from c""",
    "trajectory_signature_dups": f"""with a as (select distinct {tidy('dataset_unit_key')} as unit, event_index_0based as i, row_id, cast(round(case when abs(capacity_loss_pct) < 1e12 then capacity_loss_pct end * 10000) as bigint) as v from stress2_events),
      s as (select unit, string_agg(i || '|' || coalesce(cast(v as varchar), '-'), ',' order by i, row_id) as sig from a group by 1), c as (select sig, min(unit) as class_key, count(*) as n_members from s group by 1) select unit, class_key, n_members from s join c using (sig)""",
    "exact_duplicates": "with c as (select text, min(doc_id) as class_key, count(distinct doc_id) as n_members from documents where text is not null group by 1) select distinct doc_id, class_key, n_members from documents join c using (text)",
    "near_duplicates": """with v0 as (select vec_id, i, cast(embedding[i] as double) as x from embeddings, unnest(range(1, 65)) as u(i)), v as (from v0 union all select vec_id + 1000000000, i, x * 1.000002 from v0), p as (select a.vec_id as id_a, b.vec_id as id_b, corr(a.x, b.x) as r, sqrt(avg((a.x - b.x) ** 2)) / greatest(sqrt(avg((a.x * a.x + b.x * b.x) / 2)), 1e-300) as nrmse
      from v a join v b on a.i = b.i and a.vec_id < b.vec_id group by 1, 2) select id_a, id_b, round(r, 6) as r, round(nrmse, 6) as nrmse from p where r >= 0.999999 and nrmse <= 1e-5""",
    "shingle_hashes": f"with {SHINGLES} select grp, pos, digest from sh",
    "winnow_words": f"""with {SHINGLES}, n as (select *, row_number() over (partition by grp order by pos) as rn, count(*) over (partition by grp) as n, min(digest) over (partition by grp order by pos rows between 24 preceding and current row) as m from sh),
      z as (select grp, pos as at, m from n where rn >= 25 or (n < 25 and rn = n)) select distinct z.grp, max(sh.pos) as pos, z.m as digest from z join sh on sh.grp = z.grp and sh.digest = z.m and sh.pos between z.at - 24 and z.at group by z.grp, z.at, z.m""",
    "fingerprint_pairs": f"with {PAIRS} select lower(hex(digest)) as digest, grp_a, pos_a, grp_b, pos_b from fp",
    "confirmed_spans": f"""with {REC}, {TOK}, {PAIRS}, s as (select grp_a, grp_b, pos_a, pos_b, sh from (select distinct grp_a, grp_b, pos_a, pos_b from fp) cross join unnest(range(-24, 32)) as u(sh)),
      e as (select grp_a, grp_b, pos_a, pos_b, sh from s join k a on a.grp = grp_a and a.pos = pos_a + sh join k b on b.grp = grp_b and b.pos = pos_b + sh where a.token = b.token),
      i as (select *, sh - row_number() over (partition by grp_a, grp_b, pos_a, pos_b order by sh) as isle from e)
      select distinct grp_a, pos_a + lo as start_a, grp_b, pos_b + lo as start_b, hi - lo + 1 as n_rows from (select grp_a, grp_b, pos_a, pos_b, isle, min(sh) as lo, max(sh) as hi from i group by all) where lo <= 0 and hi >= 0 and hi - lo + 1 >= 32""",
    "source_spans": """with g as (select distinct split_part(container, '/', 1) as grp, cast(split_part(container, '/', 2) as bigint) as fragment, coalesce(n_rows, 0) as n_rows from record_groups)
      select grp, fragment, cast(sum(n_rows) over w - n_rows as bigint) as lo, cast(sum(n_rows) over w as bigint) as hi from g window w as (partition by grp order by fragment)""",
    "hash_chain": f"with recursive {CHAIN} select o_orderkey, rn as row_number, payload as row_payload_json, prev as prev_row_hash, hash as row_hash from h",
    "hash_chain_verify": f"with recursive {CHAIN} select o_custkey, rn as row_number, false as bad_link, true as bad_hash from h where st = 'P' and pri like '1%'",
    "causal_barrier_violations": f"""with p0 as (select distinct {pid('prediction_id')} as id, prediction_commit_seq as cs, cast(expected_target_event_index_0based as varchar) as ch from prediction_ledger where prediction_id is not null),
      p as (select * from (select *, row_number() over (partition by id order by cs nulls first, ch nulls first) as rn from p0) where rn = 1), m as (select distinct {pid('prediction_id')} as id, row_id, cast(target_event_index_0based as varchar) as rh, label_available_seq as rs from maturity_ledger where prediction_id is not null),
      v as (select case when ch is null then 'NO_CHECKPOINT' when ch <> rh then 'HASH_MISMATCH' when cs >= rs then 'REVEALED_BEFORE_COMMIT' end as violation from m left join p using (id) where id <> '') select violation, count(*) as n_rows from v where violation is not null group by 1""",
    "status_precedence": """with o as (select o_custkey, case when o_orderstatus = 'F' then 3 when o_orderstatus = 'O' then 2 when o_orderpriority like '1%' then 0 end as k from orders) select o_custkey, coalesce(['FAIL', 'BLOCKED', 'AMBER', 'PASS'][min(k) + 1], 'BLOCKED') as status from o group by 1""",
    "generation_grid": f"""with p as (select distinct {tidy('outer_test_unit')} as unit, model, target_name, horizon_event_steps from prediction_ledger), m as (select distinct model, target_name, horizon_event_steps from p),
      u as (select distinct {tidy('dataset_unit_key')} as unit from endpoint_labels), g as (select unit, model, target_name, horizon_event_steps from u cross join m)
      select *, 'MISSING' as problem from (from g except from p) union all select *, 'UNPLANNED' from (from p except from g)""",
    "listing_diff": f"""with {REC}, f as (select gid, count(*) as n from r group by 1), e as (select distinct gid, n_rows from record_groups)
      select gid, case when n is null then 'MISSING' when e.gid is null then 'UNEXPECTED' else 'CHANGED' end as kind, case when n is not null and e.gid is not null then 'n_rows' end as changed_fields from e full join f using (gid) where n is null or e.gid is null or n is distinct from n_rows""",
    "path_groups": "select regexp_extract(container, '^([a-z]+[0-9]+)/', 1) as batch, count(*) as n_containers, string_agg(container, ';' order by container) as containers from (select distinct container, n_rows from record_groups) group by 1",
    "clock_parse": f"""with {REC} select gid, row_pos, (time_us // 3600000000) || ':' || lpad(cast(time_us // 60000000 % 60 as varchar), 2, '0') || ':' || lpad(cast(time_us // 1000000 % 60 as varchar), 2, '0') || '.' || lpad(cast(time_us % 1000000 as varchar), 6, '0') as clock, time_us as parsed_us from r""",
}
