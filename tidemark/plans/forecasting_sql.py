"""SQL checks of ``plans.forecasting``."""

from __future__ import annotations

_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def tidy(c: str) -> str:
    return f"lower(trim({c}, {_CHARS}))"


def pid(c: str) -> str:
    return f"regexp_replace({tidy(c)}, '^sha256:', '')"


EV = """ev as (
  select user_id as unit, row_number() over (partition by user_id order by ts, event_id) - 1 as event_index, value,
         coalesce(lag(ts) over (partition by user_id order by ts, event_id) = ts, false) as is_tie, count(*) over (partition by user_id) as n
  from events)"""
H = "(values (1), (2), (3)) as h(horizon)"
_F = lambda k: f"rows between {'unbounded' if k == 'all' else k - 1} preceding and current row"


def _line(y: str, k) -> str:
    w = f"over (partition by unit order by event_index {_F(k)})"
    return f"regr_slope({y}, event_index) {w} as s, avg(event_index) {w} as mx, avg({y}) {w} as my"


def _line_of(y: str, k, name: str) -> str:
    w = f"over (partition by unit order by event_index {_F(k)})"
    return f"regr_slope({y}, event_index) {w} as {name}_s, avg(event_index) {w} as {name}_x, avg({y}) {w} as {name}_y"


_LN = "case when value > 0 then ln(value) end"
FRAMES = f"""fr as (
  select unit, event_index, value, n, first_value(value) over (partition by unit order by event_index) as v0,
         lead(value, 1) over w as a1, lead(value, 2) over w as a2, lead(value, 3) over w as a3,
         min(value) over (partition by unit order by event_index {_F(4)}) as low4, min(value) over (partition by unit order by event_index {_F('all')}) as lowall,
         {_line_of('value', 2, 'l2')}, {_line_of('value', 3, 'l3')}, {_line_of('value', 4, 'l4')}, {_line_of(_LN, 4, 'e4')}, {_line_of(_LN, 'all', 'ea')}
  from ev window w as (partition by unit order by event_index)),
fh as (select *, case horizon when 1 then a1 when 2 then a2 else a3 end as actual from fr cross join {H} where event_index >= 3 and event_index < n - horizon)"""
_AT = "(event_index + horizon - {0}_x)"
POINTS = {
    "last_value": "value",
    "global_drift": "value + horizon * (value - v0) / event_index",
    "local_linear_2": f"l2_y + l2_s * {_AT.format('l2')}",
    "local_linear_3": f"l3_y + l3_s * {_AT.format('l3')}",
    "local_linear_4": f"l4_y + l4_s * {_AT.format('l4')}",
    "exponential_4": f"case when low4 > 0 then exp(e4_y + e4_s * {_AT.format('e4')}) end",
    "exponential_4_down": f"case when low4 > 0 then exp(e4_y + least(e4_s, 0.0) * {_AT.format('e4')}) end",
    "exponential_all": f"case when lowall > 0 then exp(ea_y + ea_s * {_AT.format('ea')}) end",
}


def preds(*names: str) -> str:
    parts = " union all ".join(f"select unit, event_index as origin, horizon, '{n}' as model, {POINTS[n]} as point, actual from fh" for n in names)
    return f"with {EV}, {FRAMES}, p as ({parts})"


def metrics(of: str) -> str:
    return f"""um as (
  select model, horizon, unit, count(*) as planned_count, count(point) as predicted_count, count(abs(actual - point)) as matured_count, count(*) - count(abs(actual - point)) as failed_count,
         case when count(*) = count(abs(actual - point)) then avg(abs(actual - point)) end as mae,
         case when count(*) = count(abs(actual - point)) then sqrt(avg((actual - point) * (actual - point))) end as rmse
  from {of} group by 1, 2, 3)"""


UNIT = """select model, horizon, unit, planned_count, predicted_count, matured_count, failed_count,
  case when failed_count > 0 then 'NA_planned_failure' else 'OK' end as metric_status, case when model like 'exponential%' then round(mae, 4) else round(mae, 10) end as mae, case when model like 'exponential%' then round(rmse, 4) else round(rmse, 10) end as rmse from um"""
MACRO = """select model, horizon, count(*) as n_units, cast(sum(planned_count) as bigint) as planned_count, cast(sum(failed_count) as bigint) as failed_count,
  round(case when count(*) = count(mae) then avg(mae) end, 10) as macro_mae, round(case when count(*) = count(rmse) then avg(rmse) end, 10) as macro_rmse from um group by 1, 2"""
ALL = tuple(POINTS)
STRESS = f"""st as (
  select distinct row_id, {tidy('dataset_unit_key')} as unit, event_index_0based as event_index, aging_time_h as time_h,
         case when isfinite(capacity_loss_pct) then capacity_loss_pct end as c, case when isfinite(esr_increase_pct) then esr_increase_pct end as r
  from stress2_events)"""
LEDGER = f"""pd as (
  select distinct {pid('prediction_id')} as prediction_id, {tidy('outer_test_unit')} as unit, model, target_name, horizon_event_steps as horizon, origin_event_index_0based as origin,
         expected_target_event_index_0based as target_index, point_prediction as point, status, config_hash, prediction_commit_seq, expected_label_available_seq, withdrawn_seq
  from prediction_ledger where prediction_id is not null),
pl as (select * from (select *, row_number() over (partition by prediction_id order by prediction_commit_seq nulls first, config_hash nulls first) as rn from pd) where rn = 1),
ld as (select distinct {pid('prediction_id')} as prediction_id, label_available_seq, row_id, actual from maturity_ledger where prediction_id is not null and {pid('prediction_id')} <> ''),
lb as (select prediction_id as lid, label_available_seq, actual from (select *, row_number() over (partition by prediction_id order by label_available_seq nulls first, row_id) as rn from ld) where rn = 1),
sc as (
  select pl.*, label_available_seq, actual, case when lid is null then 'NEVER_MATURED' when actual is null or isnan(actual) then 'LABEL_MISSING' else 'MATURED' end as maturity
  from pl left join lb on pl.prediction_id = lid)"""
LOSS = """lo as (select target_name as k, horizon as stratum, unit as cl, model as action_id, abs(actual - point) as loss from sc where maturity = 'MATURED' and point is not null),
sm as (select k, stratum, action_id, cl, avg(loss) as m from lo group by 1, 2, 3, 4),
s as (select k, stratum, action_id, count(*) as nc, avg(m) as mean, case when count(*) > 1 then stddev_samp(m) / sqrt(count(*)) else 0.0 end as se from sm group by 1, 2, 3),
gm as (select k, action_id, cl, avg(loss) as m from lo group by 1, 2, 3),
g as (select k, action_id, avg(m) as g, case when count(*) > 1 then stddev_samp(m) / sqrt(count(*)) else 0.0 end as se_g from gm group by 1, 2)"""
KEYS = "target_name, horizon, unit, origin"
FORE = f"fo as (select model, {KEYS}, point, point - abs(point) * 0.1 as lower, point as median, point + abs(point) * 0.1 as upper from pl)"
_M = ["last_value", "global_drift", "local_linear", "exponential", "local_trend_kf", "ridge"]
ACTIONS = f"""ba as (select * from (values {', '.join(f"('EMIT', '{m}')" for m in _M)}, {', '.join(f"('FUSE', 'w{i}')" for i in range(1, 6))}, ('FALLBACK', null)) as t(operator, reference_id)),
tr as (select transform, cast(parameter as double) as parameter from (values (null, null), ('SHIFT', -1.0), ('SHIFT', -0.5), ('SHIFT', 0.5), ('SHIFT', 1.0), ('INFLATE', 1.25), ('INFLATE', 1.5), ('INFLATE', 2.0)) as t(transform, parameter)),
ac as (
  select sha256(concat_ws('|', operator, coalesce(reference_id, '-'), coalesce(transform, '-'), coalesce(cast(cast(round(parameter * 100) as bigint) as varchar), '-'))) as action_id,
         operator, reference_id, transform, parameter, cast(case when transform is null then 1 else 2 end as bigint) as complexity
  from ba cross join tr)"""
ATOMS = "at1 as (select f || '=' || b as atom from (values ('age'), ('drift'), ('noise'), ('spread'), ('trend')) as x(f) cross join (values ('high'), ('low'), ('mid')) as y(b))"
PREDICATES = f"""{ATOMS}, pr as (
  select 'ATOM' as operator, atom as first, cast(null as varchar) as second from at1
  union all select o, a.atom, b.atom from at1 a join at1 b on sha256(a.atom) < sha256(b.atom) cross join (values ('AND'), ('OR')) as q(o))"""
_W = {"w1": [1, 0, 0, 0, 0, 0], "w2": [0, 1, 0, 0, 0, 0], "w3": [0.5, 0.5, 0, 0, 0, 0], "w4": None, "w5": [0.5, 0, 0, 0, 0, 0.5]}
WEIGHTS = "wt as (select t as template_id, m as model, cast(n as double) / cast(d as double) as w from (values " + ", ".join(
    f"('{t}', '{m}', {1 if ws is None else int(ws[i] * 2)}, {6 if ws is None else 2})" for t, ws in _W.items() for i, m in enumerate(_M)
) + ") as x(t, m, n, d))"
UNITS = f"""hv as (select distinct event_id, {tidy('dataset_unit_key')} as unit, event_index, measurements['capacity_ratio'] as value from hidden_events),
hs as (select unit, event_index, value from (select *, row_number() over (partition by unit, event_index order by event_id desc) as rn from hv where value is not null and isfinite(value)) where rn = 1),
own as (select unit, avg(d) as own from (select unit, abs(value - lag(value) over (partition by unit order by event_index)) as d from hs) group by unit having avg(d) is not null),
ts as (select unit, ((select sum(own) from own) - own) / ((select count(*) from own) - 1) as scale from own)"""
_PM = f"""with {LEDGER}, pv as (select concat_ws('/', model, target_name) as model, horizon, unit, point, actual from sc where maturity = 'MATURED' and point is not null), {metrics('pv')},
pb as (select horizon, unit, split_part(model, '/', 2) as target, mae as base from um where model like 'last_value/%'),
pj as (select um.model, um.horizon, base - mae as d from um join pb on um.horizon = pb.horizon and um.unit = pb.unit and split_part(model, '/', 2) = target where model not like 'last_value/%')
"""

ORACLE = {
    "trajectory_events": f"with {EV} select unit, event_index, round(value, 9) as value, is_tie from ev",
    "origin_grid": f"with {EV} select unit, event_index as origin, horizon from ev cross join {H} where event_index >= 3 and event_index < n - horizon",
    "window_features": f"""with {EV} select unit, event_index, round(value - lag(value) over w, 4) as first_difference, round(sum(value) over (partition by unit order by event_index), 4) as prefix_sum,
      max(value) over (partition by unit order by event_index rows between 2 preceding and current row) as trailing_max, lead(value, 2) over w as ahead from ev window w as (partition by unit order by event_index)""",
    "derived_ratios": """with x as (select distinct row_id, case when isfinite(capacity_loss_pct) then 1 - capacity_loss_pct / 100 end as c, case when isfinite(esr_increase_pct) then 1 + esr_increase_pct / 100 end as r from stress2_events)
      select row_id, round(c, 9) as capacity_ratio, round(r, 9) as esr_ratio, round(c, 9) as soh_capacity, round(case when r <> 0 then 1 / r end, 9) as soh_esr_inverse,
      round(case when c is not null and r is not null then least(greatest(least((c - 0.8::double) / 0.2::double, 2 - r), 0), 1) end, 9) as composite_health_margin from x""",
    "at_risk_flags": f"""with {STRESS}, f as (select *, min(case when c >= 20 then event_index end) over (partition by unit) as fc, min(case when r >= 100 then event_index end) over (partition by unit) as fr from st)
      select row_id, fc is null or event_index < fc as is_at_risk_capacity, fr is null or event_index < fr as is_at_risk_esr from f""",
    "interval_labels": f"""with {STRESS}, l as (select unit, event_index, time_h, e, th, v from st cross join lateral (values ('capacity_loss_20pct', 20.0, c), ('esr_increase_100pct', 100.0, r)) as q(e, th, v)),
      f as (select unit, e, th, min(case when v >= th then event_index end) as fi, max(event_index) as li, arg_max(time_h, event_index) filter (where time_h is not null) as lt0 from l group by 1, 2, 3),
      last1 as (select unit, event_index as li, any_value(time_h) as lt from st group by 1, 2),
      up as (select l.unit, l.e, any_value(l.time_h) as up from l join f on l.unit = f.unit and l.e = f.e and l.event_index = f.fi group by 1, 2),
      lo as (select l.unit, l.e, max(l.event_index) as lni from l join f on l.unit = f.unit and l.e = f.e where l.event_index < f.fi group by 1, 2),
      lot as (select l.unit, l.e, arg_max(l.time_h, l.event_index) filter (where l.time_h is not null) as lt from l join f on l.unit = f.unit and l.e = f.e where l.event_index < f.fi group by 1, 2)
      select f.unit, f.e as endpoint, case when fi is not null then 'interval_crossing' else 'right_censored' end as status, case when fi is not null then lot.lt end as lower_time_h, up.up as upper_time_h,
      lo.lni as last_non_crossing_index, fi as first_crossing_index, case when fi is null then f.lt0 end as censor_time_h, cast(th as double) as threshold
      from f left join up on f.unit = up.unit and f.e = up.e left join lo on f.unit = lo.unit and f.e = lo.e left join lot on f.unit = lot.unit and f.e = lot.e""",
    "unit_metrics": f"{preds(*ALL)}, {metrics('p')} {UNIT}",
    "macro_metrics": f"{preds(*ALL)}, {metrics('p')} {MACRO}",
    "last_value_macro_mae": f"{preds('last_value')}, q as (select * from p where horizon = 1), {metrics('q')} select model, horizon, n_units, planned_count, macro_mae from ({MACRO})",
    "drift_predictions": f"{preds('global_drift')} select unit, origin, horizon, model, round(point, 9) + 0.0::double as point, actual from p",
    "local_linear_predictions": f"{preds('local_linear_3')} select unit, origin, horizon, model, round(point, 9) + 0.0::double as point, actual from p",
    "exponential_predictions": f"{preds('exponential_4', 'exponential_4_down')} select unit, origin, horizon, model, round(point, 5) + 0.0::double as point, actual from p",
    "mase_scale_leave_one_out": f"""with {EV}, o as (select unit, avg(d) as own from (select unit, abs(value - lag(value) over (partition by unit order by event_index)) as d from ev) group by unit having avg(d) is not null)
      select unit, round(((select sum(own) from o) - own) / ((select count(*) from o) - 1), 9) as scale from o""",
    "skill_vs_last_value": f"""{preds(*ALL)}, {metrics('p')}, b as (select horizon as bh, unit as bu, mae as base from um where model = 'last_value')
      select model, horizon, unit, round(case when mae is not null and base > 0 then mae / base end, 9) as relative_mae, round(case when mae is not null and base > 0 then 1 - mae / base end, 9) as skill,
      case when mae is null then 'NA_failed' when base is null then 'NA_baseline_failed' when base = 0 then 'NA_zero_baseline' else 'OK' end as comparison_status from um left join b on horizon = bh and unit = bu""",
    "config_selection": f"""{preds('local_linear_2', 'local_linear_3', 'local_linear_4')}, {metrics('p')}, ma as (select horizon as grp, model as config, avg(mae) as score from um group by 1, 2)
      select grp, config, round(score, 9) as score from (select *, row_number() over (partition by grp order by score, config) as rn from ma) where rn = 1""",
    "nested_selection": f"""{preds(*ALL)}, {metrics('p')},
      g as (select regexp_extract(model, '^(last_value|global_drift|local_linear|exponential)', 1) as family, model as config, case when model like 'local_linear%' then cast(right(model, 1) as bigint) else length(model) end as ord, horizon, unit, mae from um),
      s as (select a.unit as outer_test_unit, a.family, a.horizon, a.config, a.ord, case when bool_and(b.mae is not null) then avg(b.mae) end as score from g a join g b on a.family = b.family and a.config = b.config and a.horizon = b.horizon and a.unit <> b.unit group by all),
      w as (select *, row_number() over (partition by outer_test_unit, family, horizon order by round(score, 9) nulls last, ord) as rn from s)
      select outer_test_unit, family, horizon, config, case when score is null then 'FAIL' else 'OK' end as status, case when family = 'exponential' then round(score, 3) else round(score, 9) end as inner_macro_mae, rn = 1 and score is not null as selected from w""",
    "residual_quantiles": f"""{preds('last_value')} select model, horizon, cast(level as double) as level, round(quantile_cont(actual - point, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])[i], 9) as "offset"
      from p cross join (values (1, 0.05), (2, 0.1), (3, 0.25), (4, 0.5), (5, 0.75), (6, 0.9), (7, 0.95)) as l(i, level) group by model, horizon, i, level""",
    "qualification": f"""{preds(*ALL)}, o as (select model, unit, origin, count(distinct horizon) as n, count(*) as m, bool_and(point is not null and isfinite(point)) as ok from p group by 1, 2, 3),
      u as (select model, unit, max(n) as hs, bool_and(n = m) as uk, bool_and(ok) as fin from o group by 1, 2) select model, count(*) as n_units, bool_and(fin) as finite, bool_and(uk) as unique_keys, bool_and(hs = 3) as complete from u group by 1""",
    "common_key_parity": f"with {LEDGER} select {KEYS}, count(distinct model) as n_models from pl group by all having count(distinct model) < (select count(distinct model) from pl)",
    "robust_scale": f"""with {EV}, d as (select unit, value - lag(value) over (partition by unit order by event_index) as d from ev), m as (select unit, quantile_cont(d, 0.5) as m, quantile_cont(abs(d), 0.5) as a from d where d is not null group by 1),
      s as (select d.unit, 1.4826 * quantile_cont(abs(d - m), 0.5) as s, max(a) as a from d join m using (unit) where d is not null group by 1) select unit, round(greatest(case when s > 0 then s else a end, 1e-8), 9) as scale from s""",
    "maturity_join": f"with {LEDGER} select prediction_id, unit, model, horizon, point, actual, label_available_seq from sc where maturity = 'MATURED'",
    "never_matured": f"with {LEDGER} select model, target_name, horizon, maturity, count(*) as n from sc group by all",
    "ledger_unit_metrics": f"with {LEDGER}, q as (select concat_ws('/', model, target_name) as model, horizon, unit, point, actual from sc), {metrics('q')} {UNIT}",
    "ledger_macro_metrics": f"with {LEDGER}, q as (select concat_ws('/', model, target_name) as model, horizon, unit, point, actual from sc), {metrics('q')} {MACRO}",
    "failure_ledger_dedup": f"""with f as (select distinct {pid('prediction_id')} as prediction_id, failure_stage, failure_seq, row_id, error_type from failure_ledger where prediction_id is not null and {pid('prediction_id')} <> '')
      select prediction_id, failure_stage, failure_seq, row_id, error_type from (select *, row_number() over (partition by prediction_id, failure_stage order by failure_seq nulls first, row_id) as rn from f) where rn = 1""",
    "duplicate_prediction_ids": f"with f as (select distinct {pid('prediction_id')} as prediction_id, row_id from maturity_ledger where prediction_id is not null and {pid('prediction_id')} <> '') select prediction_id, count(*) as count from f group by 1 having count(*) > 1",
    "target_lookup": f"""with {LEDGER}, he as (select distinct {tidy('dataset_unit_key')} as u, event_index, event_id, available_at from hidden_events),
      la as (select u, event_index, event_id from (select *, row_number() over (partition by u, event_index order by available_at desc nulls last, event_id desc) as rn from he) where rn = 1)
      select prediction_id, event_id, case when event_id is null then 'NO_EVENT' else 'FOUND' end as lookup from pl left join la on unit = u and target_index = event_index""",
    "cluster_mean_se": f'with {LEDGER}, {LOSS} select k as "key", stratum, action_id, nc as n_clusters, round(mean, 9) as mean, round(se, 9) as se from s',
    "enum_argmin": f"""with {LEDGER}, {LOSS}, sco as (select k, stratum, action_id, nc, case when nc < 5 then g + se_g else g + 0.5 * (mean - g) + se end + 0.01 as score from s join g using (k, action_id)),
      rk as (select *, row_number() over (partition by k, stratum order by score, action_id) as rn, bool_and(nc < 5) over (partition by k, stratum) as uq, count(*) over (partition by k, stratum) as na from sco)
      select k as "key", stratum, action_id, round(score, 9) as score, uq as stratum_unqualified, na as n_actions from rk where rn = 1""",
    "paired_t_moments": _PM + "select model, horizon, count(*) as n, round(case when count(*) > 1 then avg(d) end, 9) as mean, round(case when count(*) > 1 then stddev_samp(d) / sqrt(count(*)) end, 9) as se from pj where d is not null group by 1, 2",
    "holm_rejections": """with r as (select c_nationkey as family, c_custkey as member, abs(c_acctbal) / 1e6 as p, row_number() over (partition by c_nationkey order by abs(c_acctbal) / 1e6, c_custkey) as rn, count(*) over (partition by c_nationkey) as n from customer)
      select family, member, bool_and(p <= 0.05 / (n - rn + 1)) over (partition by family order by p, member) as rejected from r""",
    "action_space_96": f"with {ACTIONS} select * from ac",
    "action_space_19": f"with {ACTIONS} select * from ac where transform is null or operator = 'FALLBACK'",
    "arm_permissions": f"""with {ACTIONS}, m as (select 'H1' as arm, count(*) filter (where transform is null and operator = 'EMIT') as n_actions from ac union all select 'RF1', count(*) filter (where transform is null and operator = 'FUSE') from ac
      union all select 'RC1', count(*) filter (where operator = 'FALLBACK') from ac union all select a, count(*) filter (where transform is null or operator = 'FALLBACK') from ac cross join (values ('ACT1'), ('IF1')) as v(a) group by a
      union all select 'ACT_COMP96', count(*) from ac) select * from m""",
    "predicate_225": f"with {PREDICATES} select * from pr",
    "program_count": f"with {PREDICATES} select operator, count(*) * 19 * 18 as n_programs from pr group by 1 union all select 'NONE', 19",
    "convex_fusion": f"""with {LEDGER}, {FORE}, {WEIGHTS}, f as (
      select template_id, {KEYS}, count(*) as n, count(point) as nn, sum(w * point) as point, sum(w * lower) as lower, sum(w * median) as median, sum(w * upper) as upper from fo join wt using (model) group by all)
      select template_id, {KEYS}, {', '.join(f'round(case when n = 6 and n = nn then {c} end, 10) as {c}' for c in ('point', 'lower', 'median', 'upper'))}, case when n < 6 then 'INVALID_MISSING' when nn = 0 then 'NA' when nn < n then 'INVALID_MIXED' else 'NUMERIC' end as status from f""",
    "emit_shift_inflate": f"""with {LEDGER}, {FORE}, {UNITS} select model, {KEYS}, round(point, 10) as point, round(point + 0.5 * scale, 10) as shifted_point, round(lower + 0.5 * scale, 10) as shifted_lower, round(median + 0.5 * scale, 10) as shifted_median,
      round(upper + 0.5 * scale, 10) as shifted_upper, round(point - 1.5 * (point - lower), 10) as inflated_lower, round(point + 1.5 * (upper - point), 10) as inflated_upper, coalesce(lower <= median and median <= upper and point between lower and upper, false) as is_valid
      from fo join ts using (unit)""",
    "all_or_fallback": f"""with {LEDGER}, b as (select *, max(case when model = 'last_value' then point end) over (partition by {KEYS}) as fb, bool_and(point is not null) over (partition by model, unit, origin) as ok from pl)
      select prediction_id, ok as bundle_ok, round(case when ok then point else fb end, 9) as executed from b""",
    "median_bundle": f"with {LEDGER}, {FORE} select {KEYS}, count(*) as n_members, {', '.join(f'round(quantile_cont({c}, 0.5), 10) as {c}' for c in ('point', 'lower', 'median', 'upper'))} from fo group by {KEYS}",
    "fallback_weights": f"""with {LEDGER}, e as (select concat_ws('/', target_name, horizon) as grp, model, avg(abs(actual - point)) as e from sc where maturity = 'MATURED' and point is not null group by 1, 2)
      select grp, model, case when row_number() over (partition by grp order by e, model) = 1 then 1.0 else 0.0 end as weight from e""",
    "disagreement_route": f"with {LEDGER}, {FORE} select {KEYS}, round(max(point) - min(point), 9) as spread, case when max(point) - min(point) > 0.05 then 'REVIEW' else 'NUMERIC_ONLY' end as route from fo group by {KEYS}",
}
