"""Trajectory, forecast and scoring queries, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import actions as A
from tidemark.operators import forecast as M
from tidemark.operators import candidates, orphans, profile, scoring, stats
from tidemark.operators import series as S
from tidemark.runtime import table, tidy

CONTEXT, HORIZONS = 4, [1, 2, 3]
ENDPOINTS = {"capacity_loss_20pct": ("capacity_loss_pct", 20.0), "esr_increase_100pct": ("esr_increase_pct", 100.0)}


def _r(c: str, digits: int = 9):
    return F.round(F.col(c), digits).alias(c)


def _steady(c: str):
    """Errors of exponential forecasts reach thousands, where ten digits would show the order of summation."""
    return F.when(F.col("model").startswith("exponential"), F.round(c, 4)).otherwise(F.round(c, 10)).alias(c)


def users(spark, d: str) -> DataFrame:
    return S.trajectories(table(spark, d, "events"), "user_id", "ts", "event_id", "value")


def stress(spark, d: str) -> DataFrame:
    """Stress readings with unit, event index and hours; values that are not finite as null."""
    df = table(spark, d, "stress2_events").select(
        "row_id", tidy("dataset_unit_key").alias("unit"), F.col("event_index_0based").cast("long").alias("event_index"), F.col("aging_time_h").alias("time_h"),
        *[F.when(S.finite(c), F.col(c)).alias(c) for c in ("capacity_loss_pct", "esr_increase_pct")],
    )
    return df.distinct()


def trajectory_events(spark, d):
    return users(spark, d).select("unit", "event_index", _r("value"), "is_tie")


def origin_grid(spark, d):
    return S.origins(users(spark, d), CONTEXT, HORIZONS)


def window_features(spark, d):
    w = S.by_event()
    return users(spark, d).select(
        "unit", "event_index", F.round(F.col("value") - F.lag("value").over(w), 4).alias("first_difference"), F.round(F.sum("value").over(w), 4).alias("prefix_sum"),
        F.max("value").over(w.rowsBetween(-2, 0)).alias("trailing_max"), F.lead("value", 2).over(w).alias("ahead"),
    )


def derived_ratios(spark, d):
    df = table(spark, d, "stress2_events").select("row_id", "capacity_loss_pct", "esr_increase_pct").distinct()
    return S.derived_ratios(df).select("row_id", *[_r(c) for c in ("capacity_ratio", "esr_ratio", "soh_capacity", "soh_esr_inverse", "composite_health_margin")])


def at_risk_flags(spark, d):
    df = S.at_risk(S.at_risk(stress(spark, d), "capacity_loss_pct", 20.0, "is_at_risk_capacity"), "esr_increase_pct", 100.0, "is_at_risk_esr")
    return df.select("row_id", "is_at_risk_capacity", "is_at_risk_esr")


def interval_labels(spark, d):
    return S.interval_labels(stress(spark, d), ENDPOINTS)


def window_predictions(spark, d) -> DataFrame:
    s = users(spark, d)
    models = {
        "last_value": M.last_value(), "global_drift": M.global_drift(), "local_linear_2": M.local_linear(2), "local_linear_3": M.local_linear(3), "local_linear_4": M.local_linear(4),
        "exponential_4": M.exponential(4), "exponential_4_down": M.exponential(4, "down"), "exponential_all": M.exponential("all"),
    }
    return M.predict(s, models, CONTEXT, HORIZONS)


def _predictions(*names: str, digits: int = 9):
    def q(spark, d):
        s = users(spark, d)
        points = {"global_drift": M.global_drift, "local_linear_3": lambda: M.local_linear(3), "exponential_4": lambda: M.exponential(4), "exponential_4_down": lambda: M.exponential(4, "down"), "last_value": M.last_value}
        out = M.predict(s, {n: points[n]() for n in names}, CONTEXT, HORIZONS)
        return out.select("unit", "origin", "horizon", "model", (F.round("point", digits) + F.lit(0.0)).alias("point"), "actual")

    return q


def unit_metrics(spark, d):
    m = scoring.unit_metrics(window_predictions(spark, d))
    return m.select("model", "horizon", "unit", "planned_count", "predicted_count", "matured_count", "failed_count", "metric_status", _steady("mae"), _steady("rmse"))


def macro_metrics(spark, d):
    m = scoring.macro(scoring.unit_metrics(window_predictions(spark, d)), ["mae", "rmse"])
    return m.select("model", "horizon", "n_units", "planned_count", "failed_count", _r("macro_mae", 10), _r("macro_rmse", 10))


def _mase(spark, d) -> DataFrame:
    return scoring.with_mase(scoring.unit_metrics(window_predictions(spark, d)), scoring.training_scale(users(spark, d)))


def unit_mase(spark, d):
    return _mase(spark, d).select("model", "horizon", "unit", F.when(F.col("model").startswith("exponential"), F.round("mase", 4)).otherwise(F.round("mase", 10)).alias("mase"))


def macro_mase(spark, d):
    return scoring.macro(_mase(spark, d), ["mase"]).select("model", "horizon", "n_units", "planned_count", "failed_count", _r("macro_mase", 10))


def last_value_macro_mae(spark, d):
    p = M.predictions(users(spark, d), "last_value", M.last_value(), CONTEXT, [1])
    return scoring.macro(scoring.unit_metrics(p), ["mae"]).select("model", "horizon", "n_units", "planned_count", _r("macro_mae", 10))


def mase_scale_leave_one_out(spark, d):
    return scoring.training_scale(users(spark, d)).select("unit", _r("scale"))


def skill_vs_last_value(spark, d):
    m = scoring.with_skill(scoring.unit_metrics(window_predictions(spark, d)))
    return m.select("model", "horizon", "unit", _r("relative_mae"), _r("skill"), "comparison_status")


def config_selection(spark, d):
    m = scoring.macro(scoring.unit_metrics(window_predictions(spark, d).filter("model like 'local_linear%'")), ["mae"])
    errors = m.select(F.col("horizon").alias("grp"), F.col("model").alias("config"), F.substring("model", -1, 1).cast("long").alias("config_order"), F.col("macro_mae").alias("score"))
    return scoring.select_config(errors).select("grp", "config", _r("score"))


def nested_selection(spark, d):
    """Outer folds by configurations of all window models, scored on inner folds."""
    m = scoring.unit_metrics(window_predictions(spark, d))
    family = F.regexp_extract("model", "^(last_value|global_drift|local_linear|exponential)", 1)
    grid = m.select(family.alias("family"), F.col("model").alias("config"), F.length("model").cast("long").alias("len"), "horizon", "unit", "mae")
    order = F.when(F.col("family") == "local_linear", F.substring("config", -1, 1).cast("long")).otherwise(F.col("len"))
    out = scoring.nested_selection(grid.withColumn("config_order", order).drop("len"))
    score = F.when(F.col("family") == "exponential", F.round("inner_macro_mae", 3)).otherwise(F.round("inner_macro_mae", 9))
    return out.select("outer_test_unit", "family", "horizon", "config", "status", score.alias("inner_macro_mae"), "selected")


def residual_quantiles(spark, d):
    p = M.predictions(users(spark, d), "last_value", M.last_value(), CONTEXT, HORIZONS)
    return M.residual_quantiles(p, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]).select("model", "horizon", "level", F.round("offset", 9).alias("offset"))


def qualification(spark, d):
    return M.qualification(window_predictions(spark, d), HORIZONS).groupBy("model").agg(F.count("*").alias("n_units"), F.bool_and("finite").alias("finite"), F.bool_and("unique_keys").alias("unique_keys"), F.bool_and("complete").alias("complete"))


def common_key_parity(spark, d):
    """Ledger keys that some model lacks."""
    return scoring.unequal_keys(ledger_predictions(spark, d), "model", ("target_name", "horizon", "unit", "origin"))


def kalman_predictions(spark, d):
    return M.kalman_predictions(users(spark, d), HORIZONS, CONTEXT)


def rls_predictions(spark, d):
    return M.rls_predictions(users(spark, d), HORIZONS, CONTEXT)


def ridge_predictions(spark, d):
    return M.ridge_predictions(users(spark, d))


def particle_predictions(spark, d):
    return M.particle_predictions(users(spark, d), [1], CONTEXT)


def elastic_net_predictions(spark, d):
    return candidates.direct_predictions(users(spark, d), "elastic_net")


def theta_predictions(spark, d):
    return candidates.smoothing_predictions(users(spark, d), "theta", HORIZONS, CONTEXT)


def holt_predictions(spark, d):
    return candidates.smoothing_predictions(users(spark, d), "holt", HORIZONS, CONTEXT)


def robust_scale(spark, d):
    return profile.robust_scale(users(spark, d), "unit", "event_index", "value").select("unit", _r("scale"))


# --- the project's own ledgers -------------------------------------------------------


def ledger_predictions(spark, d) -> DataFrame:
    df = table(spark, d, "prediction_ledger").select(
        orphans.record_id("prediction_id").alias("prediction_id"), tidy("outer_test_unit").alias("unit"), "model", "target_name", F.col("horizon_event_steps").alias("horizon"),
        F.col("origin_event_index_0based").alias("origin"), F.col("expected_target_event_index_0based").alias("target_index"), F.col("point_prediction").alias("point"),
        "status", "config_hash", "prediction_commit_seq", "expected_label_available_seq", "withdrawn_seq",
    )
    return scoring.keep_first(df.filter("prediction_id is not null").distinct(), ["prediction_id"], ["prediction_commit_seq", "config_hash"])


def ledger_labels(spark, d) -> DataFrame:
    """One label per prediction: the first one logged for it."""
    df = table(spark, d, "maturity_ledger").select(orphans.record_id("prediction_id").alias("prediction_id"), "label_available_seq", "row_id", "actual").filter("prediction_id is not null and prediction_id <> ''").distinct()
    return scoring.keep_first(df, ["prediction_id"], ["label_available_seq", "row_id"])


def ledger_scored(spark, d) -> DataFrame:
    return scoring.mature(ledger_predictions(spark, d), ledger_labels(spark, d), "prediction_id")


def maturity_join(spark, d):
    return ledger_scored(spark, d).filter("maturity = 'MATURED'").select("prediction_id", "unit", "model", "horizon", "point", "actual", "label_available_seq")


def never_matured(spark, d):
    return ledger_scored(spark, d).groupBy("model", "target_name", "horizon", "maturity").agg(F.count("*").alias("n"))


def ledger_unit_metrics(spark, d):
    s = ledger_scored(spark, d).withColumn("model", F.concat_ws("/", "model", "target_name"))
    m = scoring.unit_metrics(s)
    return m.select("model", "horizon", "unit", "planned_count", "predicted_count", "matured_count", "failed_count", "metric_status", _steady("mae"), _steady("rmse"))


def ledger_macro_metrics(spark, d):
    s = ledger_scored(spark, d).withColumn("model", F.concat_ws("/", "model", "target_name"))
    m = scoring.macro(scoring.unit_metrics(s), ["mae", "rmse"])
    return m.select("model", "horizon", "n_units", "planned_count", "failed_count", _r("macro_mae", 10), _r("macro_rmse", 10))


def failure_ledger_dedup(spark, d):
    df = table(spark, d, "failure_ledger").select(orphans.record_id("prediction_id").alias("prediction_id"), "failure_stage", "failure_seq", "row_id", "error_type").filter("prediction_id is not null and prediction_id <> ''").distinct()
    return scoring.keep_first(df, ["prediction_id", "failure_stage"], ["failure_seq", "row_id"])


def duplicate_prediction_ids(spark, d):
    return scoring.assert_unique(table(spark, d, "maturity_ledger").select(orphans.record_id("prediction_id").alias("prediction_id"), "row_id").filter("prediction_id is not null and prediction_id <> ''").distinct(), ["prediction_id"])


def target_lookup(spark, d):
    """Each prediction with the event at exactly origin + horizon, the latest known revision of it."""
    events = table(spark, d, "hidden_events").select(tidy("dataset_unit_key").alias("unit"), F.col("event_index").alias("target_index"), "event_id", "available_at").distinct()
    last = events.groupBy("unit", "target_index").agg(F.max(F.struct("available_at", "event_id")).alias("e"))
    return ledger_predictions(spark, d).join(last, ["unit", "target_index"], "left").select("prediction_id", F.col("e.event_id").alias("event_id"), F.when(F.col("e").isNull(), "NO_EVENT").otherwise("FOUND").alias("lookup"))


def losses(spark, d) -> DataFrame:
    return ledger_scored(spark, d).filter("maturity = 'MATURED' and point is not null").select(
        F.col("target_name").alias("key"), F.col("horizon").alias("stratum"), F.col("unit").alias("cluster"), F.col("model").alias("action_id"), F.lit(1).alias("complexity"), F.abs(F.col("actual") - F.col("point")).alias("loss")
    )


def cluster_mean_se(spark, d):
    return A.cluster_mean_se(losses(spark, d), ["key", "stratum", "action_id"], "cluster", "loss").select("key", "stratum", "action_id", "n_clusters", _r("mean"), _r("se"))


def enum_argmin(spark, d):
    return A.best_action(losses(spark, d), 5, 0.5, 1.0, 0.01).select("key", "stratum", "action_id", _r("score"), "stratum_unqualified", "n_actions")


def _paired(spark, d) -> DataFrame:
    m = scoring.unit_metrics(ledger_scored(spark, d).withColumn("model", F.concat_ws("/", "model", "target_name")).filter("maturity = 'MATURED' and point is not null"))
    base = m.filter("model like 'last_value/%'").select("horizon", "unit", F.split("model", "/")[1].alias("target"), F.col("mae").alias("base"))
    m = m.filter("model not like 'last_value/%'").withColumn("target", F.split("model", "/")[1])
    return m.join(base, ["horizon", "unit", "target"])


def paired_t_moments(spark, d):
    return stats.paired_moments(_paired(spark, d), ["model", "horizon"], "base", "mae").select("model", "horizon", "n", _r("mean"), _r("se"))


def paired_t_decisions(spark, d):
    t = stats.paired_t(stats.paired_moments(_paired(spark, d), ["model", "horizon"], "base", "mae"))
    return stats.holm(t, "horizon", "p_one_sided", "model")


def holm_rejections(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("family"), F.col("c_custkey").alias("member"), (F.abs("c_acctbal") / 1e6).alias("p"))
    return stats.holm(c, "family", "p", "member").select("family", "member", "rejected")


def clopper_pearson(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("successes"), F.count("*").alias("trials"))
    return stats.clopper_pearson(e, "successes", "trials")


def design_simulation_cells(spark, d):
    return stats.design_cells(stats.simulate(spark, harm=-0.05))


# --- forecast actions ----------------------------------------------------------------

MODEL_NAMES = ["last_value", "global_drift", "local_linear", "exponential", "local_trend_kf", "ridge"]
TEMPLATES = {"w1": [1, 0, 0, 0, 0, 0], "w2": [0, 1, 0, 0, 0, 0], "w3": [0.5, 0.5, 0, 0, 0, 0], "w4": [1 / 6] * 6, "w5": [0.5, 0, 0, 0, 0, 0.5]}
FKEY = ["target_name", "horizon", "unit", "origin"]


def forecasts(spark, d) -> DataFrame:
    """Point forecasts of the ledger with an interval of a tenth of their size around each."""
    p = ledger_predictions(spark, d)
    half = F.abs("point") * 0.1
    return p.select("model", *FKEY, "point", (F.col("point") - half).alias("lower"), F.col("point").alias("median"), (F.col("point") + half).alias("upper"))


def _spaces(spark):
    return A.action_space(A.base_actions(spark, MODEL_NAMES, list(TEMPLATES)))


def _actions(df):
    return df.select("action_id", "operator", "reference_id", "transform", "parameter", F.col("complexity").cast("long").alias("complexity"))


def action_space_96(spark, d):
    return _actions(_spaces(spark))


def action_space_19(spark, d):
    return _actions(A.primary_space(_spaces(spark)))


FEATURES = {f: ["high", "low", "mid"] for f in ("age", "drift", "noise", "spread", "trend")}


def predicate_225(spark, d):
    return A.predicates(spark, FEATURES)


def program_count(spark, d):
    return A.programs(A.primary_space(_spaces(spark)), A.predicates(spark, FEATURES)).groupBy(F.coalesce("operator", F.lit("NONE")).alias("operator")).agg(F.count("*").alias("n_programs"))


def arm_permissions(spark, d):
    return candidates.permitted_actions(_spaces(spark)).groupBy("arm").agg(F.count("*").alias("n_actions"))


def weights(spark) -> DataFrame:
    return spark.createDataFrame([(t, m, float(w)) for t, ws in TEMPLATES.items() for m, w in zip(MODEL_NAMES, ws, strict=True)], "template_id string, model string, weight double")


def convex_fusion(spark, d):
    return A.fuse(forecasts(spark, d), weights(spark), FKEY).select("template_id", *FKEY, *[_r(c, 10) for c in A.FIELDS], "status")


def emit_shift_inflate(spark, d):
    f = forecasts(spark, d).join(scoring.training_scale(users_of_ledger(spark, d)), "unit")
    s, i = A.shift(F.col("scale"), 0.5), A.inflate(1.5)
    return f.select("model", *FKEY, _r("point", 10), *[F.round(s[c], 10).alias(f"shifted_{c}") for c in A.FIELDS], *[F.round(i[c], 10).alias(f"inflated_{c}") for c in ("lower", "upper")], A.valid_forecast().alias("is_valid"))


def users_of_ledger(spark, d) -> DataFrame:
    """Capacity ratios of held-out units as series, the latest revision of each event."""
    e = table(spark, d, "hidden_events").select(tidy("dataset_unit_key").alias("unit"), F.col("event_index"), "event_id", F.col("measurements")["capacity_ratio"].alias("value")).filter(S.finite("value")).dropDuplicates(["event_id"])
    return scoring.keep_first(e.withColumn("_o", -F.col("event_id")), ["unit", "event_index"], ["_o"]).select("unit", "event_index", "value")


def all_or_fallback(spark, d):
    p = ledger_predictions(spark, d)
    base = F.first(F.when(F.col("model") == "last_value", F.col("point")), ignorenulls=True).over(Window.partitionBy(*FKEY))
    out = A.all_or_fallback(p.withColumn("fallback_point", base), ["model", "unit", "origin"], F.col("point").isNotNull())
    return out.select("prediction_id", "bundle_ok", _r("executed"))


def median_bundle(spark, d):
    return A.median_bundle(forecasts(spark, d), FKEY).select(*FKEY, "n_members", *[_r(c, 10) for c in A.FIELDS])


def fallback_weights(spark, d):
    e = losses(spark, d).select(F.concat_ws("/", "key", "stratum").alias("grp"), F.col("action_id").alias("model"), F.lit(1).alias("complexity"), F.col("loss").alias("error"))
    return A.lowest_error_weights(e)


def disagreement_route(spark, d):
    g = forecasts(spark, d).groupBy(*FKEY).agg((F.max("point") - F.min("point")).alias("spread"))
    return g.select(*FKEY, _r("spread"), A.route(F.col("spread"), 0.05).alias("route"))


QUERIES = {
    f.__name__: f
    for f in (
        trajectory_events, origin_grid, window_features, derived_ratios, at_risk_flags, interval_labels, unit_metrics, macro_metrics, unit_mase, macro_mase, last_value_macro_mae, mase_scale_leave_one_out, skill_vs_last_value,
        config_selection, nested_selection, residual_quantiles, qualification, common_key_parity, kalman_predictions, rls_predictions, ridge_predictions, particle_predictions, elastic_net_predictions, theta_predictions, holt_predictions, robust_scale, arm_permissions, maturity_join, never_matured,
        ledger_unit_metrics, ledger_macro_metrics, failure_ledger_dedup, duplicate_prediction_ids, target_lookup, cluster_mean_se, enum_argmin, paired_t_moments, paired_t_decisions, holm_rejections,
        clopper_pearson, design_simulation_cells, action_space_96, action_space_19, predicate_225, program_count, convex_fusion, emit_shift_inflate, all_or_fallback, median_bundle, fallback_weights, disagreement_route,
    )
} | {
    "drift_predictions": _predictions("global_drift"),
    "local_linear_predictions": _predictions("local_linear_3"),
    "exponential_predictions": _predictions("exponential_4", "exponential_4_down", digits=5),
}
