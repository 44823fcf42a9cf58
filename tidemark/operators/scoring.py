"""Maturing and scoring forecasts with strict handling of what is missing.

Planned keys are the denominator. One failed key nulls its unit's metrics, one null unit
nulls the macro metric, and macro metrics are means of unit means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["model", "horizon", "unit"]


def strict_avg(value: str | Column, ok: Column) -> Column:
    """Average, or null as soon as one row is not ok."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.count_if(~ok) == 0, F.avg(v))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a sound ledger gives no rows."""
    return df.groupBy(*keys).count().filter("count > 1")


def mature(planned: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Planned forecasts with their label; ``maturity`` is MATURED, LABEL_MISSING or NEVER_MATURED."""
    seen = labels.withColumn("_seen", F.lit(True))
    out = planned.join(seen, key, "left")
    return out.withColumn("maturity", F.when(F.col("_seen").isNull(), "NEVER_MATURED").when(F.col("actual").isNull() | F.isnan("actual"), "LABEL_MISSING").otherwise("MATURED")).drop("_seen")


def unit_metrics(scored: DataFrame) -> DataFrame:
    """Per model, horizon and unit from ``model, horizon, unit, point, actual``; a null point or actual is a failure."""
    err = F.abs(F.col("actual") - F.col("point"))
    ok = err.isNotNull() & ~F.isnan(err)
    return scored.groupBy(*KEY).agg(
        F.count("*").alias("planned_count"), F.count_if(F.col("point").isNotNull()).alias("predicted_count"), F.count_if(ok).alias("matured_count"), F.count_if(~ok).alias("failed_count"),
        strict_avg(err, ok).alias("mae"), F.sqrt(strict_avg(err * err, ok)).alias("rmse"),
    ).withColumn("metric_status", F.when(F.col("failed_count") > 0, "NA_planned_failure").otherwise("OK"))


def training_scale(series: DataFrame) -> DataFrame:
    """``unit, scale``: mean over all other units of their mean absolute first difference.

    The leave-one-out mean is (total - own) / (n - 1), so no unit is joined to every other.
    """
    d = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("unit").orderBy("event_index")))
    per = series.withColumn("d", d).groupBy("unit").agg(F.avg("d").alias("own")).filter("own is not null")
    total = per.agg(F.sum("own").alias("total"), F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(total)).filter("n > 1").select("unit", ((F.col("total") - F.col("own")) / (F.col("n") - 1)).alias("scale"))  # one row


def with_mase(metrics: DataFrame, scales: DataFrame) -> DataFrame:
    """``mase`` beside the unit metrics: MAE by the unit's ``training_scale``; null where either is missing or the scale is zero."""
    s = scales.select("unit", "scale")
    return metrics.join(s, "unit", "left").withColumn("mase", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale"))).drop("scale")


def with_skill(metrics: DataFrame, baseline: str = "last_value") -> DataFrame:
    """Relative error and skill against the baseline of the same horizon and unit, with a status for its gaps.

    The baseline's row is one of its partition's rows, so a window takes the place of a
    self-join and the metrics are computed once.
    """
    base = F.max(F.when(F.col("model") == baseline, F.col("mae"))).over(Window.partitionBy("horizon", "unit"))
    out = metrics.withColumn("base_mae", base)
    good = F.col("mae").isNotNull() & F.col("base_mae").isNotNull() & (F.col("base_mae") > 0)
    return out.select(
        *metrics.columns, "base_mae", F.when(good, F.col("mae") / F.col("base_mae")).alias("relative_mae"), F.when(good, 1 - F.col("mae") / F.col("base_mae")).alias("skill"),
        F.when(F.col("mae").isNull(), "NA_failed").when(F.col("base_mae").isNull(), "NA_baseline_failed").when(F.col("base_mae") == 0, "NA_zero_baseline").otherwise("OK").alias("comparison_status"),
    )


def macro(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Unweighted means over units; a null in any unit makes the column null."""
    aggs = [strict_avg(c, F.col(c).isNotNull()).alias(f"macro_{c}") for c in columns]
    return metrics.groupBy("model", "horizon").agg(
        F.count("*").alias("n_units"), F.sum("planned_count").cast("long").alias("planned_count"), F.sum("failed_count").cast("long").alias("failed_count"), *aggs
    )


def select_config(errors: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """Per group the first configuration whose score no other beats by more than ``tolerance``.

    ``errors`` has ``grp, config, config_order, score``; null scores (failed configurations)
    never win. Walking in order and moving on a strict improvement by the tolerance ends at
    the first configuration within the tolerance of the running best; ties of floating
    sums are settled by the order.
    """
    step = lambda acc, x: F.when(acc["score"].isNull() | (x["score"] < acc["score"] - F.lit(tolerance)), x).otherwise(acc)
    sorted_ = errors.filter("score is not null").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("config_order", "config", "score"))).alias("c"))  # a grid of configurations is fixed and small
    start = F.struct(F.lit(None).cast("long").alias("config_order"), F.lit(None).cast("string").alias("config"), F.lit(None).cast("double").alias("score"))
    return sorted_.select("grp", F.aggregate("c", start, step).alias("w")).select("grp", F.col("w.config").alias("config"), F.col("w.score").alias("score"))


def nested_selection(metrics: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Every configuration in every outer fold with its inner score, and which one the fold takes.

    ``metrics`` has ``family, config, config_order, horizon, unit, mae`` of forecasts that rest on
    their own prefix alone. In the fold that holds a unit out, a configuration scores the
    mean over the other units, each of them once the validation unit; one that failed on any
    of them is FAIL there and never taken. As such forecasts do not change with the fold,
    all folds follow from one sum: rows are units times configurations, not folds squared.
    """
    key = ["family", "config", "config_order", "horizon"]
    sums = metrics.groupBy(*key).agg(F.sum("mae").alias("_t"), F.count_if(F.col("mae").isNull()).alias("_bad"), F.count("*").alias("_n"))
    own_bad = F.when(F.col("mae").isNull(), 1).otherwise(0)
    sound = (F.col("_bad") - own_bad == 0) & (F.col("_n") > 1)
    score = F.when(sound, (F.col("_t") - F.coalesce("mae", F.lit(0.0))) / (F.col("_n") - 1))
    each = metrics.join(sums, key).select("unit", "family", "horizon", F.struct("config_order", "config", score.alias("score")).alias("_c"))
    grid = each.groupBy("unit", "family", "horizon").agg(F.sort_array(F.collect_list("_c")).alias("_c"))  # a family's configurations are few
    step = lambda acc, x: F.when(x["score"].isNotNull() & (acc["score"].isNull() | (x["score"] < acc["score"] - F.lit(tolerance))), x).otherwise(acc)
    none = F.struct(F.lit(None).cast("long").alias("config_order"), F.lit(None).cast("string").alias("config"), F.lit(None).cast("double").alias("score"))
    won = grid.withColumn("_w", F.aggregate("_c", none, step)["config"]).withColumn("_c", F.explode("_c"))
    return won.select(
        F.col("unit").alias("outer_test_unit"), "family", "horizon", "_c.config", F.when(F.col("_c.score").isNull(), "FAIL").otherwise("OK").alias("status"), F.col("_c.score").alias("inner_macro_mae"),
        F.coalesce(F.col("_c.config") == F.col("_w"), F.lit(False)).alias("selected"),
    )


def unequal_keys(planned: DataFrame, model: str = "model", keys: tuple[str, ...] = ("horizon", "unit", "origin")) -> DataFrame:
    """Keys that not every model has: empty if all models share one key set."""
    n = planned.select(model).distinct().count()
    return planned.groupBy(*keys).agg(F.count_distinct(model).alias("n_models")).filter(F.col("n_models") < n)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def budget(df: DataFrame, most: int) -> DataFrame:
    """The frame itself, or an error if it has more than ``most`` rows: a budget fails, it never cuts."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df
