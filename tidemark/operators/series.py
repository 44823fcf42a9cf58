"""Trajectories: event order, derived ratios, crossing labels, origins and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = (Window.unboundedPreceding, Window.unboundedFollowing)


def by_event(unit: str = "unit", idx: str = "event_index") -> Window:
    return Window.partitionBy(unit).orderBy(idx)


def trajectories(df: DataFrame, unit: str, time: str, tie: str, value: str) -> DataFrame:
    """``unit, event_index, ts, value, is_tie``: dense 0-based order by (time, tie) per unit."""
    w = Window.partitionBy(unit).orderBy(time, tie)
    return df.select(
        F.col(unit).alias("unit"), (F.row_number().over(w) - 1).cast("long").alias("event_index"), F.col(time).alias("ts"), F.col(value).alias("value"),
        F.coalesce(F.lag(time).over(w) == F.col(time), F.lit(False)).alias("is_tie"),
    )


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def derived_ratios(df: DataFrame, loss: str = "capacity_loss_pct", rise: str = "esr_increase_pct") -> DataFrame:
    """Health columns from percent losses; null where the inputs are not finite, so nothing non-finite spreads."""
    c = F.when(finite(loss), 1 - F.col(loss) / 100)
    r = F.when(finite(rise), 1 + F.col(rise) / 100)
    return df.withColumns(
        {
            "capacity_ratio": c, "esr_ratio": r, "soh_capacity": c, "soh_esr_inverse": F.when(r != 0, 1 / r),
            "composite_health_margin": F.when(c.isNotNull() & r.isNotNull(), F.least(F.greatest(F.least((c - 0.8) / 0.2, 2 - r), F.lit(0.0)), F.lit(1.0))),
        }
    )


def first_crossing(df: DataFrame, value: str, threshold: float, unit: str = "unit", idx: str = "event_index") -> Column:
    """Index of the unit's first value at or over the threshold; null if it never gets there."""
    return F.min(F.when(F.col(value) >= threshold, F.col(idx))).over(Window.partitionBy(unit))


def at_risk(df: DataFrame, value: str, threshold: float, name: str) -> DataFrame:
    """True before the first crossing."""
    first = first_crossing(df, value, threshold)
    return df.withColumn(name, first.isNull() | (F.col("event_index") < first))


def interval_labels(df: DataFrame, endpoints: dict[str, tuple[str, float]]) -> DataFrame:
    """Interval-censored first crossings per unit and endpoint.

    ``df`` has ``unit, event_index, time_h`` and the measures. A crossing lies in
    (last time without it, first time with it]; a unit that never crosses is censored at
    its last event. One pass of conditional aggregates serves all endpoints.
    """
    aggs = [F.max("event_index").alias("last_idx"), F.max_by("time_h", "event_index").alias("last_time")]
    for k, (value, threshold) in enumerate(endpoints.values()):
        aggs.append(F.min(F.when(F.col(value) >= threshold, F.struct("event_index", "time_h"))).alias(f"x{k}"))
    firsts = df.groupBy("unit").agg(*aggs)
    long = firsts.select(
        "unit", "last_idx", "last_time",
        F.explode(F.array(*[F.struct(F.lit(n).alias("endpoint"), F.lit(t).alias("threshold"), F.col(f"x{k}").alias("x")) for k, (n, (_, t)) in enumerate(endpoints.items())])).alias("e"),
    ).select("unit", "last_idx", "last_time", "e.endpoint", "e.threshold", F.col("e.x.event_index").alias("first_idx"), F.col("e.x.time_h").alias("upper_time"))
    before = df.select("unit", F.col("event_index").alias("i"), F.col("time_h").alias("t"))
    hit = long.filter("first_idx is not null").join(before, "unit").filter("i < first_idx").groupBy("unit", "endpoint").agg(F.max_by("t", "i").alias("lower_time"), F.max("i").alias("last_non_crossing"))
    out = long.join(hit, ["unit", "endpoint"], "left")
    crossed = F.col("first_idx").isNotNull()
    return out.select(
        "unit", "endpoint", F.when(crossed, "interval_crossing").otherwise("right_censored").alias("status"), F.when(crossed, F.col("lower_time")).alias("lower_time_h"), F.when(crossed, F.col("upper_time")).alias("upper_time_h"),
        F.col("last_non_crossing").alias("last_non_crossing_index"), F.col("first_idx").alias("first_crossing_index"), F.when(~crossed, F.col("last_time")).alias("censor_time_h"), "threshold",
    )


def origins(series: DataFrame, context: int, horizons: list[int]) -> DataFrame:
    """``unit, origin, horizon`` of every forecast that has ``context`` events behind and its target ahead."""
    n = F.count("*").over(Window.partitionBy("unit"))
    grid = series.withColumn("n", n).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return grid.filter((F.col("event_index") >= context - 1) & (F.col("event_index") < F.col("n") - F.col("horizon"))).select("unit", F.col("event_index").alias("origin"), "horizon")
