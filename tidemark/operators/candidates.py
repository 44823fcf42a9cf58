"""More forecast candidates: direct learners on prefix features, Theta, Holt; permissions and late results.

AutoARIMA is left out: its order search needs a library that is not there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.forecast import fold_of, streamed
from tidemark.operators.series import by_event

FEATURES = ["last", "global_slope", "local_slope", "curvature", "robust_step", "n_seen", "local_min", "local_max"]
LOCAL = 5
#: What each arm may choose.
ARMS = [
    ("N0", "NONE", 0), ("D1_RAW", "DIRECT_BUNDLE", 0), ("D1_PACKET", "DIRECT_BUNDLE", 0), ("H1", "EMIT_ONLY", 6), ("RF1", "FUSE_ONLY", 5), ("RC1", "CHAMPION_CORRECTION", 8),
    ("ACT1", "PRIMARY_ACTION", 19), ("IF1", "IF_REPRESENTATION", 19), ("ACT_COMP96", "COMPOSITIONAL_ACTION", 96),
]


def prefix_features(series: DataFrame, horizon: int, context: int = LOCAL) -> DataFrame:
    """``unit, origin, value, actual, y, FEATURES`` from each prefix of at least five events; window expressions throughout."""
    w = by_event()
    seen, local = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - LOCAL, 0)
    x = F.col("event_index").cast("double")
    s = series.withColumn("d", F.col("value") - F.lag("value").over(w)).withColumn("d1", F.lag("d").over(w)).withColumn("ds", F.collect_list("d").over(local))
    mid = lambda a: F.element_at(F.array_sort(a), F.floor(F.size(a) / 2).cast("int") + 1)
    s = s.withColumn("m", F.when(F.size("ds") > 0, mid(F.col("ds")))).withColumn("mad", F.when(F.size("ds") > 0, mid(F.transform("ds", lambda v: F.abs(v - F.col("m"))))))
    ahead = F.lead("value", horizon).over(w)
    out = s.select(
        "unit", F.col("event_index").alias("origin"), "value", ahead.alias("actual"), (ahead - F.col("value")).alias("y"), F.col("value").alias("last"), F.regr_slope("value", x).over(seen).alias("global_slope"),
        F.regr_slope("value", x).over(local).alias("local_slope"), (F.col("d") - F.col("d1")).alias("curvature"), F.col("mad").alias("robust_step"), (x + 1).alias("n_seen"), F.min("value").over(local).alias("local_min"), F.max("value").over(local).alias("local_max"),
    )
    return out.filter((F.col("origin") >= max(context, LOCAL) - 1) & F.col("actual").isNotNull())


def direct_predictions(series: DataFrame, kind: str, horizon: int = 1, folds: int = 4, seed: int = 0, iterations: int = 100) -> DataFrame:
    """Direct forecasts by ``elastic_net`` or ``boosted`` trees; a unit's model never saw its fold. Each training unit weighs the same."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    rows = prefix_features(series, horizon).dropna(subset=FEATURES).withColumn("fold", fold_of("unit", folds)).withColumn("wt", 1.0 / F.count("*").over(Window.partitionBy("unit")))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(rows).cache()
    out = None
    for f in range(folds):  # a fixed, small number of distributed fits
        train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        if train.isEmpty() or test.isEmpty():
            continue
        scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(train)
        if kind == "elastic_net":
            learner = LinearRegression(labelCol="y", weightCol="wt", regParam=1e-3, elasticNetParam=0.5, standardization=False, predictionCol="step")
        elif kind == "boosted":
            learner = GBTRegressor(labelCol="y", weightCol="wt", maxIter=iterations, stepSize=0.05, maxDepth=3, seed=seed, predictionCol="step")
        else:
            raise KeyError(kind)
        p = learner.fit(scaler.transform(train)).transform(scaler.transform(test))
        p = p.select("unit", "origin", F.lit(horizon).alias("horizon"), F.lit(kind).alias("model"), (F.col("value") + F.col("step")).alias("point"), "actual")
        out = p if out is None else out.unionByName(p)
    return out if out is not None else series.select("unit", F.col("event_index").alias("origin"), F.lit(horizon).alias("horizon"), F.lit(kind).alias("model"), F.col("value").alias("point"), F.col("value").alias("actual")).limit(0)


class Theta:
    """Smoothed level plus half the slope of the prefix.

    Levels of several smoothing weights run side by side; the one with the least one-step
    error so far speaks.
    """

    def __init__(self, alphas: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> None:
        self.alphas, self.seen = np.array(alphas), 0
        self.errors = np.zeros(len(alphas))
        self.sums = np.zeros(4)  # of index, value, index * value, index squared

    def feed(self, y: float) -> None:
        i = float(self.seen)
        self.sums += (i, y, i * y, i * i)
        if self.seen:
            self.errors += (y - self.levels) ** 2
            self.levels = self.levels + self.alphas * (y - self.levels)
        else:
            self.levels = np.full(len(self.alphas), y)
        self.seen += 1

    def points(self, horizons: list[int]) -> list[float]:
        n, (sx, sy, sxy, sxx) = self.seen, self.sums
        den = n * sxx - sx * sx
        drift = (n * sxy - sx * sy) / den / 2 if den > 0 else 0.0
        k = int(self.errors.argmin())
        a = self.alphas[k]
        return [float(self.levels[k] + drift * (h - 1 + 1 / a - (1 - a) ** n / a)) for h in horizons]


class Holt:
    """Damped additive trend; a grid of weights runs side by side, the least one-step error so far speaks."""

    def __init__(self, grid: tuple[float, ...] = (0.2, 0.5, 0.8), damp: float = 0.98) -> None:
        self.a, self.b = (g.ravel() for g in np.meshgrid(grid, grid, indexing="ij"))
        self.damp, self.seen = damp, 0
        self.errors = np.zeros(len(self.a))

    def feed(self, y: float) -> None:
        if self.seen:
            guess = self.level + self.damp * self.trend
            gap = y - guess
            self.errors += gap * gap
            self.level, self.trend = guess + self.a * gap, self.damp * self.trend + self.a * self.b * gap
        else:
            self.level, self.trend = np.full(len(self.a), y), np.zeros(len(self.a))
        self.seen += 1

    def points(self, horizons: list[int]) -> list[float]:
        k = int(self.errors.argmin())
        return [float(self.level[k] + self.trend[k] * sum(self.damp**j for j in range(1, h + 1))) for h in horizons]


def smoothing_predictions(series: DataFrame, kind: str, horizons: list[int], context: int) -> DataFrame:
    """``theta`` or ``holt`` forecasts of all origins."""
    machine = {"theta": Theta, "holt": Holt}[kind]
    return streamed(series.select("unit", "event_index", "value"), lambda row: machine(), kind, horizons, context)


def permitted_actions(space: DataFrame) -> DataFrame:
    """``arm, action_id`` for every action an arm may choose from an action space of 96."""
    spark: SparkSession = space.sparkSession
    arms = spark.createDataFrame(ARMS, "arm string, permission string, cardinality int")
    plain, fallback = F.col("transform").isNull(), F.col("operator") == "FALLBACK"
    may = (
        F.when(F.col("permission") == "EMIT_ONLY", plain & (F.col("operator") == "EMIT")).when(F.col("permission") == "FUSE_ONLY", plain & (F.col("operator") == "FUSE"))
        .when(F.col("permission") == "CHAMPION_CORRECTION", fallback).when(F.col("permission").isin("PRIMARY_ACTION", "IF_REPRESENTATION"), plain | fallback)
        .when(F.col("permission") == "COMPOSITIONAL_ACTION", F.lit(True)).otherwise(False)
    )
    return space.crossJoin(F.broadcast(arms)).filter(may).select("arm", "action_id")  # 96 actions by nine arms


def committed(attempts: DataFrame, fallback: DataFrame) -> DataFrame:
    """What is committed per slot: the first started attempt's value if it came valid and in time, else the fallback.

    ``attempts``: ``slot, attempt, started_at, finished_at, deadline, valid, value``; ``fallback``: ``slot, fallback_value``.
    A slot is consumed by its first attempt; what comes later, or late, never replaces what was committed.
    """
    first = attempts.withColumn("_rn", F.row_number().over(Window.partitionBy("slot").orderBy("started_at", "attempt"))).filter("_rn = 1")
    j = fallback.join(first, "slot", "left")
    reason = F.when(F.col("attempt").isNull(), "NOT_STARTED").when(F.col("finished_at").isNull(), "PROVIDER_FAILURE").when(F.col("finished_at") > F.col("deadline"), "LATE_RESPONSE").when(~F.coalesce("valid", F.lit(False)), "INVALID_RESPONSE").otherwise("VERIFIED_RESPONSE")
    return j.select("slot", reason.alias("reason"), F.when(reason == "VERIFIED_RESPONSE", F.col("value")).otherwise(F.col("fallback_value")).alias("value"))
