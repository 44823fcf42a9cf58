"""Forecasts from revealed prefixes: window models as expressions, fold models by Arrow.

Every model reads events up to its origin only. last_value, global_drift, local_linear and
exponential are window expressions and stay in the JVM. The Kalman, recursive
least-squares and particle folds carry a state along the series while its rows stream
through in Arrow batches; ridge uses leave-group-out sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import by_event

MODELS = ["last_value", "global_drift", "local_linear", "exponential", "local_trend_kf", "ridge"]
#: The configurations each model is tried with, in the order that settles ties.
CONFIGS = {
    "last_value": [{}],
    "global_drift": [{}],
    "local_linear": [{"window": k} for k in (2, 3, 4)],
    "exponential": [{"window": w, "direction": d} for w in (4, "all") for d in ("none", "physical")],
    "local_trend_kf": [{"q_level": a, "q_slope": b, "r": r} for a in (1e-4, 1e-2) for b in (1e-4, 1e-2) for r in (1e-2, 1.0)],
    "ridge": [{"window": k, "alpha": a} for k in (2, 3, 4) for a in (1e-4, 1e-2, 1.0, 1e2)],
}


Point = Callable[[Column], Column]  # horizon -> forecast, over the rows of one series


def last_value() -> Point:
    return lambda h: F.col("value")


def global_drift() -> Point:
    """Last value plus the mean step of the whole prefix."""
    start = F.first("value").over(by_event())
    step = F.when(F.col("event_index") > 0, (F.col("value") - start) / F.col("event_index")).otherwise(0.0)
    return lambda h: F.col("value") + h * step


def _line(y: Column, window: int | str) -> tuple[Column, Column, Column]:
    """Slope, mean place and mean height of the least-squares line through the last ``window`` events."""
    w = by_event().rowsBetween(Window.unboundedPreceding if window == "all" else 1 - int(window), 0)
    x = F.col("event_index").cast("double")
    full = F.count("*").over(w)
    slope = F.when(full > 1, F.regr_slope(y, x).over(w)).otherwise(0.0)
    return slope, F.avg(x).over(w), F.avg(y).over(w)


def local_linear(window: int) -> Point:
    slope, x, y = _line(F.col("value"), window)
    return lambda h: y + slope * (F.col("event_index") + h - x)


def exponential(window: int | str, direction: str | None = None) -> Point:
    """Line through logarithms; ``direction`` 'down' or 'up' clips the slope. Null if any value in the frame is not positive."""
    slope, x, y = _line(F.ln(F.when(F.col("value") > 0, F.col("value"))), window)
    w = by_event().rowsBetween(Window.unboundedPreceding if window == "all" else 1 - int(window), 0)
    if direction:
        slope = F.least(slope, F.lit(0.0)) if direction == "down" else F.greatest(slope, F.lit(0.0))
    return lambda h: F.when(F.min("value").over(w) > 0, F.exp(y + slope * (F.col("event_index") + h - x)))


def predict(series: DataFrame, models: dict[str, Point], context: int, horizons: list[int]) -> DataFrame:
    """``unit, origin, horizon, model, point, actual`` of window models, which see the prefix only.

    All models and horizons share one sort of the bare series: every forecast is a column
    of one projection, and rows are multiplied only after the windows.
    """
    w = by_event()
    cols = {f"_a{h}": F.lead("value", h).over(w) for h in horizons} | {f"_t{h}": F.lead("event_index", h).over(w) for h in horizons}
    cols |= {f"_p{k}_{h}": point(F.lit(h)) for k, point in enumerate(models.values()) for h in horizons}
    wide = series.select("unit", "event_index", *[c.alias(n) for n, c in cols.items()]).filter(F.col("event_index") >= context - 1)
    cells = [F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"), F.col(f"_p{k}_{h}").alias("point"), F.col(f"_a{h}").alias("actual"), F.col(f"_t{h}").isNotNull().alias("there")) for k, m in enumerate(models) for h in horizons]
    long = wide.select("unit", F.col("event_index").alias("origin"), F.explode(F.array(*cells)).alias("c")).filter("c.there")
    return long.select("unit", "origin", "c.horizon", "c.model", "c.point", "c.actual")


def predictions(series: DataFrame, model: str, point: Point, context: int, horizons: list[int]) -> DataFrame:
    """``predict`` for one model."""
    return predict(series, {model: point}, context, horizons)


class Kalman:
    """Two-state local trend; fed one value at a time, it forecasts from what it has seen."""

    def __init__(self, scale: float, q_level: float, q_slope: float, r: float) -> None:
        self.var, self.q_level, self.q_slope, self.r = scale * scale, q_level, q_slope, r
        self.seen = 0

    def feed(self, y: float) -> None:
        var = self.var
        if not self.seen:
            self.level, self.slope, self.a, self.b, self.c = y, 0.0, 10 * var, 0.0, 10 * var
        else:
            if self.seen == 1:
                self.slope = y - self.level
            self.level += self.slope
            self.a, self.b, self.c = self.a + 2 * self.b + self.c + var * self.q_level, self.b + self.c, self.c + var * self.q_slope
            s = self.a + var * self.r
            k0, k1, gap = self.a / s, self.b / s, y - self.level
            self.level, self.slope = self.level + k0 * gap, self.slope + k1 * gap
            self.a, self.b, self.c = (1 - k0) * self.a, (1 - k0) * self.b, self.c - k1 * self.b
        self.seen += 1

    def points(self, horizons: list[int]) -> list[float]:
        return [self.level + h * self.slope for h in horizons]


class Rls:
    """Recursive least squares of value on index with forgetting; covariance starts at 1e4."""

    def __init__(self, forgetting: float) -> None:
        self.forgetting, self.seen = forgetting, 0
        self.w, self.p = np.zeros(2), 1e4 * np.eye(2)

    def feed(self, y: float) -> None:
        x = np.array([1.0, float(self.seen)])
        px = self.p @ x
        k = px / (self.forgetting + x @ px)
        self.w = self.w + k * (y - x @ self.w)
        self.p = (self.p - np.outer(k, px)) / self.forgetting
        self.seen += 1

    def points(self, horizons: list[int]) -> list[float]:
        return [float(self.w[0] + self.w[1] * (self.seen - 1 + h)) for h in horizons]


class Particles:
    """Level and slope particles with a Student-type likelihood and systematic resampling.

    The scale is the median step of the first ``context`` values; no forecast is asked before.
    """

    def __init__(self, seed: int, particles: int, context: int, nu: float) -> None:
        self.rng, self.n, self.context, self.nu = np.random.default_rng(seed), particles, context, nu
        self.first: list[float] = []
        self.level = None

    def feed(self, y: float) -> None:
        if self.level is None:
            self.first.append(y)
            if len(self.first) < self.context:
                return
            d = np.abs(np.diff(self.first))
            self.s = max(float(np.median(d)) if len(d) else 0.0, 1e-6)
            self.level = self.first[0] + self.s * self.rng.standard_normal(self.n)
            self.slope = self.s * self.rng.standard_normal(self.n)
            for i, v in enumerate(self.first):
                self._step(v, i > 0)
        else:
            self._step(y, True)

    def _step(self, y: float, move: bool) -> None:
        if move:
            self.slope = self.slope + 0.1 * self.s * self.rng.standard_normal(self.n)
            self.level = self.level + self.slope + 0.1 * self.s * self.rng.standard_normal(self.n)
        logw = -0.5 * (self.nu + 1) * np.log1p(((y - self.level) / self.s) ** 2 / self.nu)
        w = np.exp(logw - logw.max())
        pick = systematic(w / w.sum(), self.rng.random())
        self.level, self.slope = self.level[pick], self.slope[pick]

    def points(self, horizons: list[int]) -> list[float]:
        return [float(np.mean(self.level + h * self.slope)) for h in horizons]


def streamed(series: DataFrame, make, model: str, horizons: list[int], context: int) -> DataFrame:
    """``unit, origin, horizon, model, point, actual`` of a model that is fed a unit's values in order.

    ``make`` gets a unit's first row and returns the model's state. Only that state is held:
    rows stream through, so a unit may be of any length. Actual values come from the lead
    of a window in the JVM, whose partitioning and order the stream keeps.
    """
    w = by_event()
    leads = [F.lead("value", h).over(w).alias(f"a{h}") for h in horizons]
    extra = [c for c in series.columns if c not in ("unit", "event_index", "value")]
    ordered = series.select("unit", "event_index", "value", *extra, *leads).sortWithinPartitions("unit", "event_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = state = None
        for b in batches:
            ahead = [b[f"a{h}"].to_numpy(float) for h in horizons]
            index, values, units = b["event_index"].to_numpy(), b["value"].to_numpy(float), b["unit"].to_numpy()
            out = []
            for i in range(len(b)):
                if state is None or units[i] != unit:
                    unit, state = units[i], make(b.iloc[i])
                state.feed(values[i])
                if index[i] >= context - 1:
                    there = [j for j in range(len(horizons)) if ahead[j][i] == ahead[j][i]]
                    if there:
                        p = state.points(horizons)
                        out += [(unit, index[i], horizons[j], model, p[j], ahead[j][i]) for j in there]
            yield pd.DataFrame(out, columns=["unit", "origin", "horizon", "model", "point", "actual"])

    unit_type = dict(series.dtypes)["unit"]
    return ordered.mapInPandas(run, f"unit {unit_type}, origin long, horizon int, model string, point double, actual double")


def training_scales(series: DataFrame, folds: int) -> DataFrame:
    """``fold, scale``: median absolute first difference of all units outside each fold, at least 1e-6."""
    d = series.withColumn("d", F.abs(F.col("value") - F.lag("value").over(by_event()))).filter("d is not null")
    d = d.withColumn("own", fold_of("unit", folds))
    out = d.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(folds)]))).filter("fold <> own")
    return out.groupBy("fold").agg(F.greatest(F.percentile("d", 0.5), F.lit(1e-6)).alias("scale"))


def fold_of(unit: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(unit).cast("string")), F.lit(folds)).cast("int")


def kalman_predictions(series: DataFrame, horizons: list[int], context: int, folds: int = 8, q_level: float = 1e-4, q_slope: float = 1e-4, r: float = 1.0) -> DataFrame:
    """Kalman forecasts whose scale comes from other folds of units only."""
    scaled = series.withColumn("fold", fold_of("unit", folds)).join(F.broadcast(training_scales(series, folds)), "fold")  # one row per fold
    return streamed(scaled.select("unit", "event_index", "value", "scale"), lambda row: Kalman(float(row["scale"]), q_level, q_slope, r), "local_trend_kf", horizons, context)


def rls_predictions(series: DataFrame, horizons: list[int], context: int, forgetting: float = 0.98) -> DataFrame:
    return streamed(series.select("unit", "event_index", "value"), lambda row: Rls(forgetting), "rls_trend", horizons, context)


def ridge_features(series: DataFrame, window: int, horizon: int, context: int) -> DataFrame:
    """``unit, origin, actual, y, x0..``: last value, index and the last differences; null where the prefix is too short."""
    w = by_event()
    diffs = [F.lag("value", k).over(w) - F.lag("value", k + 1).over(w) for k in range(window - 2, -1, -1)]
    cols = [F.col("value").alias("x0"), F.col("event_index").cast("double").alias("x1"), *[d.alias(f"x{i + 2}") for i, d in enumerate(diffs)]]
    ahead = F.lead("value", horizon).over(w)
    return series.select("unit", F.col("event_index").alias("origin"), F.col("value"), ahead.alias("actual"), (ahead - F.col("value")).alias("y"), *cols).filter((F.col("origin") >= context - 1) & F.col("actual").isNotNull())


def ridge_predictions(series: DataFrame, window: int = 3, alpha: float = 1.0, horizon: int = 1, context: int = 4, folds: int = 8) -> DataFrame:
    """Ridge on standardised features, each training unit weighing the same, fitted without the unit's own fold.

    Weighted moments add up over folds, so one aggregate of (features + 2) squared numbers
    per fold serves every leave-one-fold-out fit; the fits are solved on the driver from
    these ``folds`` rows and joined back as ``folds`` coefficient rows.
    """
    n_x = window + 1
    rows = ridge_features(series, window, horizon, context).withColumn("fold", fold_of("unit", folds))
    rows = rows.withColumn("wt", 1.0 / F.count("*").over(Window.partitionBy("unit")))
    z = [F.lit(1.0), *[F.col(f"x{i}") for i in range(n_x)], F.col("y")]
    moments = rows.groupBy("fold").agg(*[F.sum(F.col("wt") * z[i] * z[j]).alias(f"m{i}_{j}") for i in range(len(z)) for j in range(i, len(z))])
    per = {r["fold"]: np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(len(z))] for i in range(len(z))], float) for r in moments.collect()}
    fits = []
    for f in per:
        m = sum((v for k, v in per.items() if k != f), np.zeros((len(z), len(z))))
        if m[0, 0] <= 0:
            continue
        mean = m[0, 1:-1] / m[0, 0]
        y_mean = m[0, -1] / m[0, 0]
        cov = m[1:-1, 1:-1] - m[0, 0] * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov) / m[0, 0], 0))
        sd[sd == 0] = 1.0
        beta = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(n_x), (m[1:-1, -1] - m[0, 0] * mean * y_mean) / sd) / sd
        fits.append((int(f), float(y_mean - beta @ mean), [float(b) for b in beta]))
    fit = series.sparkSession.createDataFrame(fits, "fold int, b0 double, b array<double>")
    point = F.col("value") + F.col("b0") + sum((F.col("b")[i] * F.col(f"x{i}") for i in range(n_x)), F.lit(0.0))
    return rows.join(F.broadcast(fit), "fold").select("unit", "origin", F.lit(horizon).alias("horizon"), F.lit("ridge").alias("model"), point.alias("point"), "actual")


def particle_predictions(series: DataFrame, horizons: list[int], context: int, particles: int = 512, seed: int = 0, nu: float = 4.0) -> DataFrame:
    """A unit's generator is seeded by the seed and the unit, so results do not depend on how units are spread over tasks."""

    def make(row) -> Particles:
        import xxhash

        return Particles(xxhash.xxh64_intdigest(f"{seed}:{row['unit']}"), particles, context, nu)

    return streamed(series.select("unit", "event_index", "value"), make, "particle", horizons, context)


def systematic(weights: np.ndarray, u: float) -> np.ndarray:
    """Indices drawn by one shifted comb over the cumulative weights."""
    n = len(weights)
    total = np.cumsum(weights)
    total[-1] = 1.0
    return np.searchsorted(total, (np.arange(n) + u) / n)


def residual_quantiles(preds: DataFrame, levels: list[float]) -> DataFrame:
    """``model, horizon, level, offset``: quantiles of actual minus point, to be added to a point."""
    r = preds.withColumn("r", F.col("actual") - F.col("point"))
    q = r.groupBy("model", "horizon").agg(F.percentile("r", F.array(*map(F.lit, levels))).alias("q"))
    return q.select("model", "horizon", F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("q").alias("offset"))).alias("z")).select("model", "horizon", "z.level", "z.offset")


def qualification(preds: DataFrame, horizons: list[int]) -> DataFrame:
    """Per model and unit: all horizons there, all points finite, one row per key."""
    return (
        preds.groupBy("model", "unit", "origin")
        .agg(F.count_distinct("horizon").alias("n"), F.count("*").alias("m"), F.bool_and(F.col("point").isNotNull() & ~F.isnan("point") & (F.abs("point") < 1.7e308)).alias("ok"))
        .groupBy("model", "unit")
        .agg(F.max("n").alias("horizons"), F.bool_and(F.col("n") == F.col("m")).alias("unique_keys"), F.bool_and("ok").alias("finite"))
        .withColumn("complete", F.col("horizons") == len(horizons))
    )
