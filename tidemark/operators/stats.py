"""Paired decisions: t summaries, Holm step-down, exact binomial intervals, design simulation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.special import beta_quantile_udf, t_quantile, t_quantile_udf, t_survival, t_survival_udf

LEVEL, ALPHA = 0.95, 0.05
#: The scenarios of the design simulation.
SCENARIOS = [
    ("QT0_h1", 6, 7, 0.4, 0.6, 0.8, 1.0, 0.0, 1),
    ("QT0_h2", 6, 6, 0.4, 0.6, 0.8, 1.0, 0.0, 1),
    ("QT0_h3", 6, 5, 0.4, 0.6, 0.8, 1.0, 0.0, 1),
    ("QT1", 12, 25, 0.4, 0.6, 0.8, 0.9, 0.5, 1),
    ("QT2", 6, 7, 0.7, 0.9, 0.3, 0.7, 0.5, 1),
    ("QT3", 12, 25, 0.4, 0.6, 0.8, 0.9, 0.5, 5),
]
SCENARIO_SCHEMA = "scenario_id string, n_units int, mean_origins int, icc double, phi double, rho double, availability double, length_cv double, n_candidates int"


def paired_moments(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Count, mean and standard error of a - b per group; null where fewer than two pairs are finite."""
    d = df.withColumn("_d", F.col(a) - F.col(b)).filter("_d is not null and not isnan(_d)")
    n = F.count("*")
    return d.groupBy(*by).agg(n.alias("n"), F.when(n > 1, F.avg("_d")).alias("mean"), F.when(n > 1, F.stddev_samp("_d") / F.sqrt(n)).alias("se"))


def paired_t(moments: DataFrame, level: float = LEVEL) -> DataFrame:
    """One-sided p and interval from moments; without spread p is 0 or 1 and the interval a point."""
    m = moments.filter("n > 1").withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    m = m.withColumn("_p", t_survival_udf(F.coalesce("t", F.lit(0.0)), (F.col("n") - 1).cast("double"))).withColumn("_q", t_quantile_udf(F.lit(0.5 + level / 2), (F.col("n") - 1).cast("double")))
    p = F.when(F.col("se") > 0, F.col("_p")).otherwise(F.when(F.col("mean") > 0, 0.0).otherwise(1.0))
    return m.withColumn("p_one_sided", p).withColumn("ci_lower", F.col("mean") - F.col("_q") * F.col("se")).withColumn("ci_upper", F.col("mean") + F.col("_q") * F.col("se")).drop("_p", "_q", "t")


def holm(df: DataFrame, family: str, p: str, order: str, alpha: float = ALPHA) -> DataFrame:
    """``rejected``: step-down within each family, ties by ``order``, stopping at the first failure."""
    w = Window.partitionBy(family).orderBy(p, order)
    n = F.count("*").over(Window.partitionBy(family))
    passes = F.col(p) <= F.lit(alpha) / (n - F.row_number().over(w) + 1)
    return df.withColumn("_ok", F.coalesce(passes, F.lit(False)).cast("int")).withColumn("rejected", F.min("_ok").over(w) == 1).drop("_ok")


def clopper_pearson(df: DataFrame, successes: str, trials: str, level: float = LEVEL) -> DataFrame:
    """Exact binomial interval: 0 below no successes, 1 above only successes, null without trials."""
    s, n = F.col(successes).cast("double"), F.col(trials).cast("double")
    a = (1 - level) / 2
    lower = F.when(s <= 0, 0.0).otherwise(beta_quantile_udf(F.lit(a), F.greatest(s, F.lit(0.5)), n - s + 1))
    upper = F.when(s >= n, 1.0).otherwise(beta_quantile_udf(F.lit(1 - a), s + 1, F.greatest(n - s, F.lit(0.5))))
    return df.withColumn("ci_lower", F.when(n > 0, lower)).withColumn("ci_upper", F.when(n > 0, upper))


def simulate_losses(rng: np.random.Generator, s, effect: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit losses of the incumbent (n) and candidates (n, k) of one repeat.

    Log-errors share a unit effect and an autoregressive difficulty; the first candidate is
    better by ``effect``. Units nothing was observed of are NaN.
    """
    n, k = int(s.n_units), int(s.n_candidates)
    if s.length_cv > 0:
        var = np.log1p(s.length_cv**2)
        lengths = np.clip(np.rint(rng.lognormal(np.log(s.mean_origins) - var / 2, np.sqrt(var), n)).astype(int), 2, 200)
    else:
        lengths = np.full(n, int(s.mean_origins))
    most = int(lengths.max())
    half = (1 - s.icc) / 2
    noise = rng.normal(size=(most, n))
    hard = np.empty((most, n))
    hard[0] = noise[0]
    for t in range(1, most):
        hard[t] = s.phi * hard[t - 1] + np.sqrt(1 - s.phi**2) * noise[t]
    shared = np.sqrt(s.icc) * rng.normal(size=n) + np.sqrt(half) * hard
    common = rng.normal(size=(most, n))
    own = rng.normal(size=(k + 1, most, n))
    gain = np.zeros(k + 1)
    gain[1] = np.log1p(-effect)
    errors = np.exp(shared + gain[:, None, None] + np.sqrt(half) * (np.sqrt(s.rho) * common + np.sqrt(1 - s.rho) * own))
    seen = (rng.random((most, n)) < s.availability) & (np.arange(most)[:, None] < lengths)
    count = seen.sum(axis=0)
    with np.errstate(invalid="ignore"):
        losses = np.where(count > 0, (errors * seen).sum(axis=1) / count, np.nan)
    return losses[0], losses[1:].T


@lru_cache(maxsize=1024)
def _half_width(df: int) -> float:
    return float(t_quantile(0.5 + LEVEL / 2, df))


def decide(incumbent: np.ndarray, candidates: np.ndarray) -> dict:
    """Promote the Holm winner of lowest mean loss if it also beats the runner-up; nothing on missing units."""
    if not (np.isfinite(incumbent).all() and np.isfinite(candidates).all()):
        return {"ok": False, "selected": -1, "effect": np.nan, "lower": np.nan, "upper": np.nan}
    n = len(incumbent)

    def t_test(d):
        m, se = d.mean(axis=0), d.std(axis=0, ddof=1) / np.sqrt(n)
        return m, np.where(se > 0, t_survival(m / np.where(se > 0, se, 1), n - 1), np.where(m > 0, 0.0, 1.0)), se

    m, p, se = t_test(incumbent[:, None] - candidates)
    order = np.argsort(p, kind="stable")
    fails = np.flatnonzero(p[order] > ALPHA / (len(p) - np.arange(len(p))))
    winners = order[: fails[0] if len(fails) else len(p)]
    selected = -1
    if len(winners) == 1:
        selected = int(winners[0])
    elif len(winners) > 1:
        ranked = winners[np.lexsort((winners, candidates.mean(axis=0)[winners]))]
        _, q, _ = t_test((candidates[:, ranked[1]] - candidates[:, ranked[0]])[:, None])
        if q[0] <= ALPHA:
            selected = int(ranked[0])
    half = _half_width(n - 1) * se[0]
    return {"ok": True, "selected": selected, "effect": float(1 - candidates[:, 0].mean() / incumbent.mean()), "lower": float(m[0] - half), "upper": float(m[0] + half)}


def simulate(spark: SparkSession, scenarios: list[tuple] = SCENARIOS, effects: tuple[float, ...] = (0.0, 0.1, 0.2), repeats: int = 200, seed: int = 20260813, harm: float | None = None) -> DataFrame:
    """One row per scenario, effect and repeat; each repeat has its own generator, seeded by its coordinates.

    With ``harm``, scenarios named QT0_ also run with this (negative) effect.
    """
    s = spark.createDataFrame(scenarios, SCENARIO_SCHEMA)
    e = spark.createDataFrame([(x,) for x in effects], "effect double")
    cells = s.crossJoin(F.broadcast(e))
    if harm is not None:
        cells = cells.unionByName(s.filter(F.col("scenario_id").startswith("QT0_")).withColumn("effect", F.lit(float(harm))))
    grid = cells.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))  # a fixed grid of cells

    schema = "scenario_id string, effect double, repeat int, ok boolean, selected int, estimate double, lower double, upper double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}|{r.scenario_id}|{r.effect:.6f}|{r.repeat}"))
                d = decide(*simulate_losses(rng, r, r.effect))
                rows.append((r.scenario_id, r.effect, r.repeat, d["ok"], d["selected"], d["effect"], d["lower"], d["upper"]))
            yield pd.DataFrame(rows, columns=["scenario_id", "effect", "repeat", "ok", "selected", "estimate", "lower", "upper"])

    return grid.repartition("scenario_id", "effect", "repeat").mapInPandas(run, schema)


def design_cells(runs: DataFrame) -> DataFrame:
    """Rates per cell over planned repeats with exact intervals; means over analyzable repeats only."""
    cells = runs.groupBy("scenario_id", "effect").agg(
        F.count("*").alias("repeats"), F.count_if("ok").alias("analyzable"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("selected") >= 0).alias("promoted"),
        F.count_if(F.when(F.col("effect") > 0, F.col("selected") == 0).otherwise(F.col("ok") & (F.col("selected") < 0))).alias("correct"), F.avg(F.when(F.col("ok"), F.col("estimate"))).alias("mean_estimate"),
    )
    return clopper_pearson(cells.withColumn("promotion_rate", F.col("promoted") / F.col("repeats")).withColumn("correct_rate", F.col("correct") / F.col("repeats")), "promoted", "repeats")
