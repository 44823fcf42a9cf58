"""A closed algebra of forecast actions, their enumeration, execution and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Transform parameters.
SHIFTS = [-1.0, -0.5, 0.5, 1.0]
INFLATIONS = [1.25, 1.5, 2.0]
FIELDS = ["point", "lower", "median", "upper"]


def base_actions(spark: SparkSession, models: list[str], templates: list[str]) -> DataFrame:
    rows = [("EMIT", m) for m in models] + [("FUSE", t) for t in templates] + [("FALLBACK", None)]
    return spark.createDataFrame(rows, "operator string, reference_id string")


def action_space(bases: DataFrame) -> DataFrame:
    """Every base as it is, shifted by each bin and inflated by each factor, with a hash as identity."""
    spark = bases.sparkSession
    t = spark.createDataFrame([(None, None), *[("SHIFT", x) for x in SHIFTS], *[("INFLATE", x) for x in INFLATIONS]], "transform string, parameter double")
    a = bases.crossJoin(F.broadcast(t))  # twelve bases by eight fixed transforms
    text = F.concat_ws("|", "operator", F.coalesce("reference_id", F.lit("-")), F.coalesce("transform", F.lit("-")), F.coalesce(F.round(F.col("parameter") * 100).cast("long").cast("string"), F.lit("-")))
    return a.withColumn("action_id", F.sha2(text, 256)).withColumn("complexity", F.when(F.col("transform").isNull(), 1).otherwise(2))


def primary_space(space: DataFrame) -> DataFrame:
    """The untransformed bases and the transforms of the common fallback."""
    return space.filter("transform is null or operator = 'FALLBACK'")


def predicates(spark: SparkSession, features: dict[str, list[str]]) -> DataFrame:
    """Atoms ``feature=bin`` and AND/OR of every unordered pair of distinct atoms, in hash order."""
    atoms = spark.createDataFrame([(f"{f}={b}",) for f in features for b in features[f]], "atom string").withColumn("h", F.sha2("atom", 256))
    single = atoms.select(F.lit("ATOM").alias("operator"), F.col("atom").alias("first"), F.lit(None).cast("string").alias("second"))
    a, b = atoms.alias("a"), atoms.alias("b")
    pairs = a.join(b, F.col("a.h") < F.col("b.h")).select(F.explode(F.array(F.lit("AND"), F.lit("OR"))).alias("operator"), F.col("a.atom").alias("first"), F.col("b.atom").alias("second"))
    return single.unionByName(pairs)


def programs(actions: DataFrame, preds: DataFrame) -> DataFrame:
    """Every action alone and every predicate with two different branches: a grammar of fixed size."""
    a = actions.select("action_id")
    none = F.lit(None).cast("string")
    alone = a.select(none.alias("operator"), none.alias("first"), none.alias("second"), F.col("action_id").alias("if_true"), none.alias("if_false"))
    branches = a.select(F.col("action_id").alias("if_true")).join(a.select(F.col("action_id").alias("if_false")), F.col("if_true") != F.col("if_false"))
    return alone.unionByName(preds.crossJoin(F.broadcast(branches)))  # 225 predicates by 342 branches


def holds(operator: Column, first: Column, second: Column) -> Column:
    """Truth of a predicate whose children are booleans; unknown children make it false."""
    t, f = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return F.when(operator == "AND", t & f).when(operator == "OR", t | f).otherwise(t)


def conditional(preds: Column, if_true: Column, if_false: Column) -> Column:
    """One of two actions; null if either is unresolved, since both must resolve."""
    return F.when(if_true.isNotNull() & if_false.isNotNull(), F.when(F.coalesce(preds, F.lit(False)), if_true).otherwise(if_false))


def valid_forecast(low: float | None = None, high: float | None = None) -> Column:
    """lower <= median <= upper, point within, all finite, all within bounds if there are any."""
    ok = F.lit(True)
    for c in FIELDS:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1.7e308)
        if low is not None:
            ok = ok & (F.col(c) >= low)
        if high is not None:
            ok = ok & (F.col(c) <= high)
    return F.coalesce(ok & (F.col("lower") <= F.col("median")) & (F.col("median") <= F.col("upper")) & F.col("point").between(F.col("lower"), F.col("upper")), F.lit(False))


def fuse(forecasts: DataFrame, weights: DataFrame, key: list[str], slack: float = 1e-12) -> DataFrame:
    """Convex combinations per template and key: ``template_id, key..., point, lower, median, upper, status``.

    A key that lacks a member is invalid, one where every member is NA is NA, one with some
    NA members is invalid, and so is a value outside the hull of its members by more than ``slack``.
    """
    weights = weights.withColumn("_members", F.count("*").over(Window.partitionBy("template_id")))
    j = forecasts.join(F.broadcast(weights), "model")  # templates times models: a fixed table
    aggs = [F.count("*").alias("n"), F.count("point").alias("n_numeric"), F.max("_members").alias("_members")]
    for c in FIELDS:
        aggs += [F.sum(F.col("weight") * F.col(c)).alias(c), F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    out = j.groupBy("template_id", *key).agg(*aggs)
    inside = F.lit(True)
    for c in FIELDS:
        inside = inside & (F.col(c) >= F.col(f"_lo_{c}") - slack) & (F.col(c) <= F.col(f"_hi_{c}") + slack)
    status = F.when(F.col("n") < F.col("_members"), "INVALID_MISSING").when(F.col("n_numeric") == 0, "NA").when(F.col("n_numeric") < F.col("n"), "INVALID_MIXED").when(~inside, "INVALID_HULL").otherwise("NUMERIC")
    out = out.withColumn("status", status)
    return out.select("template_id", *key, *[F.when(F.col("status") == "NUMERIC", F.col(c)).alias(c) for c in FIELDS], "status")


def shift(scale: Column, parameter: Column | float) -> dict[str, Column]:
    d = (F.lit(parameter) if isinstance(parameter, float) else parameter) * scale
    return {c: F.col(c) + d for c in FIELDS}


def inflate(factor: Column | float) -> dict[str, Column]:
    """Bounds move away from the point, the median stays."""
    f = F.lit(factor) if isinstance(factor, float) else factor
    return {"lower": F.col("point") - f * (F.col("point") - F.col("lower")), "upper": F.col("point") + f * (F.col("upper") - F.col("point"))}


def all_or_fallback(df: DataFrame, bundle: list[str], valid: Column, fallback: str = "fallback_point", value: str = "point") -> DataFrame:
    """One invalid key turns the whole bundle to its fallback."""
    ok = F.bool_and(valid).over(Window.partitionBy(*bundle))
    return df.withColumn("bundle_ok", ok).withColumn("executed", F.when(F.col("bundle_ok"), F.col(value)).otherwise(F.col(fallback)))


def median_bundle(forecasts: DataFrame, key: list[str]) -> DataFrame:
    """Component-wise medians over members."""
    return forecasts.groupBy(*key).agg(F.count("*").alias("n_members"), *[F.percentile(c, 0.5).alias(c) for c in FIELDS])


def lowest_error_weights(errors: DataFrame) -> DataFrame:
    """All weight on the model with the lowest mean error, then the least complexity, then the first name.

    ``errors`` has ``grp, model, complexity, error``.
    """
    m = errors.groupBy("grp", "model").agg(F.avg("error").alias("e"), F.min("complexity").alias("c"))
    best = m.groupBy("grp").agg(F.min(F.struct("e", "c", "model")).alias("b"))
    return m.join(best, "grp").select("grp", "model", F.when(F.col("model") == F.col("b.model"), 1.0).otherwise(0.0).alias("weight"))


def route(disagreement: Column, threshold: float) -> Column:
    return F.when(disagreement > threshold, "REVIEW").otherwise("NUMERIC_ONLY")


def cluster_mean_se(losses: DataFrame, by: list[str], cluster: str, loss: str) -> DataFrame:
    """Mean of cluster means and its standard error (0 for one cluster)."""
    m = losses.groupBy(*by, cluster).agg(F.avg(loss).alias("m"))
    return m.groupBy(*by).agg(F.avg("m").alias("mean"), F.count("*").alias("n_clusters"), F.when(F.count("*") > 1, F.stddev_samp("m") / F.sqrt(F.count("*"))).otherwise(0.0).alias("se"))


def best_action(losses: DataFrame, n_min: int, lam: float, kappa: float, eta: float) -> DataFrame:
    """Shrunken-score argmin per key and stratum.

    ``losses`` has ``key, stratum, cluster, action_id, complexity, loss``. Within a stratum of
    at least ``n_min`` clusters: g + lam (s - g) + kappa se_s + eta complexity, else
    g + kappa se_g + eta complexity. Ties go to lower complexity, then to the smaller id.
    """
    g = cluster_mean_se(losses, ["key", "action_id", "complexity"], "cluster", "loss").select("key", "action_id", "complexity", F.col("mean").alias("g"), F.col("se").alias("se_g"))
    s = cluster_mean_se(losses, ["key", "stratum", "action_id"], "cluster", "loss").select("key", "stratum", "action_id", F.col("mean").alias("s"), F.col("se").alias("se_s"), "n_clusters")
    j = s.join(g, ["key", "action_id"])
    few = F.col("n_clusters") < n_min
    score = F.when(few, F.col("g") + kappa * F.col("se_g")).otherwise(F.col("g") + lam * (F.col("s") - F.col("g")) + kappa * F.col("se_s")) + eta * F.col("complexity")
    j = j.withColumn("score", score)
    w = j.groupBy("key", "stratum").agg(F.min(F.struct("score", "complexity", "action_id")).alias("w"), F.bool_and(few).alias("stratum_unqualified"), F.count("*").alias("n_actions"))
    return w.select("key", "stratum", F.col("w.action_id").alias("action_id"), F.col("w.score").alias("score"), "stratum_unqualified", "n_actions")
