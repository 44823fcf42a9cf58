"""Profiles of numeric fields and vectors: finiteness, missingness, robust scales, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: elements, nulls, NaNs, infinities of either sign, smallest and largest finite value.

    All columns are counted in one scan; the wide row is then turned long.
    """
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        ok = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        aggs.append(
            F.struct(
                F.lit(c).alias("field"), F.count("*").alias("n_rows"), F.count_if(x.isNull()).alias("null_count"), F.count_if(F.isnan(x)).alias("nan_count"), F.count_if(x == float("inf")).alias("pos_inf_count"),
                F.count_if(x == float("-inf")).alias("neg_inf_count"), F.count(ok).alias("finite_count"), F.min(ok).alias("min_value"), F.max(ok).alias("max_value"), F.min(F.abs(ok)).alias("min_abs"), F.max(F.abs(ok)).alias("max_abs"),
            ).alias(c)
        )
    return df.agg(*aggs).select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def missingness_geometry(df: DataFrame, key: str, values: Column) -> DataFrame:
    """Per row of an array: how many places are missing, in how many runs, and whether the finite ones are a prefix."""
    miss = F.transform(values, lambda x: x.isNull() | F.isnan(x))
    d = df.select(F.col(key).alias("id"), miss.alias("m"))
    starts = F.aggregate(F.col("m"), F.struct(F.lit(0).alias("runs"), F.lit(False).alias("last")), lambda a, x: F.struct((a["runs"] + F.when(x & ~a["last"], 1).otherwise(0)).alias("runs"), x.alias("last")))
    n_missing = F.size(F.filter("m", lambda x: x))
    first = F.array_position("m", F.lit(True))
    return d.select(
        "id", F.size("m").alias("n_values"), n_missing.alias("n_missing"), starts["runs"].alias("n_runs"),
        (n_missing > 0).alias("any_missing"), ((n_missing == F.size("m")) & (n_missing > 0)).alias("all_missing"), ((n_missing == 0) | (n_missing == F.size("m") - first + 1)).alias("finite_prefix"),
    )


def robust_scale(df: DataFrame, unit: str, idx: str, value: str, floor: float = 1e-8) -> DataFrame:
    """1.4826 times the median absolute deviation of first differences, else their median size, at least ``floor``."""
    d = df.select(F.col(unit).alias("unit"), (F.col(value) - F.lag(value).over(Window.partitionBy(unit).orderBy(idx))).alias("d")).filter("d is not null")
    m = d.groupBy("unit").agg(F.percentile("d", 0.5).alias("m"), F.percentile(F.abs("d"), 0.5).alias("a"))
    mad = d.join(m, "unit").groupBy("unit").agg((1.4826 * F.percentile(F.abs(F.col("d") - F.col("m")), 0.5)).alias("s"), F.max("a").alias("a"))
    return mad.select("unit", F.greatest(F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("a")), F.lit(floor)).alias("scale"))


def scaled_error(actual: Column, expected: Column) -> Column:
    """Relative error with a floor of 1e-12 under the denominator."""
    return F.abs(actual - expected) / F.greatest(F.abs(actual), F.abs(expected), F.lit(1e-12))


def identity_errors(df: DataFrame, key: str, identities: dict[str, tuple[Column, Column]], limit: float = 1e-5) -> DataFrame:
    """Largest scaled error of each algebraic identity per key, and whether all stay within the limit."""
    worst = [F.max(scaled_error(a, e)).alias(n) for n, (a, e) in identities.items()]
    out = df.groupBy(F.col(key).alias("id")).agg(*worst)
    return out.withColumn("within_limit", F.greatest(*[F.col(n) for n in identities]) <= limit)


def impedance_identities() -> dict[str, tuple[Column, Column]]:
    """Polar and Cartesian columns of a complex spectrum must agree."""
    re, im, mod, ph = (F.col(c) for c in ("z_re", "z_im", "z_mod", "z_phase_deg"))
    return {
        "modulus": (mod, F.hypot(re, im)), "phase": (ph, F.degrees(F.atan2(im, re))), "real": (re, mod * F.cos(F.radians(ph))), "imaginary": (im, mod * F.sin(F.radians(ph))),
        "admittance_re": (F.col("y_re"), re / (mod * mod)), "admittance_im": (F.col("y_im"), -im / (mod * mod)), "admittance_mod": (F.col("y_mod"), 1 / mod), "capacitance": (F.col("c_im"), re / (mod * mod) / F.col("omega")),
    }


def sweep_structure(df: DataFrame, key: str, order: str, frequency: str, n_sweep: int = 51, preambles: tuple[int, ...] = (7, 8)) -> DataFrame:
    """Whether a sweep starts with a contiguous preamble of zero frequencies and then falls strictly."""
    w = Window.partitionBy("id").orderBy("o")
    d = df.select(F.col(key).alias("id"), F.col(order).alias("o"), F.col(frequency).alias("f")).withColumn("p", F.lag("f").over(w))
    s = d.groupBy("id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("f") == 0).alias("n_preamble"), F.count_if(F.col("f") > 0).alias("n_sweep"),
        F.count_if((F.col("f") == 0) & (F.col("p") > 0)).alias("late_zeros"), F.count_if((F.col("p") > 0) & (F.col("f") > 0) & (F.col("f") >= F.col("p"))).alias("not_falling"),
    )
    return s.withColumn("sound", (F.col("late_zeros") == 0) & (F.col("not_falling") == 0) & (F.col("n_sweep") == n_sweep) & F.col("n_preamble").isin(list(preambles)))


def equidistant(df: DataFrame, group: str, order: str, most: int = 257) -> DataFrame:
    """At most ``most`` rows of each group at truncated equal steps from first to last, in integer arithmetic."""
    w = Window.partitionBy(group).orderBy(order)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    k = F.least(F.lit(most), F.col("_n"))
    # row i is floor(j * (n - 1) / (k - 1)) for some j: test the only candidate
    j = F.ceil(F.col("_i") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = (k == 1) | (F.floor(j * (F.col("_n") - 1) / F.greatest(k - 1, F.lit(1))) == F.col("_i"))
    return d.filter(hit).drop("_i", "_n")
