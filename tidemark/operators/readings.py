"""The two tables of measured series in one shape, cut into bounded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import table, tidy

#: Measures of each table, in the order of the columns m0, m1, m2.
MEASURES = {"stress2_events": ["capacity_loss_pct", "esr_increase_pct"], "hidden_events": ["capacity_ratio", "esr_ratio", "case_temp_c"]}
TABLES = list(MEASURES)
N_MEASURES = max(map(len, MEASURES.values()))


def _value(value: Column, flagged: Column | None = None) -> Column:
    """Null where there is no reading, infinity for any non-finite one (so that it survives Arrow's NaN for null)."""
    v = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value)
    return v if flagged is None else F.when(F.coalesce(flagged, F.lit(False)), None).otherwise(v)


def readings(spark, sf_dir: str) -> DataFrame:
    """``tab, unit, member, row_key, ev, t, m0, m1, m2``: one row per record of either table.

    Values flagged missing are null. Rows without a unit belong to no series and are left out.
    """
    s, h = (table(spark, sf_dir, t) for t in TABLES)
    none = F.lit(None).cast("double")
    stress = s.select(
        F.lit(0).alias("tab"), tidy("dataset_unit_key").alias("unit"), tidy("source_member").alias("member"), "row_id", F.col("event_index_0based").cast("long").alias("ev"), F.col("aging_time_h").alias("t"),
        *[_value(F.col(m)).alias(f"m{i}") for i, m in enumerate(MEASURES["stress2_events"])], none.alias("m2"),
    )
    hidden = h.select(
        F.lit(1).alias("tab"), tidy("dataset_unit_key").alias("unit"), tidy("source_member").alias("member"), "event_id", F.col("event_index").cast("long").alias("ev"), F.col("observed_at").alias("t"),
        *[_value(F.col("measurements")[m], F.col("missingness")[m]).alias(f"m{i}") for i, m in enumerate(MEASURES["hidden_events"])],
    )
    return stress.withColumnRenamed("row_id", "row_key").unionByName(hidden.withColumnRenamed("event_id", "row_key")).filter("unit is not null")


def in_blocks(df: DataFrame, place: str, size: int, halo: int) -> DataFrame:
    """Give each row its block of ``size`` places and copies for the neighbours whose margin it lies in.

    Adds ``block`` and ``core`` (1 in the row's own block, 0 in a margin). No block holds
    more than ``size + 2 * halo`` places, however long its series is.
    """
    own = lambda shift=0: F.floor((F.col(place) + shift) / size).cast("long")
    blocks = F.array_distinct(F.array(own(), own(-halo), own(halo)))
    return df.withColumn("_own", own()).withColumn("block", F.explode(blocks)).withColumn("core", (F.col("block") == F.col("_own")).cast("int")).drop("_own")
