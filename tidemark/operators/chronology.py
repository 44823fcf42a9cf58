"""Audits of instrument record streams: order, segments, summaries, cycles, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = [
    "valid_adjacent_pairs", "record_nonunit", "record_repeats", "record_backwards", "record_forward_gaps", "missing_record_numbers", "cycle_backwards", "step_changes",
    "time_decreases", "same_step_time_decreases", "adjacent_duplicate_keys",
]
_KEY = ["cycle_no", "step_no", "status_code", "record_number", "time_us"]


def edge_counters(a: Column, b: Column) -> dict[str, Column]:
    """Counters of one step from key ``a`` to key ``b`` (structs, null if invalid): an invalid key breaks adjacency."""
    both = a.isNotNull() & b.isNotNull()
    delta = b["record_number"] - a["record_number"]
    moved = (a["cycle_no"] != b["cycle_no"]) | (a["step_no"] != b["step_no"]) | (a["status_code"] != b["status_code"])
    flag = lambda c: F.when(both & c, 1).otherwise(0)
    back = b["time_us"] < a["time_us"]
    return {
        "valid_adjacent_pairs": flag(F.lit(True)), "record_nonunit": flag(delta != 1), "record_repeats": flag(delta == 0), "record_backwards": flag(delta < 0), "record_forward_gaps": flag(delta > 1),
        "missing_record_numbers": F.when(both & (delta > 1), delta - 1).otherwise(0), "cycle_backwards": flag(b["cycle_no"] < a["cycle_no"]), "step_changes": flag(moved), "time_decreases": flag(back),
        "same_step_time_decreases": flag(~moved & back), "adjacent_duplicate_keys": flag(~moved & (delta == 0) & (b["time_us"] == a["time_us"])),
    }


def record_key() -> Column:
    """The key of a record, or null if any part of it is missing."""
    valid = F.lit(True)
    for c in _KEY:
        valid = valid & F.col(c).isNotNull()
    return F.when(valid, F.struct(*_KEY))


def chronology(records: DataFrame, group: str = "gid", place: str = "row_pos", block: int | None = None) -> DataFrame:
    """Transition counters per group (or per block of ``block`` places of it, with its first and last key)."""
    keys = records.select(F.col(group).alias("grp"), F.col(place).alias("place"), record_key().alias("k")).distinct()
    part = ["grp"]
    if block:
        keys = keys.withColumn("blk", F.floor(F.col("place") / block))
        part = ["grp", "blk"]
    prev = F.lag("k").over(Window.partitionBy(*part).orderBy("place"))
    keys = keys.withColumn("prev", prev)
    counters = [F.sum(c).cast("long").alias(n) for n, c in edge_counters(F.col("prev"), F.col("k")).items()]
    negative = (F.col("k.cycle_no") < 0) | (F.col("k.step_no") < 0) | (F.col("k.record_number") < 0)
    return keys.groupBy(*part).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("k").isNull()).alias("invalid_key_rows"), F.count_if(F.coalesce(negative, F.lit(False))).alias("negative_identifier_rows"), *counters,
        F.min_by("k", "place").alias("first_key"), F.max_by("k", "place").alias("last_key"),
    )


def merge_chronology(parts: DataFrame) -> DataFrame:
    """Totals of each group from its blocks: their counters plus the edges between neighbouring blocks.

    Only one row per block is compared, so a group of any length is merged from summaries.
    """
    before = F.lag("last_key").over(Window.partitionBy("grp").orderBy("blk"))
    first = F.row_number().over(Window.partitionBy("grp").orderBy("blk")) == 1
    p = parts.withColumn("before", before).withColumn("is_first", first)
    edges = edge_counters(F.col("before"), F.col("first_key"))
    for n, c in edges.items():
        p = p.withColumn(n, F.col(n) + c)
    nonunit = edges["record_nonunit"]
    return p.groupBy("grp").agg(
        F.sum("n_rows").cast("long").alias("n_rows"), F.sum("invalid_key_rows").cast("long").alias("invalid_key_rows"), F.sum("negative_identifier_rows").cast("long").alias("negative_identifier_rows"),
        *[F.sum(n).cast("long").alias(n) for n in COUNTERS], F.count_if(~F.col("is_first")).alias("block_boundaries"), F.sum(nonunit).cast("long").alias("nonunit_record_boundaries"),
        F.count_if(~F.col("is_first") & (F.col("before").isNull() | F.col("first_key").isNull())).alias("invalid_key_boundaries"),
    )


def segments(records: DataFrame, group: str = "gid", place: str = "row_pos") -> DataFrame:
    """Contiguous runs of one (cycle, step, status) with what was observed inside: gaps and islands by key change."""
    rows = records.distinct()
    w = Window.partitionBy(group).orderBy(place)
    prev = lambda c: F.lag(c).over(w)
    new = F.coalesce((prev("cycle_no") != F.col("cycle_no")) | (prev("step_no") != F.col("step_no")) | (prev("status_code") != F.col("status_code")), F.lit(True))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("segment", (F.sum("_new").over(w) - 1).cast("long"))
    for c in ("time_us", "voltage_v", "current_ma", "capacity_mah"):
        rows = rows.withColumn(f"_p_{c}", F.when(F.col("_new") == 0, prev(c)))
    n = lambda cond, name: F.count_if(cond).alias(name)
    return rows.groupBy(F.col(group).alias("grp"), "segment").agg(
        F.min("cycle_no").alias("cycle_no"), F.min("step_no").alias("step_no"), F.min("status_code").alias("status_code"), F.count("*").alias("n_rows"), F.min(place).alias("first_row"), F.max(place).alias("last_row"),
        F.min(F.col("current_ma") + F.lit(0.0)).alias("current_min"), F.max(F.col("current_ma") + F.lit(0.0)).alias("current_max"), n(F.col("current_ma") > 0, "positive_rows"), n(F.col("current_ma") < 0, "negative_rows"), n(F.col("current_ma") == 0, "zero_rows"),
        n(F.col("time_us") < F.col("_p_time_us"), "time_decreases"), n(F.col("time_us") == F.col("_p_time_us"), "equal_time_pairs"), n(F.col("voltage_v") > F.col("_p_voltage_v"), "voltage_increases"),
        n(F.col("voltage_v") < F.col("_p_voltage_v"), "voltage_decreases"), n(F.col("current_ma") != F.col("_p_current_ma"), "current_changes"), n(F.col("capacity_mah") < F.col("_p_capacity_mah"), "charge_decreases"),
        F.min_by("time_us", place).alias("first_time"), F.max_by("time_us", place).alias("last_time"), F.min_by("voltage_v", place).alias("first_voltage"), F.max_by("voltage_v", place).alias("last_voltage"),
        F.max_by("capacity_mah", place).alias("last_charge"), F.max_by("energy_mwh", place).alias("last_energy"), n(F.col("energy_mwh").isNull(), "energy_missing_rows"),
    )


def summary_join(segs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Segments against step summaries per (group, cycle, step, status), ambiguity kept.

    Each side is first reduced to one row per key with its member ids, so two ambiguous
    sides never multiply; differences exist for keys with one member on either side only.
    ``summaries`` has ``grp, cycle_no, step_no, status_code, summary_id, time_us, charge,
    energy, first_voltage, last_voltage``.
    """
    k = ["grp", "cycle_no", "step_no", "status_code"]
    a = segs.groupBy(*k).agg(
        F.sort_array(F.collect_list("segment")).alias("segment_ids"), F.min("first_time").alias("ft"), F.min("last_time").alias("lt"), F.min("last_charge").alias("lc"), F.min("last_energy").alias("le"),
        F.max("energy_missing_rows").alias("em"), F.min("first_voltage").alias("fv"), F.min("last_voltage").alias("lv"),
    )
    b = summaries.groupBy(*k).agg(
        F.sort_array(F.collect_list("summary_id")).alias("summary_ids"), F.min("time_us").alias("st"), F.min("charge").alias("sc"), F.min("energy").alias("se"), F.min("first_voltage").alias("sfv"), F.min("last_voltage").alias("slv")
    )
    j = a.join(b, k, "full_outer")
    na, nb = F.coalesce(F.size("segment_ids"), F.lit(0)), F.coalesce(F.size("summary_ids"), F.lit(0))
    na, nb = F.when(F.col("segment_ids").isNull(), 0).otherwise(na), F.when(F.col("summary_ids").isNull(), 0).otherwise(nb)
    status = F.when((na > 1) | (nb > 1), "AMBIGUOUS_KEY").when(na == 0, "SUMMARY_ONLY").when(nb == 0, "RECORD_ONLY").otherwise("UNIQUE_KEY_OBSERVATION")
    one = status == "UNIQUE_KEY_OBSERVATION"
    return j.select(
        *k, status.alias("status"), na.cast("long").alias("n_segments"), nb.cast("long").alias("n_summaries"), F.when(one, F.col("st") - F.col("lt")).alias("minus_last_time"), F.when(one, F.col("st") - (F.col("lt") - F.col("ft"))).alias("minus_elapsed"),
        F.when(one, F.col("sc") - F.col("lc")).alias("minus_last_charge"), F.when(one & (F.col("em") == 0), F.col("se") - F.col("le")).alias("minus_last_energy"),
        F.when(one, F.col("sfv") - F.col("fv")).alias("minus_first_voltage"), F.when(one, F.col("slv") - F.col("lv")).alias("minus_last_voltage"),
    )


def sign_buckets(segs: DataFrame, cycles: DataFrame) -> DataFrame:
    """Per cycle the segments of each current sign and, if its summary is unique, the difference of their end charges."""
    sign = F.when(F.col("positive_rows") == F.col("n_rows"), "positive").when(F.col("negative_rows") == F.col("n_rows"), "negative").when(F.col("zero_rows") == F.col("n_rows"), "zero").otherwise("mixed")
    s = segs.withColumn("sign", sign).groupBy("grp", "cycle_no").agg(
        F.count("*").alias("n_segments"), *[F.count_if(F.col("sign") == x).alias(f"n_{x}") for x in ("positive", "negative", "zero", "mixed")],
        F.sum(F.when(F.col("sign") == "positive", F.col("last_charge"))).alias("charge_sum"), F.sum(F.when(F.col("sign") == "negative", F.col("last_charge"))).alias("discharge_sum"),
    )
    c = cycles.groupBy("grp", "cycle_no").agg(F.count("*").alias("n_summaries"), F.min("charge").alias("charge"), F.min("discharge").alias("discharge"))
    j = s.join(c, ["grp", "cycle_no"], "full_outer").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_segments", "n_positive", "n_negative", "n_zero", "n_mixed", "n_summaries")})
    one = (F.col("n_summaries") == 1) & (F.col("n_segments") > 0)
    return j.select(
        "grp", "cycle_no", "n_segments", "n_positive", "n_negative", "n_zero", "n_mixed", "n_summaries",
        F.when(one, F.col("charge") - F.col("charge_sum")).alias("charge_difference"), F.when(one, F.col("discharge") - F.col("discharge_sum")).alias("discharge_difference"),
    )


def time_gaps(df: DataFrame, group: str, order: list[str], seconds: Column, tolerance: float = 1e-7, irregular: float = 1e-4) -> DataFrame:
    """Reversals, repeats and irregular gaps against the group's median positive gap."""
    w = Window.partitionBy("grp").orderBy(*order)
    d = df.select(F.col(group).alias("grp"), *order, seconds.alias("s")).withColumn("gap", F.col("s") - F.lag("s").over(w))
    base = d.groupBy("grp").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("gap") < -tolerance).alias("reversal_count"), F.count_if(F.abs("gap") <= tolerance).alias("duplicate_count"),
        F.percentile(F.when(F.col("gap") > tolerance, F.col("gap")), 0.5).alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
    )
    odd = d.filter(F.col("gap") > tolerance).join(base.select("grp", "median_gap"), "grp").groupBy("grp").agg(F.count_if(F.abs(F.col("gap") - F.col("median_gap")) > irregular).alias("irregular_gap_count"))
    return base.join(odd, "grp", "left").withColumn("irregular_gap_count", F.coalesce("irregular_gap_count", F.lit(0)))


def cycle_axis(df: DataFrame, group: str, cycle: str, order: str) -> DataFrame:
    """Distinct values, repeats, reversals, jumps and integers missing within the range, per group."""
    w = Window.partitionBy("grp").orderBy("o")
    d = df.select(F.col(group).alias("grp"), F.col(cycle).cast("long").alias("c"), F.col(order).alias("o")).withColumn("step", F.col("c") - F.lag("c").over(w))
    return d.groupBy("grp").agg(
        F.count_distinct("c").alias("n_distinct"), F.count_if(F.col("step") == 0).alias("repeat_count"), F.count_if(F.col("step") < 0).alias("reversal_count"), F.count_if(F.col("step") > 1).alias("jump_count"),
        (F.max("c") - F.min("c") + 1 - F.count_distinct("c")).alias("missing_count"),
    )


def status_chains(df: DataFrame, group: str, order: str, status: str) -> DataFrame:
    """How often each run of one status stands between which neighbours."""
    w = Window.partitionBy("grp").orderBy("o")
    d = df.select(F.col(group).alias("grp"), F.col(order).alias("o"), F.col(status).alias("s")).withColumn("p", F.lag("s").over(w))
    runs = d.filter(F.col("p").isNull() | (F.col("p") != F.col("s"))).withColumn("follower", F.lead("s").over(w))
    return runs.groupBy(F.col("p").alias("predecessor"), F.col("s").alias("status"), "follower").agg(F.count("*").alias("n_runs"))
