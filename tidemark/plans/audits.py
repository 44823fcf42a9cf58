"""Record-stream, overlap, profile and ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import chronology as C
from tidemark.operators import fingerprints, ledger, orphans, overlap, profile, scoring
from tidemark.runtime import cut, table, tidy

BLOCK = 128


def records(spark, d: str) -> DataFrame:
    """Instrument records, repeated rows once."""
    return table(spark, d, "instrument_records").distinct()


def chronology_counters(spark, d):
    return C.chronology(records(spark, d)).drop("first_key", "last_key")


def chronology_merge(spark, d):
    return C.merge_chronology(C.chronology(records(spark, d), block=BLOCK))


def segment_evidence(spark, d):
    return C.segments(records(spark, d))


def step_summaries(spark, d) -> DataFrame:
    """Summaries of each (group, cycle, step, status) as the instrument would print them; time and charge at its end."""
    k = ["gid", "cycle_no", "step_no", "status_code"]
    return records(spark, d).groupBy(*k).agg(
        F.min("row_pos").alias("summary_id"), F.max("time_us").alias("time_us"), F.max("capacity_mah").alias("charge"), F.max("energy_mwh").alias("energy"),
        F.min_by("voltage_v", "row_pos").alias("first_voltage"), F.max_by("voltage_v", "row_pos").alias("last_voltage"),
    ).withColumnRenamed("gid", "grp")


def segment_summary_join(spark, d):
    j = C.summary_join(C.segments(records(spark, d)), step_summaries(spark, d))
    return j.select("grp", "cycle_no", "step_no", "status_code", "status", "n_segments", "n_summaries", "minus_last_time", "minus_elapsed", *[F.round(c, 6).alias(c) for c in ("minus_last_charge", "minus_last_energy", "minus_first_voltage", "minus_last_voltage")])


def cycle_sign_buckets(spark, d):
    r = records(spark, d)
    cycles = r.groupBy(F.col("gid").alias("grp"), "cycle_no").agg(F.max(F.when(F.col("current_ma") > 0, F.col("capacity_mah"))).alias("charge"), F.max(F.when(F.col("current_ma") < 0, F.col("capacity_mah"))).alias("discharge"))
    j = C.sign_buckets(C.segments(r), cycles)
    return j.select("grp", "cycle_no", *[F.col(f"n_{x}").cast("long").alias(f"n_{x}") for x in ("segments", "positive", "negative", "zero", "mixed", "summaries")], F.round("charge_difference", 6).alias("charge_difference"), F.round("discharge_difference", 6).alias("discharge_difference"))


def status_chains(spark, d):
    return C.status_chains(records(spark, d), "gid", "row_pos", "status_code")


def time_gap_audit(spark, d):
    e = table(spark, d, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    g = C.time_gaps(e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id", ["us", "event_id"], F.col("us") / F.lit(1e6), irregular=60.0)
    return g.select("grp", "n_rows", "reversal_count", "duplicate_count", "irregular_gap_count", *[F.round(c, 3).alias(c) for c in ("median_gap", "min_gap", "max_gap")])


def cycle_axis_audit(spark, d):
    return C.cycle_axis(records(spark, d), "gid", "cycle_no", "row_pos")


def lineitem_axis_audit(spark, d):
    return C.cycle_axis(table(spark, d, "lineitem").withColumn("o", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")), "l_orderkey", "l_linenumber", "o")


FIELDS = ["aging_time_h", "capacity_loss_pct", "esr_increase_pct", "composite_health_margin"]


def finite_profile(spark, d):
    p = profile.finite_profile(table(spark, d, "stress2_events").select("row_id", *FIELDS).distinct(), FIELDS)
    return p


def missingness_geometry(spark, d):
    h = table(spark, d, "hidden_events").select("event_id", F.array(*[F.col("measurements")[m] for m in ("capacity_ratio", "esr_ratio", "case_temp_c")]).alias("v")).distinct()
    return profile.missingness_geometry(h, "event_id", F.col("v")).select("id", F.col("n_values").cast("long").alias("n_values"), F.col("n_missing").cast("long").alias("n_missing"), F.col("n_runs").cast("long").alias("n_runs"), "any_missing", "all_missing", "finite_prefix")


def trajectory_signature_dups(spark, d):
    """Units whose rounded series of readings equal another unit's."""
    s = table(spark, d, "stress2_events").select(tidy("dataset_unit_key").alias("unit"), F.col("event_index_0based").alias("i"), "row_id", F.round(F.when(F.abs("capacity_loss_pct") < 1e12, F.col("capacity_loss_pct")) * 10000).cast("long").alias("v")).distinct()
    row = F.sha2(F.concat_ws("|", "i", F.coalesce(F.col("v").cast("string"), F.lit("-"))), 256)
    sig = s.withColumn("h", row).groupBy("unit").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"))  # order-free: rows carry their index
    return overlap.content_classes(sig, "unit", F.concat_ws("|", "n", F.col("s").cast("string"))).select("unit", "class_key", "n_members")


def exact_duplicates(spark, d):
    return overlap.content_classes(table(spark, d, "documents"), "doc_id", F.sha2("text", 256)).select("doc_id", "class_key", "n_members")


def near_duplicates(spark, d):
    """All vectors beside a slightly scaled copy of each."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    copies = v.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.transform("embedding", lambda x: x * F.lit(1.000002)).alias("embedding"))
    return overlap.near_duplicates(v.unionByName(copies), "vec_id", "embedding").select("id_a", "id_b", F.round("r", 6).alias("r"), F.round("nrmse", 6).alias("nrmse"))


def shingle_hashes(spark, d):
    """Shingles of eight words, per document digest counts."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token")).filter("doc_id is not null").dropDuplicates(["doc_id", "pos"])
    return overlap.shingles(w, 8, "doc_id")


def winnow_words(spark, d):
    return overlap.winnow(shingle_hashes(spark, d), 25)


def winnow_fingerprints(spark, d):
    """Fingerprints of the instrument records, built anew from the rows."""
    return fingerprints.index(records(spark, d))


def fingerprint_pairs(spark, d):
    f = table(spark, d, "fingerprints").select("digest", F.col("gid").alias("grp"), F.col("row_offset").alias("pos"))
    return overlap.fingerprint_pairs(f).select(F.lower(F.hex("digest")).alias("digest"), "grp_a", "pos_a", "grp_b", "pos_b")


def row_tokens(spark, d) -> DataFrame:
    r = records(spark, d)
    return r.select(F.col("gid").alias("grp"), F.col("row_pos").alias("pos"), F.struct("status_code", "time_us", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("voltage_v", "current_ma", "capacity_mah")]).alias("token"))


def confirmed_spans(spark, d):
    return overlap.confirmed_spans(row_tokens(spark, d), fingerprint_pairs(spark, d))


def source_spans(spark, d):
    g = table(spark, d, "record_groups").select(F.split("container", "/")[0].alias("grp"), F.split("container", "/")[1].cast("long").alias("fragment"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")).distinct()
    return overlap.source_spans(g)


# --- ledgers -------------------------------------------------------------------------


def hash_chain(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return ledger.with_chain(o, "o_custkey", ["o_orderkey"]).select("o_orderkey", "row_number", "row_payload_json", "prev_row_hash", "row_hash")


def _tampered(spark, d) -> DataFrame:
    """The order chain with the payload of every urgent order of status P changed after it was hashed."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    hit = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1")
    return cut(ledger.with_chain(o, "o_custkey", ["o_orderkey"])).withColumn("row_payload_json", F.when(hit, F.replace("row_payload_json", F.lit('"P"'), F.lit('"F"'))).otherwise(F.col("row_payload_json")))


def hash_chain_verify(spark, d):
    return ledger.verify_chain(_tampered(spark, d), "o_custkey").select("o_custkey", F.col("row_number").cast("long").alias("row_number"), "bad_link", "bad_hash")


def causal_barrier_violations(spark, d):
    """Labels revealed without a committed prediction, or not after it, or for another target event."""
    p = table(spark, d, "prediction_ledger").select(orphans.record_id("prediction_id").alias("id"), F.col("prediction_commit_seq").alias("commit_seq"), F.col("expected_target_event_index_0based").cast("string").alias("commit_hash")).filter("id is not null").distinct()
    p = scoring.keep_first(p, ["id"], ["commit_seq", "commit_hash"])
    m = table(spark, d, "maturity_ledger").select(orphans.record_id("prediction_id").alias("id"), "row_id", F.col("target_event_index_0based").cast("string").alias("required_hash"), F.col("label_available_seq").alias("reveal_seq")).filter("id is not null and id <> ''").distinct()
    return ledger.barrier_violations(p, m, ["id"]).groupBy("violation").agg(F.count("*").alias("n_rows"))


def status_precedence(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "AMBER").when(F.col("o_orderpriority").startswith("1"), "FAIL").alias("s"))
    return o.groupBy("o_custkey").agg(ledger.status_of(F.col("s")).alias("status"))


def generation_grid(spark, d):
    """Cells (unit, model, target, horizon) planned for all labelled units, against those the ledger holds, both ways."""
    p = table(spark, d, "prediction_ledger").select(tidy("outer_test_unit").alias("unit"), "model", "target_name", "horizon_event_steps").distinct()
    models = p.select("model", "target_name", "horizon_event_steps").distinct()
    units = table(spark, d, "endpoint_labels").select(tidy("dataset_unit_key").alias("unit")).distinct()
    grid = units.crossJoin(models)  # every unit is planned for every arm; arms are few, and units meet them in blocks
    return ledger.missing_cells(grid, p, ["unit", "model", "target_name", "horizon_event_steps"])


def listing_diff(spark, d):
    """record_groups against what instrument_records hold."""
    found = records(spark, d).groupBy("gid").agg(F.count("*").alias("n_rows"))
    return ledger.listing_diff(table(spark, d, "record_groups").select("gid", "n_rows").distinct(), found, "gid", ["n_rows"])


def path_groups(spark, d):
    g = table(spark, d, "record_groups").select("container", "n_rows").distinct()
    return g.groupBy(F.regexp_extract("container", r"^([a-z]+\d+)/", 1).alias("batch")).agg(F.count("*").alias("n_containers"), F.concat_ws(";", F.sort_array(F.collect_set("container"))).alias("containers"))


def member_safety(spark, d):
    """Problems of archive members, and members that differ by letter case only."""
    m = table(spark, d, "acquisition_plans").select("source_member").distinct()
    bad = spark.createDataFrame([("../up.mat",), ("C:/a.mat",), ("bank_a\\es.mat",), ("bank_a//x.mat",), ("/root.mat",), ("BANK_A/es_sweep_01.MAT",), ("notes.exe",)], "source_member string")
    u = m.unionByName(bad)
    twins = u.groupBy(F.lower("source_member").alias("folded")).agg(F.count("*").alias("n_folded"))
    return u.withColumn("folded", F.lower("source_member")).join(twins, "folded").select("source_member", F.array_join(scalars.member_problems(F.col("source_member"), ["mat"]), ",").alias("problems"), "n_folded")


def clock_parse(spark, d):
    """Times of the records written as clock text and read back."""
    t = records(spark, d).select("gid", "row_pos", "time_us")
    text = F.concat(F.floor(F.col("time_us") / 3_600_000_000), F.lit(":"), F.lpad(F.floor(F.col("time_us") / 60_000_000) % 60, 2, "0"), F.lit(":"), F.lpad(F.floor(F.col("time_us") / 1_000_000) % 60, 2, "0"), F.lit("."), F.lpad(F.col("time_us") % 1_000_000, 6, "0"))
    return t.withColumn("clock", text).select("gid", "row_pos", "clock", scalars.clock_us(F.col("clock")).alias("parsed_us"))


QUERIES = {
    f.__name__: f
    for f in (
        chronology_counters, chronology_merge, segment_evidence, segment_summary_join, cycle_sign_buckets, status_chains, time_gap_audit, cycle_axis_audit, lineitem_axis_audit, finite_profile, missingness_geometry,
        trajectory_signature_dups, exact_duplicates, near_duplicates, shingle_hashes, winnow_words, winnow_fingerprints, fingerprint_pairs, confirmed_spans, source_spans, hash_chain, hash_chain_verify,
        causal_barrier_violations, status_precedence, generation_grid, listing_diff, path_groups, member_safety, clock_parse,
    )
}
