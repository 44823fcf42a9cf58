"""References to records that do not exist (yet, or any more)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import BLANKS, cut, table, tidy

FOREVER = (1 << 63) - 1
HEAVY_KEYS = 1000
HEAVY_INTERVALS = 100_000
SALTS = 64
ROW_BLOCK = 1024


def record_id(col: str) -> Column:
    """Hexadecimal id without case, surrounding blanks and one leading ``sha256:``."""
    return F.regexp_replace(tidy(col), "^sha256:", "")


def standing_intervals(records: DataFrame) -> DataFrame:
    """``(ref_key, born, gone)``: disjoint half-open spans in which some record with that key stands.

    ``records`` has ``ref_key, born, gone``; a null ``gone`` lasts for ever, a null ``born``
    or key never stands. Equal starts are folded before the per-key window sees them.
    """
    first = (
        records.filter("ref_key is not null and born is not null")
        .groupBy("ref_key", "born")
        .agg(F.max(F.coalesce("gone", F.lit(FOREVER))).alias("gone"))
        .filter("gone > born")
    )
    order = Window.partitionBy("ref_key").orderBy("born")
    reach = F.max("gone").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        first.withColumn("_fresh", F.when(reach >= F.col("born"), 0).otherwise(1))
        .withColumn("_island", F.sum("_fresh").over(order))
        .groupBy("ref_key", "_island")
        .agg(F.min("born").alias("born"), F.max("gone").alias("gone"))
        .drop("_island")
    )


def reference_groups(refs: DataFrame) -> DataFrame:
    """Pre-aggregate references per table, key, period and sequence number.

    ``refs`` has ``table_name, row_id, ref_key, seq, period``. Row ids ride along in sets
    cut at blocks of ROW_BLOCK consecutive ids, so no set can outgrow that number.
    Repeated rows collapse here. Rows without a key are no references.
    """
    return (
        refs.filter(F.col("ref_key").isNotNull())
        .groupBy("table_name", "ref_key", "period", "seq", F.floor(F.col("row_id") / ROW_BLOCK).alias("_block"))
        .agg(F.collect_set("row_id").alias("row_ids"))
        .drop("_block")
    )


def orphan_groups(groups: DataFrame, standing: DataFrame) -> DataFrame:
    """The groups of ``reference_groups`` whose key has no standing record at their sequence number.

    Keys with at least 1/HEAVY_KEYS of all groups are heavy: there can be no more than
    HEAVY_KEYS of them. Their spans are broadcast if counting shows that they are few,
    else the heavy groups are salted. All other keys go through one shuffled anti-join.
    A null sequence number can be covered by nothing, so such a reference is an orphan.
    """
    groups = cut(groups)
    least = max(2, groups.count() // HEAVY_KEYS + 1)
    heavy = cut(groups.groupBy("ref_key").count().filter(F.col("count") >= least).select("ref_key"))
    covers = (F.col("g.ref_key") == F.col("s.ref_key")) & (F.col("g.seq") >= F.col("s.born")) & (F.col("g.seq") < F.col("s.gone"))
    light = groups.join(F.broadcast(heavy), "ref_key", "left_anti")
    orphans = light.alias("g").join(standing.alias("s"), covers, "left_anti")
    if not heavy.isEmpty():
        hot = groups.join(F.broadcast(heavy), "ref_key", "left_semi")
        spans = cut(standing.join(F.broadcast(heavy), "ref_key", "left_semi"))
        if spans.limit(HEAVY_INTERVALS + 1).count() <= HEAVY_INTERVALS:
            found = hot.alias("g").join(F.broadcast(spans).alias("s"), covers, "left_anti")
        else:
            hot = hot.withColumn("_salt", F.pmod(F.xxhash64("row_ids", "seq"), F.lit(SALTS)))
            spans = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            found = hot.alias("g").join(spans.alias("s"), covers & (F.col("g._salt") == F.col("s._salt")), "left_anti").drop("_salt")
        orphans = orphans.unionByName(found)
    return orphans


def ledger_references(spark, sf_dir: str) -> DataFrame:
    """Non-blank prediction references of both dependent ledgers."""
    parts = [
        table(spark, sf_dir, name).select(
            F.lit(name).alias("table_name"), "row_id", F.when(F.btrim("prediction_id", F.lit(BLANKS)) != "", record_id("prediction_id")).alias("ref_key"),
            F.col(seq).alias("seq"), F.date_format("logged_at", "yyyy-MM").alias("period"),
        )
        for name, seq in (("maturity_ledger", "label_available_seq"), ("failure_ledger", "failure_seq"))
    ]
    return parts[0].unionByName(parts[1])


def prediction_spans(spark, sf_dir: str) -> DataFrame:
    preds = table(spark, sf_dir, "prediction_ledger").select(
        record_id("prediction_id").alias("ref_key"), F.col("prediction_commit_seq").alias("born"), F.col("withdrawn_seq").alias("gone")
    )
    return standing_intervals(preds)


def p1_found(spark, sf_dir: str) -> DataFrame:
    groups = reference_groups(ledger_references(spark, sf_dir))
    return orphan_groups(groups, prediction_spans(spark, sf_dir)).select("table_name", F.explode("row_ids").alias("row_id")).distinct()


def p1_orphan_counts(spark, sf_dir: str) -> DataFrame:
    """Orphan references per ledger and month of logging."""
    groups = reference_groups(ledger_references(spark, sf_dir))
    return (
        orphan_groups(groups, prediction_spans(spark, sf_dir))
        .groupBy("table_name", "period")
        .agg(F.sum(F.size("row_ids")).cast("long").alias("n_orphans"))
    )
