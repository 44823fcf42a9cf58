"""Tamper-evident ledgers: row hash chains, their parallel check, causal barriers, gate status."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64
CHAIN = ["row_payload_json", "prev_row_hash", "row_hash"]


def payload_json(columns: list[str], kinds: dict[str, str]) -> Column:
    """Canonical JSON of a row: keys in order, no blanks, nulls kept, non-finite numbers as {"nonfinite": ...}."""
    parts: list[Column] = []
    for i, c in enumerate(sorted(columns)):
        x = F.col(c)
        kind = kinds[c]
        if kind in ("double", "float"):
            text = F.when(F.isnan(x), F.lit('{"nonfinite":"NaN"}')).when(x == float("inf"), F.lit('{"nonfinite":"+Inf"}')).when(x == float("-inf"), F.lit('{"nonfinite":"-Inf"}')).otherwise(x.cast("string"))
        elif kind in ("bigint", "int", "smallint", "tinyint", "boolean"):
            text = x.cast("string")
        else:
            text = F.expr(f"substring({_json_text(c)}, 2, length({_json_text(c)}) - 2)")
        parts += [F.lit(("," if i else "{") + '"' + c + '":'), F.coalesce(text, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def _json_text(c: str) -> str:
    return f"to_json(array(cast(`{c}` as string)))"


def with_chain(df: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """Each row with its payload, the hash of its predecessor in its chain and its own hash.

    A chain is sequential by definition: each hash contains the one before. Sorted rows
    stream through their task, which carries one hash, so a chain of any length takes one
    row's memory; many chains run side by side. Rows without a chain form one of their own.
    """
    taken = {*CHAIN, "row_number"} & set(df.columns)
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")
    rows = df.withColumn("row_payload_json", payload_json(df.columns, dict(df.dtypes)))
    added = [T.StructField("row_number", T.IntegerType()), T.StructField("prev_row_hash", T.StringType()), T.StructField("row_hash", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, n = None, GENESIS, 0
        for b in batches:
            numbers, links, hashes = [], [], []
            for key, payload in zip(b.column(chain).to_pylist(), b.column("row_payload_json").to_pylist(), strict=True):
                if n == 0 or key != here:
                    here, last, n = key, GENESIS, 0
                n += 1
                numbers.append(n)
                links.append(last)
                last = hashlib.sha256(f"{last}\n{payload}".encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int32()), pa.array(links, pa.string()), pa.array(hashes, pa.string())], names=[*b.schema.names, *[f.name for f in added]])

    laid = rows.repartition(chain).sortWithinPartitions(chain, *order, "row_payload_json")
    return laid.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def verify_chain(ledger: DataFrame, chain: str, order: str = "row_number") -> DataFrame:
    """Rows that break their chain: a wrong own hash or a link that is not the predecessor's hash. Parallel within chains."""
    prev = F.coalesce(F.lag("row_hash").over(Window.partitionBy(chain).orderBy(order)), F.lit(GENESIS))
    own = F.sha2(F.concat("prev_row_hash", F.lit("\n"), "row_payload_json"), 256)
    checked = ledger.withColumn("bad_link", F.col("prev_row_hash") != prev).withColumn("bad_hash", F.col("row_hash") != own)
    return checked.filter("bad_link or bad_hash").select(chain, order, "bad_link", "bad_hash")


def seal(ledger: DataFrame, chain: str, order: str = "row_number") -> DataFrame:
    """Row count and last hash of every chain."""
    return ledger.groupBy(chain).agg(F.count("*").alias("row_count"), F.max_by("row_hash", order).alias("final_row_hash"))


def unsealed(ledger: DataFrame, seals: DataFrame, chain: str) -> DataFrame:
    """Chains whose count or last hash is not what their seal says, and seals or chains without the other."""
    now = seal(ledger, chain).toDF(chain, "n", "h")
    j = now.join(seals, chain, "full_outer")
    same = (F.col("n") == F.col("row_count")) & (F.col("h") == F.col("final_row_hash"))
    return j.filter(~F.coalesce(same, F.lit(False))).select(chain)


def barrier_violations(commits: DataFrame, reveals: DataFrame, key: list[str]) -> DataFrame:
    """Reveals whose checkpoint is missing, differs, or was committed only after them.

    ``commits``: key, ``commit_hash``, ``commit_seq``; ``reveals``: key, ``required_hash``, ``reveal_seq``.
    """
    j = reveals.join(commits, key, "left")
    why = F.when(F.col("commit_hash").isNull(), "NO_CHECKPOINT").when(F.col("commit_hash") != F.col("required_hash"), "HASH_MISMATCH").when(F.col("commit_seq") >= F.col("reveal_seq"), "REVEALED_BEFORE_COMMIT")
    return j.withColumn("violation", why).filter("violation is not null").select(*key, "violation")


def status_of(statuses: Column) -> Column:
    """The gravest status of a group: FAIL, BLOCKED, AMBER, PASS; BLOCKED if there is none. Use as an aggregate."""
    rank = F.min(F.when(statuses == "FAIL", 0).when(statuses == "BLOCKED", 1).when(statuses == "AMBER", 2).when(statuses == "PASS", 3))
    return F.when(rank == 0, "FAIL").when(rank == 2, "AMBER").when(rank == 3, "PASS").otherwise("BLOCKED")


def missing_cells(planned: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Planned cells without a result and results nobody planned."""
    a, b = planned.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("problem", F.lit("MISSING")).unionByName(b.join(a, keys, "left_anti").withColumn("problem", F.lit("UNPLANNED")))


def listing_diff(expected: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Missing, unexpected and changed entries; of changed ones the fields that differ."""
    e, f = expected.select(key, F.struct(*fields).alias("e")), found.select(key, F.struct(*fields).alias("f"))
    changed = F.filter(F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    j = e.join(f, key, "full_outer").withColumn("kind", F.when(F.col("f").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").when(F.size(changed) > 0, "CHANGED"))
    return j.filter("kind is not null").select(key, "kind", F.when(F.col("kind") == "CHANGED", F.array_join(changed, ",")).alias("changed_fields"))
