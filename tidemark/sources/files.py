"""Listings, strict JSON, ledger CSV, fragment groups, manifests, spools, matrices."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import header_time


class Duplicate(ValueError):
    pass


def _pairs(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise Duplicate(f"duplicate key {k}")
        out[k] = v
    return out


def _reject(x):
    raise ValueError(f"non-finite number {x}")


def strict_json(text: str, canonical: bool = True):
    """Value of JSON text without duplicate keys or non-finite numbers; canonical text must also be its own rendering."""
    value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_reject)
    if canonical and json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) != text:
        raise ValueError("not canonical")
    return value


def json_problems(df: DataFrame, column: str, canonical: bool = True) -> DataFrame:
    """The frame with ``json_error``: null where the text is strict JSON."""

    return df.withColumn("json_error", _json_udf(canonical)(F.col(column)))


def _json_udf(canonical: bool):
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def check(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            try:
                strict_json(t, canonical)
                out.append(None)
            except (ValueError, TypeError) as e:
                out.append(str(e)[:200])
        return pd.Series(out, dtype=object)

    return check


def archive_listing(spark: SparkSession, path: str) -> DataFrame:
    """Members of technical listings: blocks of ``Key = value`` lines, one row per member, ``path, member, props``.

    The block before the dashed line describes the archive; blocks after it are members.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    body = text.select("path", F.element_at(F.split("value", r"(?m)^-{5,}$"), -1).alias("body"))
    blocks = body.select("path", F.posexplode(F.split(F.btrim("body"), r"\n\s*\n")).alias("pos", "block"))
    props = blocks.withColumn("props", F.str_to_map("block", F.lit("\n"), F.lit(" = ")))
    return props.filter(F.col("props")["Path"].isNotNull()).select("path", "pos", F.col("props")["Path"].alias("member"), "props")


def rar_listing(spark: SparkSession, path: str) -> DataFrame:
    """Members of ``Key: value`` listings, ``path, member, size, props``."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    blocks = text.select("path", F.posexplode(F.split(F.btrim("value"), r"\n\s*\n")).alias("pos", "block"))
    props = blocks.withColumn("props", F.str_to_map(F.regexp_replace("block", r"(?m)^\s+", ""), F.lit("\n"), F.lit(": ")))
    return props.filter(F.col("props")["Name"].isNotNull()).select("path", "pos", F.col("props")["Name"].alias("member"), F.try_to_number(F.col("props")["Size"], F.lit("999999999999999")).cast("long").alias("size"), "props")


def fragment_groups(paths: DataFrame, column: str = "path", pattern: str = r"([^/]+)/(\d+)(?:_(\d+))?\.[^./]+$") -> DataFrame:
    """Files of one (batch, id) with how many fragments they have and whether those run from 0 without a gap."""
    part = lambda k: F.regexp_extract(column, pattern, k)
    p = paths.filter(F.col(column).rlike(pattern)).select(part(1).alias("batch"), part(2).cast("long").alias("id"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("0")).cast("long").alias("fragment"))
    return p.groupBy("batch", "id").agg(F.count("*").alias("n_fragments"), ((F.max("fragment") == F.count("*") - 1) & (F.count_distinct("fragment") == F.count("*"))).alias("contiguous"))


def bound_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a ``binaryFile`` frame against ``name, size, sha256``: MISSING, UNEXPECTED, SIZE, HASH or OK."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("got_size"), F.sha2("content", 256).alias("got_hash"))
    j = manifest.join(have, "name", "full_outer")
    why = F.when(F.col("got_size").isNull(), "MISSING").when(F.col("size").isNull(), "UNEXPECTED").when(F.col("size") != F.col("got_size"), "SIZE").when(F.col("sha256") != F.col("got_hash"), "HASH").otherwise("OK")
    return j.select("name", why.alias("status"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV ledger with ``NA`` as null; every column is declared, malformed rows are an error."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA", mode="FAILFAST", nanValue="NaN", positiveInf="+Inf", negativeInf="-Inf")


def headers(df: DataFrame, column: str) -> DataFrame:
    """Acquisition time, channel, device and protocol of header text; several different starts are a status."""
    starts = F.regexp_extract_all(column, F.lit(r"(?im)^\s*(?:acquisition )?start(?:ed)?(?: time)?\s*[:=]\s*(\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2})"), 1)
    one = lambda key: F.nullif(F.regexp_extract(column, rf"(?im)^\s*{key}\s*[:=]\s*(.+?)\s*$", 1), F.lit(""))
    d = df.withColumn("_s", F.array_distinct(starts))
    status = F.when(F.size("_s") == 0, "NO_START").when(F.size("_s") > 1, "CONFLICTING_START").otherwise("OK")
    return d.withColumn("started_at", F.when(F.size("_s") == 1, header_time(F.get("_s", F.lit(0))))).withColumn("start_status", status).withColumns({k: one(k) for k in ("channel", "device", "protocol")}).drop("_s")


def canonical_columns(tokens, raw: list[str], names: list[str]):
    """Names for a header if its raw tokens are the expected ones, else null."""
    return F.when(tokens == F.array(*map(F.lit, raw)), F.array(*map(F.lit, names)))


def hdf5_profile(path: str):
    """Finite, NaN and infinite counts of every numeric dataset of an HDF5 file; needs h5py, which is optional."""
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("reading HDF5 needs h5py, which is not installed") from e
    import numpy as np

    rows = []

    def visit(name, obj):
        if isinstance(obj, h5py.Dataset) and obj.dtype.kind in "fiu" and not obj.external:
            n = finite = nan = 0
            for part in obj.iter_chunks() if obj.chunks else [...]:
                x = np.asarray(obj[part], float)
                n, finite, nan = n + x.size, finite + int(np.isfinite(x).sum()), nan + int(np.isnan(x).sum())
            rows.append((name, n, finite, nan, n - finite - nan))

    with h5py.File(path, "r") as f:
        f.visititems(visit)
    return rows
