"""Writers: exact CSV, exclusive JSON, sealed ledgers, staged publishing with a last marker."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import seal, with_chain


def exact_csv(df: DataFrame, path: str) -> None:
    """CSV with the shortest digits that read back exactly, ``NA`` for null and NaN, ``+Inf`` and ``-Inf``; an existing path is an error."""
    out = df
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            x = F.col(c).cast("double")
            out = out.withColumn(c, F.when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").when(~F.isnan(x), x.cast("string")))
    out.write.mode("errorifexists").option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)


def write_json(path: str, value, exclusive: bool = True) -> None:
    """JSON through a temporary file and a rename; an exclusive write refuses an existing path."""
    if exclusive and os.path.exists(path):
        raise FileExistsError(path)
    text = json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n"
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    if exclusive:
        os.link(tmp, path)  # fails if the path came into being meanwhile
        os.unlink(tmp)
    else:
        os.replace(tmp, path)


def new_folder(path: str) -> str:
    """An empty folder; one that holds anything, or a link, is refused."""
    if os.path.islink(path) or (os.path.isdir(path) and os.listdir(path)):
        raise FileExistsError(path)
    os.makedirs(path, exist_ok=True)
    return path


def sealed_ledger(df: DataFrame, chain: str, order: list[str], path: str) -> None:
    """Hash chain as parquet with a seal per chain beside it."""
    chained = with_chain(df, chain, order)
    chained.write.mode("errorifexists").parquet(f"{path}/ledger")
    written = df.sparkSession.read.parquet(f"{path}/ledger")
    seal(written, chain).write.mode("errorifexists").parquet(f"{path}/seals")


def spool(df: DataFrame, group: str, place: str, path: str) -> None:
    """Rows of each group in order, so that a range of places is a range of row groups."""
    df.repartitionByRange(group, place).sortWithinPartitions(group, place).write.mode("errorifexists").parquet(path)


def publish(frames: dict[str, DataFrame], path: str, facts: dict) -> None:
    """Write all tables to a staging folder, then a manifest of file hashes, then COMPLETE, and rename.

    COMPLETE names the manifest's hash and comes last, so a reader that finds it finds
    everything. A failure leaves a BLOCKED receipt in place of the result and is raised again.
    """
    stage = f"{path}.staging"
    new_folder(stage)
    try:
        for name, df in frames.items():
            df.write.mode("errorifexists").parquet(f"{stage}/{name}")
        listing = {}
        for root, _, files in os.walk(stage):
            for f in sorted(files):
                if not f.startswith((".", "_")):
                    with open(os.path.join(root, f), "rb") as h:
                        listing[os.path.relpath(os.path.join(root, f), stage)] = hashlib.file_digest(h, "sha256").hexdigest()
        write_json(f"{stage}/MANIFEST.json", listing)
        with open(f"{stage}/MANIFEST.json", "rb") as h:
            digest = hashlib.file_digest(h, "sha256").hexdigest()
        write_json(f"{stage}/COMPLETE.json", {"manifest_sha256": digest, **facts})
        os.rename(stage, path)
    except BaseException as e:
        write_json(f"{stage}/BLOCKED.json", {"error": f"{type(e).__name__}: {e}"[:500]}, exclusive=False)
        raise
