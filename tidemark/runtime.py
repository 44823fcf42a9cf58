"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v\u00a0"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per application.

    Workers on other machines, and workers started elsewhere than in the repository, can
    then load the functions of the operators. Spark keeps the file for executors that join later.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-package-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(col: Column | str) -> Column:
    """An identifier without surrounding blanks, in lower case."""
    return F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the session's ``spark.checkpoint.dir``.

    Where none is set, a local one is made, on a local master only: a folder of one machine is no use to a cluster.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The files outlive any executor, so a lost executor costs the retried tasks only.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], least_rows: int) -> Iterator[pd.DataFrame]:
    """Regroup a stream sorted by ``keys`` into frames of at least ``least_rows`` rows
    that never divide a group; only the open tail is held in memory."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < least_rows:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        k = whole[keys]
        changed = (k != k.shift()).any(axis=1).to_numpy().nonzero()[0]
        at = int(changed[-1]) if len(changed) else 0
        if at == 0:
            held = [whole]
            continue
        yield whole.iloc[:at]
        held = [whole.iloc[at:]]
        rows = len(whole) - at
    if held:
        yield pd.concat(held, ignore_index=True)
