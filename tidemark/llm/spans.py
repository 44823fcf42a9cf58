"""Long exact spans shared between records.

A row's token is a 128-bit hash of its measured fields; a window is ``least`` successive
rows, hashed by a rolling polynomial of the tokens. A first pass counts windows in
count-min sketches, one per partition, which are merged counter by counter. Sketches only
overestimate, so a second pass that keeps windows with an estimate of two or more loses
none; these few are shuffled and grouped exactly.

Within a group only the ends of runs are paired: two occurrences begin a run if the rows
before them differ, and end one if the rows behind them differ. Occurrences are first
pooled by that neighbouring row, and pools rather than occurrences are set against each
other, so the pairs made are the runs themselves and never the windows inside them. Along
one diagonal beginnings and ends alternate, which yields maximal runs of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.readings import in_blocks
from tidemark.runtime import cut, table, whole_groups

LEAST = 32
BLOCK = 8192
DEPTH = 3
MAX_WIDTH = 1 << 24
SLICE = 1 << 16
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
FIELDS = ["status_code", "time_us", "voltage_v", "current_ma", "capacity_mah"]
_WINDOW = "gid long, pos long, h1 long, h2 long, prev long, next long"


def tokens(records: DataFrame, key: str, place: str, fields: list[str]) -> DataFrame:
    """``gid, pos, a, b``: both halves of each row's hash. Zeros of either sign are equal, and so are nulls."""
    kinds = dict(records.dtypes)
    plain = [F.col(f) + F.lit(0.0) if kinds[f] in ("double", "float") else F.col(f) for f in fields]
    nulls = [F.col(f).isNull() for f in fields]
    half = lambda seed: F.xxhash64(F.lit(seed), *plain, *nulls)
    return records.filter(F.col(key).isNotNull() & F.col(place).isNotNull()).select(
        F.col(key).cast("long").alias("gid"), F.col(place).cast("long").alias("pos"), half(1).alias("a"), half(2).alias("b")
    )


def rolling(tok: np.ndarray, least: int, m: np.uint64) -> np.ndarray:
    """Hash of every ``least`` successive tokens, by doubling: wraps modulo 2**64."""
    with np.errstate(over="ignore"):
        done, n, power, h = np.zeros(len(tok), np.uint64), 0, m, tok.copy()
        size, rest = 1, least
        while rest:
            if rest & 1:  # append a stretch of ``size`` tokens behind the ``n`` done
                shifted = np.zeros(len(tok), np.uint64)
                shifted[: len(tok) - n] = h[n:]
                done = done * power + shifted
                n += size
            ahead = np.zeros(len(tok), np.uint64)
            ahead[: max(0, len(tok) - size)] = h[size:]
            h, power, size, rest = h * power + ahead, power * power, size * 2, rest >> 1
        return done


def _windows(frame: pd.DataFrame, least: int) -> pd.DataFrame:
    frame = frame[~frame.duplicated(["gid", "block", "pos"])]
    gid, block, pos = (frame[c].to_numpy() for c in ("gid", "block", "pos"))
    a, b = (frame[c].to_numpy().view(np.uint64) for c in ("a", "b"))
    joined = np.r_[False, (gid[1:] == gid[:-1]) & (block[1:] == block[:-1]) & (pos[1:] == pos[:-1] + 1)]
    run = np.arange(len(gid)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(gid))))
    last = np.arange(len(gid)) + least - 1
    whole = np.zeros(len(gid), bool)
    fits = last < len(gid)
    whole[fits] = run[last[fits]] >= least - 1
    whole &= (frame["core"].to_numpy() == 1) & (run[np.minimum(last, len(gid) - 1)] >= least - 1)
    at = np.flatnonzero(whole)
    h1, h2 = (rolling(t, least, m) for t, m in zip((a, b), MULTIPLIERS, strict=True))
    with np.errstate(over="ignore"):
        mixed = np.where(a ^ (b * MULTIPLIERS[0]) == 0, np.uint64(1), a ^ (b * MULTIPLIERS[0]))
    after = np.minimum(at + least, len(gid) - 1)
    prev = np.where((at > 0) & joined[at], mixed[np.maximum(at - 1, 0)], 0)
    follow = np.where((at + least < len(gid)) & joined[after], mixed[after], 0)
    return pd.DataFrame({"gid": gid[at], "pos": pos[at], "h1": h1[at].view(np.int64), "h2": h2[at].view(np.int64), "prev": prev.astype(np.uint64).view(np.int64), "next": follow.astype(np.uint64).view(np.int64)})


def _cells(h1: np.ndarray, h2: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = h1.view(np.uint64) + np.uint64(row) * (h2.view(np.uint64) | np.uint64(1))
    return (mixed >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def _sketch(width: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((DEPTH, width), np.uint8)  # saturate at 255, which is as good as any number above one
        for frame in whole_groups(batches, ["gid", "block"], 100_000):
            w = _windows(frame, least)
            for row in range(DEPTH):
                cell, n = np.unique(_cells(w["h1"].to_numpy(), w["h2"].to_numpy(), row, width), return_counts=True)
                counts[row, cell] = np.minimum(counts[row, cell].astype(np.int64) + n, 255)
        flat = counts.reshape(-1)
        for k in range(0, len(flat), SLICE):
            part = flat[k : k + SLICE]
            if part.any():
                yield pd.DataFrame({"slice": [k // SLICE], "counts": [part.tobytes()]})

    return run


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: np.ndarray | None = None
    here = None
    for frame in frames:
        for k, raw in zip(frame["slice"], frame["counts"], strict=True):
            part = np.frombuffer(raw, np.uint8)
            if k != here:
                if here is not None:
                    yield pd.DataFrame({"slice": [here], "counts": [total.tobytes()]})
                here, total = k, part.copy()
            else:
                total = np.minimum(total.astype(np.uint16) + part, 255).astype(np.uint8)
    if here is not None:
        yield pd.DataFrame({"slice": [here], "counts": [total.tobytes()]})


def repeated_windows(toks: DataFrame, least: int = LEAST) -> DataFrame:
    """``gid, pos, h1, h2, prev, next`` of every window that occurs in more than one group.

    ``prev`` and ``next`` stand for the rows around the window, 0 where there is none. The
    sketch has a fixed largest size (DEPTH times MAX_WIDTH bytes), which bounds what is
    broadcast; with more windows than that it overestimates more, and the exact pass does
    more of the work.
    """
    spark = toks.sparkSession
    laid = in_blocks(toks, "pos", BLOCK, least + 1).repartition("gid", "block").sortWithinPartitions("gid", "block", "pos", "a", "b")
    laid = cut(laid)
    width = 1 << max(16, min(MAX_WIDTH.bit_length() - 1, int(laid.count()).bit_length()))
    parts = laid.mapInPandas(_sketch(width, least), "slice long, counts binary").repartition("slice").sortWithinPartitions("slice").mapInPandas(_merge, "slice long, counts binary")
    merged = np.zeros(DEPTH * width, np.uint8)
    for r in parts.toLocalIterator():  # at most DEPTH * MAX_WIDTH bytes in all
        merged[r["slice"] * SLICE : r["slice"] * SLICE + len(r["counts"])] = np.frombuffer(bytes(r["counts"]), np.uint8)
    shared = spark.sparkContext.broadcast(np.packbits(merged >= 2))  # one bit a counter is all that the second pass asks

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for frame in whole_groups(batches, ["gid", "block"], 100_000):
            w = _windows(frame, least)
            ok = np.ones(len(w), bool)
            for row in range(DEPTH):
                at = row * width + _cells(w["h1"].to_numpy(), w["h2"].to_numpy(), row, width)
                ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            if ok.any():
                yield w[ok]

    found = cut(laid.mapInPandas(keep, _WINDOW))
    exact = found.groupBy("h1", "h2").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).filter("lo < hi").select("h1", "h2")
    return found.join(exact, ["h1", "h2"], "left_semi")


def _edges(windows: DataFrame, side: str) -> DataFrame:
    """Pairs of occurrences of one window whose neighbours on ``side`` differ or are missing."""
    pools = windows.select("h1", "h2", F.col(side).alias("x")).distinct()
    pairs = pools.join(pools.withColumnRenamed("x", "y"), ["h1", "h2"]).filter("x <> y or x = 0")
    a = windows.select("h1", "h2", F.col(side).alias("x"), F.col("gid").alias("gid_a"), F.col("pos").alias("pos_a"))
    b = windows.select("h1", "h2", F.col(side).alias("y"), F.col("gid").alias("gid_b"), F.col("pos").alias("pos_b"))
    return pairs.join(a, ["h1", "h2", "x"]).join(b, ["h1", "h2", "y"]).filter("gid_a < gid_b").select("gid_a", "gid_b", "pos_a", "pos_b")


def shared_runs(records: DataFrame, least: int = LEAST, key: str = "gid", place: str = "row_pos", fields: list[str] = FIELDS) -> DataFrame:
    """``gid_a, start_a, gid_b, start_b, n_rows``: maximal equal runs of at least ``least`` rows in two groups.

    Rows with a null group or place belong to nothing. Repeated rows count once; of
    different rows at one place the one with the smallest hash counts. A gap in the places
    ends a run. An empty table gives an empty result.
    """
    windows = cut(repeated_windows(tokens(records, key, place, fields), least))
    ends = _edges(windows, "prev").withColumn("is_end", F.lit(0)).unionByName(_edges(windows, "next").withColumn("is_end", F.lit(1)))
    line = Window.partitionBy("gid_a", "gid_b", F.col("pos_b") - F.col("pos_a")).orderBy("pos_a", "is_end")
    runs = ends.withColumn("end_a", F.lead("pos_a").over(line)).filter("is_end = 0")
    return runs.select("gid_a", F.col("pos_a").alias("start_a"), "gid_b", F.col("pos_b").alias("start_b"), (F.col("end_a") - F.col("pos_a") + least).alias("n_rows"))


def shared_share(records: DataFrame, least: int = LEAST, key: str = "gid", place: str = "row_pos", fields: list[str] = FIELDS) -> DataFrame:
    """``gid, n_rows, n_shared, share``: how much of each group lies in any run of at least ``least`` rows shared with another.

    The shared windows alone say so: each covers ``least`` rows, less where the next one begins
    earlier. No pairs of groups are made, so the work grows with the rows. Places are cut
    into blocks; only the first place of each block crosses them.
    """
    at = records.filter(F.col(key).isNotNull() & F.col(place).isNotNull()).select(F.col(key).cast("long").alias("gid"), F.col(place).alias("pos")).distinct()
    sizes = at.groupBy("gid").agg(F.count("*").alias("n_rows"))
    places = cut(repeated_windows(tokens(records, key, place, fields), least).select("gid", "pos").distinct().withColumn("block", F.floor(F.col("pos") / BLOCK)))
    begins = places.groupBy("gid", "block").agg(F.min("pos").alias("first"))
    begins = begins.select("gid", "block", F.lead("first").over(Window.partitionBy("gid").orderBy("block")).alias("beyond"))
    inside = F.lead("pos").over(Window.partitionBy("gid", "block").orderBy("pos"))
    follow = places.withColumn("inside", inside).join(begins, ["gid", "block"]).withColumn("gap", F.coalesce("inside", "beyond") - F.col("pos"))
    covered = follow.groupBy("gid").agg(F.sum(F.least(F.coalesce("gap", F.lit(least)), F.lit(least))).cast("long").alias("n_shared"))
    out = sizes.join(covered, "gid", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)).cast("long"))
    return out.withColumn("share", F.round(F.col("n_shared") / F.col("n_rows"), 6))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return shared_runs(table(spark, sf_dir, "instrument_records"))


def p5_shares(spark, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "instrument_records"))
