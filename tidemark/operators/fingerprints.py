"""Fingerprint index of instrument records: 40-byte tokens, SHA-256 of eight rows, winnowed over 25.

The binary token needs the bytes of doubles, which Spark SQL cannot give, so bytes and
digests are made in Arrow batches; groups are cut into blocks of rows with margins as wide
as a winnowing window, so a group of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.readings import in_blocks
from tidemark.runtime import whole_groups

SHINGLE, WINDOW, BLOCK = 8, 25, 4096
_TOKEN = np.dtype([("status", ">i8"), ("time", ">i8"), ("v", ">f8"), ("a", ">f8"), ("q", ">f8")])


def tokens(frame: pd.DataFrame) -> np.ndarray:
    """40 bytes per row; zeros lose their sign."""
    out = np.empty(len(frame), _TOKEN)
    out["status"], out["time"] = frame["status_code"], frame["time_us"]
    for to, c in (("v", "voltage_v"), ("a", "current_ma"), ("q", "capacity_mah")):
        out[to] = frame[c].to_numpy(float) + 0.0
    return out


def winnowed(digests: list[bytes], window: int = WINDOW) -> list[int]:
    """Places of the rightmost smallest digest of every window, each once; a short list is one window.

    Digests are ranked as four big-endian words; rank and place together make one number
    that is smallest at the wanted place, so all windows are settled by one minimum.
    """
    n = len(digests)
    if not n:
        return []
    parts = np.frombuffer(b"".join(digests), ">u8").reshape(n, -1).astype(np.uint64)
    rank = np.unique(parts, axis=0, return_inverse=True)[1].reshape(-1).astype(np.int64)
    key = rank * n + np.arange(n)[::-1]
    lowest = np.lib.stride_tricks.sliding_window_view(key, min(window, n)).min(axis=1)
    return np.unique(n - 1 - lowest % n).tolist()


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(batches, ["gid", "block"], 50_000):
        frame = frame[~frame.duplicated(["gid", "block", "row_pos"])]
        rows = []
        for (gid, _), g in frame.groupby(["gid", "block"], sort=False):
            raw = tokens(g).tobytes()
            pos, core = g["row_pos"].to_numpy(), g["core"].to_numpy()
            d = [hashlib.sha256(raw[40 * i : 40 * (i + SHINGLE)]).digest() for i in range(len(g) - SHINGLE + 1)]
            for i in winnowed(d):
                if core[i] == 1:
                    rows.append((d[i], gid, pos[i]))
        yield pd.DataFrame(rows, columns=["digest", "gid", "row_offset"])


def index(records: DataFrame) -> DataFrame:
    """``digest, gid, row_offset`` of all groups."""
    margin = WINDOW + SHINGLE
    laid = in_blocks(records.select("gid", "row_pos", "status_code", "time_us", "voltage_v", "current_ma", "capacity_mah"), "row_pos", BLOCK, margin)
    return laid.repartition("gid", "block").sortWithinPartitions("gid", "block", "row_pos").mapInPandas(_index, "digest binary, gid long, row_offset long")
