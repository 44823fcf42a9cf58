"""Binary spreadsheets: stream of an OLE container, frame profile, allowlist guard."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
BOF, EOF = 0x0809, 0x000A
MOST_BYTES = 256 << 20


def ole_streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name; a damaged chain is an error."""
    if data[:8] != MAGIC:
        raise ValueError("not a compound file")
    big, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    n_fat, first_dir, _, limit, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<I I I I I I I I", data, 44)
    sector = lambda k: data[(k + 1) * big : (k + 2) * big]

    def chain(k: int, table: list[int]) -> list[int]:
        out: list[int] = []
        while k not in (END, FREE):
            if k >= len(table) or len(out) > len(table):
                raise ValueError("broken sector chain")
            out.append(k)
            k = table[k]
        return out

    difat = list(struct.unpack_from("<109I", data, 76))
    k = first_difat
    for _ in range(n_difat):
        part = struct.unpack(f"<{big // 4}I", sector(k))
        difat += part[:-1]
        k = part[-1]
    fat: list[int] = []
    for k in [x for x in difat if x != FREE][:n_fat]:
        fat += struct.unpack(f"<{big // 4}I", sector(k))
    entries = b"".join(sector(k) for k in chain(first_dir, fat))
    mini_fat: list[int] = []
    if n_mini:
        raw = b"".join(sector(k) for k in chain(first_mini, fat))
        mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw))
    streams: dict[str, bytes] = {}
    mini = b""
    for at in range(0, len(entries), 128):
        e = entries[at : at + 128]
        n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
        start, size = struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0]
        if kind == 5:
            mini = b"".join(sector(k) for k in chain(start, fat))[:size]
        elif kind == 2:
            if size > MOST_BYTES:
                raise ValueError("stream is too large")
            name = e[: max(0, n - 2)].decode("utf-16-le")
            if size < limit:
                body = b"".join(mini[k * small : (k + 1) * small] for k in chain(start, mini_fat)) if size else b""
            else:
                body = b"".join(sector(k) for k in chain(start, fat))
            streams[name] = body[:size]
    return streams


def workbook(data: bytes) -> bytes:
    """The one workbook stream."""
    found = [v for k, v in ole_streams(data).items() if k.lower() in ("workbook", "book")]
    if len(found) != 1:
        raise ValueError(f"{len(found)} workbook streams")
    return found[0]


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """Record id, offset and size of every frame up to the zero padding; an incomplete frame is an error."""
    at = 0
    while at + 4 <= len(data):
        rid, size = struct.unpack_from("<HH", data, at)
        if rid == 0 and size == 0 and not any(data[at:]):
            return
        if at + 4 + size > len(data):
            raise ValueError("frame is cut off")
        yield rid, at, size
        at += 4 + size
    if at != len(data):
        raise ValueError("bytes after the last frame")


def guard(data: bytes, allowed: set[int]) -> int:
    """Number of frames if all are allowed and begins and ends balance, else an error."""
    depth = n = 0
    for rid, _, _ in frames(data):
        if rid not in allowed:
            raise ValueError(f"record {rid:#06x} is not allowed")
        depth += (rid == BOF) - (rid == EOF)
        if depth < 0:
            raise ValueError("end without begin")
        n += 1
    if depth:
        raise ValueError("begin without end")
    return n


def profile(files: DataFrame, ole: bool = True) -> DataFrame:
    """``path, record_id, n, first_offset, last_offset`` per file from a ``binaryFile`` frame; problems as ``error`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, rid, at, None) for rid, at, _ in frames(workbook(content) if ole else content)]
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "record_id", "at", "error"]).astype({"record_id": "Int64", "at": "Int64"})

    found = files.select("path", "content").mapInPandas(run, "path string, record_id long, at long, error string")
    return found.groupBy("path", "record_id", "error").agg(F.count("*").alias("n"), F.min("at").alias("first_offset"), F.max("at").alias("last_offset"))
