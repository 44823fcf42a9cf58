import struct

import pytest

from tidemark.sources import biff, sheets


def frame(rid, body=b""):
    return struct.pack("<HH", rid, len(body)) + body


def book(tabs, seam=None):
    """A workbook stream from {name: rows}; text goes to the shared table, optionally cut at ``seam`` bytes."""
    texts = list(dict.fromkeys(x for rows in tabs.values() for r in rows for x in r if isinstance(x, str)))
    table = b"".join(struct.pack("<HB", len(t), 0) + t.encode("latin-1") for t in texts)
    head = struct.pack("<II", len(texts), len(texts))
    if seam is None:
        sst = frame(sheets.SST, head + table)
    else:  # cut inside the first text: the continuation repeats the width flag
        sst = frame(sheets.SST, head + table[:seam]) + frame(sheets.CONTINUE, b"\0" + table[seam:])
    bodies = []
    for rows in tabs.values():
        b = frame(biff.BOF, b"\0" * 16)
        for i, r in enumerate(rows):
            for j, x in enumerate(r):
                if isinstance(x, str):
                    b += frame(sheets.LABELSST, struct.pack("<HHHI", i, j, 0, texts.index(x)))
                elif isinstance(x, int):
                    b += frame(sheets.RK, struct.pack("<HHHI", i, j, 0, (x << 2 & 0xFFFFFFFF) | 2))
                elif x is not None:
                    b += frame(sheets.NUMBER, struct.pack("<HHHd", i, j, 0, x))
        bodies.append(b + frame(biff.EOF))
    start = len(frame(biff.BOF, b"\0" * 16)) + sum(len(frame(sheets.BOUNDSHEET, b"\0" * (8 + len(n)))) for n in tabs) + len(sst) + len(frame(biff.EOF))
    out = frame(biff.BOF, b"\0" * 16)
    for n, b in zip(tabs, bodies, strict=True):
        out += frame(sheets.BOUNDSHEET, struct.pack("<IHBB", start, 0, len(n), 0) + n.encode())
        start += len(b)
    return out + sst + frame(biff.EOF) + b"".join(bodies)


ROW = [1, 1, -5, 1, "0:00:01.5", 2.5, -20.25, 0.5]


def test_packed_numbers():
    assert sheets._rk(struct.unpack("<I", struct.pack("<i", -7 << 2))[0] | 2) == -7.0
    assert sheets._rk((123 << 2) | 3) == 1.23
    assert sheets._rk(struct.unpack("<I", struct.pack("<d", 1.5)[4:])[0]) == 1.5


@pytest.mark.parametrize("seam", [None, 5])
def test_cells(seam):
    data = book({"record_1": [list(sheets.RECORD), ROW]}, seam)
    got = {(r, c): n if n is not None else t for _, _, r, c, _, n, t in sheets.sheet_cells(data)}
    assert [got[0, j] for j in range(8)] == list(sheets.RECORD) and [got[1, j] for j in range(8)] == ROW


def test_profile_events_and_records(spark, tmp_path):
    tabs = {
        "record_1": [list(sheets.RECORD), ROW, ROW[:7], [1.5, *ROW[1:]], [*ROW[:4], "bad", *ROW[5:]]],
        "record_2": [[*sheets.RECORD, "energy(mWh)"], [*ROW, 9.0]],
        "step": [list(sheets.STEP), [1, 1, 2, "0:00:00.9", 0.5, 0.7]],
        "cycle": [list(sheets.CYCLE), [1, 0.5, 0.25]],
        "odd": [["x"], [1]],
    }
    (tmp_path / "a.bin").write_bytes(book(tabs))
    (tmp_path / "b.bin").write_bytes(book(tabs)[:-3])
    found = sheets.cells(spark.read.format("binaryFile").load(str(tmp_path)), ole=False).cache()
    assert [r["path"][-5:] for r in found.filter("error is not null").collect()] == ["b.bin"]
    p = {r["sheet"]: (r["n_rows"], r["n_cols"], r["n_text"], r["n_number"]) for r in sheets.sheet_profile(found).collect()}
    assert p["record_2"] == (2, 9, 10, 8) and p["odd"] == (2, 1, 1, 1)
    e = {(r["sheet"], r["xls_row"]): (r["kind"], r["problem"]) for r in sheets.events(found).collect()}
    assert e == {
        ("record_1", 2): ("record", None), ("record_1", 3): ("record", "RAGGED_ROW"), ("record_1", 4): ("record", "INVALID_KEY"), ("record_1", 5): ("record", "INVALID_VALUE"),
        ("record_2", 2): ("record", None), ("step", 2): ("step", None), ("cycle", 2): ("cycle", None), ("odd", 2): (None, "UNKNOWN_HEADER"),
    }
    r = sheets.records(sheets.events(found)).orderBy("sheet_index").collect()
    assert [(x["status_code"], x["time_us"], x["voltage_v"], x["energy_mwh"]) for x in r] == [(-5, 1_500_000, 2.5, None), (-5, 1_500_000, 2.5, 9.0)]
