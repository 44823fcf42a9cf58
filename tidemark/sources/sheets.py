"""Cells of BIFF8 workbooks as rows, sheet profiles, and records and summaries by exact header.

Read are numbers (also packed ones), shared and plain text, booleans and errors; formulas
give their stored number and are never evaluated. Blank cells are no cells.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clock_us
from tidemark.operators.rules import exact_integer
from tidemark.sources.biff import BOF, EOF, frames, workbook

#: Record ids.
BOUNDSHEET, SST, CONTINUE, NUMBER, RK, MULRK, LABELSST, LABEL, BOOLERR, FORMULA = 0x85, 0xFC, 0x3C, 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x205, 0x06
#: Headers of the instrument's sheets.
RECORD = ("cycle", "step", "status", "record_number", "record_time(h:min:s.ms)", "voltage(V)", "current(mA)", "capacity(mAh)")
STEP = ("cycle", "step", "status", "record_time(h:min:s.ms)", "capacity(mAh)", "energy(mWh)")
CYCLE = ("cycle", "charge_capacity(mAh)", "discharge_capacity(mAh)")
LAYOUTS = {
    RECORD: "record", (*RECORD, "energy(mWh)"): "record", STEP: "step", (*STEP, "ini_voltage(V)", "end_voltage(V)"): "step", CYCLE: "cycle", (*CYCLE, "charge_energy(mWh)", "discharge_energy(mWh)"): "cycle",
}
TEXT, NUMERIC, BOOLEAN, ERROR = 1, 2, 4, 5
_CELLS = "path string, sheet_index int, sheet string, row long, col int, ctype int, number double, text string, error string"


def _rk(raw: int) -> float:
    v = float(struct.unpack("<i", struct.pack("<I", raw & 0xFFFFFFFC))[0] >> 2) if raw & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", raw & 0xFFFFFFFC))[0]
    return v / 100 if raw & 1 else v


class _Parts:
    """Bytes of a record and its continuations, where text may change its width at each seam."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at == len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                if self.k == len(self.parts):
                    raise ValueError("text table is cut off")
            piece = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
        return out

    def text(self) -> str:
        n = struct.unpack("<H", self.take(2))[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, ""
        while n:
            if self.at == len(self.parts[self.k]):  # a continuation inside text starts with its own width flag
                self.k, self.at = self.k + 1, 0
                if self.k == len(self.parts):
                    raise ValueError("text table is cut off")
                wide = self.take(1)[0] & 1
            room = (len(self.parts[self.k]) - self.at) // (2 if wide else 1)
            m = min(n, room)
            if not m:
                raise ValueError("half a letter at a seam")
            out += self.take(m * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1")
            n -= m
        self.take(4 * runs + extra)
        return out


def sheet_cells(data: bytes) -> Iterator[tuple[int, str, int, int, int, float | None, str | None]]:
    """Sheet index and name, row, column, type, number, text of every cell, sheets in order."""
    all_frames = list(frames(data))
    body = lambda f: data[f[1] + 4 : f[1] + 4 + f[2]]
    names, strings = {}, []
    for k, f in enumerate(all_frames):
        if f[0] == EOF:
            break
        if f[0] == BOUNDSHEET:
            b = body(f)
            names[struct.unpack_from("<I", b)[0]] = b[8 : 8 + b[6] * 2].decode("utf-16-le") if b[7] & 1 else b[8 : 8 + b[6]].decode("latin-1")
        elif f[0] == SST:
            parts = [body(f)[8:]]
            for g in all_frames[k + 1 :]:
                if g[0] != CONTINUE:
                    break
                parts.append(body(g))
            p = _Parts(parts)
            strings = [p.text() for _ in range(struct.unpack_from("<I", body(f), 4)[0])]
    index, name, depth = -1, None, 0
    for f in all_frames:
        rid, at = f[0], f[1]
        if rid == BOF:
            depth += 1
            if depth == 1 and at in names:
                index, name = index + 1, names[at]
        elif rid == EOF:
            depth -= 1
            if depth == 0:
                name = None
        elif name is not None and depth == 1:
            b = body(f)
            if rid in (NUMBER, RK, LABELSST, LABEL, BOOLERR, FORMULA):
                row, col = struct.unpack_from("<HH", b)
                if rid == NUMBER or (rid == FORMULA and b[12:14] != b"\xff\xff"):
                    yield index, name, row, col, NUMERIC, struct.unpack_from("<d", b, 6)[0], None
                elif rid == RK:
                    yield index, name, row, col, NUMERIC, _rk(struct.unpack_from("<I", b, 6)[0]), None
                elif rid == LABELSST:
                    yield index, name, row, col, TEXT, None, strings[struct.unpack_from("<I", b, 6)[0]]
                elif rid == LABEL:
                    yield index, name, row, col, TEXT, None, _Parts([b[6:]]).text()
                elif rid == BOOLERR:
                    yield index, name, row, col, ERROR if b[7] else BOOLEAN, float(b[6]), None
            elif rid == MULRK:
                row, first = struct.unpack_from("<HH", b)
                for j in range((len(b) - 6) // 6):
                    yield index, name, row, first + j, NUMERIC, _rk(struct.unpack_from("<I", b, 6 + 6 * j)[0]), None


def cells(files: DataFrame, ole: bool = True) -> DataFrame:
    """All cells of a ``binaryFile`` frame of workbooks; a damaged file gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet_index", "sheet", "row", "col", "ctype", "number", "text", "error"]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    rows = [(path, *c, None) for c in sheet_cells(workbook(content) if ole else content)]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(path, *[None] * 7, f"{type(e).__name__}: {e}")]
                for k in range(0, len(rows), 50_000):
                    part = pd.DataFrame(rows[k : k + 50_000], columns=names)
                    yield part.astype({"sheet_index": "Int32", "row": "Int64", "col": "Int32", "ctype": "Int32", "number": "Float64"})

    return files.select("path", "content").mapInPandas(run, _CELLS)


def sheet_profile(found: DataFrame) -> DataFrame:
    """Rows, columns, cells by type, non-finite numbers and the text of the first eight rows, per sheet."""
    by_type = [F.count_if(F.col("ctype") == k).alias(n) for k, n in ((TEXT, "n_text"), (NUMERIC, "n_number"), (BOOLEAN, "n_boolean"), (ERROR, "n_error"))]
    preview = F.sort_array(F.collect_list(F.when((F.col("row") < 8) & (F.col("ctype") == TEXT), F.struct("row", "col", F.substring("text", 1, 256).alias("text")))))  # eight rows of at most 256 cells
    return found.filter("error is null").groupBy("path", "sheet_index", "sheet").agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), *by_type, F.count_if((F.col("ctype") == NUMERIC) & (F.isnan("number") | (F.abs("number") == float("inf")))).alias("n_nonfinite"), preview.alias("preview")
    )


def events(found: DataFrame) -> DataFrame:
    """Records, steps and cycles by exact header: ``path, sheet_index, sheet, kind, xls_row, names, values, problem``.

    ``values`` are the row's numbers in header order, the clock as microseconds. The kind
    is that of the header, or null with a problem if no layout has it; a row that is
    ragged, holds text for a number, or a key that is no exact integer carries a problem.
    """
    by_row = found.filter("error is null").groupBy("path", "sheet_index", "sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", "ctype", "number", "text"))).alias("c"))  # at most 256 cells
    head = by_row.filter("row = 0").select("path", "sheet_index", F.transform("c", lambda x: x["text"]).alias("names"))
    kind: Column = F.lit(None).cast("string")
    for names, k in LAYOUTS.items():
        kind = F.when(F.col("names") == F.array(*map(F.lit, names)), k).otherwise(kind)
    d = by_row.filter("row > 0").join(head, ["path", "sheet_index"], "left").withColumn("kind", kind)
    is_clock = lambda i: F.coalesce(F.element_at("names", i + 1).startswith("record_time"), F.lit(False))
    values = F.transform("c", lambda x, i: F.when(is_clock(i), clock_us(x["text"]).cast("double")).otherwise(x["number"]))
    d = d.withColumn("values", values)
    n_keys = F.when(F.col("kind") == "record", 4).when(F.col("kind") == "step", 3).otherwise(1)
    keys_ok = F.forall(F.slice("values", F.lit(1), n_keys), lambda x: exact_integer(x))
    gap = F.size("c") != F.size("names")
    problem = F.when(F.col("kind").isNull(), "UNKNOWN_HEADER").when(gap, "RAGGED_ROW").when(F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "INVALID_VALUE").when(~keys_ok, "INVALID_KEY")
    return d.select("path", "sheet_index", "sheet", "kind", (F.col("row") + 1).alias("xls_row"), "names", "values", problem.alias("problem"))


def records(evts: DataFrame) -> DataFrame:
    """Record events as columns; energy is null where the layout has none."""
    v = lambda i, t="double": F.get("values", F.lit(i)).cast(t)
    return evts.filter("kind = 'record' and problem is null").select(
        "path", "sheet_index", "xls_row", v(0, "long").alias("cycle_no"), v(1, "long").alias("step_no"), v(2, "long").alias("status_code"), v(3, "long").alias("record_number"), v(4, "long").alias("time_us"),
        v(5).alias("voltage_v"), v(6).alias("current_ma"), v(7).alias("capacity_mah"), v(8).alias("energy_mwh"),
    )
