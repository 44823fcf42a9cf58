"""MAT-file level 5 variables as rows: ``spark.read.format("mat5").load(path)``.

A Python data source with one partition per file, so a folder of files is read side by
side. Numeric arrays of any shape come out cell by cell with their indices; compressed
elements are inflated. Files that are damaged or hold no numeric arrays raise an error
that names the file; nothing is skipped in silence.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Element types of the format with their numpy codes, and array classes that hold numbers.
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
COMPRESSED, MATRIX = 15, 14
NUMERIC = set(range(6, 16))


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """Type, payload and the place after the element at ``at``."""
    if at + 8 > len(data):
        raise ValueError("element is cut off")
    head = struct.unpack_from(order + "I", data, at)[0]
    if head >> 16:  # small element: size and up to four bytes share the tag
        return head & 0xFFFF, data[at + 4 : at + 4 + (head >> 16)], at + 8
    size = struct.unpack_from(order + "I", data, at + 4)[0]
    stop = at + 8 + size
    if stop > len(data):
        raise ValueError("element is cut off")
    return head, data[at + 8 : stop], stop if head == COMPRESSED else stop + (-size) % 8


def variables(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Name and array of every numeric variable."""
    if len(data) < 128:
        raise ValueError("no header")
    mark = data[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a level 5 file")
    order = "<" if mark == b"IM" else ">"
    at = 128
    while at < len(data):
        kind, body, at = _element(data, at, order)
        if kind == COMPRESSED:
            kind, body, _ = _element(zlib.decompress(body), 0, order)
        if kind != MATRIX:
            continue
        _, flags, k = _element(body, 0, order)
        if flags[0 if order == "<" else 3] not in NUMERIC:
            continue
        _, dims, k = _element(body, k, order)
        _, name, k = _element(body, k, order)
        real, values, k = _element(body, k, order)
        if real not in ELEMENTS:
            raise ValueError(f"variable {name.decode('latin-1')} has element type {real}")
        shape = np.frombuffer(dims, order + "i4")
        yield name.decode("latin-1"), np.frombuffer(values, order + ELEMENTS[real]).astype(float).reshape(shape, order="F")


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        path = partition.value
        with open(path, "rb") as f:
            data = f.read()
        try:
            for name, array in variables(data):
                flat = array.reshape(array.shape[0], -1)
                for (i, j), v in np.ndenumerate(flat):
                    yield path, name, i, j, float(v)
        except (ValueError, zlib.error) as e:
            raise ValueError(f"{path}: {e}") from e


class Mat5DataSource(DataSource):
    """``path, variable, row_idx, col_idx, value``."""

    @classmethod
    def name(cls) -> str:
        return "mat5"

    def schema(self) -> str:
        return "path string, variable string, row_idx long, col_idx long, value double"

    def reader(self, schema):
        path = self.options["path"]
        paths = sorted(glob.glob(os.path.join(path, "*.mat"))) if os.path.isdir(path) else sorted(glob.glob(path))
        if not paths:
            raise ValueError(f"no file at {path}")
        return _Reader(paths)
