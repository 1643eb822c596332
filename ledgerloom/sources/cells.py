"""Sparse cell tables from rows in memory: for tests, for small inputs, and as the form all readers produce."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions import schemas as S
from ledgerloom.functions.errors import LedgerError, UnreadableSource
from ledgerloom.functions.text import label_number, place, text


@dataclass
class SheetData:
    """cells: (row, col) -> (value, formula, error, number format); merges: (top, left, bottom, right)."""

    name: str
    cells: dict = field(default_factory=dict)
    merges: list = field(default_factory=list)
    hidden: bool = False
    hidden_rows: list = field(default_factory=list)
    hidden_columns: list = field(default_factory=list)


@dataclass
class BookData:
    file_name: str
    sha: str
    size: int
    format: str
    sheets: list[SheetData]


@dataclass
class Workbooks:
    """The tables of a batch of workbooks."""

    sources: DataFrame
    sheets: DataFrame
    cells: DataFrame
    merges: DataFrame


class Area(NamedTuple):
    """A rectangle of cells."""

    top: int
    left: int
    bottom: int
    right: int

    def meets(self, other: Area) -> bool:
        return max(self.top, other.top) <= min(self.bottom, other.bottom) and max(self.left, other.left) <= min(self.right, other.right)

    def holds(self, at: tuple[int, int]) -> bool:
        return self.meets(Area(*at, *at))

    def size(self) -> int:
        return (self.bottom - self.top + 1) * (self.right - self.left + 1)

    def places(self) -> Iterator[tuple[int, int]]:
        return product(range(self.top, self.bottom + 1), range(self.left, self.right + 1))

    def label(self) -> str:
        return f"{place(self.top, self.left)}:{place(self.bottom, self.right)}"


def cell_range(ref: str, limits: tuple[int, int] = (1_048_576, 16_384)) -> Area:
    """A1 or A1:B2."""
    found = re.fullmatch(r"\$?([A-Z]{1,3})\$?([0-9]+)(?::\$?([A-Z]{1,3})\$?([0-9]+))?", ref)
    if not found:
        raise UnreadableSource(f"XLSX 坐标范围无效: {ref}")
    a, b, c, d = found.groups()
    box = Area(int(b), label_number(a), int(d or b), label_number(c or a))
    if not (1 <= box.top <= box.bottom <= limits[0] and 1 <= box.left <= box.right <= limits[1]):
        raise UnreadableSource(f"XLSX 坐标范围无效: {ref}")
    return box


def sheet_of(name: str, rows: Iterable[Iterable], merges: Iterable[str] = (), formats: dict[str, str] | None = None) -> SheetData:
    """A sheet from rows of values; a text that starts with = is a formula, `#...!` an error."""
    sheet = SheetData(name, merges=[cell_range(m) for m in merges])
    shapes = {cell_range(k)[:2]: v for k, v in (formats or {}).items()}
    covered = {(r, c) for t, l, b, e in sheet.merges for r in range(t, b + 1) for c in range(l, e + 1)} - {m[:2] for m in sheet.merges}
    for r, row in enumerate(rows, 1):
        for c, value in enumerate(row, 1):
            if value is not None and (r, c) not in covered:
                formula = isinstance(value, str) and value.startswith("=")
                error = isinstance(value, str) and bool(re.fullmatch(r"#[A-Z/0]+[!?]?", value)) and value.startswith(("#N", "#D", "#R", "#V"))
                sheet.cells[r, c] = (value, formula, error, shapes.get((r, c), "General"))
    return sheet


def book_of(sheets: list[SheetData], file_name: str = "input.xlsx") -> BookData:
    content = repr([(s.name, sorted(s.cells.items(), key=lambda x: x[0]), s.merges) for s in sheets]).encode()
    return BookData(file_name, hashlib.sha256(content).hexdigest(), len(content), "xlsx", sheets)


def _raw(value: object) -> str | None:
    return None if value is None else json.dumps(value.isoformat() if isinstance(value, datetime) else value, ensure_ascii=False, default=str)


def cell_rows(book: BookData) -> list[tuple]:
    out = []
    for i, sheet in enumerate(book.sheets):
        for (r, c), (value, formula, error, shape) in sheet.cells.items():
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            out.append((book.sha, i, r, c, text(value), _raw(value), number and float(value).is_integer(), formula, error, shape))
    return out


def workbooks(spark: SparkSession, books: list[BookData]) -> Workbooks:
    """Tables of books that are held in memory."""
    if len({b.sha for b in books}) != len(books):
        raise LedgerError("同一内容文件重复输入")
    return Workbooks(
        spark.createDataFrame([(b.sha, "source_" + b.sha[:24], b.file_name, b.size, b.format, k) for k, b in enumerate(books)], S.SOURCES),
        spark.createDataFrame([(b.sha, i, s.name, s.hidden, s.hidden_rows, s.hidden_columns) for b in books for i, s in enumerate(b.sheets)], S.SHEETS),
        spark.createDataFrame([x for b in books for x in cell_rows(b)], S.CELLS),
        spark.createDataFrame([(b.sha, i, *m, k) for b in books for i, s in enumerate(b.sheets) for k, m in enumerate(s.merges)], S.MERGES),
    )
