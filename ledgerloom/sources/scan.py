"""Reading workbooks through Spark: any store that Spark reads, one file decoded at a time on the executors. Digests of files
of any size, which no task holds whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.functions import schemas as S
from ledgerloom.functions import values as V
from ledgerloom.functions.errors import LedgerError, UnreadableSource
from ledgerloom.functions.stored import stored
from ledgerloom.functions.text import stable_id
from ledgerloom.sources.cells import BookData, Workbooks, cell_rows
from ledgerloom.sources.xls import decode as decode_xls
from ledgerloom.sources.xlsx import decode as decode_xlsx

#: One row for each thing found, told by its kind: a sheet, a cell, a merged area, or a failure. A kind fills its columns.
FOUND = (
    "sha string, file_name string, size long, format string, kind string, sheet_idx int, name string, hidden boolean, hidden_rows array<int>, hidden_columns array<int>, "
    "row int, col int, text string, raw string, number boolean, formula boolean, error boolean, number_format string, top int, left int, bottom int, right int, ord int, fatal boolean, problem string"
)
_ROWS = 20_000  # rows sent on at a time


def _things(name: str, data: bytes) -> Iterator[dict]:
    """What a file holds, as dictionaries of FOUND's columns."""
    suffix = name.rpartition(".")[2].lower()
    head = {"sha": hashlib.sha256(data).hexdigest(), "file_name": name, "size": len(data), "format": suffix}
    try:
        sheets = decode_xlsx(data) if suffix == "xlsx" else decode_xls(data)
        if len(sheets) > V.MAX_SHEETS or sum(len(s.cells) for s in sheets) > V.MAX_CELLS:
            raise LedgerError("工作簿 Sheet 数或有效单元格数超限")
    except Exception as e:  # a broken file must not stop the others
        told = str(e) if isinstance(e, LedgerError) else f"Excel 无法读取: {name} ({type(e).__name__})"
        yield head | {"kind": "failure", "fatal": isinstance(e, LedgerError) and not isinstance(e, UnreadableSource), "problem": told}
        return
    for i, s in enumerate(sheets):
        yield head | {"kind": "sheet", "sheet_idx": i, "name": s.name, "hidden": s.hidden, "hidden_rows": s.hidden_rows, "hidden_columns": s.hidden_columns}
        for k, (top, left, bottom, right) in enumerate(s.merges):
            yield head | {"kind": "merge", "sheet_idx": i, "top": top, "left": left, "bottom": bottom, "right": right, "ord": k}
    for row in cell_rows(BookData(name, head["sha"], len(data), suffix, sheets)):
        yield head | {"kind": "cell"} | dict(zip(S.names(S.CELLS)[1:], row[1:], strict=True))


def decoded(files: DataFrame) -> DataFrame:
    """files (file_name, content) as rows of FOUND."""
    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = []
                for thing in _things(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    held.append(thing)
                    if len(held) == _ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.mapInArrow(rows, FOUND)


def of_kind(found: DataFrame, kind: str, ddl: str) -> DataFrame:
    return found.where(F.col("kind") == kind).select(*S.names(ddl))


def read_workbooks(spark: SparkSession, paths: list[str]) -> tuple[Workbooks, list[dict]]:
    """(tables, failures) of the given files. A file over the limits of the batch raises LedgerError.

    A file is decoded where it is read; how many are read in one task is up to spark.sql.files.maxPartitionBytes."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "content")
    listed = files.select("path", "length").collect()  # the inputs that were named
    if any(not 0 < r.length <= V.MAX_BYTES for r in listed):
        raise LedgerError("Excel 必须是非空文件且不超过 32 MiB")
    if any(r.path.rpartition(".")[2].lower() not in ("xls", "xlsx") for r in listed):
        raise LedgerError("仅支持 .xls 和 .xlsx")
    found = stored(decoded(files.select(F.regexp_extract(F.url_decode("path"), r"([^/]+)$", 1).alias("file_name"), "content")))
    order = {p.rpartition("/")[2]: k for k, p in enumerate(paths)}
    broken = sorted(found.where("kind = 'failure'").collect(), key=lambda r: order.get(r.file_name, 0))
    if fatal := next((r.problem for r in broken if r.fatal), None):
        raise LedgerError(fatal)
    failures = [{"id": stable_id("source", r.sha), "file_name": r.file_name, "sha256": r.sha, "size": r.size, "format": r.format, "sheets": [], "status": "unreadable", "error": r.problem} for r in broken]
    books = sorted(found.where("kind = 'sheet' and sheet_idx = 0").select("sha", "file_name", "size", "format").collect(), key=lambda b: order.get(b.file_name, 0))
    if len({b.sha for b in books}) != len(books):
        raise LedgerError("同一内容文件重复输入")
    sources = spark.createDataFrame([(b.sha, "source_" + b.sha[:24], b.file_name, b.size, b.format, k) for k, b in enumerate(books)], S.SOURCES)
    return Workbooks(sources, *(of_kind(found, k, ddl) for k, ddl in (("sheet", S.SHEETS), ("cell", S.CELLS), ("merge", S.MERGES)))), failures


_CHUNK = 1 << 14  # bytes of a file, about, that are sent on in one row


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split (file, start, line) in their order as chunks (file, start, k, bytes), each line with its end."""
    file, start, k, held, size = None, None, 0, [], 0

    def chunk():
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([k], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["file", "start", "k", "bytes"])

    for batch in batches:
        for f, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (f, at) != (file, start):
                if held:
                    yield chunk()
                file, start, k, held, size = f, at, 0, [], 0
            held += (line, b"\n")
            size += len(line) + 1
            if size >= _CHUNK:
                yield chunk()
                k, held, size = k + 1, [], 0
    if held:
        yield chunk()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, sha256) of chunks (file, size, bytes) sorted by file and place. The end of the last line is only there if the
    file is as long."""
    file, left, made = None, 0, None

    def result():
        if left:
            raise ValueError(f"{file}: {left} bytes were not read")
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([made.hexdigest()])], names=["file", "sha256"])

    for batch in batches:
        for f, size, part in zip(*(batch.column(n) for n in ("file", "size", "bytes")), strict=True):
            if (f := f.as_py()) != file:
                if made:
                    yield result()
                file, left, made = f, size.as_py(), hashlib.sha256()
            part = part.as_py()[:left]
            made.update(part)
            left -= len(part)
    if made:
        yield result()


def digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, sha256) of files of any size; Spark's readers leave out empty ones.

    A file is read in splits, cut at line feeds, which are in any bytes; the pieces come together in their order in one task a
    file, as the digest is made of one byte after the other, and pass it as a stream. Files that Spark's text reader does not
    give byte for byte (compressed ones by their suffix, UTF-8 with a mark) and runs of 2 GB without a line feed raise."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.col("_metadata.file_path").alias("file"))
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    chunks = lines.mapInArrow(_chunks, "file string, start long, k long, bytes binary")
    sized = chunks.join(F.broadcast(files.select("file", F.col("length").alias("size"))), "file")
    made = sized.repartition("file").sortWithinPartitions("file", "start", "k").select("file", "size", "bytes").mapInArrow(_digested, "file string, sha256 string")
    return files.join(F.broadcast(made), "file", "left").select("path", "length", "sha256")
