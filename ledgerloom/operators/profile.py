"""What a sheet looks like: extents, header candidates, column profiles, content regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.functions.text import clean_udf
from ledgerloom.operators.merges import SHEET, resolve
from ledgerloom.operators.windows import islands
from ledgerloom.sources.cells import Workbooks

SAMPLES, SAMPLE_CHARS = 3, 80


def content(cells: DataFrame) -> DataFrame:
    return cells.where("text <> '' or formula or error")


def header_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, role) for role, names in V.HEADERS.items() for name in names], "alias string, role string")


def header_matches(cells: DataFrame) -> DataFrame:
    """(sheet, row, role, col): cells whose text is a known header; in a row the last column wins a role."""
    known = F.broadcast(header_names(cells.sparkSession))  # a fixed dictionary
    keyed = content(cells).select(*SHEET, "row", "col", F.regexp_replace(clean_udf("text"), " ", "").alias("alias"))
    return keyed.join(known, "alias").groupBy(*SHEET, "row", "role").agg(F.max("col").alias("col"))


def row_extents(cells: DataFrame) -> DataFrame:
    """Extent and sorted content rows of each sheet (100,000 rows at most)."""
    return content(cells).groupBy(*SHEET).agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.sort_array(F.collect_set("row")).alias("rows"), F.count_if("formula").alias("formulas"))


def content_regions(cells: DataFrame) -> DataFrame:
    return islands(content(cells).select(*SHEET, "row"), SHEET, "row")


def column_profiles(cells: DataFrame) -> DataFrame:
    """Counts and the first samples of each column; samples are cut before they are gathered."""
    w = Window.partitionBy(*SHEET, "col").orderBy("row")
    ranked = content(cells).withColumn("n", F.row_number().over(w))
    sample = F.when(F.col("n") <= SAMPLES, F.struct("n", F.substring("text", 1, SAMPLE_CHARS).alias("s")))
    out = ranked.groupBy(*SHEET, "col").agg(F.count("*").alias("nonempty_count"), F.count_if("formula").alias("formula_count"), F.count_if("error").alias("error_count"), F.array_sort(F.collect_list(sample)).alias("samples"))
    return out.withColumn("sample_values", F.transform("samples", lambda s: s["s"])).drop("samples")


def row_views(cells: DataFrame, first: int, last: int, names: list[str] | None = None, sheets: DataFrame | None = None) -> DataFrame:
    """Rows of a bounded range as {place: text}; the range and the sheet name are filters on the cells."""
    wanted = cells.where(F.col("row").between(first, last) & (F.col("text") != ""))
    if names:
        wanted = wanted.join(sheets.where(F.col("name").isin(names)), SHEET, "left_semi")
    spot = F.concat(F.when(F.col("col") > 26, F.expr("char(64 + (col - 1) div 26)")).otherwise(""), F.expr("char(65 + (col - 1) % 26)"), F.col("row").cast("string"))
    return wanted.groupBy(*SHEET, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(spot.alias("place"), F.substring("text", 1, 240).alias("text"))))).alias("cells"))


def mapped_facts(books: Workbooks, spans: list[tuple]) -> tuple[dict, dict]:
    """For spans (sha, sheet_idx, table_idx, first, last, header rows): the columns with content in header or data, and
    the header texts of each column, found through merged areas."""
    spark = books.cells.sparkSession
    key = [*SHEET, "table_idx"]
    s = F.broadcast(spark.createDataFrame(spans, "sha string, sheet_idx int, table_idx int, first int, last int, headers array<int>"))  # from the plan
    used = content(books.cells).join(s, SHEET).where("row between first and last or array_contains(headers, row)").select(*key, "col").distinct()
    effective: dict = {}
    for sha, i, t, c in used.collect():  # 256 columns a table at most
        effective.setdefault((sha, i, t), set()).add(c)
    tops = s.select(*key, F.explode("headers").alias("row")).join(content(books.cells).groupBy(*SHEET).agg(F.max("col").alias("max_col")), SHEET)
    points = tops.select(*key, "row", F.explode(F.sequence(F.lit(1), "max_col")).alias("col"))
    texts: dict = {}
    for r in resolve(points, books.merges, books.cells).where("text <> ''").select(*key, "row", "col", "text").orderBy("row").collect():
        texts.setdefault((r.sha, r.sheet_idx, r.table_idx, r.col), {})[r.row] = r.text
    return effective, texts
