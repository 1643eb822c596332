"""Looking cells up through merged areas: an interval join on rows, with the column as its equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHEET = ["sha", "sheet_idx"]


def by_column(merges: DataFrame) -> DataFrame:
    """A row for each column that a merged area covers (the number of columns of a sheet is bounded)."""
    return merges.withColumn("col", F.explode(F.sequence("left", "right")))


def resolve(points: DataFrame, merges: DataFrame, cells: DataFrame) -> DataFrame:
    """points (sha, sheet_idx, row, col, ...) with src_row, src_col, merged (vertically) and the cell found there.

    The first merged area that covers a point wins; other points stand for themselves.
    """
    areas = by_column(merges).select(*SHEET, "col", "top", "left", "bottom", "ord")
    keys = [*SHEET, "row", "col"]
    p = points.select(*keys).distinct()
    hit = p.alias("p").join(areas.alias("m"), [F.col(f"p.{k}") == F.col(f"m.{k}") for k in [*SHEET, "col"]] + [F.col("p.row").between(F.col("m.top"), F.col("m.bottom"))])
    first = hit.groupBy(*[F.col(f"p.{k}").alias(k) for k in keys]).agg(F.min_by(F.struct("m.top", "m.left"), "m.ord").alias("anchor"), F.max(F.col("m.top") < F.col("m.bottom")).alias("merged"))
    placed = points.join(first, keys, "left").withColumns({"src_row": F.coalesce("anchor.top", "row"), "src_col": F.coalesce("anchor.left", "col"), "merged": F.coalesce("merged", F.lit(False))}).drop("anchor")
    content = cells.select(*SHEET, F.col("row").alias("src_row"), F.col("col").alias("src_col"), "text", "raw", "number", "formula", "error", "number_format")
    return placed.join(content, [*SHEET, "src_row", "src_col"], "left")
