"""A ledger made from the supplier table: cells are built by Spark, then the engine runs as for workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerloom.functions import schemas as S
from ledgerloom.operators.emit import Results
from ledgerloom.plans.engine import build
from ledgerloom.sources.cells import Workbooks

HEADER = ("项目名称", "标段", "投标单位名称", "投标报价", "中标单位")


def supplier_ledger(spark: SparkSession, supplier: DataFrame, nation: DataFrame) -> Results:
    """One workbook; sheet = nation; the richest supplier of a nation is its award. Nations are a few dozen at most."""
    sha = F.sha2(F.lit("suppliers"), 256)
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    best = supplier.groupBy("s_nationkey").agg(F.max_by("s_name", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("award"))
    n = nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = supplier.join(n, "s_nationkey").join(best, "s_nationkey").withColumn("row", F.row_number().over(order) + 1)
    texts = [F.col("n_name"), F.concat(F.lit("L"), F.col("s_nationkey").cast("string")), F.col("s_name"), F.col("s_acctbal").cast("string"), F.when(F.col("row") == 2, F.col("award"))]
    cell = lambda c, t: F.struct(F.lit(c).alias("col"), t.alias("text"))
    body = rows.select(F.col("s_nationkey").alias("key"), "row", F.explode(F.array(*[cell(c, t) for c, t in enumerate(texts, 1)])).alias("c"))
    keys = sorted(r[0] for r in rows.select("s_nationkey").distinct().collect())
    sheet_of = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)]), F.col("key"))
    head = spark.createDataFrame([(k, 1, c, t) for k in keys for c, t in enumerate(HEADER, 1)], "key int, row int, col int, text string")
    every = body.select(F.col("key").cast("int").alias("key"), "row", "c.col", "c.text").union(head).where("text is not null")
    cells = every.select(sha.alias("sha"), sheet_of.alias("sheet_idx"), "row", "col", "text", F.to_json(F.array("text")).alias("raw"), F.lit(False).alias("number"), F.lit(False).alias("formula"), F.lit(False).alias("error"), F.lit("General").alias("number_format"))
    cells = cells.withColumn("raw", F.expr("substring(raw, 2, length(raw) - 2)"))
    digest = spark.range(1).select(sha).first()[0]
    ends = dict(cells.groupBy("sheet_idx").agg(F.max("row")).collect())
    table = {"header_rows": [1], "data_start_row": 2, "columns": {"project_name": "A", "lot_code": "B", "bidder_name": "C", "bidder_price": "D", "award_name": "E"}, "project_mode": "repeated", "group_mode": "lot", "bidder_separator": "single",
             "award_completeness": {"status": "complete", "basis_type": "structural", "basis": "每国一标"}, "award_mode": "name_match", "summary_markers": ["合计"], "non_tender_markers": ["未招标"]}
    plan = {"schema_version": 1, "sources": [{"file_name": "suppliers.xlsx", "sha256": digest, "sheets": [{"name": f"S{i}", "action": "parse", "tables": [table | {"data_end_row": ends[i]}]} for i in range(len(keys))]}]}
    books = Workbooks(
        spark.createDataFrame([(digest, "source_" + digest[:24], "suppliers.xlsx", 0, "xlsx", 0)], S.SOURCES),
        spark.createDataFrame([(digest, i, f"S{i}", False, [], []) for i in range(len(keys))], S.SHEETS),
        cells,
        spark.createDataFrame([], S.MERGES),
    )
    return build(books, plan, "2026-09-20T12:00:00+08:00")
