"""Ledgers made from driver tables: cells, merged areas and plans that the engine then reads like workbooks.

A workbook holds the rows of 50,000 keys, a sheet those of one nation or class, so that no sheet outgrows the limits and
the number of sheets grows with the table. Each scenario has its twin in SQL (the CTE `l`, a row for each sheet row).
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import schemas as S
from ledgerloom.functions.text import number_label
from ledgerloom.sources.cells import Workbooks

PER_BOOK = 50_000
COMPLETE = {"status": "complete", "basis_type": "structural", "basis": "每个区域都列出最终结果"}
TIME = "2026-09-20T12:00:00+08:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_of(tag: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{tag}-"), F.col("book").cast("string")), 256)


def dealt(rows: DataFrame, key: str, sheet_key: str, name: Column) -> DataFrame:
    """rows with book, sheet (dense within a book), name and rn, the place in the sheet from 0."""
    rows = rows.withColumns({"book": F.expr(f"{key} div {PER_BOOK}"), "name": name})
    sheets = rows.select("book", sheet_key).distinct()  # a row a sheet
    sheets = sheets.withColumn("sheet", F.row_number().over(Window.partitionBy("book").orderBy(sheet_key)) - 1)
    within = Window.partitionBy("book", sheet_key).orderBy(key)
    return rows.withColumn("rn", F.row_number().over(within) - 1).join(sheets, ["book", sheet_key])


def ledger(spark: SparkSession, tag: str, lines: DataFrame, header: dict[str, str | None], merges: DataFrame | None = None, others: list[dict] | None = None, **mapping) -> tuple[Workbooks, dict]:
    """lines: book, sheet, name, rn and a text column for each title of header, which gives the title's role (null: none).

    merges: book, sheet, top, left, bottom, right."""
    titles = list(header)
    lines = lines.withColumns({"sha": sha_of(tag), "sheet_idx": F.col("sheet").cast("int"), "row": (F.col("rn") + 2).cast("int")})
    tabs = lines.groupBy("sha", "book", "sheet_idx").agg(F.first("name").alias("name"), F.max("row").alias("last"))
    spots = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{t}`").cast("string").alias("text")) for c, t in enumerate(titles, 1)])
    heads = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(t).alias("text")) for c, t in enumerate(titles, 1)])
    every = lines.select("sha", "sheet_idx", "row", F.inline(spots)).where("text is not null").union(tabs.select("sha", "sheet_idx", F.lit(1), F.inline(heads)))
    quoted = F.to_json(F.array("text"))
    cells = every.select("sha", "sheet_idx", "row", "col", "text", F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("raw"), F.lit(False).alias("number"), F.col("text").startswith("=").alias("formula"), F.lit(False).alias("error"), F.lit("General").alias("number_format"))
    listed = tabs.orderBy("book", "sheet_idx").collect()  # a row a sheet: the plan, which is a control file
    base = {"header_rows": [1], "data_start_row": 2, "columns": {r: number_label(c) for c, r in enumerate(header.values(), 1) if r}, "column_dispositions": others or [], "bidder_separator": "single", "award_completeness": COMPLETE, "award_mode": "name_match", "summary_markers": ["合计"], "non_tender_markers": ["未招标"]}
    books: dict[str, list] = {}
    for t in listed:
        books.setdefault(t.sha, []).append((t, {"name": t["name"], "action": "parse", "tables": [base | {"data_end_row": t["last"]} | mapping]}))
    file = lambda sha: f"{tag}-{books[sha][0][0].book}.xlsx"
    plan = {"schema_version": 1, "sources": [{"file_name": file(sha), "sha256": sha, "sheets": [spec for _, spec in sheets]} for sha, sheets in books.items()]}
    areas = merges.select(sha_of(tag).alias("sha"), F.col("sheet").cast("int").alias("sheet_idx"), *[F.col(x).cast("int").alias(x) for x in ("top", "left", "bottom", "right")], F.lit(0).alias("ord")) if merges is not None else spark.createDataFrame([], S.MERGES)
    return (
        Workbooks(
            spark.createDataFrame([(sha, "source_" + sha[:24], file(sha), 0, "xlsx", k) for k, sha in enumerate(books)], S.SOURCES),
            spark.createDataFrame([(t.sha, t.sheet_idx, t["name"], False, [], []) for t in listed], S.SHEETS),
            cells,
            areas,
        ),
        plan,
    )


# ---------------------------------------------------------------- scenarios


def bids(spark: SparkSession, sf_dir: str) -> tuple[Workbooks, dict]:
    """merged x anchor: a project a sheet, its name merged down; groups of four bidders, whose first row says how many (one
    too many in every third); the richest wins, in every fifth group under a name that nobody has; every seventh says that
    there was no tender."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    rows = dealt(rows, "c_custkey", "c_nationkey", F.col("n_name")).withColumns({"g": F.expr("rn div 4"), "pos": F.expr("rn % 4")})
    group = Window.partitionBy("book", "sheet", "g")
    rows = rows.withColumns({"n": F.count("*").over(group), "place": F.row_number().over(group.orderBy(F.desc("c_acctbal"), "c_custkey"))})
    first = F.col("pos") == 0
    lines = rows.withColumns(
        {
            "项目名称": F.when(F.col("rn") == 0, F.col("name")),
            "投标单位名称": F.col("c_name"),
            "投标单位数量": F.when(first, (F.col("n") + F.expr("int(g % 3 = 2)")).cast("string")),
            "中标单位": F.when(F.col("place") == 1, F.when(F.col("g") % 5 == 4, F.concat(F.lit("Nobody "), F.col("g").cast("string"))).otherwise(F.col("c_name"))),
            "备注": F.when(first & (F.col("g") % 7 == 6), "未招标"),
        }
    )
    merges = rows.groupBy("book", "sheet").agg(F.lit(2).alias("top"), F.lit(1).alias("left"), (F.count("*") + 1).alias("bottom"), F.lit(1).alias("right")).where("bottom > top")
    header = {"项目名称": "project_name", "投标单位名称": "bidder_name", "投标单位数量": "bidder_count", "中标单位": "award_name", "备注": "notes"}
    return ledger(spark, "bids", lines, header, merges, project_mode="merged", group_mode="anchor", group_start_field="bidder_count")


BIDS = f"""c AS (SELECT c_custkey // {PER_BOOK} AS book, n_name AS name, c_custkey, c_name, c_acctbal, dense_rank() OVER (PARTITION BY c_custkey // {PER_BOOK} ORDER BY c_nationkey) - 1 AS sheet,
 row_number() OVER (PARTITION BY c_custkey // {PER_BOOK}, c_nationkey ORDER BY c_custkey) - 1 AS rn FROM customer JOIN nation ON n_nationkey = c_nationkey),
l0 AS (SELECT *, sha256('bids-' || book) AS sha, 'bids-' || book || '.xlsx' AS file, rn // 4 AS g, rn % 4 AS pos, rn + 2 AS line, rn // 4 * 4 + 2 AS first_line, count(*) OVER (PARTITION BY book, sheet, rn // 4) AS n,
 count(*) OVER (PARTITION BY book, sheet) AS n_sheet, row_number() OVER (PARTITION BY book, sheet, rn // 4 ORDER BY c_acctbal DESC, c_custkey) AS place FROM c),
l1 AS (SELECT *, 'project_' || substr(sha256('["' || sha || '",' || sheet || ',0,"A2"]'), 1, 24) AS project_id, g % 5 = 4 AS nobody, g % 3 = 2 AS miscounted, g % 7 = 6 AS untendered,
 CASE WHEN place = 1 THEN CASE WHEN g % 5 = 4 THEN 'Nobody ' || g ELSE c_name END END AS award FROM l0),
l2 AS (SELECT *, 'group_' || substr(sha256('["' || project_id || '",0,"anchor",' || first_line || ']'), 1, 24) AS group_id, 'record_' || substr(sha256('["' || sha || '",' || sheet || ',0,' || line || ',1]'), 1, 24) AS record_id FROM l1),
l AS (SELECT *, max(award) OVER (PARTITION BY group_id) AS group_award, max(CASE WHEN place = 1 THEN line END) OVER (PARTITION BY group_id) AS award_line FROM l2)"""


def lots(spark: SparkSession, sf_dir: str) -> tuple[Workbooks, dict]:
    """repeated x lot: three rows a lot; the second lists the first one's bidder again and its own twice, the third names a
    consortium in every fourth lot; prices in odd lots (so that the first one's differ); stated results in every fourth."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    rows = dealt(rows, "s_suppkey", "s_nationkey", F.col("n_name")).withColumns({"lot": F.expr("rn div 3"), "pos": F.expr("rn % 3")})
    rows = rows.withColumn("earlier", F.lag("s_name").over(Window.partitionBy("book", "sheet", "lot").orderBy("rn")))
    lines = rows.withColumns(
        {
            "项目名称": F.col("name"),
            "项目编号": F.concat(F.lit("N"), F.col("s_nationkey").cast("string")),
            "标段": F.concat(F.lit("L"), F.col("lot").cast("string")),
            "投标企业名单": F.when(F.col("pos") == 1, F.concat_ws("、", "earlier", "s_name", "s_name")).when((F.col("pos") == 2) & (F.col("lot") % 4 == 3), F.concat("s_name", F.lit("联合体"))).otherwise(F.col("s_name")),
            "投标报价": F.when(F.col("lot") % 2 == 1, F.col("s_suppkey").cast("string")),
            "中标与否": F.when(F.col("lot") % 4 == 0, F.when(F.col("pos") == 0, "中标").when(F.col("pos") == 2, "另议")),
        }
    )
    header = {"项目名称": "project_name", "项目编号": "project_code", "标段": "lot_name", "投标企业名单": "bidder_name", "投标报价": "bidder_price", "中标与否": "award_status"}
    return ledger(spark, "lots", lines, header, project_mode="repeated", group_mode="lot", bidder_separator="delimited")


LOTS = f"""c AS (SELECT s_suppkey // {PER_BOOK} AS book, n_name AS name, s_nationkey, s_suppkey, s_name, dense_rank() OVER (PARTITION BY s_suppkey // {PER_BOOK} ORDER BY s_nationkey) - 1 AS sheet,
 row_number() OVER (PARTITION BY s_suppkey // {PER_BOOK}, s_nationkey ORDER BY s_suppkey) - 1 AS rn FROM supplier JOIN nation ON n_nationkey = s_nationkey),
l0 AS (SELECT *, sha256('lots-' || book) AS sha, rn // 3 AS lot, rn % 3 AS pos, rn + 2 AS line, lead(s_suppkey) OVER (PARTITION BY book, sheet, rn // 3 ORDER BY rn) AS later FROM c),
l1 AS (SELECT *, 'project_' || substr(sha256('["' || sha || '",' || sheet || ',0,["N' || s_nationkey || '","' || name || '","",""]]'), 1, 24) AS project_id FROM l0),
l2 AS (SELECT *, 'group_' || substr(sha256('["' || project_id || '",0,"lot",["","L' || lot || '"]]'), 1, 24) AS group_id, pos = 2 AND lot % 4 = 3 AS consortium FROM l1),
l AS (SELECT *, 'record_' || substr(sha256('["' || sha || '",' || sheet || ',0,' || line || ',' || CASE WHEN pos = 1 THEN 2 ELSE 1 END || ']'), 1, 24) AS record_id FROM l2)"""


def parts(spark: SparkSession, sf_dir: str) -> tuple[Workbooks, dict]:
    """blocks x project with a context column in blocks: six rows a block; the first names the project, the fourth begins
    another context, the fifth says nothing of a company, the sixth is a summary."""
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey", "p_size", F.concat(F.lit("S"), F.col("p_size").cast("string")))
    rows = rows.withColumns({"block": F.expr("rn div 6"), "pos": F.expr("rn % 6")})
    pos = F.col("pos")
    lines = rows.withColumns(
        {
            "项目名称": F.when(pos == 0, F.concat(F.lit("P"), F.col("block").cast("string"))),
            "投标单位名称": F.when(pos < 4, F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).when(pos == 5, "合计"),
            "品牌": F.when(pos.isin(0, 3), F.col("p_brand")),
            "备注": F.col("p_type"),
        }
    )
    context = [{"column": "C", "disposition": "group_context", "mode": "blocks", "header": "品牌", "reason": "品牌分组"}]
    return ledger(spark, "parts", lines, {"项目名称": "project_name", "投标单位名称": "bidder_name", "品牌": None, "备注": "notes"}, others=context, project_mode="blocks", group_mode="project")


PARTS = f"""c AS (SELECT p_partkey // {PER_BOOK} AS book, p_partkey, p_name, p_brand, p_type, p_size, dense_rank() OVER (PARTITION BY p_partkey // {PER_BOOK} ORDER BY p_size) - 1 AS sheet,
 row_number() OVER (PARTITION BY p_partkey // {PER_BOOK}, p_size ORDER BY p_partkey) - 1 AS rn FROM part),
l0 AS (SELECT *, sha256('parts-' || book) AS sha, rn // 6 AS block, rn % 6 AS pos, rn + 2 AS line, rn // 6 * 6 + 2 AS first_line FROM c),
l1 AS (SELECT *, 'project_' || substr(sha256('["' || sha || '",' || sheet || ',0,"A' || first_line || '"]'), 1, 24) AS project_id,
 max(CASE WHEN pos = 0 THEN p_brand END) OVER (PARTITION BY book, sheet, block) AS brand_0, max(CASE WHEN pos = 3 THEN p_brand END) OVER (PARTITION BY book, sheet, block) AS brand_3 FROM l0),
l2 AS (SELECT *, CASE WHEN pos < 3 THEN brand_0 ELSE brand_3 END AS brand FROM l1),
l AS (SELECT *, CASE WHEN pos < 4 THEN 'group_' || substr(sha256('["' || project_id || '",0,"project",["project",[["C","' || brand || '"]]]]'), 1, 24) END AS group_id FROM l2)"""


def roster(spark: SparkSession, sf_dir: str) -> tuple[Workbooks, dict]:
    """none x source: a list of companies, most of them named again and again."""
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey", "p_size", F.concat(F.lit("S"), F.col("p_size").cast("string")))
    lines = rows.withColumn("公司名称", F.concat_ws(" ", "p_brand", F.lit("公司")))
    return ledger(spark, "roster", lines, {"公司名称": "bidder_name"}, project_mode="none", group_mode="source")


ROSTER = f"""c AS (SELECT p_partkey // {PER_BOOK} AS book, p_partkey, p_brand || ' 公司' AS company, p_size, dense_rank() OVER (PARTITION BY p_partkey // {PER_BOOK} ORDER BY p_size) - 1 AS sheet,
 row_number() OVER (PARTITION BY p_partkey // {PER_BOOK}, p_size ORDER BY p_partkey) - 1 AS rn FROM part),
l0 AS (SELECT *, sha256('roster-' || book) AS sha, rn + 2 AS line FROM c),
l AS (SELECT *, 'group_' || substr(sha256('["scope_' || substr(sha256('["' || sha || '",' || sheet || ',0]'), 1, 24) || '",0,"source","source_roster"]'), 1, 24) AS group_id FROM l0)"""


def beside(spark: SparkSession, sf_dir: str) -> tuple[Workbooks, dict]:
    """repeated x project with awards that nobody is named exactly like, in the row of the bidder that they mean."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    rows = dealt(rows, "c_custkey", "c_nationkey", F.col("n_name"))
    lines = rows.withColumns({"项目名称": F.concat("name", F.lit(" "), F.expr("rn div 5").cast("string")), "投标单位名称": F.col("c_name"), "中标单位": F.when(F.expr("rn % 5 = 2"), F.concat(F.lit("Award of "), F.col("c_custkey").cast("string")))})
    return ledger(spark, "beside", lines, {"项目名称": "project_name", "投标单位名称": "bidder_name", "中标单位": "award_name"}, project_mode="repeated", group_mode="project", award_mode="auto")


BESIDE = f"""c AS (SELECT c_custkey // {PER_BOOK} AS book, n_name AS name, c_custkey, c_name, dense_rank() OVER (PARTITION BY c_custkey // {PER_BOOK} ORDER BY c_nationkey) - 1 AS sheet,
 row_number() OVER (PARTITION BY c_custkey // {PER_BOOK}, c_nationkey ORDER BY c_custkey) - 1 AS rn FROM customer JOIN nation ON n_nationkey = c_nationkey),
l0 AS (SELECT *, sha256('beside-' || book) AS sha, rn // 5 AS g, rn % 5 AS pos, rn + 2 AS line FROM c),
l1 AS (SELECT *, 'project_' || substr(sha256('["' || sha || '",' || sheet || ',0,["","' || name || ' ' || g || '","",""]]'), 1, 24) AS project_id, CASE WHEN pos = 2 THEN 'Award of ' || c_custkey END AS award FROM l0),
l2 AS (SELECT *, 'group_' || substr(sha256('["' || project_id || '",0,"project","project"]'), 1, 24) AS group_id, 'record_' || substr(sha256('["' || sha || '",' || sheet || ',0,' || line || ',1]'), 1, 24) AS record_id FROM l1),
l AS (SELECT *, 'award_review_' || substr(sha256('["' || group_id || '","' || lower(replace(award, ' ', '')) || '",["C' || line || '"]]'), 1, 24) AS task FROM l2)"""


# ---------------------------------------------------------------- workbooks as files


def _part(rows: list[list[str | None]]) -> str:
    cell = lambda r, c, v: f'<c r="{number_label(c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    lines = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1) if v is not None)}</row>' for r, row in enumerate(rows, 1))
    return f"<worksheet><sheetData>{lines}</sheetData><mergeCells><mergeCell ref=\"A1:A2\"/></mergeCells></worksheet>"


def workbook_bytes(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A small .xlsx file: inline texts, A1 merged with A2."""
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets>" + "".join(f'<sheet name="{escape(n)}" id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="x/worksheet" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", _part(rows))
    return out.getvalue()


def region_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, content): a workbook for each region, a sheet for each of its nations: name, key, and a text that XML
    has to escape."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    books = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "r_name"))).alias("nations"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, files = [], []
            for key, nations in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(f"region-{key}.xlsx")
                files.append(workbook_bytes({n["n_name"]: [["head", n["n_name"]], [None, str(n["n_nationkey"])], [f"<{n['r_name']}> & more", None, "x"]] for n in nations}))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(files, pa.binary())], names=["file_name", "content"])

    return books.mapInArrow(write, "file_name string, content binary")
