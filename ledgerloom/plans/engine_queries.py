"""Queries that run the engine's own operators over ledgers made from whole driver tables (see scenarios), and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import name_key_udf
from ledgerloom.operators import profile, quality
from ledgerloom.operators.collect import assign, looked_up, plan_frames
from ledgerloom.operators.emit import Results
from ledgerloom.operators.finish import Finished, finish
from ledgerloom.operators.matching import REASONS
from ledgerloom.operators.merges import resolve
from ledgerloom.plans import review, scenarios
from ledgerloom.plans.catalogue import query
from ledgerloom.plans.engine import build
from ledgerloom.plans.scenarios import BESIDE, BIDS, LOTS, PARTS, ROSTER, TIME
from ledgerloom.sources.scan import decoded


def _finished(scenario: tuple) -> Finished:
    books, plan = scenario
    rows, tables, _ = assign(books, plan)
    return finish(rows, tables, books.sources, books.sheets)


def _results(scenario: tuple) -> Results:
    return build(*scenario, TIME)


def _sheet_rows(rows: DataFrame, *more) -> DataFrame:
    return rows.select("sha", "sheet_idx", "row", *more)


PLACE = 'sha, CAST(sheet AS INT) AS sheet_idx, CAST(line AS INT) AS "row"'

# ---------------------------------------------------------------- cells


@query(f"""WITH {BIDS}, t AS (SELECT {PLACE}, 'project_name' AS role, name AS text, 'A2' AS place, n_sheet > 1 AS merged, rn = 0 AS direct FROM l
UNION ALL SELECT {PLACE}, 'bidder_name', c_name, 'B' || line, false, true FROM l
UNION ALL SELECT {PLACE}, 'bidder_count', CASE WHEN pos = 0 THEN CAST(n + CAST(miscounted AS INT) AS VARCHAR) ELSE '' END, 'C' || line, false, pos = 0 FROM l
UNION ALL SELECT {PLACE}, 'award_name', coalesce(award, ''), 'D' || line, false, award IS NOT NULL FROM l
UNION ALL SELECT {PLACE}, 'notes', CASE WHEN pos = 0 AND untendered THEN '未招标' ELSE '' END, 'E' || line, false, pos = 0 AND untendered FROM l) SELECT * FROM t""")
def engine_lookup(spark, sf_dir):
    """Every mapped cell of every row: found through merged areas, with the place that it comes from."""
    books, plan = scenarios.bids(spark, sf_dir)
    found = looked_up(books, *plan_frames(spark, plan))
    cells = found.select("sha", "sheet_idx", "row", F.explode("at").alias("role", "c"))
    return _sheet_rows(cells, "role", "c.text", "c.place", "c.merged", "c.direct")


@query(f"""WITH {BIDS} SELECT sha, CAST(sheet AS INT) AS sheet_idx, CAST(line AS INT) AS "row", name AS text, 2 AS src_row, 1 AS src_col, n_sheet > 1 AS merged FROM l
UNION ALL SELECT sha, CAST(sheet AS INT), CAST(line AS INT), award, CAST(line AS INT), 4, false FROM l""")
def engine_resolve(spark, sf_dir):
    """The first and the fourth column of every row through merged areas, blank cells included."""
    books, _ = scenarios.bids(spark, sf_dir)
    rows = books.cells.where("col = 2 and row > 1").select("sha", "sheet_idx", "row", F.explode(F.array(F.lit(1), F.lit(4))).alias("col"))
    return resolve(rows, books.merges, books.cells).select("sha", "sheet_idx", "row", "text", "src_row", "src_col", "merged")


@query("""WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS sheet_idx FROM nation JOIN region ON r_regionkey = n_regionkey),
t AS (SELECT n_regionkey, sheet_idx, 'cell' AS kind, 1 AS "row", 1 AS col, 'head' AS text FROM n UNION ALL SELECT n_regionkey, sheet_idx, 'cell', 1, 2, n_name FROM n UNION ALL SELECT n_regionkey, sheet_idx, 'cell', 2, 2, CAST(n_nationkey AS VARCHAR) FROM n
UNION ALL SELECT n_regionkey, sheet_idx, 'cell', 3, 1, '<' || r_name || '> & more' FROM n UNION ALL SELECT n_regionkey, sheet_idx, 'cell', 3, 3, 'x' FROM n
UNION ALL SELECT n_regionkey, sheet_idx, 'merge', 1, 1, '2:1' FROM n UNION ALL SELECT n_regionkey, sheet_idx, 'sheet', NULL, NULL, n_name FROM n)
SELECT 'region-' || n_regionkey || '.xlsx' AS file_name, sheet_idx, kind, "row", col, text FROM t""")
def workbook_cells(spark, sf_dir):
    """Sheets, cells and merged areas of .xlsx files, decoded from their bytes."""
    found = decoded(scenarios.region_files(spark, sf_dir))
    merge = F.col("kind") == "merge"
    area = F.concat_ws(":", F.col("bottom").cast("string"), F.col("right").cast("string"))
    return found.select("file_name", "sheet_idx", "kind", F.coalesce("row", "top").alias("row"), F.coalesce("col", "left").alias("col"), F.when(merge, area).otherwise(F.coalesce("text", "name")).alias("text"))


@query(f"""WITH {BIDS}, cells AS (SELECT DISTINCT sha, sheet, 1 AS line, col, text FROM l, (VALUES (1, '项目名称'), (2, '投标单位名称'), (3, '投标单位数量'), (4, '中标单位'), (5, '备注')) h(col, text)
UNION ALL SELECT sha, sheet, line, 1, name FROM l WHERE rn = 0 UNION ALL SELECT sha, sheet, line, 2, c_name FROM l UNION ALL SELECT sha, sheet, line, 3, CAST(n + CAST(miscounted AS INT) AS VARCHAR) FROM l WHERE pos = 0
UNION ALL SELECT sha, sheet, line, 4, award FROM l WHERE award IS NOT NULL UNION ALL SELECT sha, sheet, line, 5, '未招标' FROM l WHERE pos = 0 AND untendered),
k AS (SELECT *, row_number() OVER (PARTITION BY sha, sheet, col ORDER BY line) AS n FROM cells), x AS (SELECT sha, sheet, max(line) AS high, max(col) AS wide FROM cells GROUP BY ALL)
SELECT sha, CAST(sheet AS INT) AS sheet_idx, col, count(*) AS nonempty_count, string_agg(text, '|' ORDER BY line) FILTER (WHERE n <= 3) AS samples, CAST(any_value(high) AS INT) AS max_row, CAST(any_value(wide) AS INT) AS max_col,
1 AS region_start, CAST(any_value(high) AS INT) AS region_end, max(CASE WHEN line = 1 THEN CASE col WHEN 1 THEN 'project_name' WHEN 2 THEN 'bidder_name' WHEN 3 THEN 'bidder_count' WHEN 4 THEN 'award_name' ELSE 'notes' END END) AS role
FROM k JOIN x USING (sha, sheet) GROUP BY sha, sheet, col""")
def engine_profile(spark, sf_dir):
    """What an inspection finds in each column: counts, samples, the header's role; the extent and region of its sheet."""
    cells = scenarios.bids(spark, sf_dir)[0].cells
    sheet = ["sha", "sheet_idx"]
    extents = profile.row_extents(cells).select(*sheet, "max_row", "max_col")
    regions = profile.content_regions(cells).select(*sheet, F.col("start").alias("region_start"), F.col("end").alias("region_end"))
    roles = profile.header_matches(cells).where("row = 1").select(*sheet, "col", "role")
    columns = profile.column_profiles(cells).select(*sheet, "col", "nonempty_count", F.array_join("sample_values", "|").alias("samples"))
    return columns.join(extents, sheet).join(regions, sheet).join(roles, [*sheet, "col"], "left")


# ---------------------------------------------------------------- rows


@query(f"""WITH {BIDS} SELECT {PLACE}, 'business' AS type, project_id, group_id, pos = 0 AS new_group, CAST(first_line AS INT) AS anchor_row, 'business' AS scope_type, c_name AS company, coalesce(award, '') AS award, CAST(line AS INT) AS award_row FROM l""")
def engine_anchor_rows(spark, sf_dir):
    """merged x anchor: the project, group and anchor of every row."""
    rows, _, _ = assign(*scenarios.bids(spark, sf_dir))
    return _sheet_rows(rows, "type", "project_id", "group_id", "new_group", "anchor_row", "scope_type", "company", "award", "award_row")


@query(f"""WITH {PARTS} SELECT {PLACE}, CASE pos WHEN 5 THEN 'summary' WHEN 4 THEN 'context_only' ELSE 'business' END AS type, project_id, group_id, pos < 4 AND line = min(line) OVER (PARTITION BY group_id) AS new_group,
CASE WHEN pos < 4 THEN CAST(min(line) OVER (PARTITION BY group_id) AS INT) END AS anchor_row, 'P' || block AS project_name, 'A' || first_line AS project_cell, CASE WHEN pos < 4 THEN 'C:' || brand ELSE '' END AS context FROM l""")
def engine_block_rows(spark, sf_dir):
    """blocks x project: filled-down projects, groups by a context that is filled down, summary and context rows."""
    rows, _, _ = assign(*scenarios.parts(spark, sf_dir))
    context = F.array_join(F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return _sheet_rows(rows, "type", "project_id", "group_id", "new_group", "anchor_row", F.col("values")["project_name"].alias("project_name"), F.col("places")["project_name"].alias("project_cell"), context.alias("context"))


@query(f"""WITH {LOTS} SELECT {PLACE}, project_id, group_id, pos = 0 AS new_group, 'L' || lot AS lot_name, CASE WHEN lot % 4 = 0 AND pos <> 1 THEN CASE pos WHEN 0 THEN '中标' ELSE '另议' END ELSE '' END AS stated, 'F' || line AS stated_cell FROM l""")
def engine_lot_rows(spark, sf_dir):
    """repeated x lot: projects told by their values, groups by their lot."""
    rows, _, _ = assign(*scenarios.lots(spark, sf_dir))
    return _sheet_rows(rows, "project_id", "group_id", "new_group", "lot_name", F.col("values")["award_status"].alias("stated"), F.col("places")["award_status"].alias("stated_cell"))


# ---------------------------------------------------------------- participants and groups


@query(f"""WITH {LOTS} SELECT group_id, record_id, s_name AS name, CAST(CASE WHEN pos = 1 THEN 2 WHEN pos = 0 AND later IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS mentions, CASE WHEN pos = 0 AND later IS NOT NULL AND lot % 2 = 1 THEN 'bidder_price' ELSE '' END AS conflicts,
CASE WHEN lot % 4 = 0 AND pos = 0 THEN '是' WHEN lot % 4 = 0 AND pos = 2 THEN '另议' ELSE '' END AS explicit, CASE WHEN lot % 4 = 0 AND pos = 0 THEN '是' ELSE '' END AS award_status FROM l WHERE NOT consortium""")
def engine_participants(spark, sf_dir):
    """Companies of each lot, once for each: split lists, repeated mentions, fields in which mentions differ, stated results."""
    records = _finished(scenarios.lots(spark, sf_dir)).records
    return records.select("group_id", "record_id", "name", F.size("occurrences").cast("long").alias("mentions"), F.array_join("conflicts", ",").alias("conflicts"), "explicit", "award_status")


@query(f"""WITH {ROSTER} SELECT group_id, company AS name, count(*) AS mentions, CAST(min(line) AS INT) AS first_row, 'roster' AS procurement FROM l GROUP BY group_id, company""")
def engine_roster(spark, sf_dir):
    """none x source: each company of a list once, with its mentions."""
    done = _finished(scenarios.roster(spark, sf_dir))
    return done.records.join(done.groups.select("group_id", "procurement"), "group_id").select("group_id", "name", F.size("occurrences").cast("long").alias("mentions"), F.col("ord.row").alias("first_row"), "procurement")


@query(f"""WITH {BIDS} SELECT group_id, any_value(name) AS sheet, CAST(any_value(first_line) AS INT) AS anchor_row, CASE WHEN any_value(untendered) THEN 'non_tender' ELSE 'bidding' END AS procurement, CAST(any_value(n) + CAST(any_value(miscounted) AS INT) AS VARCHAR) AS declared, any_value(n) AS actual,
1 AS n_awards, NOT any_value(nobody) AS verified, CASE WHEN any_value(nobody) THEN '本组存在未解决的中标读取或对应问题' ELSE '' END AS reasons, string_agg(line, ',' ORDER BY line) AS source_rows FROM l GROUP BY group_id""")
def engine_groups(spark, sf_dir):
    """Groups with what they declare and what they hold, their procurement, and whether their result is complete."""
    groups = _finished(scenarios.bids(spark, sf_dir)).groups
    texts = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return groups.select("group_id", "sheet", "anchor_row", "procurement", texts("counts").alias("declared"), "actual", F.col("n_awards").cast("int").alias("n_awards"), "verified", F.array_join("reasons", "；").alias("reasons"), texts("source_rows").alias("source_rows"))


# ---------------------------------------------------------------- awards


@query(f"""WITH {BIDS} SELECT group_id, 'award_review_' || substr(sha256('["' || group_id || '","' || lower(replace(award, ' ', '')) || '",["D' || line || '"]]'), 1, 24) AS review_task_id, award AS original_award, 'D' || line AS award_cell, CASE WHEN nobody THEN 'unresolved' ELSE 'matched' END AS status,
CASE WHEN nobody THEN 'unresolved' ELSE 'exact_name' END AS basis, CASE WHEN NOT nobody THEN record_id END AS selected_record_id, CASE WHEN NOT nobody THEN c_name END AS selected_bidder_name, n AS candidate_count, least(n, 3) AS n_shown FROM l WHERE place = 1""")
def engine_matches(spark, sf_dir):
    """Awards and the participants that carry exactly their name; the others stay open."""
    matches = _finished(scenarios.bids(spark, sf_dir)).matches
    shown = F.least(F.size("candidates"), F.lit(3)).cast("long")
    return matches.select("group_id", "review_task_id", "original_award", "award_cell", "status", "basis", "selected_record_id", "selected_bidder_name", "candidate_count", shown.alias("n_shown"))


@query(f"""WITH {BESIDE} SELECT group_id, task AS review_task_id, 'unresolved' AS status, record_id AS recommended_record_id, c_name AS recommended_bidder_name, 'same_row' AS recommendation_basis, '{REASONS["safe"]}' AS recommendation_reason FROM l WHERE pos = 2""")
def engine_same_row(spark, sf_dir):
    """Open awards whose row has one bidder: it is recommended, and nothing is settled."""
    matches = _finished(scenarios.beside(spark, sf_dir)).matches
    return matches.select("group_id", "review_task_id", "status", "recommended_record_id", "recommended_bidder_name", "recommendation_basis", "recommendation_reason")


@query(f"""WITH {BESIDE} SELECT task AS review_task_id, CASE c_custkey % 4 WHEN 2 THEN 'deferred' WHEN 3 THEN NULL ELSE 'select_bidder' END AS decision, CASE WHEN c_custkey % 4 < 2 THEN record_id END AS record_id, CASE WHEN c_custkey % 4 < 2 THEN c_name END AS company_name,
CASE WHEN c_custkey % 4 = 0 THEN 'recommended' WHEN c_custkey % 4 = 1 THEN 'manual' END AS source, CASE WHEN c_custkey % 4 = 3 THEN '{review.AMBIGUOUS}' END AS problem FROM l WHERE pos = 2""")
def engine_answers(spark, sf_dir):
    """Answers to all open questions: by id, by name, put off, and by a name that nobody has."""
    r = _results(scenarios.beside(spark, sf_dir))
    kind = F.col("original_award").substr(10, 20).cast("long") % 4
    value = F.when(kind == 0, F.col("recommended_record_id")).when(kind == 1, F.col("recommended_bidder_name")).when(kind == 2, "不确定").otherwise("nobody at all")
    given = review.award_tasks(r).select(F.xxhash64("review_task_id").alias("pos"), "review_task_id", value.alias("value"), name_key_udf(value).alias("key"), F.lit(None).cast("string").alias("problem"))
    found = review.judged(r, given)
    chosen = F.col("decision") == "select_bidder"
    return found.select("review_task_id", "decision", *[F.when(chosen, F.col(c)).alias(c) for c in ("record_id", "company_name", "source")], "problem")


# ---------------------------------------------------------------- results

MISCOUNT, OPEN = "声明投标数量与整理后的企业数量不一致", "中标名称需要用户确认对应的投标企业"
FINAL = f"""{BIDS}, f AS (SELECT *, row_number() OVER (ORDER BY book, sheet, line) AS seq, miscounted OR nobody AS pending, CASE WHEN nobody THEN '' WHEN place = 1 THEN '是' ELSE '否' END AS status, CASE WHEN miscounted OR nobody THEN '0.6' WHEN place = 1 THEN '0.92' ELSE '0.9' END AS confidence,
'Sheet=' || name || '；企业来源=B' || line || '#1；项目来源=A2；组起始行=' || first_line || '；原中标字段=D' || award_line || ':' || group_award || CASE WHEN place = 1 AND NOT nobody THEN '；中标对应=' || award || '→' || c_name || '(exact_name)' ELSE '' END || CASE WHEN untendered THEN '；原表注明未招投标' ELSE '' END AS evidence FROM l)"""


@query(f"""WITH {FINAL} SELECT seq, name AS project, c_name AS company, status, file, confidence, CASE WHEN pending THEN '待复核' ELSE '通过' END AS review, evidence FROM f""")
def engine_final(spark, sf_dir):
    """The rows of the result, densely numbered, with evidence, status and confidence."""
    final = _results(scenarios.bids(spark, sf_dir)).final
    return final.select("seq", F.col("项目名称").alias("project"), F.col("公司名称").alias("company"), F.col("中标与否").alias("status"), F.col("依据文件路径").alias("file"), F.col("置信度").alias("confidence"), F.col("复核状态").alias("review"), F.col("证据文本").alias("evidence"))


@query(f"""WITH {FINAL} SELECT row_number() OVER (ORDER BY seq) AS seq, c_name AS company, status, confidence, CASE WHEN miscounted AND nobody THEN '{MISCOUNT}；{OPEN}' WHEN miscounted THEN '{MISCOUNT}' ELSE '{OPEN}' END || chr(10) || evidence AS evidence FROM f WHERE pending""")
def engine_review(spark, sf_dir):
    """The queue of what is to be reviewed, with reasons before the evidence."""
    found = _results(scenarios.bids(spark, sf_dir)).review
    return found.select("seq", F.col("公司名称").alias("company"), F.col("中标与否").alias("status"), F.col("置信度").alias("confidence"), F.col("证据文本").alias("evidence"))


@query(f"""WITH {LOTS}, r AS (SELECT *, NOT consortium AS named, (lot % 2 = 1 AND max(CASE WHEN pos = 1 THEN 1 ELSE 0 END) OVER w = 1) OR (lot % 4 = 0 AND max(CASE WHEN pos = 2 THEN 1 ELSE 0 END) OVER w = 1) OR max(CASE WHEN consortium THEN 1 ELSE 0 END) OVER w = 1 AS pending FROM l WINDOW w AS (PARTITION BY group_id)),
linked AS (SELECT book, sheet, line, row_number() OVER (ORDER BY book, sheet, line) AS seq FROM r WHERE named AND pending)
SELECT seq, 'linked' AS kind, CAST(NULL AS VARCHAR) AS evidence FROM linked UNION ALL SELECT (SELECT count(*) FROM linked) + row_number() OVER (ORDER BY book, sheet, line), 'standalone', '联合体名单需要确认成员与共同投标关系，不能拆成独立投标企业' || chr(10) || 'Sheet=' || name || '；来源行=' || line FROM r WHERE consortium""")
def engine_review_sequence(spark, sf_dir):
    """Numbers of the review queue: flagged records first, then issues that stand alone, without a gap."""
    r = _results(scenarios.lots(spark, sf_dir))
    alone = F.col("公司名称") == ""
    return r.review.select("seq", F.when(alone, "standalone").otherwise("linked").alias("kind"), F.when(alone, F.col("证据文本")).alias("evidence"))


@query(f"""WITH {BIDS}, b AS (SELECT DISTINCT group_id, 'BIDDER_COUNT_MISMATCH' AS code, '["group"]' AS scope, n AS n_final FROM l WHERE miscounted UNION ALL SELECT group_id, 'AWARD_NAME_MISMATCH', '["award","D' || line || '","' || award || '"]', n FROM l WHERE place = 1 AND nobody)
SELECT 'issue_' || substr(sha256('["' || group_id || '","' || code || '",' || scope || ']'), 1, 24) AS issue_id, group_id, code, n_final FROM b""")
def engine_issues(spark, sf_dir):
    """Issues by identity, with the records that they are about."""
    return _results(scenarios.bids(spark, sf_dir)).issues.select("issue_id", "group_id", "code", F.size("final_sequences").cast("long").alias("n_final"))


@query(f"""WITH {LOTS}, b AS (SELECT group_id, 'DUPLICATE_CONFLICT' AS code, '["record","' || s_name || '",["bidder_price"]]' AS scope, false AS standalone FROM l WHERE pos = 0 AND later IS NOT NULL AND lot % 2 = 1
UNION ALL SELECT group_id, 'BIDDER_LIST_AMBIGUOUS', '["group"]', true FROM l WHERE consortium UNION ALL SELECT group_id, 'AWARD_STATUS_UNRECOGNIZED', '["group"]', false FROM l WHERE lot % 4 = 0 AND pos = 2)
SELECT 'issue_' || substr(sha256('["' || group_id || '","' || code || '",' || scope || ']'), 1, 24) AS issue_id, group_id, code, standalone FROM b""")
def engine_lot_issues(spark, sf_dir):
    """Issues of lists, repeated records and stated results."""
    return _finished(scenarios.lots(spark, sf_dir)).issues.select("issue_id", "group_id", "code", "standalone")


@query(f"""WITH {BIDS}, g AS (SELECT DISTINCT group_id, miscounted, nobody, untendered FROM l) SELECT (SELECT count(DISTINCT project_id) FROM l) AS project_count, count(*) AS group_count, 0 AS explicit_lot_count, count(*) FILTER (WHERE NOT untendered) AS bidding_group_count, count(*) FILTER (WHERE untendered) AS non_tender_group_count,
0 AS uncertain_group_count, 0 AS roster_group_count, 0 AS context_group_count, (SELECT count(*) FROM l) AS record_count, (SELECT count(*) FROM l WHERE miscounted OR nobody) AS pending_record_count, (SELECT count(*) FROM l WHERE miscounted OR nobody) AS review_record_count,
count(*) FILTER (WHERE miscounted) + count(*) FILTER (WHERE nobody) AS issue_count, (SELECT count(DISTINCT c_name) FROM l) AS unique_company_count, 0 AS duplicate_mentions_removed, 0 AS corrected_record_count FROM g""")
def engine_summary(spark, sf_dir):
    """The 15 counters of a result."""
    return _results(scenarios.bids(spark, sf_dir)).summary


@query(f"""WITH {ROSTER}, n AS (SELECT book, sheet, company, min(line) AS line FROM l GROUP BY ALL), s AS (SELECT *, row_number() OVER (ORDER BY book, sheet, line) AS seq FROM n) SELECT company AS name, min(seq) AS seq FROM s GROUP BY company""")
def engine_companies(spark, sf_dir):
    """Each company of all lists once, where it comes first."""
    return _results(scenarios.roster(spark, sf_dir)).companies.select("name", "seq")


@query(f"""WITH {BIDS}, b AS (SELECT '记录的分组不存在' AS rule, count(*) AS n FROM l WHERE untendered UNION ALL SELECT '记录关联未知问题', count(*) FROM l WHERE miscounted UNION ALL SELECT '复核记录没有对应的问题', count(*) FROM l WHERE miscounted AND NOT nobody) SELECT * FROM b WHERE n > 0""")
def engine_broken_rules(spark, sf_dir):
    """What the rules find when groups and issues are taken out of a result; whole, it breaks none (or the engine refuses it)."""
    r = _results(scenarios.bids(spark, sf_dir))
    quality.check(r, [])
    hurt = replace(r, groups=r.groups.where("procurement <> 'non_tender'"), issues=r.issues.where("code <> 'BIDDER_COUNT_MISMATCH'"))
    return quality.broken(hurt).where("n > 0")
