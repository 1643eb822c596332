"""Results: the 16-column rows, the review queue, company names and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.functions.stored import stored
from ledgerloom.functions.text import clean_udf, confidence_text, json_list, name_key_udf, quoted
from ledgerloom.operators.finish import Finished, identified
from ledgerloom.operators.windows import numbered

PLACE = ["place.book", "place.sheet_idx", "place.table_idx", "place.row", "ord.row", "ord.idx"]


@dataclass
class Results:
    final: DataFrame
    review: DataFrame
    records: DataFrame
    groups: DataFrame
    projects: DataFrame
    issues: DataFrame
    matches: DataFrame
    companies: DataFrame
    summary: DataFrame
    rows: DataFrame


def projects_of(rows: DataFrame, sources: DataFrame, sheets: DataFrame) -> DataFrame:
    """One project for each id: what its first row says."""
    books = sources.select("sha", "source_id", F.col("ord").alias("book"))
    place = F.struct("book", "sheet_idx", "table_idx", "row")
    named = rows.where("project_id is not null").join(books, "sha").join(sheets.select("sha", "sheet_idx", F.col("name").alias("sheet")), ["sha", "sheet_idx"])
    roles = F.array(*[F.lit(r) for r in V.CONTEXT_ROLES])
    only = lambda m: F.map_filter(m, lambda k, _: F.array_contains(roles, k))
    first = F.struct("source_id", "sheet", F.col("project_anchor").alias("anchor"), only("values").alias("values"), only("places").alias("places"))
    out = named.groupBy("project_id").agg(F.min_by(first, place).alias("p"), F.min(place).alias("project_place")).select("project_id", "p.*", "project_place")
    v = lambda r: F.coalesce(F.col("values")[r], F.lit(""))
    return out.withColumns({"project_name": clean_udf(v("project_name")), "project_code": clean_udf(v("project_code"))})


def region_issues(sources: DataFrame, sheets: DataFrame, cells: DataFrame, plan: dict, failures: list[dict]) -> DataFrame:
    """Issues that no row raises: unreadable sources, skipped and unresolved sheets and regions."""
    spark = sources.sparkSession
    listed = []
    for i, f in enumerate(failures):
        listed.append((-1, 0, i, "SOURCE_UNREADABLE", f["error"], f["id"], f["file_name"], None, None, None, None, None, f["sha256"], True))
    for b, source in enumerate(plan["sources"]):
        for i, sheet in enumerate(source["sheets"]):
            at = dict(sha=source["sha256"], sid="source_" + source["sha256"][:24], file=source["file_name"])
            if sheet["action"] == "skip":
                listed.append((b, i, 0, "SOURCE_REGION_SKIPPED", "非空工作表未解析，已转入复核", at["sid"], at["file"], sheet["name"], None, None, sheet["reason"], i, at["sha"], False))
            elif sheet["action"] == "review":
                listed.append((b, i, 0, "SOURCE_REGION_UNRESOLVED", "工作表结构未能可靠映射，已转入复核", at["sid"], at["file"], sheet["name"], None, None, sheet["reason"], i, at["sha"], True))
            for k, region in enumerate(sheet.get("review_regions") or []):
                listed.append((b, i, 1_000_000 + k, "SOURCE_REGION_UNRESOLVED", "局部结构未能可靠映射，已转入复核", at["sid"], at["file"], sheet["name"], region["start"], region["end"], region["reason"], None, at["sha"], True))
    ddl = "book int, sheet_no int, k int, code string, message string, source_id string, source_file string, sheet string, start_row int, end_row int, reason string, sheet_idx int, sha string, always boolean"
    base = spark.createDataFrame(listed, ddl)
    spans = cells.where("text <> '' or formula or error").groupBy("sha", "sheet_idx").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    found = base.join(spans, ["sha", "sheet_idx"], "left").where("always or low is not null")
    of_sheet = F.col("sheet_idx").isNotNull()
    found = found.withColumns({"start_row": F.when(of_sheet, F.coalesce("low", F.lit(1))).otherwise(F.col("start_row")), "end_row": F.when(of_sheet, F.coalesce("high", F.lit(1))).otherwise(F.col("end_row"))})
    scope = json_list(F.lit('"source"'), quoted(F.col("source_id")), quoted(F.col("sheet")), F.col("start_row").cast("string"), F.col("end_row").cast("string"))
    extra = F.to_json(F.struct("source_id", "source_file", "sheet", "start_row", "end_row", "reason"))
    order = F.concat_ws("/", *[F.format_string("%012d", (F.col(c) + 1).cast("long")) for c in ("book", "sheet_no", "k")])
    none = lambda t: F.lit(None).cast(t)
    return found.select(none("string").alias("group_id"), "code", "message", F.lit(0).alias("phase"), order.alias("ord"), scope.alias("scope"), F.lit(True).alias("standalone"), none("string").alias("field"), none("int").alias("source_row"), none("string").alias("source_cell"), extra.alias("extra"))


def confidence(records: DataFrame) -> DataFrame:
    """records with the three reliabilities, their minimum and its basis; records carry their group's columns."""
    grouping = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.GROUPING_SCORES.items() for x in kv]), F.col("group_mode")), F.lit(0.8))
    grouping = F.when(F.size("context") > 0, F.greatest(grouping, F.lit(0.97))).otherwise(grouping)
    grouping = F.when(F.col("project_mode") == "blocks", F.least(grouping, F.lit(0.9))).otherwise(grouping)
    extraction = F.when(F.col("company_unavailable"), 0.25).when(F.col("name") != "", 1.0).otherwise(0.7)
    stated = (F.col("explicit") != "") & (F.col("award_status") != "")
    award = F.when(F.col("match_basis").isNotNull(), 1.0).when(F.col("award_status") == V.NO, F.when(F.col("basis_type") == "explicit", 1.0).otherwise(0.9)).when(stated, 1.0).when(F.col("n_awards") > 0, 0.6).otherwise(1.0)
    basis = F.when(F.col("match_basis").isNotNull(), F.col("match_basis")).when(F.col("award_status") == V.NO, F.concat(F.lit("complete_"), "basis_type")).when(stated, "explicit_status").when(F.col("n_awards") > 0, "unresolved_or_incomplete").otherwise("no_award_claim")
    out = records.withColumns({"extraction": extraction, "grouping": grouping, "award_mapping": award, "award_basis": basis})
    least = F.least("extraction", "grouping", "award_mapping")
    return out.withColumn("score", F.round(F.when(F.size("group_issues") > 0, F.least(least, F.lit(0.6))).otherwise(least), 2))


def _evidence():
    """The evidence segments, in order; those that don't apply are null and left out."""
    where = F.transform("occurrences", lambda o: F.when(o["company_role"].isNotNull(), F.concat(o["places"][o["company_role"]], F.lit("#"), o["idx"].cast("string"))).otherwise(F.concat(F.lit("行"), o["row"].cast("string"))))
    context = F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit(":"), e["value"], F.lit("@"), F.element_at(F.col("context_places"), e["key"])))
    segments = [
        F.concat(F.lit("Sheet="), "sheet"),
        F.concat(F.when(F.col("name") != "", "企业来源=").otherwise("来源="), F.array_join(where, ",")),
        F.when(F.size("project_places") > 0, F.concat(F.lit("项目来源="), F.coalesce(F.col("project_places")["project_name"], F.col("project_places")["project_code"], F.lit("")))),
        F.when(F.col("scope_type") == "roster", "纯企业名单，原表未提供项目或标段归属").otherwise(F.concat(F.lit("组起始行="), F.col("anchor_row").cast("string"))),
        F.when(F.size("context") > 0, F.concat(F.lit("分组上下文="), F.array_join(context, ","))),
        F.when(F.col("n_awards") > 0, F.concat(F.lit("原中标字段="), F.array_join(F.transform("awards", lambda a: F.concat(a["cell"], F.lit(":"), a["raw"])), "；"))),
        F.when(F.size("changes") > 0, F.concat(F.lit("清洗="), F.array_join(F.transform("changes", lambda c: F.concat(c["before"], F.lit("→"), c["after"], F.lit("("), c["rule"], F.lit(")"))), "；"))),
        F.when(F.col("match_basis").isNotNull(), F.concat(F.lit("中标对应="), "match_award", F.lit("→"), "name", F.lit("("), "match_basis", F.lit(")"))),
        F.when(F.col("procurement") == "non_tender", "原表注明未招投标"),
    ]
    return F.concat_ws("；", *segments)


def _row(timestamp: str, **given):
    """The 16 columns; what is not given is empty."""
    fixed = {"文件类别": F.lit(V.CATEGORY), "提取方式": F.lit(V.METHOD), "解析结果生成日期时间": F.lit(timestamp)}
    return [F.coalesce((given | fixed).get(f, F.lit("")).cast("string"), F.lit("")).alias(f) for f in V.FIELDS]


def emit(rows: DataFrame, done: Finished, books, plan: dict, timestamp: str, failures: list[dict] | None = None) -> Results:
    """All tables of a result, numbered."""
    projects = stored(projects_of(rows, books.sources, books.sheets))
    regions = identified(region_issues(books.sources, books.sheets, books.cells, plan, failures or []))
    issues = stored(done.issues.unionByName(regions))
    listed = issues.where("group_id is not null").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("order", "issue_id", "code", "message"))).alias("group_issues"), F.collect_set(F.when(F.col("code") == "FIELD_UNAVAILABLE", F.col("field"))).alias("unavailable_fields"))
    facts = done.groups.join(listed, "group_id", "left").select(
        "group_id", "place", "source_id", "file_name", "sheet", "anchor_row", "lot_name", "lot_code", "scope_type", "company_role", "group_mode", "project_mode", "basis_type", "context", "context_places", "n_awards", "awards", "procurement",
        F.coalesce("group_issues", F.expr("array()").cast("array<struct<order:string,issue_id:string,code:string,message:string>>")).alias("group_issues"), F.coalesce(F.array_contains("unavailable_fields", F.col("company_role")), F.lit(False)).alias("company_unavailable"),
    )
    about = projects.select("project_id", "project_name", "project_code", F.col("places").alias("project_places"))
    full = done.records.join(facts, "group_id").join(about, "project_id", "left").fillna("", ["project_name", "project_code"])
    full = confidence(full).withColumns({"evidence_text": _evidence(), "pending": F.size("group_issues") > 0})
    full = numbered(full, PLACE, "final_sequence")
    flagged = numbered(full.where("pending").select("record_id", "final_sequence"), ["final_sequence"], "review_sequence").select("record_id", "review_sequence")
    full = stored(full.join(flagged, "record_id", "left"))
    status = F.when(F.col("pending"), V.PENDING).otherwise(V.PASSED)
    columns = dict(项目名称=F.col("project_name"), 项目编号=F.col("project_code"), 标段名称=F.col("lot_name"), 标段编号=F.col("lot_code"), 公司名称=F.col("name"), 中标与否=F.col("award_status"), 投标排名=F.col("rank"), 依据文件路径=F.col("file_name"), 置信度=confidence_text(F.col("score")))
    final = full.select(F.col("final_sequence").alias("seq"), *_row(timestamp, 序号=F.col("final_sequence"), 证据文本=F.col("evidence_text"), 复核状态=status, **columns))
    messages = F.array_join(F.array_distinct(F.transform("group_issues", lambda i: i["message"])), "；")
    linked = full.where("pending").select(F.col("review_sequence").alias("seq"), *_row(timestamp, 序号=F.col("review_sequence"), 证据文本=F.concat(messages, F.lit("\n"), "evidence_text"), 复核状态=F.lit(V.PENDING), **columns))
    n_linked = full.where("pending").count()
    alone = issues.where("standalone").join(done.groups.select("group_id", F.col("sheet").alias("g_sheet"), "anchor_row", "lot_name", "file_name", "project_id"), "group_id", "left").join(about.select("project_id", "project_name"), "project_id", "left")
    get = lambda k: F.get_json_object("extra", f"$.{k}")
    from_row = F.coalesce(F.col("source_row").cast("string"), F.col("anchor_row").cast("string"))
    place = F.concat_ws("；", F.concat(F.lit("Sheet="), F.coalesce(get("sheet"), "g_sheet")), F.when(get("start_row").isNotNull(), F.concat(F.lit("区域="), get("start_row"), F.lit(":"), F.coalesce(get("end_row"), get("start_row")))).otherwise(F.concat(F.lit("来源行="), from_row)), F.concat(F.lit("原因="), get("reason")))
    alone = numbered(alone.withColumn("where", place), ["order"], "review_sequence", first=n_linked + 1)
    text = F.concat("message", F.when(F.col("where") != "", F.concat(F.lit("\n"), "where")).otherwise(""))
    standalone = alone.select(F.col("review_sequence").alias("seq"), *_row(timestamp, 序号=F.col("review_sequence"), 项目名称=F.col("project_name"), 标段名称=F.col("lot_name"), 依据文件路径=F.coalesce("file_name", get("source_file")), 置信度=F.lit("0"), 复核状态=F.lit(V.PENDING), 证据文本=text))
    review = linked.unionByName(standalone)
    seen = full.where("pending").select("group_id", "final_sequence", "review_sequence", "record_id").groupBy("group_id").agg(F.sort_array(F.collect_list("final_sequence")).alias("final_sequences"), F.sort_array(F.collect_list("review_sequence")).alias("own"))
    ids = done.records.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ord", "record_id"))).alias("r")).select("group_id", F.transform("r", lambda r: r["record_id"]).alias("record_ids"))
    no_ints, no_ids = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<string>)")
    issues = issues.join(seen, "group_id", "left").join(ids, "group_id", "left").join(alone.select("issue_id", F.col("review_sequence").alias("alone_at")), "issue_id", "left")
    issues = issues.withColumns({"final_sequences": F.coalesce("final_sequences", no_ints), "record_ids": F.coalesce("record_ids", no_ids), "review_sequences": F.concat(F.coalesce("own", no_ints), F.when(F.col("alone_at").isNotNull(), F.array("alone_at")).otherwise(no_ints))}).drop("own", "alone_at")
    issues = stored(issues)
    return Results(final, review, full, done.groups, projects, issues, done.matches, companies(final), counters(full, done.groups, projects, issues, final, review), rows)


def companies(final: DataFrame) -> DataFrame:
    """Each company once, in the spelling that comes first."""
    key = final.select("seq", F.col("公司名称").alias("name")).withColumn("key", name_key_udf("name")).where("key <> ''")
    return key.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))


def counters(records: DataFrame, groups: DataFrame, projects: DataFrame, issues: DataFrame, final: DataFrame, review: DataFrame) -> DataFrame:
    """One row with the 15 counters of a result."""
    g = groups.agg(
        F.count("*").alias("group_count"), F.count_if((F.col("lot_name") != "") | (F.col("lot_code") != "")).alias("explicit_lot_count"),
        *[F.count_if(F.col("procurement") == p).alias(f"{p}_group_count") for p in ("bidding", "non_tender", "uncertain")], *[F.count_if(F.col("scope_type") == s).alias(f"{s}_group_count") for s in ("roster", "context")],
    )
    r = records.agg(F.count("*").alias("record_count"), F.count_if("pending").alias("pending_record_count"), F.coalesce(F.sum(F.size("occurrences") - 1), F.lit(0)).cast("long").alias("duplicate_mentions_removed"), F.count_if(F.size("changes") > 0).alias("corrected_record_count"))
    one = [projects.agg(F.count("*").alias("project_count")), review.agg(F.count("*").alias("review_record_count")), issues.agg(F.count("*").alias("issue_count")), companies(final).agg(F.count("*").alias("unique_company_count"))]
    out = g.withColumn("k", F.lit(1))
    for part in [r, *one]:  # single rows
        out = out.join(part.withColumn("k", F.lit(1)), "k")
    return out.drop("k")
