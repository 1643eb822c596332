"""From business rows to participants, awards and issues of each group: keyed aggregations and joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.functions.stored import stored
from ledgerloom.functions.text import clean_udf, hashed, json_list, quoted, signal_column, split_names_udf, status_column
from ledgerloom.operators.collect import TABLE
from ledgerloom.operators.matching import match_awards

ISSUE = ["group_id", "code", "message", "phase", "ord", "scope", "standalone", "field", "source_row", "source_cell", "extra"]


@dataclass
class Finished:
    business: DataFrame
    groups: DataFrame
    records: DataFrame
    awards: DataFrame
    matches: DataFrame
    issues: DataFrame


def mention_order() -> Column:
    """Order of everything that a row gives rise to: workbook, sheet, table, row, position in the row."""
    return F.struct("book", "sheet_idx", "table_idx", "row", "idx")


def _issue(df: DataFrame, code, message, ord_: Column, *, phase=0, scope: Column | None = None, standalone=False, field=None, source_row=None, source_cell=None, extra: Column | None = None) -> DataFrame:
    lit = lambda v, t: v.cast(t) if isinstance(v, Column) else F.lit(v).cast(t)
    return df.select(
        "group_id", lit(code, "string").alias("code"), lit(message, "string").alias("message"), F.lit(phase).alias("phase"), ord_.alias("ord"),
        (scope if scope is not None else F.lit('["group"]')).alias("scope"), F.lit(standalone).alias("standalone"), lit(field, "string").alias("field"),
        lit(source_row, "int").alias("source_row"), lit(source_cell, "string").alias("source_cell"), (extra if extra is not None else F.lit("{}")).alias("extra"),
    )


def _at(*parts) -> Column:
    """A comparable place: numbers padded to texts."""
    return F.concat_ws("/", *[F.format_string("%012d", (F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("long")) for p in parts])


def in_order(a: Column, b: Column) -> Column:
    return F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)


def business_rows(rows: DataFrame, tables: DataFrame, sources: DataFrame) -> DataFrame:
    """Business rows with their split names, cleaned fields and the order of their workbook."""
    books = sources.select("sha", F.col("ord").alias("book"), "source_id", "file_name")
    joined = rows.where("type = 'business'").join(tables.drop("headers", "summary_markers"), TABLE).join(books, "sha")
    v = lambda role: F.coalesce(F.col("values")[role], F.lit(""))
    return joined.withColumns(
        {"names": split_names_udf("company", "separator"), "prizes": split_names_udf("award", F.lit("delimited")), "signal": signal_column(clean_udf(v("notes")), F.col("tender_markers")), "count_text": clean_udf(v("bidder_count")),
         **{f"clean_{r}": clean_udf(v(r)) for r in ("bidder_price", "bidder_legal_person", "rank", "award_status")}}
    )


def mentions(business: DataFrame) -> DataFrame:
    """A row for each name in a company cell; a row without a name where the row is context or unreadable."""
    none = F.array(F.struct(F.lit(1).alias("idx"), F.lit("").alias("raw"), F.lit("").alias("name"), F.lit("").alias("key"), F.get("names.names", F.lit(0))["changes"].alias("changes")))
    empty = F.col("context_record") | ((F.size("unavailable") > 0) & (F.size("names.names") == 0))
    tokens = F.when(empty, none.cast("array<struct<idx:int,raw:string,name:string,key:string,changes:array<struct<rule:string,before:string,after:string,basis:string>>>>")).otherwise(F.col("names.names"))
    out = business.withColumn("n_names", F.when(empty, 1).otherwise(F.size("names.names"))).withColumn("t", F.explode(tokens)).select("*", "t.*").drop("t")
    rid = hashed("record", F.concat(F.lit('["'), "sha", F.lit('",'), F.concat_ws(",", "sheet_idx", "table_idx", "row", "idx"), F.lit("]")))
    single = (F.col("company_role") == "bidder_name") & (F.col("n_names") == 1) & ~F.array_contains("merged", "bidder_name")
    return out.withColumns({"record_id": rid, "single": F.coalesce(single, F.lit(False)), "changes": F.coalesce("changes", F.expr("array()").cast("array<struct<rule:string,before:string,after:string,basis:string>>")), "valid": (F.col("name") == "") | F.col("name").rlike(r"\p{L}")})


def participants(named: DataFrame) -> DataFrame:
    """One record for each name in a group: the first mention gives id and spelling, all mentions are kept in order."""
    key = F.when(F.col("key") != "", F.col("key")).otherwise(F.col("record_id"))
    occurrence = F.struct(mention_order().alias("ord"), "row", "idx", "raw", "company_role", "single", "places", "values", "raws", "evidence", "clean_bidder_price", "clean_bidder_legal_person", "clean_rank", "clean_award_status", "changes")
    first = F.struct("record_id", "name", "key", "context_record", "project_id", "table_idx")
    out = named.groupBy("group_id", key.alias("dedup_key")).agg(F.min_by(first, mention_order()).alias("f"), F.min(mention_order()).alias("ord"), F.array_sort(F.collect_list(occurrence), in_order).alias("occurrences"))
    filled = lambda c: F.filter(F.transform("occurrences", lambda o: o[f"clean_{c}"]), lambda x: x != "")
    out = out.select("group_id", "f.*", "ord", "occurrences", *[F.array_distinct(filled(c)).alias(f"{c}s") for c in ("bidder_price", "bidder_legal_person", "rank", "award_status")])
    canon = F.transform("award_statuss", lambda s: status_column(s))
    known = F.array_distinct(F.filter(canon, lambda s: s.isNotNull()))
    out = out.withColumns({"canon": canon, "known": known})
    statuses, all_known = F.size("award_statuss"), ~F.exists("canon", lambda s: s.isNull())
    conflict = (F.size("known") > 1) | ((F.size("known") <= 1) & ~((F.size("known") == 1) & all_known) & (statuses > 1))
    explicit = F.when(conflict | (statuses == 0), "").when((F.size("known") == 1) & all_known, F.get("known", F.lit(0))).otherwise(F.get("award_statuss", F.lit(0)))
    fields = F.array_sort(F.array_compact(F.array(F.when(conflict, "award_status"), *[F.when(F.size(f"{c}s") > 1, c) for c in ("bidder_price", "bidder_legal_person", "rank")])))
    changes = F.flatten(F.transform("occurrences", lambda o: o["changes"]))
    return out.withColumns({"explicit_conflict": conflict, "explicit": explicit, "conflicts": fields, "rank": F.when(F.size("ranks") == 1, F.get("ranks", F.lit(0))).otherwise(""), "changes": changes}).drop("canon", "known")


def awards_of(business: DataFrame) -> DataFrame:
    """Award mentions, once for each name and cell of a group."""
    listed = business.withColumn("n_prizes", F.size("prizes.names")).withColumn("t", F.explode("prizes.names")).select("*", "t.*").drop("t")
    listed = listed.withColumn("cell", F.col("places")["award_name"])
    what = F.struct("raw", "name", "changes", F.coalesce(F.col("values")["award_legal_person"], F.lit("")).alias("legal_person"), F.coalesce(F.col("values")["award_price"], F.lit("")).alias("price"), "award_row", F.array_contains("merged", "award_name").alias("merged"), (F.col("n_prizes") == 1).alias("single_name"))
    out = listed.groupBy("group_id", "key", "cell").agg(F.min_by(what, mention_order()).alias("a"), F.min(mention_order()).alias("ord"))
    return out.select("group_id", "key", "cell", "ord", "a.*")


def _row_issues(business: DataFrame, named: DataFrame) -> list[DataFrame]:
    """Issues that single rows raise, in the order in which a row is read."""
    here = lambda step, sub=0: _at("book", "sheet_idx", "table_idx", "row", step, sub)
    cleared = business.withColumn("c", F.explode("cleared")).withColumns({"field": F.get_json_object("c", "$[0]"), "lost": F.get_json_object("c", "$[1]")})
    status = F.col("field") == "award_status"
    cell = lambda role: F.col("places")[role]
    field_scope = lambda: json_list(F.lit('"field"'), quoted(F.col("field")), quoted(F.col("places")[F.col("field")]))
    missing = business.select("*", F.posexplode("unavailable").alias("p", "field"))
    rank_list = (F.size("names.names") > 1) & (F.coalesce(F.col("values")["rank"], F.lit("")) != "")
    extra = lambda **k: F.to_json(F.struct(*[c.alias(n) for n, c in k.items()]))
    return [
        _issue(cleared, F.when(status, "AWARD_STATUS_SCOPE_AMBIGUOUS").otherwise("RANK_SCOPE_AMBIGUOUS"), F.when(status, "跨行合并的中标状态不能分配给多家企业").otherwise("跨行合并的排名不能分配给多家企业"), here(1, F.when(status, 0).otherwise(1)), scope=field_scope(), field=F.col("field"), source_row=F.col("row"), source_cell=F.col("places")[F.col("field")], extra=extra(raw_value=F.col("lost"))),
        _issue(missing, "FIELD_UNAVAILABLE", F.concat("field", F.lit(" 的来源为未计算公式或错误值，该字段留空")), here(2, F.col("p")), scope=field_scope(), field=F.col("field"), source_row=F.col("row"), source_cell=F.col("places")[F.col("field")], extra=extra(raw_value=F.col("raws")[F.col("field")])),
        _issue(business.where(r"count_text <> '' and not count_text rlike '^[0-9]+(\\.0+)?$'"), "INVALID_BIDDER_COUNT", "投标数量不是可确认的整数", here(3), source_row=F.col("row"), extra=extra(raw_value=F.col("count_text"))),
        _issue(business.where("prizes.problem <> ''"), "AWARD_LIST_AMBIGUOUS", F.col("prizes.problem"), here(4), source_row=F.col("row"), extra=extra(raw_award=F.col("award"))),
        _issue(business.where("names.problem <> ''"), "BIDDER_LIST_AMBIGUOUS", F.col("names.problem"), here(5), standalone=True, source_row=F.col("row"), extra=extra(raw_company=F.col("company"))),
        _issue(named.where("not valid"), "INVALID_COMPANY_NAME", "企业字段只有数字或符号，不能形成企业名称", here(6, F.col("idx")), standalone=True, source_row=F.col("row"), extra=extra(raw_company=F.col("raw"))),
        _issue(business.where(rank_list), "RANK_SCOPE_AMBIGUOUS", "同一名单包含多家企业，单个排名无法分配；排名留空", here(7), source_row=F.col("row")),
    ]


def finish(rows: DataFrame, tables: DataFrame, sources: DataFrame, sheets: DataFrame, resolutions: dict[str, dict] | None = None) -> Finished:
    """Groups with their participants, awards, matches and issues."""
    business = stored(business_rows(rows, tables, sources))
    named = mentions(business)
    records = stored(participants(named.where("valid")))
    awards = stored(awards_of(business))
    row_issues = _row_issues(business, named)

    whole = lambda c: F.col(c).rlike(r"^[0-9]+(\.0+)?$")
    place = F.struct("book", "sheet_idx", "table_idx", "row")
    head = F.struct("source_id", "file_name", "sha", "sheet_idx", "table_idx", "project_id", "anchor_row", "lot_name", "lot_code", "scope_type", "company_role", "award_mode", "group_mode", "project_mode", "status", "basis_type", "basis", "context", "context_places", "price_units")
    groups = business.groupBy("group_id").agg(
        F.min_by(head, place).alias("h"), F.min(place).alias("place"), F.collect_set("signal").alias("signals"), F.sort_array(F.collect_list("row")).alias("source_rows"),
        F.sort_array(F.collect_set(F.when(whole("count_text"), F.col("count_text").cast("double").cast("long")))).alias("counts"),
    ).select("group_id", "h.*", "place", "signals", "source_rows", "counts")
    groups = groups.join(sheets.select("sha", "sheet_idx", F.col("name").alias("sheet")), ["sha", "sheet_idx"])
    sizes = records.groupBy("group_id").agg(F.count("*").alias("n_records"), F.count_if((F.col("name") != "") & ~F.col("context_record")).alias("actual"))
    prizes = awards.groupBy("group_id").agg(F.count("*").alias("n_awards"), F.array_sort(F.collect_list(F.struct("ord", "cell", "raw", "name", "price", "legal_person", "award_row", "merged", "single_name"))).alias("awards"))
    groups = groups.join(sizes, "group_id", "left").join(prizes, "group_id", "left").fillna(0, ["n_records", "actual", "n_awards"])
    signal = F.when(F.array_contains("signals", "uncertain") | (F.size("signals") > 1), "uncertain").otherwise(F.get("signals", F.lit(0)))
    groups = stored(groups.withColumn("procurement", F.when(signal.isin("uncertain", "non_tender"), signal).when(F.col("scope_type").isin("roster", "context"), F.col("scope_type")).otherwise("bidding")))

    matches = stored(match_awards(groups, records, awards, resolutions or {}))
    spot = lambda step, sub=0: _at("place.book", "place.sheet_idx", "place.table_idx", "place.row", step, sub)
    after = records.join(groups.select("group_id", "place"), "group_id")
    sub = lambda: F.col("ord.row").cast("long") * 100_000 + F.col("ord.idx")
    extra = lambda **k: F.to_json(F.struct(*[c.alias(n) for n, c in k.items()]))
    record_scope = F.when(F.col("name") != "", json_list(F.lit('"record"'), quoted(F.col("name")), F.to_json("conflicts"))).otherwise('["group"]')
    open_matches = matches.where("status <> 'matched'").join(groups.select("group_id", "place"), "group_id")
    clash = open_matches["status"] == "conflict"
    listed = F.col("counts")
    wrong = (F.size(listed) > 1) | ((F.size(listed) == 1) & (F.get(listed, F.lit(0)) != F.col("actual")))
    group_issues = [
        _issue(after.where("size(conflicts) > 0"), "DUPLICATE_CONFLICT", "同组重复记录存在不一致字段；一致非空值已合并，冲突字段留空复核", spot(1, sub()), phase=1, scope=record_scope, extra=extra(record_name=F.col("name"), conflicting_fields=F.col("conflicts"))),
        _issue(groups.where(wrong), "BIDDER_COUNT_MISMATCH", "声明投标数量与整理后的企业数量不一致", spot(2), phase=1, extra=extra(declared_counts=listed, actual_count=F.col("actual"))),
        _issue(open_matches, F.when(clash, "AWARD_MATCH_CONFLICT").otherwise("AWARD_NAME_MISMATCH"), F.when(clash, "中标对应证据冲突，保留复核").otherwise("中标名称需要用户确认对应的投标企业"), spot(3, sub()), phase=1, scope=json_list(F.lit('"award"'), quoted(F.col("award_cell")), quoted(F.col("original_award"))), extra=extra(original_award=F.col("original_award"), award_cell=F.col("award_cell"), review_task_id=F.col("review_task_id"), recommended_record_id=F.col("recommended_record_id"))),
    ]
    alone = row_issues[4].union(row_issues[5]).select("group_id").distinct()
    group_issues.append(_issue(groups.where("n_records = 0").join(alone, "group_id", "left_anti"), "BIDDER_MISSING", "存在结果信息，但缺少企业名单", spot(4), phase=1, standalone=True))

    hurt = row_issues[3].select("group_id").union(row_issues[1].where("field = 'award_name'").select("group_id")).union(open_matches.select("group_id")).distinct().withColumn("incomplete", F.lit(True))
    won = matches.where("status = 'matched'").groupBy("group_id").agg(F.count("*").alias("n_matched"))
    reasons = F.array_compact(F.array(F.when(F.col("status") != "complete", "区域未声明完整最终中标结果"), F.when(F.col("n_awards") == 0, "本组没有中标结果"), F.when(F.col("incomplete"), "本组存在未解决的中标读取或对应问题")))
    groups = groups.join(hurt, "group_id", "left").join(won, "group_id", "left").fillna(0, ["n_matched"]).withColumn("reasons", reasons).withColumn("verified", F.size("reasons") == 0)

    chosen = matches.where("status = 'matched'").select(F.col("selected_record_id").alias("record_id"), F.col("basis").alias("match_basis"), F.col("original_award").alias("match_award"))
    state = records.join(chosen, "record_id", "left").join(groups.select("group_id", "verified", "n_matched", "place"), "group_id")
    derived = F.when(F.col("name") == "", "").when(F.col("match_basis").isNotNull(), V.YES).when((F.col("n_matched") > 0) & F.col("verified"), V.NO).otherwise("")
    state = state.withColumns({"derived": derived, "stated": status_column(F.col("explicit"))})
    clash_status = F.col("stated").isNotNull() & (F.col("derived") != "") & (F.col("derived") != F.col("stated"))
    settled = F.when(F.col("explicit_conflict") | clash_status, "").otherwise(F.coalesce("stated", "derived"))
    state = stored(state.withColumns({"award_status": settled, "status_clash": clash_status}))
    unknown = (F.col("explicit") != "") & F.col("stated").isNull() & ~F.col("explicit").isin(V.OPEN_STATUS)
    group_issues += [
        _issue(state.where(unknown), "AWARD_STATUS_UNRECOGNIZED", "原表中标状态无法对应是/否，留空并保留原值", spot(5, sub() * 2), phase=1, source_row=F.get("occurrences", F.lit(0))["row"], extra=extra(raw_value=F.col("explicit"))),
        _issue(state.where("status_clash"), "AWARD_STATUS_CONFLICT", "原表是否中标与中标名单冲突，留空供复核", spot(5, sub() * 2 + 1), phase=1),
    ]
    issues = row_issues[0]
    for more in [*row_issues[1:], *group_issues]:
        issues = issues.unionByName(more)
    return Finished(business, stored(groups), state.drop("place", "verified", "n_matched"), awards, matches, stored(identified(issues)))


def identified(issues: DataFrame) -> DataFrame:
    """Issues with ids; of equal ids the first one's place and the last one's content stay."""
    iid = hashed("issue", json_list(quoted(F.col("group_id")), quoted(F.col("code")), F.col("scope")))
    order = F.concat("phase", F.lit("/"), "ord")
    with_id = issues.withColumns({"issue_id": iid, "order": order})
    rest = F.struct("group_id", "code", "message", "standalone", "field", "source_row", "source_cell", "extra")
    return with_id.groupBy("issue_id").agg(F.min("order").alias("order"), F.max_by(rest, "order").alias("i")).select("issue_id", "order", "i.*")
