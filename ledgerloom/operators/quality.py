"""Rules that every result must keep, as anti-joins and aggregates: each must find nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.functions.errors import LedgerError
from ledgerloom.functions.text import name_key_udf
from ledgerloom.operators.emit import Results


def _dense(df: DataFrame, column: str) -> DataFrame:
    """A row if the column is not exactly 1..n."""
    a = df.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.count_distinct(column).alias("d"))
    return a.where("n > 0 and not (low = 1 and high = n and d = n)")


def _twice(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().where("count > 1")


def resolution_rules(r: Results, resolutions: list[dict]) -> dict[str, DataFrame]:
    """What breaks the rules on user decisions (review_task_id, decision, record_id, company_name): each has its task, a
    chosen company is applied as it was chosen, a task that was put off is not matched."""
    said = [tuple(d.get(k) for k in ("review_task_id", "decision", "record_id", "company_name")) for d in resolutions]
    given = r.matches.sparkSession.createDataFrame(said, "review_task_id string, decision string, record_id string, company_name string")
    tasks = r.matches.select("review_task_id", "status", "basis", F.col("selected_record_id").alias("record_id"), F.col("selected_bidder_name").alias("company_name"))
    applied = tasks.where("status = 'matched' and basis = 'user_selection'")
    return {
        "人工决定缺少对应任务": given.join(tasks, "review_task_id", "left_anti"),
        "一个任务有多个人工决定": _twice(given, "review_task_id"),
        "人工选择未应用": given.where("decision = 'select_bidder'").join(applied, ["review_task_id", "record_id", "company_name"], "left_anti"),
        "不确定的任务被匹配": given.where("decision = 'deferred'").join(tasks.where("status = 'matched'"), "review_task_id", "left_semi"),
        "未经决定的人工匹配": applied.join(given.where("decision = 'select_bidder'"), "review_task_id", "left_anti"),
    }


def rules(r: Results, resolutions: list[dict] | None = None) -> dict[str, DataFrame]:
    """What breaks each rule."""
    rec, groups = r.records, r.groups
    known = r.issues.select(F.col("issue_id").alias("i"))
    linked = rec.select("record_id", F.explode("group_issues").alias("g")).select("record_id", F.col("g.issue_id").alias("i"))
    same = ["group_id", "project_id", "source_id"]
    pairs = r.matches.select("group_id", F.explode("candidates").alias("c")).select("group_id", F.col("c.record_id").alias("record_id"))
    chosen = r.matches.where("selected_record_id is not null").select("group_id", F.col("selected_record_id").alias("record_id"))
    members = rec.select("group_id", "record_id")
    review_links = rec.where("review_sequence is not null").select(F.col("review_sequence").alias("seq")).union(r.issues.where("standalone").select(F.explode("review_sequences").alias("seq")))
    spelled = rec.select("name", F.explode("occurrences").alias("o")).where("name <> '' and o.raw <> ''").select("name", name_key_udf("name").alias("a"), name_key_udf(F.col("o.raw")).alias("b"))
    asked = r.issues.select(F.explode("review_sequences").alias("seq")).distinct()
    return (resolution_rules(r, resolutions) if resolutions is not None else {}) | {
        "final 序号不连续": _dense(r.final, "seq"),
        "review 序号不连续": _dense(r.review, "seq"),
        "记录 ID 重复": _twice(rec, "record_id"),
        "分组 ID 重复": _twice(groups, "group_id"),
        "项目 ID 重复": _twice(r.projects, "project_id"),
        "问题 ID 重复": _twice(r.issues, "issue_id"),
        "记录的分组不存在": rec.join(groups, "group_id", "left_anti"),
        "记录的项目不存在": rec.where("project_id is not null").join(r.projects, "project_id", "left_anti"),
        "跨项目或跨文件串组": rec.select(*same).join(groups.select("group_id", F.col("project_id").alias("p"), F.col("source_id").alias("s")), "group_id").where("not (project_id <=> p and source_id <=> s)"),
        "记录缺少原始来源": rec.where(F.size("occurrences") == 0),
        "记录关联未知问题": linked.join(known, "i", "left_anti"),
        "复核状态与问题集合不一致": rec.where(F.col("pending") != F.col("review_sequence").isNotNull()),
        "结果枚举无效": r.final.where(~F.col("中标与否").isin("", V.YES, V.NO) | ~F.col("复核状态").isin(V.PASSED, V.PENDING)),
        "置信度无效": r.final.where(~F.coalesce(F.expr("try_cast(`置信度` as double)").between(0, 1), F.lit(False))),
        "复核项未全部待复核": r.review.where(F.col("复核状态") != V.PENDING),
        "存在没有审计关联的复核记录": r.review.select("seq").join(review_links.distinct(), "seq", "left_anti"),
        "复核记录没有对应的问题": r.review.select("seq").join(asked, "seq", "left_anti"),
        "问题指向不存在的复核记录": asked.join(r.review, "seq", "left_anti"),
        "问题指向不属于它的记录": r.issues.select(F.col("issue_id").alias("i"), F.explode("final_sequences").alias("final_sequence")).join(rec.select("final_sequence", F.explode("group_issues").alias("g")).select("final_sequence", F.col("g.issue_id").alias("i")), ["i", "final_sequence"], "left_anti"),
        "候选不在本组": pairs.join(members, ["group_id", "record_id"], "left_anti"),
        "选定企业不在本组": chosen.join(members, ["group_id", "record_id"], "left_anti"),
        "一家企业对应多条中标": chosen.groupBy("record_id").count().where("count > 1"),
        "企业名称与原文不一致": spelled.where("a <> b and not (b = concat(a, '投标'))"),
        "unique_companies 不等于规范去重名单": _twice(r.companies, "key"),
    }


def broken(r: Results, resolutions: list[dict] | None = None) -> DataFrame:
    """(rule, n) for all rules."""
    out = None
    for name, found in rules(r, resolutions).items():
        one = found.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


def check(r: Results, resolutions: list[dict] | None = None) -> None:
    bad = broken(r, resolutions).where("n > 0").first()
    if bad:
        raise LedgerError(f"{bad['rule']}: {bad['n']}")
