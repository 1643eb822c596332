"""The engine over one batch of small workbooks, each a scenario of its own."""

import json

import pytest

from helpers import TIME, COMPLETE, fixture, source_of
from ledgerloom.functions.errors import LedgerError, PlanRevision
from ledgerloom.operators import quality
from ledgerloom.plans import mapping, publish, review
from ledgerloom.plans.engine import build
from ledgerloom.operators.collect import assign, refuse_revisions
from ledgerloom.sources.cells import book_of, sheet_of, workbooks

BIDS = ["项目名称", "投标单位名称", "投标单位数量", "中标单位"]
ANCHOR = {"group_mode": "anchor", "group_start_field": "bidder_count"}
REPEATED = {"project_mode": "repeated"}

SCENARIOS = {
    "winners": fixture("winners", [BIDS, ["项目甲", "甲公司", 3], [None, "乙公司", None, "乙公司"], [None, "丙公司", None, "丙公司"]], ["A2:A4"], **ANCHOR),
    "summary": fixture(
        "summary",
        [[*BIDS, "备注"], ["项目甲", "项目汇总", 5, "甲公司、乙公司、丙公司"], [None, "甲公司", 2, "甲公司"], [None, "丙公司"], [None, "乙公司", 2, "乙公司"], [None, "丁公司"], [None, "丙公司", 1, "丙公司", "未招投标"]],
        ["A2:A7"],
        **ANCHOR,
    ),
    "formula": fixture("formula", [["投标单位名称", "中标单位"], ["甲公司", "=A2"], ["乙公司", None]], project_mode="none", group_mode="source"),
    "merged_award": fixture("merged_award", [BIDS, ["项目甲", "甲公司", 3, "丙公司"], [None, "乙公司"], [None, "丙公司"]], ["A2:A4", "D2:D4"], **ANCHOR),
    "lists": fixture("lists", [["项目名称", "标段", "投标企业名单", "中标单位"], ["甲项目", "一标", "甲公司、甲公司、乙公司", "甲公司"], ["甲项目", "二标", "甲公司、乙公司", "乙公司"]], group_mode="row", bidder_separator="delimited", **REPEATED),
    "prices": fixture("prices", [["项目名称", "投标单位名称", "中标单位", "投标报价(万元)"], ["甲项目", "甲公司", "甲公司", 1], ["甲项目", "甲公司", "甲公司", 2]], **REPEATED),
    "same_name": fixture("same_name", [BIDS, ["同名项目", "甲公司", 2, "甲公司"], [None, "乙公司"], ["同名项目", "甲公司", 2, "甲公司"], [None, "丙公司"]], ["A2:A3", "A4:A5"], **ANCHOR),
    "blocks": fixture("blocks", [BIDS, ["甲项目", "甲公司", 2, "甲公司"], [None, "乙公司"]], project_mode="blocks", **ANCHOR),
    "roster": fixture("roster", [["序号", "公司名称"], [1, "甲 公司"], [2, "甲公司"], [3, "乙公司"]], project_mode="none", group_mode="source"),
    "award_only": fixture("award_only", [["项目名称", "中标单位"], ["甲项目", "甲公司"], ["乙项目", "乙公司"]], **REPEATED),
    "context": fixture("context", [["项目名称", "项目编号"], ["甲项目", "1"], ["乙项目", "2"]], **REPEATED),
    "status": fixture("status", [["项目名称", "投标单位名称", "中标与否"], ["甲项目", "甲公司", "中标"], ["甲项目", "乙公司", "未中标"]], **REPEATED),
    "merged_status": fixture("merged_status", [["项目名称", "投标单位名称", "中标与否"], ["甲项目", "甲公司", "是"], ["甲项目", "乙公司", None]], ["C2:C3"], **REPEATED),
    "padded": fixture("padded", [["项目名称", "项目编号", "投标单位名称", "中标单位"], ["甲项目", 42, "甲公司", "甲公司"]], formats={"B2": "00000"}, **REPEATED),
    "consortium": fixture("consortium", [["项目名称", "标段", "投标企业名单"], ["甲项目", "一标", "甲公司、乙公司"], ["甲项目", "二标", "丙公司联合体"]], group_mode="row", bidder_separator="delimited", **REPEATED),
    "count": fixture("count", [BIDS, ["甲项目", "甲公司", 3, "甲公司"], [None, "乙公司"]], project_mode="blocks", **ANCHOR),
    "near_name": fixture("near_name", [["项目名称", "投标单位名称", "中标单位"], ["甲项目", "甲建设有限公司", None], ["甲项目", "乙水利有限公司", "甲建设工程有限公司"]], **REPEATED),
    "unknown": fixture("unknown", [["项目名称", "投标单位名称", "中标单位"], ["甲项目", "甲公司", "甲公司"], ["甲项目", "乙公司", None]], award_completeness=COMPLETE | {"status": "unknown", "basis_type": "none"}, **REPEATED),
    "risky": fixture("risky", [["项目名称", "投标单位名称"], ["=甲".replace("=", "-"), "甲公司"]], **REPEATED),
    "digits": fixture("digits", [["项目名称", "投标单位名称", "中标单位"], ["甲项目", "123", None]], **REPEATED),
}


@pytest.fixture(scope="module")
def batch(spark):
    books = [b for b, _ in SCENARIOS.values()]
    plan = {"schema_version": 1, "sources": [s for _, s in SCENARIOS.values()]}
    tables = workbooks(spark, books)
    return tables, plan, build(tables, plan, TIME)


@pytest.fixture(scope="module")
def final(batch):
    out: dict = {}
    for r in batch[2].final.orderBy("seq").collect():
        out.setdefault(r["依据文件路径"].removesuffix(".xlsx"), []).append(r)
    return out


@pytest.fixture(scope="module")
def reviews(batch):
    out: dict = {}
    for r in batch[2].review.orderBy("seq").collect():
        out.setdefault(r["依据文件路径"].removesuffix(".xlsx"), []).append(r)
    return out


def column(rows, name):
    return [r[name] for r in rows]


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("winners", ["否", "是", "是"]),
        ("summary", ["是", "否", "是", "否", "是"]),
        ("formula", ["", ""]),
        ("merged_award", ["否", "否", "是"]),
        ("lists", ["是", "否", "否", "是"]),
        ("same_name", ["是", "否", "是", "否"]),
        ("award_only", ["是", "是"]),
        ("status", ["是", "否"]),
        ("merged_status", ["", ""]),
        ("unknown", ["是", ""]),
        ("near_name", ["", ""]),
    ],
)
def test_award_status(final, name, expected):
    assert column(final[name], "中标与否") == expected


def test_review(reviews, final):
    assert not {"winners", "summary", "merged_award", "lists", "same_name", "status", "padded", "unknown"} & set(reviews)
    assert len(reviews["prices"]) == 1 and "不一致字段" in reviews["prices"][0]["证据文本"]
    assert len(reviews["consortium"]) == 1 and reviews["consortium"][0]["置信度"] == "0"
    assert len(reviews["count"]) == 2
    assert all(r["复核状态"] == "待复核" for r in final["formula"])
    assert len(reviews["digits"]) == 1 and "digits" not in final


def test_names_projects_and_evidence(final, batch):
    assert column(final["roster"], "公司名称") == ["甲 公司", "乙公司"]
    assert column(final["blocks"], "项目名称") == ["甲项目", "甲项目"]
    assert "项目来源=A2" in final["blocks"][1]["证据文本"]
    assert final["padded"][0]["项目编号"] == "00042"
    assert column(final["context"], "公司名称") == ["", ""]
    assert final["lists"][0]["置信度"] == "1" and final["lists"][1]["置信度"] == "0.9"
    assert len(final["prices"]) == 1 and final["prices"][0]["置信度"] == "0.6"
    assert {tuple(g.price_units.items()) for g in batch[2].groups.where("price_units is not null").select("price_units").collect()} == {(("bidder_price", "万元"),)}
    groups = {(g.file_name, g.group_id) for g in batch[2].groups.select("file_name", "group_id").collect()}
    assert sum(f == "summary.xlsx" for f, _ in groups) == 3
    codes = {r.code for r in batch[2].issues.select("code").collect()}
    assert {"FIELD_UNAVAILABLE", "DUPLICATE_CONFLICT", "AWARD_STATUS_SCOPE_AMBIGUOUS", "BIDDER_LIST_AMBIGUOUS", "BIDDER_COUNT_MISMATCH", "AWARD_NAME_MISMATCH", "INVALID_COMPANY_NAME"} <= codes


def test_sequences_and_rules(batch):
    r = batch[2]
    n = r.final.count()
    assert sorted(x.seq for x in r.final.select("seq").collect()) == list(range(1, n + 1))
    assert {x.rule: x.n for x in quality.broken(r).collect() if x.n} == {}
    summary = r.summary.first()
    assert summary.record_count == n and summary.duplicate_mentions_removed == 3 and summary.roster_group_count == 2


def test_questions_and_decisions(batch):
    tables, plan, r = batch
    tasks = review.award_tasks(r)
    asked, total, left = review.questions(tasks, {})
    assert total == left >= 1
    task = next(t for t in tasks.collect() if t.original_award == "甲建设工程有限公司")
    assert task.recommended_bidder_name == "甲建设有限公司" and task.recommendation_basis == "name_similarity"
    decisions, errors = review.apply_answers(r, {}, {task.review_task_id: "查无此企业", "award_review_x": "a"})
    assert not decisions and len(errors) == 2
    decisions, errors = review.apply_answers(r, {}, {task.review_task_id: {"value": task.recommended_record_id}})
    assert not errors and decisions[task.review_task_id]["source"] == "recommended"
    assert review.apply_answers(r, {}, {task.review_task_id: "不确定"})[0][task.review_task_id]["decision"] == "deferred"
    only = {"schema_version": 1, "sources": [s for k, (_, s) in SCENARIOS.items() if k == "near_name"]}
    again = build(workbooks(batch[0].cells.sparkSession, [SCENARIOS["near_name"][0]]), only, TIME, resolutions=decisions)
    assert column(again.final.orderBy("seq").collect(), "中标与否") == ["是", "否"]
    assert again.review.count() == 0


def test_publish(batch, tmp_path):
    tables, plan, r = batch
    rows, _, _ = assign(tables, plan)
    ledger = publish.ledger_of(r, rows, tables, plan, TIME, [], {})
    result = publish.publish(tmp_path / "out", r, ledger)
    assert result["validated"] and result["summary"]["record_count"] == r.final.count()
    raw = (tmp_path / "out/final.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\r\n") >= 2 and "'-甲".encode() in raw
    with pytest.raises(LedgerError):
        publish.publish(tmp_path / "out", r, ledger)
    text = (tmp_path / "out/ledger.json").read_text("utf-8")

    def summary(d):
        d["summary"]["record_count"] += 1

    def name(d):
        d["records"][0]["occurrences"][0]["raw_company"] = "别家公司"

    def match(d):
        m = next(m for g in d["groups"] for m in g["award_matches"] if m["status"] == "matched")
        m["selected_bidder_name"] = "别家公司"

    def group(d):
        d["records"][0]["group_id"] = d["groups"][-1]["id"]

    def issue(d):
        d["issues"].pop()

    def decision(d):
        d["resolutions"].append({"review_task_id": "x", "decision": "deferred"})

    def pairs(d):
        d.update(name_pairs=[{"id": "p", "name_a": "甲", "name_b": "乙"}], name_decisions={})

    for change, error in ((summary, "summary"), (name, "清洗结果"), (match, "名称不一致"), (group, "."), (issue, "."), (decision, "缺少对应任务"), (pairs, "名称对")):
        broken = json.loads(text)
        change(broken)
        (tmp_path / "out/ledger.json").write_text(json.dumps(broken, ensure_ascii=False), "utf-8")
        with pytest.raises(LedgerError, match=error):
            publish.validate_outputs(tmp_path / "out")


def test_revisions(spark):
    book, source = fixture("header", [["项目名称", "投标单位名称"], ["甲", "甲公司"], ["项目名称", "投标单位名称"]], project_mode="repeated")
    books = workbooks(spark, [book])
    rows, _, _ = assign(books, {"sources": [source]})
    with pytest.raises(PlanRevision, match="台账 第 3 行疑似重复/新表头") as e:
        refuse_revisions(rows, books)
    assert e.value.evidence == {"source": "header.xlsx", "sheet": "台账", "row": 3, "row_values": {"A3": "项目名称", "B3": "投标单位名称"}}
    book, source = fixture("counts", [BIDS, ["甲", "甲公司", 2], ["甲", "乙公司", 2]], **ANCHOR)
    with pytest.raises(PlanRevision, match="每行重复"):
        assign(workbooks(spark, [book]), {"sources": [source]})


def test_inspect_and_validate(spark):
    rows = [[*BIDS], ["项目甲", "甲公司", 2, "甲公司"], [None, "乙公司"]]
    book = book_of([sheet_of("台账", rows, ["A2:A3"]), sheet_of("空", [])])
    tables = workbooks(spark, [book])
    plan = mapping.inspect(tables)["suggested_plan"]
    first, second = plan["sources"][0]["sheets"]
    assert first["action"] == "parse" and second["action"] == "skip"
    table = first["tables"][0]
    assert (table["project_mode"], table["group_mode"], table["group_start_field"]) == ("merged", "anchor", "bidder_count")
    mapping.validate(plan, tables)
    for change, error in (({"group_mode": "x"}, "group_mode"), ({"bogus": 1}, "映射字段"), ({"data_end_row": 2}, "未解释"), ({"columns": {"bidder_name": "B"}}, "未说明去向"), ({"structure_warnings": [{"code": "x"}]}, "结构变化"), ({"award_mode": "row_presence"}, "已停用")):
        broken = json.loads(json.dumps(plan))
        broken["sources"][0]["sheets"][0]["tables"][0].update(change)
        with pytest.raises(LedgerError, match=error):
            mapping.validate(broken, tables)
    assert source_of(book, rows)["sha256"] == book.sha


def test_aliases_are_refused():
    mapping.refuse_aliases({"schema_version": 1, "aliases": []})
    for bad in ({"schema_version": 2, "aliases": []}, {"schema_version": 1, "aliases": [{"from": "甲", "to": "乙"}]}, {"schema_version": 1, "aliases": [{"from": "甲", "to": "乙", "basis": "x"}]}, {"schema_version": 1, "aliases": [{"from": "甲", "to": " 甲", "basis": "x"}]}):
        with pytest.raises(LedgerError):
            mapping.refuse_aliases(bad)


def test_suggests_review_for_mixed_layouts(spark):
    rows = [["项目名称", "投标单位名称", "中标单位"], *[["项目甲", "甲公司", "甲公司"]] * 13, ["项目甲", "甲公司、乙公司", "甲公司"]]
    found = mapping.inspect(workbooks(spark, [book_of([sheet_of("台账", rows)])]))
    sheet = found["suggested_plan"]["sources"][0]["sheets"][0]
    assert sheet["action"] == "needs_mapping" and sheet["tables"][0]["structure_warnings"][0]["code"] == "MIXED_BIDDER_LAYOUT"
