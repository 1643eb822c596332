"""What a plan must keep, as declared rules: one loop applies them, the first that does not hold is raised.

Each level of a plan (whole, source, sheet, table, disposition, region) has its list; a rule may rely on those before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from ledgerloom.functions import values as V
from ledgerloom.functions.errors import LedgerError, PlanRevision
from ledgerloom.functions.text import label_number, name_key, number_label

# The keys of a plan, by level (required, optional), and the choices of its fields.
KEYS = {
    "plan": ({"schema_version", "sources"}, set()),
    "source": ({"file_name", "sha256", "sheets"}, set()),
    "sheet": ({"name", "action"}, {"reason", "tables", "ignored_rows", "review_regions"}),
    "table": (
        {"header_rows", "data_start_row", "data_end_row", "columns", "project_mode", "group_mode", "bidder_separator", "summary_markers", "non_tender_markers"},
        {"group_start_field", "award_list_complete", "award_completeness", "award_mode", "column_dispositions", "structure_warnings"},
    ),
    "columns": (set(), set(V.ROLES)),
    "disposition": ({"column", "disposition", "reason"}, {"header", "mode"}),
    "region": ({"start", "end", "reason"}, set()),
    "completeness": ({"status", "basis_type", "basis"}, set()),
    "alias": ({"from", "to", "basis"}, set()),
}
CHOICES = {
    "project_mode": ["merged", "blocks", "repeated", "none"],
    "group_mode": ["anchor", "row", "project", "lot", "source"],
    "bidder_separator": ["single", "delimited", "lines"],
    "award_mode": ["auto", "name_match", "row_aligned"],
    "status": ["complete", "partial", "unknown"],
    "basis_type": ["explicit", "structural", "none"],
    "disposition": ["context", "evidence", "group_context", "ignore", "unrecognized"],
}


class Rule(NamedTuple):
    """says: the message, or what makes it; evidence: a rule that asks for another plan gives it."""

    says: str | Callable
    holds: Callable[[Any], object]
    evidence: Callable[[Any], dict] | None = None


def keep(rules: Iterable[Rule], case: Any) -> None:
    for rule in rules:
        if not rule.holds(case):
            told = rule.says if isinstance(rule.says, str) else rule.says(case)
            raise PlanRevision(told, rule.evidence(case)) if rule.evidence else LedgerError(told)


def shape(level: str, of: Callable[[Any], Any]) -> Rule:
    """The part must be an object with the keys of its level."""
    required, optional = KEYS[level]
    return Rule(f"映射字段不符（{level}）：必需 {sorted(required)}，可选 {sorted(optional)}", lambda c: isinstance(of(c), dict) and required <= set(of(c)) <= required | optional)


def words(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def chosen(name: str, of: Callable[[Any], Any], says: str | None = None) -> Rule:
    return Rule(says or f"{name} 无效，可选: {'/'.join(CHOICES[name])}", lambda c: of(c) in CHOICES[name])


# ---------------------------------------------------------------- cases


@dataclass
class TableCase:
    """A table of a plan with what its sheet shows: titles by label, labels with content, rows that other tables took."""

    table: dict
    sheet: Any
    where: dict
    titles: dict = field(default_factory=dict)
    effective: set = field(default_factory=set)
    taken: set = field(default_factory=set)
    taken_data: set = field(default_factory=set)

    def line(self, value: Any) -> bool:
        return type(value) is int and 1 <= value <= self.sheet.max_row

    @property
    def headers(self) -> set[int]:
        return set(self.table["header_rows"])

    @property
    def data(self) -> set[int]:
        return set(range(self.table["data_start_row"], self.table["data_end_row"] + 1))

    @property
    def columns(self) -> dict:
        return self.table["columns"]

    @property
    def dispositions(self) -> list:
        return self.table.get("column_dispositions", [])

    @property
    def place(self) -> dict:
        return self.where | {"rows": [min(self.data), max(self.data)]}

    def unsaid(self) -> set:
        """Columns with content that the plan says nothing about."""
        return self.effective - set(self.columns.values()) - {d["column"] for d in self.dispositions}

    def unknown(self) -> list:
        return [d for d in self.dispositions if d["disposition"] == "unrecognized"]


@dataclass
class PartCase:
    """A part of a table or sheet, with the case that it belongs to and the parts before it."""

    part: Any
    owner: Any
    earlier: list


# ---------------------------------------------------------------- rules

PLAN = [
    shape("plan", lambda c: c["plan"]),
    Rule("映射版本必须为 1", lambda c: type(c["plan"]["schema_version"]) is int and c["plan"]["schema_version"] == 1),
    Rule("每个输入文件都要在映射中出现一次", lambda c: isinstance(c["plan"]["sources"], list) and len(c["plan"]["sources"]) == len(c["books"])),
    Rule("输入中有内容相同的文件", lambda c: len({b.sha for b in c["books"]}) == len(c["books"])),
]
SOURCE = [
    shape("source", lambda c: c["source"]),
    Rule("文件名或哈希与输入不符，请重新 inspect", lambda c: (c["source"]["file_name"], c["source"]["sha256"]) == (c["book"].file_name, c["book"].sha)),
    Rule("每个 Sheet 都要按顺序出现在映射中", lambda c: isinstance(c["source"]["sheets"], list) and len(c["source"]["sheets"]) == len(c["book"].sheets)),
]
SHEET = [
    shape("sheet", lambda c: c["spec"]),
    Rule("Sheet 的名称或顺序与文件不符", lambda c: c["spec"]["name"] == c["sheet"].name),
    Rule(lambda c: f"{c['sheet'].name} 尚需结构审阅", lambda c: c["spec"]["action"] != "needs_mapping", lambda c: c["where"] | {"suggested_tables": c["spec"].get("tables", [])}),
    Rule("不解析的 Sheet 要写明原因", lambda c: c["spec"]["action"] not in ("skip", "review") or words(c["spec"].get("reason"))),
    Rule("不解析的 Sheet 不能带表格或区域", lambda c: c["spec"]["action"] not in ("skip", "review") or not any(c["spec"].get(k) for k in ("tables", "ignored_rows", "review_regions"))),
    Rule("要解析的 Sheet 缺少表格映射", lambda c: c["spec"]["action"] in ("skip", "review") or c["spec"]["action"] == "parse" and isinstance(c["spec"].get("tables"), list) and c["spec"]["tables"]),
]
EXTENT = [
    shape("table", lambda c: c.table),
    Rule("数据行号不在 Sheet 内", lambda c: c.line(c.table["data_start_row"]) and c.line(c.table["data_end_row"])),
    Rule("header_rows 要列出互不相同的行号", lambda c: isinstance(c.table["header_rows"], list) and c.table["header_rows"] and len(set(map(str, c.table["header_rows"]))) == len(c.table["header_rows"])),
    Rule("表头行号不在 Sheet 内", lambda c: all(map(c.line, c.table["header_rows"]))),
    Rule("表头必须在数据之前，数据行必须从小到大", lambda c: max(c.headers) < c.table["data_start_row"] <= c.table["data_end_row"]),
    Rule("表格之间的行重叠", lambda c: not c.taken & c.data and not c.taken_data & c.headers),
]
COLUMNS = [
    shape("columns", lambda c: c.columns),
    Rule("没有任何业务字段", lambda c: set(c.columns) & set(V.BUSINESS_ROLES)),
    Rule("列标必须是文本", lambda c: all(isinstance(x, str) for x in c.columns.values())),
    Rule("两个角色指向同一列", lambda c: len(set(c.columns.values())) == len(c.columns)),
    Rule(lambda c: f"映射的列不存在或没有表头: {[r for r, x in c.columns.items() if not c.titles.get(label_number(x))]}", lambda c: all(c.titles.get(label_number(x)) for x in c.columns.values())),
    Rule("column_dispositions 必须是列表", lambda c: isinstance(c.dispositions, list)),
]
DISPOSITION = [
    shape("disposition", lambda c: c.part),
    Rule("列去向越界、重复或与映射的列相同", lambda c: label_number(c.part["column"]) <= c.owner.sheet.max_col and c.part["column"] not in {*(d["column"] for d in c.earlier), *c.owner.columns.values()}),
    chosen("disposition", lambda c: c.part["disposition"]),
    Rule("列去向要写明依据", lambda c: words(c.part["reason"])),
    Rule("mode 只用于 group_context，可选 repeated/blocks", lambda c: c.part.get("mode", "repeated") in ("repeated", "blocks") if c.part["disposition"] == "group_context" else "mode" not in c.part),
]
REVIEWED = [
    Rule(lambda c: f"{c.sheet.name} 存在未说明去向的有效列", lambda c: not c.unsaid(), lambda c: c.place | {"columns": sorted(c.unsaid())}),
    Rule(lambda c: f"{c.sheet.name} 存在尚未识别的有效列", lambda c: not c.unknown(), lambda c: c.place | {"columns": c.unknown()}),
    Rule("structure_warnings 必须是列表", lambda c: isinstance(c.table.get("structure_warnings", []), list)),
    Rule(lambda c: f"{c.sheet.name} 存在尚未处理的结构变化", lambda c: not c.table.get("structure_warnings"), lambda c: c.place | {"warnings": c.table["structure_warnings"][:20]}),
]
MODES = [
    chosen("project_mode", lambda c: c.table["project_mode"]),
    chosen("group_mode", lambda c: c.table["group_mode"]),
    Rule("group_mode 为 anchor 时，group_start_field 必须是已映射的角色", lambda c: c.table["group_mode"] != "anchor" or c.table.get("group_start_field") in c.columns),
    Rule("group_mode 为 lot 时，必须映射标段字段", lambda c: c.table["group_mode"] != "lot" or {"lot_name", "lot_code"} & set(c.columns)),
    chosen("bidder_separator", lambda c: c.table["bidder_separator"]),
    chosen("award_mode", lambda c: c.table.get("award_mode", "auto"), f"award_mode 可选 {'/'.join(CHOICES['award_mode'])}；row_presence 已停用"),
    Rule("中标完整性只能用 award_completeness 或旧字段 award_list_complete 之一说明", lambda c: ("award_completeness" in c.table) != ("award_list_complete" in c.table)),
    Rule("award_list_complete 必须是布尔值", lambda c: type(c.table.get("award_list_complete", False)) is bool),
    Rule("summary_markers、non_tender_markers 必须是非空文本的列表", lambda c: all(isinstance(c.table[k], list) and all(map(words, c.table[k])) for k in ("summary_markers", "non_tender_markers"))),
]
COMPLETENESS = [
    shape("completeness", lambda c: c),
    chosen("status", lambda c: c["status"]),
    chosen("basis_type", lambda c: c["basis_type"]),
    Rule("中标完整性要有依据，声明 complete 时依据类型不能为 none", lambda c: words(c["basis"]) and (c["status"], c["basis_type"]) != ("complete", "none")),
]
REGION = [
    shape("region", lambda c: c.part),
    Rule("区域的行号不在 Sheet 内", lambda c: all(type(c.part[k]) is int and 1 <= c.part[k] <= c.owner.max_row for k in ("start", "end"))),
    Rule("区域要有从小到大的行号和原因", lambda c: c.part["start"] <= c.part["end"] and words(c.part["reason"])),
    Rule("区域与表格或其他区域重叠", lambda c: not set(range(c.part["start"], c.part["end"] + 1)) & set(c.earlier)),
]
ALIASES = [
    Rule("别名文件格式无效", lambda c: isinstance(c, dict) and set(c) == {"schema_version", "aliases"} and c["schema_version"] == 1 and isinstance(c["aliases"], list)),
    Rule("别名要写明 from、to 和 basis", lambda c: all(isinstance(x, dict) and set(x) == KEYS["alias"][0] and all(map(words, x.values())) for x in c["aliases"])),
    Rule("别名指向自身，或一个名称有多个别名", lambda c: len({name_key(x["from"]) for x in c["aliases"]}) == len(c["aliases"]) and all(name_key(x["from"]) != name_key(x["to"]) for x in c["aliases"])),
    Rule("别名不能再指向别名", lambda c: not {name_key(x["from"]) for x in c["aliases"]} & {name_key(x["to"]) for x in c["aliases"]}),
    Rule("不接受全局公司名映射；输出保留投标单位名称", lambda c: not c["aliases"]),
]


# ---------------------------------------------------------------- a sheet


def check_sheet(spec: dict, sheet: Any, book: Any, effective: dict, texts: dict) -> None:
    """All rules of a sheet, table by table, then its regions and whether every content row is explained."""
    where = {"source": book.file_name, "sheet": sheet.name}
    keep(SHEET, {"spec": spec, "sheet": sheet, "where": where})
    if spec["action"] != "parse":
        return
    taken: set[int] = set()
    taken_data: set[int] = set()
    for t, table in enumerate(spec["tables"]):
        key = (sheet.sha, sheet.idx, t)
        case = TableCase(table, sheet, where, {c: texts.get((*key, c)) for c in range(1, sheet.max_col + 1)}, {number_label(c) for c in effective.get(key, ())}, set(taken), set(taken_data))
        keep([*EXTENT, *COLUMNS], case)
        for k, d in enumerate(case.dispositions):
            keep(DISPOSITION, PartCase(d, case, case.dispositions[:k]))
        keep([*REVIEWED, *MODES], case)
        if "award_completeness" in table:
            keep(COMPLETENESS, table["award_completeness"])
        taken |= case.headers | case.data
        taken_data |= case.data
    for name in ("ignored_rows", "review_regions"):
        keep([Rule(f"{name} 必须是列表", lambda parts: isinstance(parts, list))], spec.get(name, []))
        for part in spec.get(name, []):
            keep(REGION, PartCase(part, sheet, sorted(taken)))
            taken |= set(range(part["start"], part["end"] + 1))
    lost = [r for r in sheet.rows if r not in taken]
    keep([Rule(f"{sheet.name} 有未解释的非空行: {lost[:10]}", lambda rows: not rows)], lost)
