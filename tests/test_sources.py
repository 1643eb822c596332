import hashlib
import json
import random
from datetime import datetime

import pytest

from helpers import xls, xlsx
from ledgerloom import cli
from ledgerloom.functions.errors import LedgerError, UnreadableSource
from ledgerloom.plans import mapping
from ledgerloom.sources import xls as X
from ledgerloom.sources import xlsx as R
from ledgerloom.sources.cells import cell_range
from ledgerloom.sources.scan import digests, read_workbooks

ROWS = [["项目名称", "投标单位名称", "中标单位"], ["甲项目", "甲公司", "甲公司"], [None, "乙公司", None]]


def test_values_and_types():
    data = xlsx({"a": [["文本", 3, 2.5, True, ("f", "A1&B1"), ("e", "#N/A"), 45000, 7, 0]]}, styles={"G1": "yyyy-mm-dd", "H1": "00000"})
    (sheet,) = R.decode(data)
    row = [sheet.cells[1, c] for c in range(1, 10)]
    assert [c[0] for c in row[:5]] == ["文本", 3, 2.5, True, "=A1&B1"]
    assert row[4][1] and row[5][2] and row[6][0] == datetime(2023, 3, 15) and row[7][3] == "00000" and row[8][0] == 0


def test_1904_dates():
    (sheet,) = R.decode(xlsx({"a": [[1]]}, styles={"A1": "yyyy-mm-dd"}, date1904=True))
    assert sheet.cells[1, 1][0] == datetime(1904, 1, 2)


def test_merges_are_kept_beside_content_only():
    (sheet,) = R.decode(xlsx({"a": [["x"], [None, "y"]]}, {"a": ["A1:B1", "C2:D2", "XF10:XG20"]}))
    assert sheet.merges == [(1, 1, 1, 2)]


def test_content_under_a_merge_is_refused():
    with pytest.raises(UnreadableSource, match="非锚点"):
        R.decode(xlsx({"a": [["x", "y"]]}, {"a": ["A1:B1"]}))


def test_far_content_and_doctype_are_refused():
    with pytest.raises(UnreadableSource, match="范围超限"):
        R.decode(xlsx({"a": [["x"]]}, patch=lambda p: p.update({k: v.replace('r="A1"', 'r="XFD1"') for k, v in p.items() if "worksheets" in k})))
    with pytest.raises(UnreadableSource, match="DTD"):
        R.decode(xlsx({"a": [["x"]]}, patch=lambda p: p.update({k: "<!DOCTYPE x [<!ENTITY a 'b'>]>" + v for k, v in p.items() if "worksheets" in k})))
    with pytest.raises(UnreadableSource):
        R.decode(b"no zip")
    with pytest.raises(UnreadableSource, match="共享字符串"):
        R.decode(xlsx({"a": [["x"]]}, patch=lambda p: p.update({k: v.replace("<v>0</v>", "<v>9</v>") for k, v in p.items() if "worksheets" in k})))


def test_empty_shared_string_is_no_content():
    (sheet,) = R.decode(xlsx({"a": [["", "x"]]}))
    assert list(sheet.cells) == [(1, 2)]


def test_hyperlink_targets_fill_empty_cells():
    def link(parts):
        k = "xl/worksheets/s1.xml"
        parts[k] = parts[k].replace("<mergeCells></mergeCells>", '<hyperlinks><hyperlink ref="B1" location="a!A1"/></hyperlinks>')

    (sheet,) = R.decode(xlsx({"a": [["x"]]}, patch=link))
    assert sheet.cells[1, 2][0] == "a!A1"


def sheet_part(change):
    """A patch that changes the first sheet's part."""
    return lambda parts: parts.update({"xl/worksheets/s1.xml": change(parts["xl/worksheets/s1.xml"])})


def test_shared_formulas_read_as_they_are_in_their_cell():
    def share(part):
        return part.replace("<f>A1</f>", '<f t="shared" si="0" ref="B1:B2">A1</f>').replace("<f>x</f>", '<f t="shared" si="0"/>')

    (sheet,) = R.decode(xlsx({"a": [[3, ("f", "A1")], [4, ("f", "x")]]}, patch=sheet_part(share)))
    assert sheet.cells[2, 2][:2] == ("=A2", True) and sheet.cells[1, 2][:2] == ("=A1", True)


@pytest.mark.parametrize(
    ("formula", "rows", "cols", "moved"),
    [("A1+$B$2*C$3", 2, 1, "B3+$B$2*D$3"), ('IF(Z9>1,"A1",LOG10(AA10))', 1, 1, 'IF(AA10>1,"A1",LOG10(AB11))'), ("'A1 x'!B2+Sheet1!C3", 1, 0, "'A1 x'!B3+Sheet1!C4"), ("SUM(A1:B2)", 0, 2, "SUM(C1:D2)")],
)
def test_moved_references(formula, rows, cols, moved):
    assert R.shifted(formula, rows, cols) == moved


def test_hidden_content_is_kept_and_told(spark, tmp_path):
    def hide(part):
        return part.replace("<sheetData>", '<cols><col min="2" max="40" hidden="1"/></cols><sheetData>').replace('<row r="2">', '<row r="2" hidden="1">')

    data = xlsx({"a": [["项目名称", "公司名称"], [False, 0]]}, patch=sheet_part(hide))
    (sheet,) = R.decode(data)
    assert sheet.hidden_rows == [2] and sheet.hidden_columns == [2] and sheet.cells[2, 1][0] is False and sheet.cells[2, 2][0] == 0
    (tmp_path / "h.xlsx").write_bytes(data)
    seen = mapping.inspect(read_workbooks(spark, [str(tmp_path / "h.xlsx")])[0])
    shown = seen["sources"][0]["sheets"][0]
    assert shown["hidden_rows"] == [2] and shown["hidden_columns"] == [2] and shown["local_inspect_hint"] and seen["notice"]


def test_array_formulas_and_merges_far_away_are_refused():
    with pytest.raises(UnreadableSource, match="公式范围=A1:XFD1"):
        R.decode(xlsx({"a": [[("f", "1")]]}, patch=sheet_part(lambda p: p.replace("<f>", '<f t="array" ref="A1:XFD1">'))))
    with pytest.raises(UnreadableSource, match="合并=.*XFD"):
        R.decode(xlsx({"a": [["x"]]}, {"a": ["A1:XFD1"]}))


def test_blank_merges_do_not_draw_in_others():
    (sheet,) = R.decode(xlsx({"a": [["首"], [], [], [None, "尾"]]}, {"a": ["B2:C2", "C3:D3", "XFC10:XFD20"]}))
    assert sheet.merges == [(2, 2, 2, 3)]


def test_overlapping_merges_hide_nothing():
    (sheet,) = R.decode(xlsx({"a": [["x"], [None], ["y"]]}, {"a": ["A1:A2", "B1:B3"]}))
    assert len(sheet.merges) == 1 and sheet.cells[3, 1][0] == "y"
    with pytest.raises(UnreadableSource, match="非锚点.*A3"):
        R.decode(xlsx({"a": [["x"], [None], ["y"]]}, {"a": ["A1:A3", "A3:B3"]}))


def test_ranges():
    assert cell_range("B2") == (2, 2, 2, 2) and cell_range("$A$1:C3") == (1, 1, 3, 3)
    for bad in ("A0", "B2:A1", "XFE1", "1A"):
        with pytest.raises((UnreadableSource, LedgerError)):
            cell_range(bad)


def test_xls():
    (sheet,) = X.decode(xls([["项目", 5, -2, 2.5, True], ["乙", 45000.0]], merges=[(0, 0, 1, 2)]))
    assert sheet.name == "台账" and sheet.merges == [(1, 2, 1, 3)]
    assert [sheet.cells[1, c][0] for c in range(1, 6)] == ["项目", 5.0, -2.0, 2.5, 1]
    assert sheet.cells[2, 2][0] == datetime(2023, 3, 15)
    with pytest.raises(UnreadableSource):
        X.decode(b"PK" + bytes(600))


def test_scan_isolates_broken_files(spark, tmp_path):
    (tmp_path / "good.xlsx").write_bytes(xlsx({"台账": ROWS, "空": []}))
    (tmp_path / "old.xls").write_bytes(xls([["项目名称", "公司名称"], ["甲", "甲公司"]]))
    (tmp_path / "bad.xlsx").write_bytes(b"not a workbook")
    names = ["good.xlsx", "old.xls", "bad.xlsx"]
    books, failures = read_workbooks(spark, [str(tmp_path / n) for n in names])
    assert [f["file_name"] for f in failures] == ["bad.xlsx"]
    assert [s.file_name for s in books.sources.orderBy("ord").collect()] == ["good.xlsx", "old.xls"]
    assert books.cells.count() == 7 + 4 and books.sheets.count() == 3
    with pytest.raises(LedgerError):
        (tmp_path / "x.csv").write_text("a")
        read_workbooks(spark, [str(tmp_path / "x.csv")])


def said(capsys):
    return [json.loads(line) for line in capsys.readouterr().out.splitlines()]


def test_command_line(spark, tmp_path, capsys):
    path, out = tmp_path / "in.xlsx", tmp_path / "out"
    path.write_bytes(xlsx({"台账": [["项目名称", "投标单位名称", "中标单位"], ["甲项目", "甲建设有限公司", None], ["甲项目", "乙水利有限公司", "甲建设工程有限公司"]]}))
    assert cli.main(["run", str(path)], spark) == cli.NEEDS_PLAN
    plan = said(capsys)[-1]["suggested_plan"]
    table = plan["sources"][0]["sheets"][0]["tables"][0]
    table["award_completeness"] = {"status": "complete", "basis_type": "explicit", "basis": "测试"}
    (tmp_path / "plan.json").write_text(json.dumps(plan, ensure_ascii=False), "utf-8")
    assert cli.main(["inspect", str(path), "--sheet", "台账", "--rows", "1:2"], spark) == cli.DONE
    assert said(capsys)[-1]["rows"][0]["cells"]["A1"] == "项目名称"
    assert cli.main(["run", str(path), "--plan", str(tmp_path / "plan.json"), "--output", str(out), "--progress"], spark) == cli.NEEDS_ANSWERS
    asked = said(capsys)[-1]
    question = asked["questions"][0]
    (tmp_path / "answers.json").write_text(json.dumps({question["question_id"]: question["options"][0]["value"]}), "utf-8")
    assert cli.main(["resolve", "--state", asked["state"], "--answers", str(tmp_path / "answers.json")], spark) == cli.DONE
    assert said(capsys)[-1]["kind"] == "result" and not list(tmp_path.glob(".ledgerloom-work-*"))
    assert cli.main(["validate", str(out)]) == cli.DONE and cli.main(["companies", str(out)]) == cli.DONE
    assert said(capsys)[-1]["companies"] == ["甲建设有限公司", "乙水利有限公司"]
    assert cli.main(["validate", str(tmp_path)]) == cli.FAILED
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    assert cli.main(["run", str(path), "--plan", str(tmp_path / "twice.json")], spark) == cli.FAILED


def test_digests_of_files_that_are_too_large_for_one_row(spark, tmp_path):
    """The limit of 2 GB a row is lowered; splits are small, so that files are cut inside lines, at line ends and in runs of them."""
    rng = random.Random(5)
    files = {"a": b"", "b": b"\n", "c": b"no end", "d": b"\n" * 40_000 + b"x\r\n\r", "e": rng.randbytes(90_000), "f": b"y" * 50_000 + b"\n"}
    for name, data in files.items():
        (tmp_path / f"{name}.parquet").write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        got = {r.path.rpartition("/")[2][0]: (r.length, r.sha256) for r in digests(spark, f"{tmp_path}/*.parquet").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items() if data}
