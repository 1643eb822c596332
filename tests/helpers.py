"""Small workbooks for tests: as plans with their sheets, and as .xlsx and .xls bytes."""

import io
import struct
import zipfile
from xml.sax.saxutils import escape

from ledgerloom.functions.text import number_label
from ledgerloom.sources.cells import book_of, sheet_of

TIME = "2026-09-20T12:00:00+08:00"
COMPLETE = {"status": "complete", "basis_type": "structural", "basis": "测试夹具"}
ROLE = {
    "项目名称": "project_name", "项目编号": "project_code", "标段": "lot_name", "投标单位名称": "bidder_name", "投标企业名单": "bidder_name", "公司名称": "bidder_name", "投标单位数量": "bidder_count", "中标单位": "award_name",
    "备注": "notes", "投标报价": "bidder_price", "投标报价(万元)": "bidder_price", "中标与否": "award_status", "投标排名": "rank", "代理公司": "agent",
}


def fixture(name, rows, merges=(), *, formats=None, **table):
    """(book, its plan's source): header in the first row, roles from the header texts."""
    book = book_of([sheet_of("台账", rows, merges, formats)], f"{name}.xlsx")
    return book, source_of(book, rows, **table)


def source_of(book, rows, **table):
    columns = {ROLE[h]: number_label(c) for c, h in enumerate(rows[0], 1) if h in ROLE}
    base = {"header_rows": [1], "data_start_row": 2, "data_end_row": len(rows), "columns": columns, "project_mode": "merged", "group_mode": "project", "bidder_separator": "single", "award_completeness": COMPLETE, "award_mode": "name_match", "summary_markers": ["项目汇总", "合计"], "non_tender_markers": ["未招投标", "未招标"]}
    return {"file_name": book.file_name, "sha256": book.sha, "sheets": [{"name": "台账", "action": "parse", "tables": [base | table]}]}


def xlsx(sheets: dict, merges: dict | None = None, styles: dict | None = None, date1904=False, patch=None) -> bytes:
    """sheets: name -> rows; a value ("f", text) is a formula, ("e", text) an error; styles: place -> number format."""
    formats = sorted(set((styles or {}).values()))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://x/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + '<Relationship Id="rs" Type="http://x/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rt" Type="http://x/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts>' + "".join(f'<numFmt numFmtId="{170 + k}" formatCode="{f}"/>' for k, f in enumerate(formats)) + '</numFmts><cellXfs><xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{170 + k}"/>' for k in range(len(formats))) + "</cellXfs></styleSheet>",
    }
    strings: list[str] = []
    for i, (name, rows) in enumerate(sheets.items(), 1):
        body = ""
        for r, row in enumerate(rows, 1):
            cells = ""
            for c, v in enumerate(row, 1):
                at = f"{number_label(c)}{r}"
                s = f' s="{formats.index(styles[at]) + 1}"' if styles and at in styles else ""
                if v is None:
                    continue
                if isinstance(v, tuple):
                    cells += f'<c r="{at}"{s}><f>{escape(v[1])}</f></c>' if v[0] == "f" else f'<c r="{at}" t="e"><v>{v[1]}</v></c>'
                elif isinstance(v, bool):
                    cells += f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, (int, float)):
                    cells += f'<c r="{at}"{s}><v>{v}</v></c>'
                else:
                    strings.append(v)
                    cells += f'<c r="{at}"{s} t="s"><v>{len(strings) - 1}</v></c>'
            body += f'<row r="{r}">{cells}</row>'
        areas = "".join(f'<mergeCell ref="{m}"/>' for m in (merges or {}).get(name, ()))
        parts[f"xl/worksheets/s{i}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData><mergeCells>{areas}</mergeCells></worksheet>'
    parts["xl/sharedStrings.xml"] = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>"
    if patch:
        patch(parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def xls(rows, name="台账", merges=()) -> bytes:
    """A BIFF8 workbook of one sheet in an OLE container."""
    rec = lambda kind, raw: struct.pack("<HH", kind, len(raw)) + raw
    strings = [v for row in rows for v in row if isinstance(v, str)]
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(struct.pack("<HB", len(s), 1) + s.encode("utf-16-le") for s in strings)
    bof = lambda kind: rec(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    head = bof(5) + rec(0x22, struct.pack("<H", 0)) + rec(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + rec(0xE0, struct.pack("<HH", 0, 14) + bytes(16))
    label = name.encode("utf-16-le")
    after = rec(0xFC, sst) + rec(0x0A, b"")
    size = len(rec(0x85, struct.pack("<IBB", 0, 0, 0) + struct.pack("<BB", len(name), 1) + label))
    offset = len(head) + size + len(after)
    body, k = bof(16), 0
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            if isinstance(v, str):
                body += rec(0xFD, struct.pack("<HHHI", r, c, 0, k))
                k += 1
            elif isinstance(v, bool):
                body += rec(0x205, struct.pack("<HHHBB", r, c, 0, int(v), 0))
            elif isinstance(v, int):
                body += rec(0x27E, struct.pack("<HHHI", r, c, 0, (v << 2 | 2) & 0xFFFFFFFF))
            elif isinstance(v, float):
                body += rec(0x203, struct.pack("<HHHd", r, c, 1 if v > 40000 else 0, v))
    body += rec(0xE5, struct.pack("<H", len(merges)) + b"".join(struct.pack("<4H", *m) for m in merges)) + rec(0x0A, b"")
    stream = head + rec(0x85, struct.pack("<IBB", offset, 0, 0) + struct.pack("<BB", len(name), 1) + label) + after + body
    length = max(4096, len(stream))
    stream = stream.ljust(-(-length // 512) * 512, b"\0")
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    assert len(fat) == 128

    def entry(title, kind, start, size_):
        raw = (title.encode("utf-16-le") + b"\0\0").ljust(64, b"\0")
        return raw + struct.pack("<HBB", 2 * len(title) + 2, kind, 1) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, 1 if kind == 5 else 0xFFFFFFFF) + bytes(36) + struct.pack("<IQ", start, size_)

    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, length)).ljust(512, b"\0")
    header = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    header += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return header + struct.pack("<128I", *fat) + directory + stream
