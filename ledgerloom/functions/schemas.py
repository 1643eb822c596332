"""Schemas of the engine's tables. A sheet is told by (sha, sheet_idx), a mapped table by (sha, sheet_idx, table_idx)."""


def names(ddl: str) -> list[str]:
    """The top-level column names of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[start:i].split()[0])
            start = i + 1
    return out


SOURCES = "sha string, source_id string, file_name string, size long, format string, ord int"
SHEETS = "sha string, sheet_idx int, name string, hidden boolean, hidden_rows array<int>, hidden_columns array<int>"
CELLS = "sha string, sheet_idx int, row int, col int, text string, raw string, number boolean, formula boolean, error boolean, number_format string"
MERGES = "sha string, sheet_idx int, top int, left int, bottom int, right int, ord int"
FAILURES = "sha string, file_name string, size long, format string, fatal boolean, error string"

TABLES = (
    "sha string, sheet_idx int, table_idx int, scope_idx int, first_row int, last_row int, headers array<int>, project_mode string, group_mode string, start_field string, separator string, "
    "award_mode string, status string, basis_type string, basis string, summary_markers array<string>, tender_markers array<string>, company_role string, has_count_anchor boolean"
)
COLUMNS = "sha string, sheet_idx int, table_idx int, pos int, col int, label string, role string, disposition string, mode string, header string, reason string"
