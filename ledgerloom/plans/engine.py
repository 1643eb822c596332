"""The engine end to end: workbooks and a plan to results."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from ledgerloom.functions.errors import LedgerError
from ledgerloom.operators.collect import assign, refuse_revisions
from ledgerloom.operators.emit import Results, emit
from ledgerloom.operators.finish import finish
from ledgerloom.plans.mapping import refuse_aliases
from ledgerloom.sources.cells import Workbooks


def now() -> str:
    return datetime.now(timezone(timedelta(hours=8))).isoformat(timespec="seconds")


def build(books: Workbooks, plan: dict, generated_at: str | None = None, failures: list[dict] | None = None, resolutions: dict[str, dict] | None = None, aliases: dict | None = None) -> Results:
    """Results of a validated plan. Raises PlanRevision where the rows contradict the plan."""
    refuse_aliases(aliases)
    timestamp = generated_at or now()
    try:
        aware = datetime.fromisoformat(timestamp).utcoffset() is not None
    except ValueError:
        aware = False
    if not aware:
        raise LedgerError("生成时间必须为带时区的 ISO 8601")
    rows, tables, _ = assign(books, plan)
    refuse_revisions(rows, books)
    done = finish(rows, tables, books.sources, books.sheets, resolutions)
    out = emit(rows, done, books, plan, timestamp, failures)
    if out.final.isEmpty() and out.review.isEmpty():
        raise LedgerError("没有识别到可整理的数据或复核项；未发布空的成功产物")
    return out
