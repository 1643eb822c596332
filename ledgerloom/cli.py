"""Command line: run, inspect, export, validate, companies, resolve."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ledgerloom.functions.errors import LedgerError, PlanRevision
from ledgerloom.operators import profile
from ledgerloom.plans import mapping, publish, review
from ledgerloom.plans.engine import build, now
from ledgerloom.sources.scan import read_workbooks

DONE, FAILED, NEEDS_PLAN, NEEDS_ANSWERS = 0, 2, 3, 4
STAGES = ("read", "build", "publish")


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ledgerloom")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("run", "export"):
        p = commands.add_parser(name)
        p.add_argument("inputs", nargs="+")
        p.add_argument("--plan", required=name == "export")
        p.add_argument("--output", required=name == "export")
        p.add_argument("--progress", action="store_true")
    p = commands.add_parser("inspect")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--sheet")
    p.add_argument("--rows")
    for name in ("validate", "companies"):
        commands.add_parser(name).add_argument("output")
    p = commands.add_parser("resolve")
    p.add_argument("--state", required=True)
    p.add_argument("--answers", required=True)
    p.add_argument("--progress", action="store_true")
    return out


def _say(value: dict) -> None:
    print(json.dumps(value, ensure_ascii=False), flush=True)


class Progress:
    def __init__(self, on: bool):
        self.on, self.stage = on, None

    def to(self, stage: str | None, status: str = "completed") -> None:
        if self.on and self.stage:
            _say({"kind": "progress", "stage": self.stage, "status": status})
        self.stage = stage
        if self.on and stage:
            _say({"kind": "progress", "stage": stage, "status": "in_progress"})


def _finish(spark, books, failures, plan, output: str, generated_at: str, decisions: dict, progress: Progress, inputs: list[str], state: tuple | None, errors: list | None = None) -> int:
    progress.to("build")
    results = build(books, plan, generated_at, failures, decisions)
    tasks = review.award_tasks(results)
    asked, total, left = review.questions(tasks, decisions)
    if left:
        path = state[0] if state else review.create_state(inputs, plan, output, generated_at, total)
        progress.to(None)
        _say({"kind": "award_review_required", "message": "请确认非精确中标名称对应的投标企业。", "state": str(path), "review_task_count": state[1]["review_task_count"] if state else total, "remaining_task_count": left, "questions": asked, "validation_errors": errors or [], "summary": results.summary.first().asDict()})
        return NEEDS_ANSWERS
    progress.to("publish")
    ledger = publish.ledger_of(results, results.rows, books, plan, generated_at, failures, decisions)
    result = publish.publish(output, results, ledger)
    progress.to(None)
    if state:
        review.cleanup_state(state[0])
    _say(result)
    return DONE


def _inspect(spark, args) -> int:
    books, failures = read_workbooks(spark, args.inputs)
    if not args.rows:
        _say(mapping.inspect(books, failures))
        return DONE
    first, _, last = args.rows.partition(":")
    if not (args.sheet and first.isdigit() and last.isdigit() and 1 <= int(first) <= int(last) <= int(first) + 99):
        raise LedgerError("--rows 需要 --sheet，格式为 起始:结束，且不超过 100 行")
    views = profile.row_views(books.cells, int(first), int(last), [args.sheet], books.sheets).orderBy("sha", "sheet_idx", "row").collect()
    _say({"kind": "inspection_detail", "sheet": args.sheet, "rows": [{"row": v.row, "cells": v.cells} for v in views]})
    return DONE


def _run(spark, args, progress: Progress) -> int:
    progress.to("read")
    books, failures = read_workbooks(spark, args.inputs)
    plan = mapping.load_json(args.plan) if args.plan else {"schema_version": 1, "sources": []}
    if not args.plan and not books.sources.isEmpty():
        progress.to(None)
        _say({"kind": "mapping_required", **{k: v for k, v in mapping.inspect(books, failures).items() if k != "kind"}})
        return NEEDS_PLAN
    mapping.validate(plan, books)
    return _finish(spark, books, failures, plan, args.output or f"outputs/ledger-{uuid.uuid4().hex[:12]}", now(), {}, progress, args.inputs, None)


def _resolve(spark, args, progress: Progress) -> int:
    path, state = review.load_state(args.state)
    answers = review.load_answers(args.answers)
    progress.to("read")
    books, failures = read_workbooks(spark, state["inputs"])
    mapping.validate(state["plan"], books)
    results = build(books, state["plan"], state["generated_at"], failures, state["decisions"])
    decisions, errors = review.apply_answers(results, state["decisions"], answers)
    state["decisions"] = decisions
    review.save_state(path, state)  # before anything is published
    return _finish(spark, books, failures, state["plan"], state["output"], state["generated_at"], decisions, progress, state["inputs"], (path, state), errors)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    progress = Progress(getattr(args, "progress", False))
    try:
        if args.command == "validate":
            _say({"kind": "validation", **publish.validate_outputs(args.output)})
            return DONE
        if args.command == "companies":
            publish.validate_outputs(args.output)
            _say({"kind": "companies", "companies": json.loads((Path(args.output) / "ledger.json").read_text(encoding="utf-8"))["unique_companies"]})
            return DONE
        spark = spark or SparkSession.builder.appName("ledgerloom").getOrCreate()
        if args.command == "inspect":
            return _inspect(spark, args)
        return _resolve(spark, args, progress) if args.command == "resolve" else _run(spark, args, progress)
    except PlanRevision as e:
        progress.to(None, "failed")
        _say({"kind": "mapping_required", "message": str(e), "evidence": e.evidence})
        return NEEDS_PLAN
    except LedgerError as e:
        progress.to(None, "failed")
        print(json.dumps({"kind": "error", "message": str(e)}, ensure_ascii=False), file=sys.stderr)
        return FAILED
    except Exception as e:
        progress.to(None, "failed")
        print(json.dumps({"kind": "error", "message": type(e).__name__}, ensure_ascii=False), file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
