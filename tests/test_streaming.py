from helpers import xls, xlsx
from ledgerloom.streaming.ingest import ingest


def test_each_file_is_taken_in_once(spark, tmp_path):
    folder, target, progress = tmp_path / "in", str(tmp_path / "cells"), str(tmp_path / "progress")
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(xlsx({"台账": [["项目名称", "公司名称"], ["甲", "甲公司"]]}))
    (folder / "notes.txt").write_text("not a workbook")
    ingest(spark, str(folder), target, progress).awaitTermination(120)
    assert spark.read.parquet(target).where("kind = 'cell'").count() == 4
    (folder / "b.xls").write_bytes(xls([["公司名称"], ["乙公司"]]))
    (folder / "c.xlsx").write_bytes(b"broken")
    ingest(spark, str(folder), target, progress).awaitTermination(120)
    found = {(r.file_name, r.kind): r["count"] for r in spark.read.parquet(target).groupBy("file_name", "kind").count().collect()}
    assert found == {("a.xlsx", "sheet"): 1, ("a.xlsx", "cell"): 4, ("b.xls", "sheet"): 1, ("b.xls", "cell"): 2, ("c.xlsx", "failure"): 1}
