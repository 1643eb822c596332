"""Every query with SQL against DuckDB; operators of their own against plain Python."""

import difflib
import hashlib
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators import merges, windows
from ledgerloom.plans import catalogue, engine_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Of the queries that run the whole engine, those that are tested here; all are compared at a larger scale.
ENGINE = ["engine_answers", "engine_block_rows", "engine_broken_rules", "engine_participants", "engine_profile"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if not n.startswith(("engine_", "ledger_")) or n in ENGINE))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in catalogue.ORACLES:
        rel = duck.sql(catalogue.ORACLES[name])
        names = rel.columns
        assert cols == sorted(names)
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
        assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_likeliest_names_against_all_pairs(spark, duck):
    """top3_candidates by plain loops over the names of each nation."""
    rows = duck.sql("select s_nationkey, s_suppkey, s_name, s_acctbal from supplier").fetchall()
    want = set()
    for nation in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == nation]
        award = max(mine, key=lambda r: (r[3], r[1]))[2]

        def likeness(name, award=award):
            a, b = (x.lower().replace(" ", "") for x in (award, name))
            full = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
            return round(0.65 * full + 0.35 * full, 6)  # no common company words in these names

        ranked = sorted(mine, key=lambda r: (-likeness(r[2]), r[1]))[:3]
        want |= {(nation, r[1], r[2], award, likeness(r[2]), k) for k, r in enumerate(ranked, 1)}
    got = {(r.s_nationkey, r.s_suppkey, r.s_name, r.award, r.score, r.place) for r in catalogue.QUERIES["top3_candidates"](spark, DATA).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_source_scan_against_the_files(spark):
    want = {(f, os.path.getsize(f"{DATA}/{f}"), hashlib.sha256(open(f"{DATA}/{f}", "rb").read()).hexdigest()) for f in os.listdir(DATA) if f.endswith(".parquet")}
    assert {tuple(r) for r in catalogue.QUERIES["source_scan"](spark, DATA).select("file_name", "length", "sha256").collect()} == want


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    rows = windows.numbered(df, ["k"], "n", first=5).collect()
    assert sorted((r.k, r.n) for r in rows) == [(k, k + 5) for k in range(1000)]
    assert windows.numbered(df.where("false"), ["k"], "n").count() == 0


def test_runs_over_partition_edges(spark):
    """One key with all rows, runs longer than a partition, runs of one, a repeated row."""
    rows = [("a", k) for k in range(1000) if k % 400 != 399] + [("b", 3), ("b", 5), ("b", 5), ("c", 1), ("c", 2)]
    got = {tuple(r) for r in windows.islands(spark.createDataFrame(rows, "k string, p int"), ["k"], "p").collect()}
    assert got == {("a", 0, 398), ("a", 400, 798), ("a", 800, 999), ("b", 3, 3), ("b", 5, 5), ("c", 1, 2)}
    assert windows.islands(spark.createDataFrame([], "k string, p int"), ["k"], "p").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 6), st.integers(0, 4), st.integers(0, 3)), max_size=6))
def test_resolve_matches_a_plain_lookup(spark, areas):
    boxes = [(t, l, t + h, l + w) for t, l, h, w in areas]
    cells = spark.createDataFrame([("s", 0, r, c, f"{r}.{c}", None, False, False, False, "General") for r in range(1, 17, 2) for c in range(1, 10)], "sha string, sheet_idx int, row int, col int, text string, raw string, number boolean, formula boolean, error boolean, number_format string")
    areas_df = spark.createDataFrame([("s", 0, *b, k) for k, b in enumerate(boxes)], "sha string, sheet_idx int, top int, left int, bottom int, right int, ord int")
    points = spark.createDataFrame([("s", 0, r, c) for r in range(1, 17) for c in range(1, 10)], "sha string, sheet_idx int, row int, col int")
    for p in merges.resolve(points, areas_df, cells).collect():
        first = next(((t, l) for t, l, b, e in boxes if t <= p.row <= b and l <= p.col <= e), (p.row, p.col))
        assert (p.src_row, p.src_col) == first
        assert p.text == (f"{first[0]}.{first[1]}" if first[0] % 2 else None)
