"""Training on distinct texts, documents without a learned language, secrets inside paths, all source files."""

import os
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, langid, secrets
from ledgerloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_copies_train_once(spark):
    texts = [f"some words of text number {chr(97 + i) * 5}" for i in range(20)]
    once = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    often = spark.createDataFrame([("en", t) for k, t in enumerate(texts) for _ in range(400 if k == 3 else 100)], "lang string, text string")
    a, b = langid.train(once, 25), langid.train(often, 25)
    assert a.languages == b.languages == ["en"] and np.array_equal(a.p, b.p)


def test_letters_stay_without_a_language(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "123"), (3, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert [r.doc_id for r in langid.keep_identified(docs, langid.learned_from(docs)).collect()] == [1]


def test_keys_in_paths_and_of_one_case(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(120):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
        rows.append((i, f"see /my-app/{key} there"))
        want[i] = (12, 52)
        letters = "".join(rng.choice(string.ascii_lowercase) for _ in range(40))
        rows.append((1000 + i, f"see {letters} there"))
        want[1000 + i] = (4, 44)
    rows += [(5000, "-" * 40), (5001, "a" + "-_/+" * 10), (5002, "z" * 40)]
    found = {r.doc_id: [(s.start, s.end) for s in r["all"]] for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] == [w] for i, w in want.items()) > 0.8 * len(want)
    assert found[5000] == found[5001] == found[5002] == []


def test_decontamination_takes_one_worker_a_task(spark):
    """Two Python steps in a row hold two workers a task, which stay in the executor for all later steps."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 20])) for k in range(15)] + [(99, "nothing of it"), (100, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"b{k}", " ".join(words[k : k + 13])) for k in range(0, 27, 9)], "item_id string, text string")
    for max_bytes in (1 << 20, 60):  # in one part and in several
        for df in (decontaminate.drop_contaminated(docs, bench, max_bytes=max_bytes), decontaminate.decontaminate(docs, bench, max_bytes=max_bytes)):
            assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        clean = [k for k in range(15) if not any(k <= at and at + 13 <= k + 20 for at in range(0, 27, 9))]
        assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench, max_bytes=max_bytes).orderBy("doc_id").collect()] == [*clean, 99, 100]


def test_streamed_rows_come_from_no_shuffle(spark, monkeypatch):
    """toLocalIterator() goes on reading after its action's end, when the pipeline's sessions delete the shuffles."""
    frame, plans = type(spark.range(0)), []
    streamed = frame.toLocalIterator
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, *a, **b: plans.append(self._jdf.queryExecution().executedPlan().toString()) or streamed(self, *a, **b))
    model = langid.train(spark.createDataFrame([("en", "some words"), ("de", "andere Worte"), ("en", "some words")], "lang string, text string"))
    bench = spark.createDataFrame([(f"b{k % 5}", f"item number {k % 5}") for k in range(10)], "item_id string, text string")
    parts = list(decontaminate.parts_of(bench, 20))
    assert model.languages == ["de", "en"]
    assert sorted(i for part, _ in parts for i, _ in part) == [f"b{k}" for k in range(5)] and [last for _, last in parts] == [False] * (len(parts) - 1) + [True]
    assert len(plans) > 1 and not any("Exchange" in p for p in plans)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_every_source_file_is_scanned(spark):
    got = {r.file_name: r.length for r in catalogue.source_scan(spark, DATA).collect()}
    assert got == {f: os.path.getsize(f"{DATA}/{f}") for f in os.listdir(DATA) if f.endswith(".parquet")}
