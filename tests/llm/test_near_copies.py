"""The pipeline's near-copy stage against all pairs: Jaccard similarity of five-word shingle sets, in whole numbers."""

import random
import time

import pytest

import corpus_pipeline
from ledgerloom.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def exact_groups(texts):
    """The smallest number of each text's group when all pairs with a similarity of 0.8 or more are linked."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
                pairs.append((j, i))
    return [top(k) for k in range(len(texts))], pairs


def got_groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    return [found[k] for k in range(len(texts))]


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def test_pairs_at_the_limit_are_all_found(spark):
    """Copies just above and just below 0.8, of texts of few and of many shingles: the same groups as all pairs."""
    rng = random.Random(8)
    texts = ["one two three four five six seven eight", "one two three four five six seven eight nine"]  # 4 of 5: 0.8
    for _ in range(150):
        n = rng.choice((12, 30, 60, 180, 350, 900))
        base = [word(rng) for _ in range(n)]
        copy, k = list(base), 0
        while True:  # changed words until the similarity falls below the limit
            changed = list(copy)
            changed[rng.randrange(n)] = word(rng)
            a, b = shingles(" ".join(base)), shingles(" ".join(changed))
            if len(a & b) * 10 < 8 * len(a | b):
                break
            copy, k = changed, k + 1
        texts += [" ".join(base), " ".join(copy), " ".join(changed)]
    want, pairs = exact_groups(texts)
    assert len(pairs) > 100
    assert got_groups(spark, texts) == want


def test_no_link_below_the_limit(spark):
    """Neighbours at 0.6 to 0.79, short templates and one much-repeated passage are not linked, nor chained."""
    rng = random.Random(9)
    texts, passage = [], " ".join(word(rng) for _ in range(6))
    for n in (8, 10, 14, 18, 180, 350) * 8:
        base = [word(rng) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(3):  # a chain: each neighbour is just below the limit
            while len(shingles(" ".join(base)) & shingles(texts[-1])) * 10 >= 8 * len(shingles(" ".join(base)) | shingles(texts[-1])):
                base[rng.randrange(n)] = word(rng)
            texts.append(" ".join(base))
    texts += [f"{(passage + ' ') * 40}{' '.join(word(rng) for _ in range(30))}" for _ in range(5)]
    want, _ = exact_groups(texts)
    assert want == list(range(len(texts)))
    assert got_groups(spark, texts) == want


@pytest.mark.parametrize("limit", [1024, 40])
def test_dense_groups(spark, limit):
    """Many variants of one text, pairs of which are about as far apart as the limit, with and without the text itself."""
    rng = random.Random(11)
    texts = []
    for n, changes, with_base in ((40, 1, True), (40, 2, False), (60, 2, True), (120, 4, False)):
        base = [word(rng) for _ in range(n)]
        texts += [" ".join(base)] * with_base
        for _ in range(70):
            variant = list(base)
            for _ in range(rng.randrange(changes + 1)):
                variant[rng.randrange(n)] = word(rng)
            texts.append(" ".join(variant))
    want, pairs = exact_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, limit=limit).collect()}
    assert [found[k] for k in range(len(texts))] == want and len(pairs) > 1000


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_the_stage_leaves_no_shuffle_files(spark, tmp_path):
    """They would lie on disk beside those of later steps, until the driver collects garbage."""
    before = shuffle_files(spark)
    docs = spark.createDataFrame([(k, f"a text of some words with the number {k // 2} in it") for k in range(40)], "doc_id long, text string")
    corpus_pipeline.simhash_stage(spark, docs, "").write.parquet(f"{tmp_path}/out")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left and spark.read.parquet(f"{tmp_path}/out").count() == 20
