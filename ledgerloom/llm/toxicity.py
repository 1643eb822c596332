"""Toxicity by maximum-scoring segments.

Tokens score by their log-odds between labelled toxic and other documents, with an informative Dirichlet prior; words
whose log-odds are not significant among that many words score nothing. A small cost for each token makes clean text drift downwards, so that
Ruzzo and Tompa's linear scan finds all maximal segments. Extreme-value theory (Karlin and Altschul) says how high the
best segment of clean text of that length would score; the segments' excess over that, not raw scores, is aggregated
and mapped to a probability by a logistic curve that is fitted to the training documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, longs, pieces, strings
from ledgerloom.llm.langid import held_out

_WORD = re.compile(r"[^\W\d_]+")
COST = 0.35


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def forms(word: str) -> list[str]:
    """The word and its beginnings, so that inflected and compound words are recognised."""
    return [word, *(f"{word[:n]}*" for n in range(4, min(len(word), 8) + 1))]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time; runs between positive scores are skipped."""
    at = np.flatnonzero(scores > 0)
    sums = np.r_[0.0, np.cumsum(scores)]
    stack: list[list] = []  # [start, end, sum before, sum after, index of the last one before with a smaller sum before]
    for i in at.tolist():
        new = [i, i + 1, sums[i], sums[i + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(s, e, b - a) for s, e, a, b, _ in stack]


class TokenScores(dict):
    """Scores of the words seen lately: that of the word's most significant form, less the cost of a token."""

    def __init__(self, table: dict[str, tuple[float, float]]):
        self.table = table

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        found = [self.table[f] for f in forms(word) if f in self.table]
        score = self[word] = (max(found)[1] if found else 0.0) - COST
        return score


class Scorer:
    """words: (|z|, log-odds) by form; lam, k: extreme-value parameters; rate: significant segments a token of clean
    text; weights: of the logistic curve."""

    def __init__(self, words: dict[str, tuple[float, float]], lam: float = 1.0, k: float = 1.0, rate: float = 1e-4, weights: tuple = (0.0,) * 5):
        self.words, self.lam, self.k, self.rate, self.weights = words, lam, k, rate, weights
        self.scores = TokenScores(words)

    def __reduce__(self):
        return Scorer, (self.words, self.lam, self.k, self.rate, self.weights)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        found = tokens(text)
        if not found or not self.words:
            return len(found), []
        return len(found), segments(np.fromiter(map(self.scores.__getitem__, found), np.float64, len(found)))

    def excesses(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(tokens, segments with their excess over the best of clean text of that length)."""
        n, found = self.scan(text)
        limit = math.log(self.k * max(n, 1))
        return n, [(a, b, self.lam * s - limit) for a, b, s in found]

    def features(self, n: int, found: list[tuple[int, int, float]]) -> list[float]:
        """The best excess; sum and number of the significant ones; how unlikely their number is in clean text."""
        best = max((e for *_, e in found), default=-math.log(self.k * n) if n else -20.0)
        good = [e for *_, e in found if e > 0]
        expected = max(self.rate * n, 1e-9)
        surprise = len(good) * math.log(len(good) / expected) - len(good) + expected if len(good) > expected else 0.0
        return [min(60.0, max(-20.0, best)), math.log1p(sum(good)), float(len(good)), min(60.0, surprise)]

    def score(self, features) -> float:
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def karlin_lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * scores)) = 1."""
    if not (scores > 0).any() or (scores * share).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights none of which is negative: features that would count against toxicity are left out in turn."""
    use = list(range(x.shape[1]))
    while use:
        w = _logistic(x[:, use], y)
        if (w[1:] >= 0).all():
            break
        use.pop(int(np.argmin(w[1:])))
    out = np.zeros(x.shape[1] + 1)
    out[0] = w[0] if use else _logistic(x[:, :0], y)[0]
    out[[u + 1 for u in use]] = w[1:] if use else 0
    return out


def _sample(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, per_class: int) -> DataFrame:
    """(text, toxic) of the training documents: per_class of each class on average, by a hash of the id, copies once."""
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out(modulus, remainder)).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max(F.col("toxic").cast("double")) > 0).cast("int").alias("toxic"))
    rate = {r[0]: min(1.0, per_class / r[1]) for r in marks.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    wanted = marks.where(draw < F.coalesce(*[F.when(F.col("toxic") == k, F.lit(v)) for k, v in rate.items()], F.lit(0.0)))
    # the sample's ids are bounded by per_class, so they are sent to the texts instead of moving all texts
    drawn = docs.join(F.broadcast(wanted), docs.doc_id == wanted.id).select("text", "toxic")

    def signed(batches):
        """With the smallest hash of five-word shingles: copies and near copies share it and count once."""
        for batch in batches:
            signs = []
            for text in strings(batch):
                w = (text or "").split()
                signs.append(min((xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5])) >> 1 for i in range(max(1, len(w) - 4))), default=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, longs(signs)], names=["text", "toxic", "sign"])

    marked = drawn.mapInArrow(signed, "text string, toxic int, sign long")
    return cut(marked.groupBy("sign", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, per_class: int = 4000) -> Scorer:
    """Learns from labelled documents that are not held out.

    per_class bounds the sample (documents of each class, on average; whole texts), and with it the table of its
    significant words, which is not cut. A toxic value above 0 marks the class. Words are counted on the executors. Without
    both classes all scores are alike.
    """
    sample = _sample(docs, labels, modulus, remainder, per_class)

    def count(batches):
        total: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(strings(batch), batch.column(1).to_pylist(), strict=True):
                for w in {f for t in set(tokens(text or "")) for f in forms(t)}:  # once a document: one long rant doesn't make a word toxic
                    total.setdefault(w, [0, 0])[toxic > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), longs([v[0] for v in total.values()]), longs([v[1] for v in total.values()])], names=["word", "n0", "n1"])

    counts = sample.mapInArrow(count, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = counts.agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    if not sums[0] or not sums[1]:
        return Scorer({})
    n0_all, n1_all = sums[0], sums[1]
    prior = 0.01 * (n0_all + n1_all)
    a = F.lit(prior) * (F.col("n0") + F.col("n1")) / F.lit(n0_all + n1_all)
    delta = F.log((F.col("n1") + a) / (n1_all + prior - F.col("n1") - a)) - F.log((F.col("n0") + a) / (n0_all + prior - F.col("n0") - a))
    # significance: the signed root of the likelihood ratio, which holds for words that one class lacks
    share = n1_all / (n0_all + n1_all)
    n, part = F.col("n0") + F.col("n1"), lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("n0") + F.col("n1")) * p))).otherwise(0.0)
    z = F.when(F.col("n1") > n * share, 1).otherwise(-1) * F.sqrt(F.greatest(F.lit(0.0), 2 * (part("n1", share) + part("n0", 1 - share))))
    table = counts.select("word", "n0", delta.alias("delta"), z.alias("z")).where(F.abs("z") > math.sqrt(2 * math.log(max(2, sums[2])))).collect()  # significant words of the sample
    words = {r["word"]: (abs(r["z"]), max(-3.0, min(8.0, r["delta"]))) for r in table}
    found = np.zeros((1 << 12) + 1, np.int64)  # how often clean text has each token score, in steps

    def scored(batches):
        scores, total = TokenScores(words), np.zeros(len(found), np.int64)
        for batch in batches:
            for text, toxic in zip(strings(batch), batch.column(1).to_pylist(), strict=True):
                if not toxic:
                    x = np.fromiter(map(scores.__getitem__, tokens(text or "")), np.float64)
                    total += np.bincount(np.clip(np.rint((x + 4) * 256), 0, len(found) - 1).astype(np.int64), minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["n"])

    for (part,) in sample.mapInArrow(scored, "n binary").toLocalIterator():
        found += np.frombuffer(bytes(part), "<i8")
    lam = karlin_lambda(np.arange(len(found)) / 256 - 4, found / max(1, found.sum()))
    def measure(scorer: Scorer) -> np.ndarray:
        """Tokens, features and label of each training document."""

        def rows(batches):
            for batch in batches:
                f = [(float(n), *scorer.features(n, found)) for n, found in (scorer.excesses(t or "") for t in strings(batch))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in f], pa.float64()) for i in range(5)] + [pa.array([float(x > 0) for x in batch.column(1).to_pylist()], pa.float64())], names=["n", "a", "b", "c", "d", "toxic"])

        return np.array([tuple(r) for r in sample.mapInArrow(rows, "n double, a double, b double, c double, d double, toxic double").collect()])  # bounded by the sample

    # k from clean documents: in half of them the best segment stays below it
    first = measure(Scorer(words, lam))
    best = first[first[:, 5] == 0, 1]
    k = float(np.clip(np.exp(np.median(best) + math.log(math.log(2))), 1e-6, 1e6)) if len(best) else 1.0
    second = measure(Scorer(words, lam, k))
    clean = second[second[:, 5] == 0]
    scorer = Scorer(words, lam, k, (clean[:, 3].sum() + 0.5) / (clean[:, 0].sum() + 1))
    seen = measure(scorer)
    scorer.weights = tuple(_rising(seen[:, 1:5], seen[:, 5]).tolist())
    return scorer


def toxicity(docs: DataFrame, scorer: Scorer, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Scores every whole text from the text alone.

    docs: doc_id, text; other columns are ignored. Null, empty and wordless texts score like a text without findings.
    Repeated rows get equal results. Returns doc_id, held_out, score, predicted, spans (token positions and excess of
    significant segments).
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # significant words of the bounded sample

    def rows(batches):
        s = sent.value
        for batch in pieces(batches):
            scores, spans = [], []
            for text in strings(batch):
                n, found = s.excesses(text or "")
                scores.append(s.score(s.features(n, found)))
                spans.append([{"start": a, "end": b, "excess": e} for a, b, e in found if e > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())])))], names=["doc_id", "held_out", "score", "predicted", "spans"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(modulus, remainder).alias("held_out"))
    return given.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long,excess:double>>")


def toxicity_held_out(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> DataFrame:
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return toxicity(given, train(given, labels, per_class=per_class)).select("doc_id", "held_out", "score", "predicted")
