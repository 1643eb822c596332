"""Language identification by multilingual mixture inference.

A language is a distribution over hashed character trigrams. A document is a mixture of languages: its proportions are
estimated by expectation-maximisation from the likelihoods of all its trigrams. Which languages it holds is decided by
penalised likelihood: the mixture of the m strongest languages is fitted for each m, and a further language must pay
for itself. The strongest language of the chosen set is the prediction, its proportion the score.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, documents_of, longs, pieces, strings, trimmed

BUCKETS = 1 << 14
UNDETERMINED = "und"
_OVERLAP = 3  # a character stands in three trigrams
_TOGETHER = 1 << 16  # trigrams fitted at a time

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Of each code point: is it a letter (general category L)?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the trigrams of a whole text: letters lower-cased, all else one blank; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter | np.r_[True, letter[:-1]]
    x = np.where(letter, points, 32)[keep].astype(np.uint64)
    x = np.r_[np.uint64(32), x, np.uint64(32)] if x[0] != 32 else np.r_[x, np.uint64(32)]
    h = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    buckets = ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(50)).astype(np.int64)
    counts = np.bincount(buckets, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


class _Fit:
    """Expectation-maximisation for several documents at once."""

    def __init__(self, p: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.array([len(b) for b, _ in docs])
        self.starts = np.r_[0, np.cumsum(sizes)[:-1]]
        self.owner = np.repeat(np.arange(len(docs)), sizes)
        self.p = p[np.concatenate([b for b, _ in docs])]
        self.c = np.concatenate([n for _, n in docs]).astype(np.float64)
        self.total = np.add.reduceat(self.c, self.starts)[:, None]

    def run(self, pi: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            r = self.p * pi[self.owner]
            r *= (self.c / r.sum(axis=1))[:, None]
            pi = np.add.reduceat(r, self.starts, axis=0) / self.total
        return pi

    def fitness(self, pi: np.ndarray) -> np.ndarray:
        """Log-likelihood, trigrams' overlap taken out."""
        return np.add.reduceat(self.c * np.log(np.maximum((self.p * pi[self.owner]).sum(axis=1), 1e-300)), self.starts) / _OVERLAP


class Model:
    """languages: names; p: (BUCKETS, languages) trigram probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.languages = languages
        self.p = ((counts + smooth) / (counts.sum(axis=0) + smooth * len(counts))).astype(np.float64)

    def mixtures(self, docs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, number of languages) of documents that have trigrams."""
        k = len(self.languages)
        full = _Fit(self.p, docs).run(np.full((len(docs), k), 1 / k), rounds)
        order = np.argsort(-full, axis=1, kind="stable")
        best, value, chosen = np.zeros_like(full), np.full(len(docs), -np.inf), np.ones(len(docs), np.int64)
        open_ = np.arange(len(docs))  # documents for which one more language is tried
        for m in range(1, k + 1):
            open_ = open_[full[open_, order[open_, m - 1]] > (0.01 if m > 1 else -1)]
            if not len(open_):
                break
            pi = np.zeros((len(open_), k))
            strongest = order[open_, :m]
            np.put_along_axis(pi, strongest, np.maximum(np.take_along_axis(full[open_], strongest, 1), 1e-9), 1)
            fit = _Fit(self.p, [docs[i] for i in open_])
            pi = fit.run(pi / pi.sum(axis=1, keepdims=True), 6 if m > 1 else 0)
            v = fit.fitness(pi) - 0.5 * (2 * m - 1) * np.log(np.maximum(fit.total[:, 0] / _OVERLAP, 2))
            better = open_[v > value[open_]]
            best[better], chosen[better], value[better] = pi[v > value[open_]], m, v[v > value[open_]]
        return best, chosen

    def _fitted(self, texts: list[str | None]):
        """(places, trigrams, proportions, number of languages) of the texts that have trigrams, some at a time."""
        held, at, n = [], [], 0
        for i, text in enumerate(texts):
            found = trigram_counts(text) if text and self.languages else (np.empty(0), np.empty(0))
            if len(found[0]):
                held.append(found)
                at.append(i)
                n += len(found[0])
            if n >= _TOGETHER:
                yield at, held, *self.mixtures(held)
                held, at, n = [], [], 0
        if held:
            yield at, held, *self.mixtures(held)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        out: list = [(UNDETERMINED, 0.0, 0)] * len(texts)
        for at, _, pi, chosen in self._fitted(texts):
            top = pi.argmax(axis=1)
            for i, t, s, m in zip(at, top.tolist(), pi[np.arange(len(at)), top].tolist(), chosen.tolist(), strict=True):
                out[i] = (self.languages[t], min(1.0, max(0.0, s)), m)
        return out

    def identified(self, texts: list[str | None]) -> list[bool]:
        """Is a text's mixture not clearly less likely than trigrams at random?"""
        out = [False] * len(texts)
        for at, held, pi, _ in self._fitted(texts):
            fit = _Fit(self.p, held)
            random = -fit.total[:, 0] / _OVERLAP * np.log(len(self.p))
            for i, good in zip(at, (fit.fitness(pi) > random - CLEARLY).tolist(), strict=True):
                out[i] = good
        return out


def train(labelled: DataFrame, per_language: int = 1500) -> Model:
    """A model from whole texts with a non-null lang.

    The sample is bounded: per_language distinct texts of each language on average, chosen by a hash of the text, or all
    where a language has fewer; copies count once. Trigrams are counted on the executors; one row a language and task reaches the driver.
    """
    labelled = labelled.where("lang is not null and text is not null")
    rate = {r[0]: min(1.0, per_language / r[1]) for r in labelled.groupBy("lang").agg(F.count_distinct(F.xxhash64("text"))).collect()}
    if not rate:
        return Model([], np.zeros((BUCKETS, 0)))
    draw = F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    cases = [F.when(F.col("lang") == k, F.lit(v)) for k, v in rate.items()]
    # toLocalIterator() reads on when its action has ended and tidy_shuffles() takes the shuffle away: it must read none
    sample = cut(labelled.where(draw < F.coalesce(*cases)).select("lang", "text").distinct())

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch), strict=True):
                b, n = trigram_counts(text)
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))[b] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["lang", "counts"])

    sums: dict[str, np.ndarray] = {lang: np.zeros(BUCKETS, np.int64) for lang in rate}
    for lang, counts in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        sums[lang] = sums[lang] + np.frombuffer(bytes(counts), "<i8")
    languages = sorted(x for x in sums if sums[x].sum())
    return Model(languages, np.stack([sums[x] for x in languages], axis=1) if languages else np.zeros((BUCKETS, 0)))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """lang_pred, score and n_langs for every whole text, from the text alone.

    docs: doc_id, text, and the columns named in keep (booleans); others are ignored. Null text and text without a
    letter: `und` with score 0. With no language learned all are `und`. Repeated rows get equal results; ties go to the
    language that sorts first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def rows(batches):
        for batch in pieces(batches):
            found = sent.value.predict(strings(batch))
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), longs([f[2] for f in found])], names=["doc_id", *keep, "lang_pred", "score", "n_langs"])

    extra = "".join(f", {k} boolean" for k in keep)
    return documents_of(docs, *keep).mapInArrow(trimmed(rows), f"doc_id long{extra}, lang_pred string, score double, n_langs long")


def identify_held_out(docs: DataFrame, modulus: int = 3, remainder: int = 1, per_language: int = 1500) -> DataFrame:
    """Learns from the documents that are not held out, predicts all: doc_id, held_out, lang_pred, score."""
    marked = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), held_out(modulus, remainder).alias("held_out"))
    model = train(marked.where(~F.col("held_out") & F.col("doc_id").isNotNull()), per_language)
    return identify(marked, model, "held_out").select("doc_id", "held_out", "lang_pred", "score", "n_langs")


CLEARLY = 30.0  # of log-likelihood, that "no language" must be ahead by


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text is in the learned languages.

    Rejected are texts without a letter, and texts for which "no language" (all trigrams equally likely) is clearly likelier
    than the chosen mixture, as for other scripts or encoded data. Where no language was learned, texts with a letter stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in pieces(batches):
            texts = strings(batch)
            if sent.value.languages:
                kept = sent.value.identified(texts)
            else:
                kept = [len(trigram_counts(t or "")[0]) > 0 for t in texts]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(trimmed(rows), docs.schema)


def learned_from(docs: DataFrame, per_language: int = 1500) -> Model:
    """A model from all documents with a language."""
    return train(docs.select("text", F.col("lang").cast("string").alias("lang")), per_language)
