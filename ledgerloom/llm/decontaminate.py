"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

The automaton's letters are word numbers: words of the items get a number, all other words are 0. Any 13 consecutive words
of an item hold one of its blocks of 7 words (cut at multiples of 7) whole, so the automaton holds these blocks only, a
node for each word of the benchmark, and items of fewer than 13 words whole. Each text is scanned once; from a block that
is found the match is followed to both sides, and a run of 13 words or more, all of whose words stand in windows, is hit.
Word numbers lead back to offsets in the original text.

The items go to all tasks; their size is checked, and a benchmark larger than the bound is put to the texts in parts, one
after the other, whose hits are united.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, documents_of, kept, pieces, strings, trimmed, utf8

#: A-Z to a-z; other ASCII characters that are neither letter nor digit to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Items:
    """The automaton over the benchmark's items (id, text), and what is needed to follow a match."""

    def __init__(self, items: list[tuple], size: int):
        self.size, self.block = size, (size + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.texts: dict[tuple[int, ...], set] = {}  # word numbers of each distinct item: its ids
        for item, text in items:
            words = normal_words((text or "").encode())
            if words:
                self.texts.setdefault(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), set()).add(item)
        self.items = [(np.array(t, np.int64), ids) for t, ids in self.texts.items()]
        spots: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, words in enumerate(self.texts):
            step = self.block if len(words) >= size else len(words)
            for at in range(0, len(words) - step + 1, step):
                spots.setdefault(words[at : at + step], []).append((k, at))
        del self.texts
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, places in spots.items():
            self.machine.add_word(pattern, (len(pattern), places))
        self.empty = not spots
        if spots:
            self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words stand in an occurrence of a window; the items of these windows."""
        edges, found = np.zeros(len(words) + 1, np.int64), set()
        if words and not self.empty:
            ids = [self.numbers.get(w, 0) for w in words]
            text = np.array(ids, np.int64)
            done: dict[tuple[int, int], int] = {}  # for an item and a diagonal: up to where the text has been compared
            for end, (length, places) in self.machine.iter(tuple(ids)) if any(ids) else ():
                first = end - length + 1
                for k, at in places:
                    if done.get((k, first - at), -1) >= end:
                        continue
                    item, owners = self.items[k]
                    left, right = self._run(text, item, first, at)
                    done[k, first - at] = right - 1
                    if right - left >= min(self.size, len(item)):
                        edges[left] += 1
                        edges[right] -= 1
                        found |= owners
        return np.cumsum(edges[:-1]) > 0, found

    def _run(self, text: np.ndarray, item: np.ndarray, first: int, at: int) -> tuple[int, int]:
        """The longest stretch of the text around first that the item repeats around at."""
        back, ahead = min(first, at), min(len(text) - first, len(item) - at)
        same = text[first - back : first + ahead] == item[at - back : at + ahead]
        other = np.flatnonzero(~same)
        k = np.searchsorted(other, back)
        left = other[k - 1] + 1 if k else 0
        right = other[k] if k < len(other) else len(same)
        return first - back + int(left), first - back + int(right)


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as offsets (code points, end exclusive) in the original text."""
    out: list[dict] = []
    before = False
    for m, h in zip(_WORD.finditer(text), hit.tolist(), strict=True):
        if h and before:
            out[-1]["end"] = m.end()
        elif h:
            out.append({"start": m.start(), "end": m.end()})
        before = h
    return out


MAX_BYTES = 8 << 20  # of the items that are put to the texts together: an automaton takes some 30 bytes for each


def parts_of(benchmark: DataFrame, max_bytes: int):
    """The distinct items, in as many parts as the bound asks for, each with whether it is the last (which may be empty); one
    part at a time is on the driver. A single item that is larger than the bound is a part of its own, of its own size."""
    # cut, because toLocalIterator() reads on when its action has ended and tidy_shuffles() takes the shuffle away
    items = cut(benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // max_bytes)) if total > max_bytes else 1  # parts by hash: half full on average
    for k in range(n):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator()]
        if part or k == n - 1:
            yield part, k == n - 1


def with_hits(docs: DataFrame, benchmark: DataFrame, size: int, max_bytes: int, finish: Callable, schema) -> DataFrame:
    """What finish makes of each batch of docs (with text; other columns stay) with __hit, a bit for each word of the text that
    stands in a window (packed and compressed, null for none), and __items, the ids found.

    The last pass over the items calls finish itself: two Python steps in a row would take two workers a task, which live
    on in the executor for the steps that follow and each hold what those keep."""
    context, key = docs.sparkSession.sparkContext, uuid.uuid4().hex
    marked = docs.withColumn("__hit", F.lit(None).cast("binary")).withColumn("__items", F.array().cast("array<string>"))
    between = marked.schema
    for k, (part, last) in enumerate(parts_of(benchmark, max_bytes)):

        def rows(batches, sent=context.broadcast(part), name=f"{key}-{k}", last=last):
            items = kept(("items", name, size), lambda: Items(sent.value, size))
            for batch in pieces(batches):
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                bits, ids = [], []
                for raw, z, found in zip(utf8(batch), columns["__hit"].to_pylist(), columns["__items"].to_pylist(), strict=True):
                    hit, more = items.hits(normal_words(raw))
                    if hit.any():
                        z = zlib.compress(np.packbits(hit | _bits(z, len(hit))).tobytes())
                    bits.append(z)
                    ids.append(sorted({*found, *(x for x in more if x is not None)}))
                columns |= {"__hit": pa.array(bits, pa.binary()), "__items": pa.array(ids, pa.list_(pa.string()))}
                found = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                yield finish(found) if last else found

        before = cut(marked) if k else marked  # so that a worker holds one part's automaton
        marked = before.mapInArrow(trimmed(rows, keeps=True), schema if last else between)
    return marked


def _bits(z: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(z), np.uint8), count=n).astype(bool) if z else np.zeros(n, bool)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Finds benchmark passages in whole texts.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A word is a run of ASCII letters or
    digits (A-Z lower-cased) and all non-ASCII characters. A window is size consecutive words of an item; an item
    of fewer words, but not none, is one window. A word of a document inside any occurrence of a window is hit.
    A document with a hit is contaminated if one word in one_in or more is hit. Null or empty text has no
    words and is clean; items that are null, empty or repeated are harmless; an empty benchmark leaves all clean.

    The items are broadcast, about max_bytes of them at a time; a larger benchmark takes more passes, with equal results.
    Returns a row per input row: doc_id, n_words, n_hit, items (ids as strings, sorted), contaminated, spans (offsets
    of the hit passages in the original text).
    """

    def told(batch):
        n_words, n_hit, flags, spans = [], [], [], []
        for raw, text, z in zip(utf8(batch), strings(batch), batch.column(2).to_pylist(), strict=True):
            words = len(normal_words(raw))
            hit = _bits(z, words)
            n = int(hit.sum())
            n_words.append(words)
            n_hit.append(n)
            flags.append(n > 0 and one_in * n >= words)
            spans.append(original_spans(text, hit) if n else [])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), batch.column(3), pa.array(flags, pa.bool_()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_hit", "items", "contaminated", "spans"])

    return with_hits(documents_of(docs), benchmark, size, max_bytes, told, "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean, spans array<struct<start:long,end:long>>")


def contamination_digest(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20) -> DataFrame:
    found = decontaminate(docs, benchmark, size, one_in)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs, all columns, that decontaminate() does not call contaminated."""

    def kept_rows(batch):
        keep = []
        for raw, z in zip(utf8(batch), batch.column(batch.schema.get_field_index("__hit")).to_pylist(), strict=True):
            words = len(normal_words(raw)) if z else 0
            keep.append(not (z and one_in * int(_bits(z, words).sum()) >= words))
        return batch.select(names).filter(pa.array(keep, pa.bool_()))

    names = docs.columns
    return with_hits(docs, benchmark, size, max_bytes, kept_rows, docs.schema)
