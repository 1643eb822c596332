"""Removal of word windows that an earlier document already has.

Method: a count-min prefilter, then exact grouping of the windows that it leaves.

The sketch has ROWS rows of counters. In each row a window of 13 words has one counter, chosen by the smallest hash
among its 6-word grams, so that equal windows always share it and neighbouring windows mostly do. Each stored part of
the corpus makes a sketch of its own: how many of its documents touch a counter, two at most. The sketches are cut into
ranges of counters (shards), merged by adding up, and each part is told which of its counters reach two. A counter is
never below the number of documents that have a window of it, so a window that is left out stands in one document only.

The second pass hashes the windows all of whose counters reach two (128 bits). Each part settles its own documents
first and sends a window once, for the smallest document id it has there; the smallest id of all parts then decides.
So a passage that very many documents share is one entry for each part, in the sketch as in the exact grouping.

Whole copies are put aside first: only the copy with the smallest id is searched (windows of the others start in it,
too). Texts are moved between machines once, compressed, and written to the shared folder dealt by document, so that
what the passes find is joined to them without moving them again.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, documents_of, longs, mix, partitions, pieces, trimmed, utf8
from ledgerloom.llm.units import Powers

GRAM = 6
ROWS = 2
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64) for r in range(ROWS)]
_TEXT = 1 << 20  # bytes of text hashed at a time
_CHUNK = 1 << 19  # candidate windows that a task holds before it settles and sends them


class Sketch:
    """The shape of the sketch: shards ranges of width counters in each row."""

    def __init__(self, words: int, tasks: int, shard_words: int):
        self.shards = max(1, -(-words // shard_words), min(tasks, words // 500_000))
        self.width = 1 << max(12, int(-(-words // self.shards)).bit_length())  # a counter or more for each word
        if self.shards * self.width > 1 << 46:
            raise ValueError("more words than the sketch has numbers for")

    def counters(self, smallest: np.ndarray) -> np.ndarray:
        """Counters (shard * width + place) for the smallest gram hashes of windows."""
        h = mix(smallest + np.uint64(0xD6E8FEB86659FD93))
        return h % np.uint64(self.shards) * np.uint64(self.width) + (h >> np.uint64(16)) % np.uint64(self.width)


class Windows:
    """All windows of some texts (words joined by single blanks): doc (their text), at (their first word), start and end
    (bytes of data), smallest (of each sketch row, the smallest gram hash)."""

    def __init__(self, powers: Powers, lines: list[bytes], numbers: list[int], first_words: list[int], size: int):
        self.raw = b" ".join(lines)
        data = np.frombuffer(self.raw, np.uint8)
        up, down = powers.upto(len(data) + 1)
        blanks = np.flatnonzero(data == 32)
        starts, ends = np.r_[0, blanks + 1], np.r_[blanks, len(data)]
        n_words = np.array([x.count(b" ") + 1 for x in lines])
        begin = np.cumsum(n_words) - n_words
        text = np.repeat(np.arange(len(lines)), n_words)
        n = len(starts)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
        gram = min(GRAM, size)
        h = (sums[ends[gram - 1 :]] - sums[starts[: n - gram + 1]]) * down[starts[: n - gram + 1]]
        whole = np.flatnonzero(text[: max(0, n - size + 1)] == text[size - 1 :])
        self.doc, self.at = np.array(numbers)[text[whole]], whole - begin[text[whole]] + np.array(first_words)[text[whole]]
        self.start, self.end = starts[whole], ends[whole + size - 1]
        self.smallest = []
        for salt in _SALTS:
            g = mix(h ^ salt)
            low = g[: n - size + 1].copy()
            for k in range(1, size - gram + 1):
                np.minimum(low, g[k : n - size + 1 + k], out=low)
            self.smallest.append(low[whole])

    def runs(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(first window, length) of the runs of windows of one text that share their smallest hash."""
        s = self.smallest[row]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (self.doc[1:] != self.doc[:-1])]) if len(s) else np.empty(0, np.int64)
        return first, np.diff(np.r_[first, len(s)])


def segments(line: bytes, size: int, limit: int = _TEXT):
    """(number of the first word, piece) of a text; pieces overlap by size - 1 words, so that they hold all its windows."""
    word = at = 0
    while len(line) - at > limit:
        end = line.find(b" ", at + limit)
        if end < 0:
            break
        piece = line[at:end]
        yield word, piece
        tail = piece.split(b" ")[1 - size :] if size > 1 else []
        word += piece.count(b" ") + 1 - len(tail)
        at = end + 1 - sum(len(w) + 1 for w in tail)
    yield word, line[at:]


def windows_of(texts, size: int):
    """Windows of (number, line) texts, about _TEXT bytes at a time."""
    powers, lines, numbers, first_words, held = Powers(), [], [], [], 0
    for number, line in texts:
        for word, piece in segments(line, size):
            lines.append(piece)
            numbers.append(number)
            first_words.append(word)
            held += len(piece)
            if held >= _TEXT:
                yield Windows(powers, lines, numbers, first_words, size)
                lines, numbers, first_words, held = [], [], [], 0
    if lines:
        yield Windows(powers, lines, numbers, first_words, size)


# ---------------------------------------------------------------- packed numbers


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers below 2 ** 32: their differences, byte by byte of all, compressed."""
    steps = np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def unpacked(z: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u4").reshape(-1), dtype=np.int64)


def _line(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


# ---------------------------------------------------------------- passes


def _store(docs: DataFrame) -> DataFrame:
    """(doc_id, v, dg, n_words, sha, z, part): each row's words, blank-joined and compressed, dealt by (doc_id, v) and
    sorted by them in each part; dg is the 128-bit hash of the words, v its first half."""

    def rows(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches):
            lines = [b" ".join(t.split()) for t in utf8(batch)]
            dgs = [xxhash.xxh3_128_digest(x) for x in lines]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), longs(np.frombuffer(b"".join(dgs), "<i8")[::2]), pa.array(dgs, pa.binary()), longs([x.count(b" ") + 1 if x else 0 for x in lines]), pa.array([hashlib.sha256(x).hexdigest() for x in lines]), pa.array([pack(x) for x in lines], pa.binary())],
                names=["doc_id", "v", "dg", "n_words", "sha", "z"],
            )

    made = docs.mapInArrow(trimmed(rows), "doc_id long, v long, dg binary, n_words long, sha string, z binary")
    dealt = made.repartition(partitions(docs.sparkSession), "doc_id", "v").sortWithinPartitions("doc_id", "v")
    return cut(dealt.withColumn("part", F.spark_partition_id()))


_CELLS = "shard int, row int, doc_id long, v long, cells binary, twice binary"


def _fill(size: int, sketch: Sketch):
    """The sketch of a part, cut into shards: counters touched (cells), and which of them by two documents or more. It is
    addressed by the part's first document (doc_id, v)."""

    def rows(batches):
        lead, held = None, [[] for _ in range(ROWS)]

        def texts():
            nonlocal lead
            number = 0
            for batch in pieces(batches, "z", 4 << 20):
                for doc, v, z in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    lead = lead or (doc, v)
                    yield number, _line(z)
                    number = (number + 1) % (1 << 16)

        for w in windows_of(texts(), size):
            for r in range(ROWS):
                first, _ = w.runs(r)
                cells = sketch.counters(w.smallest[r][first])
                held[r].append(np.unique(cells << np.uint64(16) | w.doc[first].astype(np.uint64)) >> np.uint64(16))
        for r in range(ROWS):
            if not held[r]:
                continue
            cells = np.sort(np.concatenate(held[r]))
            at = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            cells, twice = cells[at], np.diff(np.r_[at, len(cells)]) > 1
            edges = np.searchsorted(cells, np.arange(sketch.shards + 1, dtype=np.uint64) * np.uint64(sketch.width))
            for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                a, b = edges[s], edges[s + 1]
                yield pa.RecordBatch.from_pylist([{"shard": s, "row": r, "doc_id": lead[0], "v": lead[1], "cells": packed(cells[a:b] - np.uint64(s * sketch.width)), "twice": np.packbits(twice[a:b]).tobytes()}], schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("v", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])
    return rows


def _merge(sketch: Sketch):
    """Adds up the parts' sketches of each shard and tells each part which of its counters reach two."""

    def rows(batches):
        shards = defaultdict(list)
        for batch in batches:
            for b in batch.to_pylist():
                shards[b["shard"], b["row"]].append(b)
        for (shard, row), parts in shards.items():
            counts = np.zeros(sketch.width, np.uint8)
            for b in parts:
                at = unpacked(b["cells"])
                counts[at] = np.minimum(counts[at] + 1 + np.unpackbits(np.frombuffer(b["twice"], np.uint8), count=len(at)), 2)
            for k in range(0, len(parts), 64):
                out = [(b, (at := unpacked(b["cells"]))[counts[at] > 1]) for b in parts[k : k + 64]]
                yield pa.RecordBatch.from_arrays([longs([b["doc_id"] for b, _ in out]), longs([b["v"] for b, _ in out]), pa.array([shard] * len(out), pa.int32()), pa.array([row] * len(out), pa.int32()), pa.array([packed(x) for _, x in out], pa.binary())], names=["doc_id", "v", "shard", "row", "cells"])

    return rows


_FOUND = "shard int, ids array<long>, vs array<long>, row binary, at binary, hash binary"
_FOUND_SCHEMA = pa.schema([("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("vs", pa.list_(pa.int64())), ("row", pa.binary()), ("at", pa.binary()), ("hash", pa.binary())])


def _found(shard: int, ids: np.ndarray, vs: np.ndarray, row: np.ndarray, at: np.ndarray, hashes: np.ndarray | None) -> pa.RecordBatch:
    docs, number = np.unique(row, return_inverse=True)
    return pa.RecordBatch.from_pylist([{"shard": shard, "ids": ids[docs].tolist(), "vs": vs[docs].tolist(), "row": number.astype("<u4").tobytes(), "at": at.astype("<u4").tobytes(), "hash": None if hashes is None else hashes.tobytes()}], schema=_FOUND_SCHEMA)


def _candidates(size: int, sketch: Sketch):
    """Windows all of whose counters reach two, hashed: a row for each shard with those of the smallest document id that
    the part has for a hash, and one (without hashes) with the windows that the part's other documents lose to it.

    Rows of a part whose answer from the sketch does not stand before them are searched without it: nothing is lost."""

    def rows(batches):
        known, flagged = None, None  # the part whose counters are loaded, and they
        ids, vs, held, n = [], [], [], 0

        def load(answers):
            cells = [[] for _ in range(ROWS)]
            for a in answers:
                cells[a["row"]].append(unpacked(a["cells"]).astype(np.uint64) + np.uint64(a["shard"] * sketch.width))
            return [np.sort(np.concatenate(c)) if c else np.empty(0, np.uint64) for c in cells]

        def texts(batch):
            nonlocal known, flagged
            for doc, v, z, part, answers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if answers:
                    known, flagged = part, load(answers)
                ids.append(doc)
                vs.append(v)
                yield flagged if part == known else None, len(ids) - 1, _line(z)

        def repeated(w: Windows, twice: list[np.ndarray] | None) -> np.ndarray:
            chosen = np.ones(len(w.doc), bool)
            for r, there in enumerate(twice or ()):
                first, length = w.runs(r)
                cells = sketch.counters(w.smallest[r][first])
                place = np.minimum(np.searchsorted(there, cells), max(0, len(there) - 1))
                chosen &= np.repeat(there[place] == cells if len(there) else np.zeros(len(first), bool), length)
            return np.flatnonzero(chosen)

        def settle():
            row, at, shard, h = (np.concatenate([x[k] for x in held]) for k in range(4))
            ids_, vs_ = np.array(ids, np.int64), np.array(vs, np.int64)
            order = np.lexsort((ids_[row], h[:, 1], h[:, 0]))
            row, at, shard, h = row[order], at[order], shard[order], h[order]
            starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(axis=1)])
            doc = ids_[row]
            lost = doc != np.repeat(doc[starts], np.diff(np.r_[starts, len(doc)]))
            if lost.any():
                yield _found(int(shard[0]), ids_, vs_, row[lost], at[lost], None)
            row, at, shard, h = row[~lost], at[~lost], shard[~lost], h[~lost]
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(sketch.shards + 1))
            for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                chosen = order[edges[s] : edges[s + 1]]
                yield _found(s, ids_, vs_, row[chosen], at[chosen], h[chosen])

        def searched(texts_, twice):
            nonlocal n
            digest = xxhash.xxh3_128_digest
            for w in windows_of(texts_, size):
                chosen = repeated(w, twice)
                if len(chosen):
                    found = b"".join([digest(w.raw[a:b]) for a, b in zip(w.start[chosen].tolist(), w.end[chosen].tolist(), strict=True)])
                    shard = (sketch.counters(w.smallest[0][chosen]) // np.uint64(sketch.width)).astype(np.int64)
                    held.append((w.doc[chosen], w.at[chosen], shard, np.frombuffer(found, "<u8").reshape(-1, 2)))
                    n += len(chosen)

        for batch in pieces(batches, "z", 2 << 20):
            same, block = None, []  # texts that are searched with one set of counters
            for twice, number, line in texts(batch):
                if block and twice is not same:
                    searched(block, same)
                    block = []
                same = twice
                block.append((number, line))
            searched(block, same)
            if n >= _CHUNK:
                yield from settle()
                ids, vs, held, n = [], [], [], 0
        if n:
            yield from settle()

    return rows


def _runs(at: np.ndarray, size: int) -> bytes:
    """Windows (by their first word) as runs of words: pairs of first and end."""
    at = np.unique(at).astype(np.int64)
    first = np.r_[True, np.diff(at) > size]
    last = np.r_[np.diff(at) > size, True]
    return np.stack([at[first], at[last] + size], axis=1).astype("<u4").tobytes()


def _decide(size: int):
    """The words that each document loses to a smaller id, from all of a shard's windows."""

    def rows(batches):
        shards = defaultdict(list)
        for batch in batches:
            for b in batch.to_pylist():
                shards[b["shard"]].append(b)
        for parts in shards.values():
            ids, vs, row, at, hashes, settled = [], [], [], [], [], []
            for b in parts:
                row.append(np.frombuffer(b["row"], "<u4").astype(np.int64) + len(ids))
                at.append(np.frombuffer(b["at"], "<u4"))
                hashes.append(np.frombuffer(b["hash"], "<u8").reshape(-1, 2) if b["hash"] is not None else np.zeros((len(at[-1]), 2), np.uint64))
                settled.append(np.full(len(at[-1]), b["hash"] is None))
                ids += b["ids"]
                vs += b["vs"]
            ids, vs, row, at, h, settled = np.array(ids, np.int64), np.array(vs, np.int64), *(np.concatenate(x) for x in (row, at, hashes, settled))
            open_ = np.flatnonzero(~settled)
            order = open_[np.lexsort((ids[row[open_]], h[open_, 1], h[open_, 0]))]
            starts = np.flatnonzero(np.r_[True, (h[order[1:]] != h[order[:-1]]).any(axis=1)]) if len(order) else order
            doc = ids[row[order]]
            lost = np.r_[np.flatnonzero(settled), order[doc != np.repeat(doc[starts], np.diff(np.r_[starts, len(order)]))]]
            lost = lost[np.argsort(row[lost], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, row[lost[1:]] != row[lost[:-1]]]) if len(lost) else lost
            ends = np.r_[cuts[1:], len(lost)] if len(lost) else cuts
            yield pa.RecordBatch.from_arrays([longs(ids[row[lost[cuts]]]), longs(vs[row[lost[cuts]]]), pa.array([_runs(at[lost[a:b]], size) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["doc_id", "v", "lost"])

    return rows


def _strip(size: int):
    def rows(batches):
        for batch in pieces(batches, "z", 4 << 20):
            removed, shas = [], []
            for n, sha, z, copy, lost in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                if copy and n >= size:
                    removed.append(n)
                    shas.append(hashlib.sha256(b"").hexdigest())
                elif lost:
                    edges = np.zeros(n + 1, np.int64)
                    runs = np.frombuffer(b"".join(lost), "<u4").reshape(-1, 2)
                    np.add.at(edges, runs[:, 0], 1)
                    np.add.at(edges, runs[:, 1], -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(b" ".join([w for w, g in zip(_line(z).split(b" "), gone.tolist(), strict=True) if not g])).hexdigest())
                else:
                    removed.append(0)
                    shas.append(sha)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), longs(removed), pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows


def substring_dedup(docs: DataFrame, size: int = 13, shard_words: int = 4_000_000) -> DataFrame:
    """Removes each word that a window of size words covers whose words also start in a document with a smaller id.

    docs: doc_id, text; other columns are ignored. Words are runs without blanks (U+0020, U+0009 to U+000D), unchanged;
    null or empty text has none. Windows are judged on the input. Rows with one doc_id never remove each other's
    words; repeated rows get the same result. A null doc_id is not smaller or larger than any other: such rows stay
    whole and remove nothing. An empty table gives an empty result.

    shard_words: the corpus's words for each shard of the sketch, which bounds a merging task's memory.
    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one blank).
    """
    stored = _store(documents_of(docs))
    firsts = cut(stored.where("doc_id is not null").groupBy("dg").agg(F.min("doc_id").alias("doc_id"), F.first("v").alias("v"), F.max("n_words").alias("n")))
    sketch = Sketch(firsts.agg(F.sum("n")).first()[0] or 0, partitions(docs.sparkSession), shard_words)
    searched = stored.join(firsts.where(F.col("n") >= size).select("doc_id", "v"), ["doc_id", "v"], "left_semi").select("doc_id", "v", "z", "part")
    filled = searched.mapInArrow(trimmed(_fill(size, sketch)), _CELLS).repartitionById(sketch.shards, F.col("shard"))
    answers = filled.mapInArrow(trimmed(_merge(sketch)), "doc_id long, v long, shard int, row int, cells binary").groupBy("doc_id", "v").agg(F.collect_list(F.struct("shard", "row", "cells")).alias("answers"))
    asked = searched.join(answers, ["doc_id", "v"], "left").select("doc_id", "v", "z", "part", "answers")
    found = asked.mapInArrow(trimmed(_candidates(size, sketch)), _FOUND).repartitionById(sketch.shards, F.col("shard"))
    lost = found.mapInArrow(trimmed(_decide(size)), "doc_id long, v long, lost binary").groupBy("doc_id", "v").agg(F.collect_list("lost").alias("lost"))
    copies = firsts.select("doc_id", "v", F.lit(False).alias("copy"))
    on = lambda right: (F.col("s.doc_id") == F.col(f"{right}.doc_id")) & (F.col("s.v") == F.col(f"{right}.v"))
    out = stored.alias("s").join(copies.alias("c"), on("c"), "left").join(lost.alias("l"), on("l"), "left")
    return out.select("s.doc_id", "s.v", "s.n_words", "s.sha", "s.z", F.expr("c.copy is null and s.doc_id is not null").alias("copy"), "l.lost").mapInArrow(trimmed(_strip(size)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
