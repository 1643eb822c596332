"""Line de-duplication over a corpus.

Method: each distinct line of a document becomes a row (128-bit hash, document, lines); the rows are
range-partitioned by (hash, document) and sorted, so that a line's occurrences stand together and one very common
line spreads over many partitions. Each partition is streamed; runs that touch a partition's edge are completed
from a small table of edges (two rows a partition). What comes back per document is a compressed bitmap of the
lines to keep, never text.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, cut, documents_of, partitions, pieces, strings, trimmed, utf8

_STRIP = BLANKS.encode()


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower() changes A-Z only


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h binary, doc_id, v, at binary): a row for each distinct key of min_chars code points or more in a document."""

    def rows(batches):
        for batch in pieces(batches):
            hs, ids, vs, ats = [], [], [], []
            for doc, v, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), utf8(batch), strict=True):
                found = defaultdict(list)
                for i, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if key and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        found[xxhash.xxh3_128_digest(key)].append(i)
                hs += found
                ids += [doc] * len(found)
                vs += [v] * len(found)
                ats += [np.array(x, "<u4").tobytes() for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(ids, pa.int64()), pa.array(vs, pa.int64()), pa.array(ats, pa.binary())], names=["h", "doc_id", "v", "at"])

    return docs.mapInArrow(trimmed(rows), "h binary, doc_id long, v long, at binary")


def _occurrences(batches):
    """The sorted rows (h, doc_id, v, at) of a partition, repeated rows once."""
    before = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != before:
                before = row[:3]
                yield row
        yield None  # the end of a batch


def _edges(batches):
    """One row: the first and the last hash of the partition, with the number of documents of each run."""
    first = last = None
    n_first = n_last = 0
    for row in _occurrences(batches):
        if row:
            if row[0] != last:
                if last is not None and first == last:
                    n_first = n_last
                if first is None:
                    first = row[0]
                last, n_last = row[0], 0
            n_last += 1
    if first is not None:
        alone = first == last
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([n_last if alone else n_first], pa.int64()), pa.array([last], pa.binary()), pa.array([0 if alone else n_last], pa.int64())], names=["first", "n_first", "last", "n_last"])


def _common(edge_counts: dict[bytes, int], min_docs: int):
    def stream(batches):
        found, held, now = [], [], None  # held: a run's rows until the run is long enough; min_docs at most
        common = inner = False
        for row in _occurrences(batches):
            if row is None:
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.int64()), pa.array([r[3] for r in found], pa.binary())], names=["doc_id", "v", "at"])
                found = []
                continue
            if row[0] != now:
                now, held = row[0], []
                inner = now not in edge_counts
                common = edge_counts.get(now, 0) >= min_docs
            if common:
                found.append(row)
            elif inner:
                held.append(row)
                if len(held) >= min_docs:
                    common = True
                    found += held
                    held = []

    return stream


def common_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, v, at): the occurrences of keys that min_docs documents or more have."""
    spark = rows.sparkSession
    rows = cut(rows)  # else the sampling for the ranges reads and splits all texts a second time
    dealt = cut(rows.repartitionByRange(partitions(spark), "h", "doc_id", "v").sortWithinPartitions("h", "doc_id", "v"))
    counts: dict[bytes, int] = defaultdict(int)
    for first, n_first, last, n_last in dealt.mapInArrow(_edges, "first binary, n_first long, last binary, n_last long").collect():  # one row a partition
        counts[bytes(first)] += n_first
        counts[bytes(last)] += n_last
    return dealt.mapInArrow(_common(dict(counts), min_docs), "doc_id long, v long, at binary")


def keep_bitmaps(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(doc_id, v, keep) of the documents that lose lines: a bit a line up to the last one that goes, in little-endian order,
    1 = keep, compressed with zlib. Later lines stay. docs: doc_id, text, v (xxhash64 of the text)."""
    drops = common_lines(line_rows(docs, min_chars), min_docs).groupBy("doc_id", "v").agg(F.collect_set("at").alias("drops"))  # as many as the document has lines

    def rows(batches):
        for batch in batches:
            keeps = []
            for ats in batch.column(2).to_pylist():
                gone = np.frombuffer(b"".join(ats), "<u4")
                keep = np.ones(int(gone.max()) // 8 * 8 + 8, bool)  # the bits that fill the last byte keep what there may be
                keep[gone] = False
                keeps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keeps, pa.binary())], names=["doc_id", "v", "keep"])

    return drops.mapInArrow(trimmed(rows), "doc_id long, v long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, np.ndarray, bytes]:
    """(lines, bits, text of the kept lines) of a text and its bitmap."""
    lines = text.split(b"\n")
    bits = np.ones(len(lines), bool)
    if keep:
        known = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
        bits[: len(known)] = known
        text = b"\n".join([x for x, k in zip(lines, bits.tolist(), strict=True) if k])
    return len(lines), bits, text


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Marks the lines whose key stands in min_docs documents or more.

    docs has doc_id and text; other columns are ignored. Lines are split at \\n; a key is the line without blanks
    (U+0020, U+0009 to U+000D) at both ends, A-Z lower-cased. A document is a distinct pair of doc_id and text:
    repeated rows count once, and each gets the same result. Null or empty text: one empty line, kept. A null doc_id
    is an id like any other. An empty table gives an empty result.

    Returns doc_id, n_lines, n_dropped, keep (see keep_bitmaps(); null where all lines stay), kept_text.
    """
    docs = documents_of(docs).withColumn("v", F.xxhash64("text"))
    bitmaps = keep_bitmaps(docs.select("doc_id", "text", "v"), min_docs, min_chars)

    def apply(batches):
        for batch in pieces(batches):
            n_lines, n_dropped, kept = [], [], []
            for raw, keep in zip(utf8(batch), batch.column(2).to_pylist(), strict=True):
                n, bits, text = kept_lines(raw, keep)
                n_lines.append(n)
                n_dropped.append(n - int(bits.sum()))
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), batch.column(2), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "keep", "kept_text"])

    joined = docs.alias("d").join(bitmaps.alias("k"), F.expr("d.doc_id <=> k.doc_id AND d.v = k.v"), "left").select("d.doc_id", "d.text", "k.keep")
    return joined.mapInArrow(trimmed(apply), "doc_id long, n_lines long, n_dropped long, keep binary, kept_text string")


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows of docs, all columns, their text without the lines that line_dedup() drops; n_chars follows the text.

    A null text stays null."""
    v = F.xxhash64(F.col("text").cast("string"))
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), v.alias("hash"))
    bitmaps = keep_bitmaps(documents_of(docs).withColumn("v", F.xxhash64("text")), min_docs, min_chars)
    joined = given.join(bitmaps, F.expr("id <=> doc_id AND hash = v"), "left").select("row.*", F.col("keep").alias("__keep"))

    def rows(batches):
        for batch in pieces(batches):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = [kept_lines(raw, keep)[2].decode() if keep else text for raw, text, keep in zip(utf8(batch), strings(batch), columns.pop("__keep").to_pylist(), strict=True)]
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(trimmed(rows), docs.schema)


def line_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    return line_dedup(docs, min_docs, min_chars).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
