"""SimHash fingerprints and near-duplicate groups.

Method: pivot distance tables. The Hamming distances of every fingerprint to a set of reference fingerprints are
computed first; by the triangle inequality two fingerprints within r bits differ by r at most in every coordinate, so
pairs with a larger coordinate difference are discarded and only survivors are compared bit by bit.

To spread the tables over a cluster, the distinct fingerprints are dealt by agreement: 64 bits are cut into r + 2
blocks, two of which agree in any pair within r bits, and each choice of two blocks is a key. That deal loses no pair.
Within a key the rows are sorted by the distance to the first pivot, so that only a window of 2 r + 1 distances is
compared. Very large keys are cut into parts of a bounded size.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import grouped, pair_blocks, salted_join
from ledgerloom.llm.common import Local, cut, documents_of, longs, mix, partitions, pieces, trimmed, utf8
from ledgerloom.llm.components import components

PIVOTS = mix(np.arange(1, 97, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(24, 4)
_PAIRS = 1 << 18  # pairs compared at a time


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of size words (all words, if fewer), repeats included; A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, seed)], np.uint64)
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)], np.uint64)


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Bit k is 1 if it is 1 in more than half of the shingle hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, size, seed)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, v, fp): fp as a signed 64-bit integer, v a hash of the text."""

    def rows(batches):
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, size, seed) for t in utf8(batch)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), longs(fps)], names=["doc_id", "v", "fp"])

    return documents_of(docs).withColumn("v", F.xxhash64("text")).mapInArrow(trimmed(rows), "doc_id long, v long, fp long")


def _compare(radius: int):
    def work(arrays, starts, ends):
        fps = arrays["fp"].astype(np.uint64)
        left, right = [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            group, sub, same = fps[a:b], arrays["sub"][a:b], arrays["i"][a] == arrays["j"][a]
            local = Local(len(group))
            for x, y in near(group, radius):
                if not same:
                    x, y = x[sub[x] != sub[y]], y[sub[x] != sub[y]]
                local.add(x, y)
            linked = np.flatnonzero(local.root != np.arange(len(group)))
            left.append(group[linked])
            right.append(group[local.root[linked]])
        yield pa.RecordBatch.from_arrays([longs(np.concatenate(left).astype(np.int64)), longs(np.concatenate(right).astype(np.int64))], names=["a", "b"])

    return work


def near(group: np.ndarray, radius: int, pivots: int = len(PIVOTS)):
    """Chunks (x, y) of positions in group with radius differing bits or fewer, each pair once.

    group: fingerprints as 64-bit words, or rows of several words."""
    group = group.reshape(len(group), -1)
    table = np.stack([np.bitwise_count(group ^ p[: group.shape[1]]).sum(axis=1, dtype=np.int16) for p in PIVOTS[:pivots]], axis=1)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_group = table[order], group[order]
    until = np.searchsorted(table[:, 0], table[:, 0] + radius, "right")
    widths = until - np.arange(len(group)) - 1
    total = np.r_[0, np.cumsum(widths)]
    a = 0
    while a < len(group):
        b = max(a + 1, int(np.searchsorted(total, total[a] + _PAIRS, "right")) - 1)
        x = np.repeat(np.arange(a, b), widths[a:b])
        y = np.arange(total[b] - total[a]) - np.repeat(total[a:b] - total[a], widths[a:b]) + x + 1
        for p in range(1, pivots):
            if not len(x):
                break
            close = np.abs(table[x, p] - table[y, p]) <= radius
            x, y = x[close], y[close]
        close = np.bitwise_count(sorted_group[x] ^ sorted_group[y]).sum(axis=1, dtype=np.int16) <= radius
        yield order[x[close]], order[y[close]]
        a = b


def near_fingerprints(distinct: DataFrame, radius: int, limit: int = 4096) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within radius bits, a spanning forest per block."""
    bounds = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    masks = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(x | y))).alias("key")) for t, (x, y) in enumerate(combinations(masks, 2))]
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", "k.key")
    dealt = pair_blocks(rows, ["t", "key"], "fp", limit)
    return grouped(dealt, ["t", "key", "i", "j"], _compare(radius), "a long, b long", ["t", "key", "i", "j", "sub", "fp"])


def smallest_ids(classes: DataFrame) -> DataFrame:
    """(f, component_id) of classes (fp, first, root): the smallest id of the component; root is null for classes that
    are linked with no other. A component may hold a large part of all classes, so its rows are spread for the join."""
    linked = classes.where("root is not null")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    found = salted_join(linked, smallest, ["root"], "fp").select(F.col("fp").alias("f"), "component_id")
    return found.union(classes.where("root is null").select("fp", "first"))


def simhash_groups(docs: DataFrame, size: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Groups documents whose fingerprints are linked by radius differing bits or fewer, directly or in steps.

    docs: doc_id, text; other columns are ignored. Words are runs without blanks (U+0020, U+0009 to U+000D), A-Z
    lower-cased. Null, empty and blank texts have fingerprint 0, linked like any other. Repeated rows get the same
    group. component_id is the smallest doc_id of the group (null ids don't count; null if all are null). Documents of
    one fingerprint are one node, so copies are never paired. An empty table gives an empty result.

    Returns doc_id, v (xxhash64 of the text), fp, component_id.
    """
    marked = cut(fingerprints(docs, size, seed))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(near_fingerprints(classes.select("fp"), radius))
    of_class = smallest_ids(classes.join(linked, classes.fp == linked.node, "left").select("fp", "first", F.col("component").alias("root")))
    return marked.join(of_class, marked.fp == of_class.f).select("doc_id", "v", "fp", "component_id")


def simhash_digest(docs: DataFrame, size: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    return simhash_groups(docs, size, radius, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- shingle sets, for a similarity well below 1

WORDS = 2  # 64-bit words of a wide fingerprint
BANDS, ROWS = 28, 4  # keys of a shingle set, and the smallest hashes that each is made of


def _wide(hashes: np.ndarray) -> bytes:
    """WORDS fingerprints in a row: of the distinct shingle hashes and of scramblings of them."""
    if not len(hashes):
        return bytes(8 * WORDS)
    counts = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        wide = np.stack([part, *[mix(part + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64)) for w in range(1, WORDS)]], axis=1)
        counts += np.unpackbits(np.ascontiguousarray(wide, "<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def differing_bits(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of shingle sets of one size."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def farthest(similarity: float, deviations: float = 8) -> int:
    """Differing bits of wide fingerprints that sets of the similarity stay within: so many standard deviations above
    the expected number that fewer than one such pair in a billion is lost, texts of a few shingles included."""
    p, n = differing_bits(similarity), 64 * WORDS
    return int(np.ceil(n * p + deviations * np.sqrt(n * p * (1 - p))))


_SALT, _FACTOR = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(2, -1) | np.array([[0], [1]], np.uint64)


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each of BANDS * ROWS scramblings; two sets agree in one with the probability of
    their Jaccard similarity."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1 << 12):
        np.minimum(out, ((hashes[k : k + (1 << 12), None] ^ _SALT) * _FACTOR).min(axis=0), out=out)
    return out


def band_keys(smallests: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS smallest hashes, for the sets (rows) of smallest(). Sets of similarity 0.8 share none of
    BANDS keys in (1 - 0.8 ** ROWS) ** BANDS of all cases, fewer than one in two million."""
    rows = smallests.reshape(len(smallests), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
    for k in range(ROWS):
        keys = mix(keys ^ rows[:, :, k])
    return keys.astype(np.int64)


def as_similar(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> bool:
    """Is the Jaccard similarity of two sets (sorted, distinct) at least that? In whole numbers."""
    union = len(np.union1d(a, b))
    return (len(a) + len(b) - union) * similarity.denominator >= union * similarity.numerator


def _shingle_set(line: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(line, size, 42))


def _stored(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, v, node, fp, n, keys, z), dealt by node: node is a hash of the distinct shingles, so that texts of one set are
    one node; n their number. keys (band_keys()) and z, the words, lower-cased, blank-joined and compressed, are sent once
    for a node and task."""

    def rows(batches):
        pack, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in pieces(batches):
            nodes, fps, ns, zs, new, smallests = [], [], [], [], [], []
            for text in utf8(batch):
                line = b" ".join(text.lower().split())
                hashes = _shingle_set(line, size)
                node = int(np.uint64(xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes())).astype(np.int64))
                nodes.append(node)
                fps.append(_wide(hashes))
                ns.append(len(hashes))
                new.append(node not in seen)
                zs.append(pack(line) if new[-1] else None)
                if new[-1]:
                    smallests.append(smallest(hashes))
                seen.add(node)
            keys = iter(band_keys(np.array(smallests)) if smallests else ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), longs(nodes), pa.array(fps, pa.binary()), longs(ns), pa.array([next(keys) if x else None for x in new], pa.list_(pa.int64())), pa.array(zs, pa.binary())], names=["doc_id", "v", "node", "fp", "n", "keys", "z"])

    made = documents_of(docs).withColumn("v", F.xxhash64("text")).mapInArrow(trimmed(rows), "doc_id long, v long, node long, fp binary, n long, keys array<long>, z binary")
    return cut(made.repartition(partitions(docs.sparkSession), "node").sortWithinPartitions("node"))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity, from the whole texts."""

    def rows(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held, of = None, None
        for batch in batches:
            keep = []
            for a, za, zb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if of is None or a != held:
                    held, of = a, _shingle_set(unpack(za), size)
                keep.append(as_similar(of, _shingle_set(unpack(zb), size), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    left = texts.select(F.col("node").alias("a"), F.col("z").alias("za"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "za", "zb")
    return cut(both.mapInArrow(trimmed(rows), "a long, b long"))


STARS = 8  # bands in which each set is first put to the smallest one of its key


def _star_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): each node with the most central node of its key in a few bands: STARS pairs a node at most. Central is a node
    that shares its keys with many others, as the text that near copies were made from does: it is similar to all of them,
    while two of them may differ more. So a large group is joined early, and its pairs are not met again."""
    rows = texts.where("n > 0").select("node", F.explode(F.slice("keys", 1, STARS)).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = cut(salted_join(rows, shared, ["key"], "node"))
    central = met.groupBy("node").agg(F.sum("size").alias("score"))
    hubs = met.join(central, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    return salted_join(met.select("key", "node"), hubs, ["key"], "node").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


DENSE = 8  # pairs that are still open, for each set of a block, beyond which a block is dense


def _compare_wide(radius: int, similarity: Fraction):
    """Pairs (a, b) of different components and of like sizes whose fingerprints are near; they are still to be verified. A
    block that has very many of them gives itself instead: a row (node, null, key, i, j) for each of its sets."""

    def work(arrays, starts, ends):
        s = float(similarity) - 1e-9
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            group = np.frombuffer(b"".join(arrays["fp"][a:b]), "<u8").reshape(b - a, WORDS)
            node, sub, n, root = (arrays[c][a:b] for c in ("node", "sub", "n", "root"))
            same = arrays["i"][a] == arrays["j"][a]
            if (root == root[0]).all():
                continue
            held, total = [], 0
            for x, y in near(group, radius, pivots=4):
                open_ = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= s * np.maximum(n[x], n[y]))
                if not same:
                    open_ &= sub[x] != sub[y]
                held.append((node[x[open_]], node[y[open_]]))
                total += int(open_.sum())
                if total > DENSE * (b - a):
                    break
            if total > DENSE * (b - a):
                place = [longs(np.full(b - a, arrays[c][a])) for c in ("key", "i", "j")]
                yield pa.RecordBatch.from_arrays([longs(node), longs([None] * (b - a)), *place, longs(sub)], names=["a", "b", "key", "i", "j", "sub"])
            elif total:
                x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([longs(np.maximum(x, y)), longs(np.minimum(x, y)), *[longs([None] * total)] * 4], names=["a", "b", "key", "i", "j", "sub"])

    return work


def _within(similarity: Fraction, size: int):
    """A spanning forest of the links of dense blocks, from the whole sets: what two sets share is counted for all pairs at
    once, as the product of the sets by shingles with itself."""

    def work(arrays, starts, ends):
        unpack = zstandard.ZstdDecompressor().decompress
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            node, sub = arrays["node"][a:b], arrays["sub"][a:b]
            same = arrays["i"][a] == arrays["j"][a]
            sets = [_shingle_set(unpack(z), size) for z in arrays["z"][a:b]]
            n = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(b - a), n)
            _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            common = often > 1  # shingles of one set alone are shared by no pair
            order = np.argsort(shingle, kind="stable")
            order = order[common[shingle[order]]]
            shingle, owner = (np.cumsum(common) - 1)[shingle[order]], owner[order]
            shared, step, last = np.zeros((b - a, b - a), np.float32), max(1, (1 << 23) // (b - a)), int(common.sum())
            for k in range(0, last, step):
                at = slice(*np.searchsorted(shingle, [k, k + step]))
                has = np.zeros((b - a, min(step, last - k)), np.float32)
                has[owner[at], shingle[at] - k] = 1
                shared += has @ has.T
            union = n[:, None] + n[None, :] - shared
            close = shared.astype(np.int64) * similarity.denominator >= union.astype(np.int64) * similarity.numerator
            if not same:
                close &= sub[:, None] != sub[None, :]
            local = Local(b - a)
            local.add(*np.nonzero(np.triu(close, 1)))
            linked = np.flatnonzero(local.root != np.arange(b - a))
            if len(linked):
                yield pa.RecordBatch.from_arrays([longs(node[linked]), longs(node[local.root[linked]])], names=["a", "b"])

    return work


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, limit: int = 1024) -> DataFrame:
    """Groups documents whose sets of five-word shingles (size) have the Jaccard similarity or more, directly or in steps.

    Every link is verified on the whole sets, pair by pair or, in blocks with very many open pairs, all of a block at once
    (their pairs are never written out). Pairs meet by equal band keys (band_keys()); among those that meet, the
    pivot table and popcount leave the ones with near fingerprints (farthest()). Copies that are joined already by the
    central node of a key are not paired again.

    The bound on blocks, nulls, repeated rows and empty tables are as in simhash_groups(); texts without words are one
    group. Returns doc_id, v, fp (binary), component_id.
    """
    exact = Fraction(str(similarity))
    radius = farthest(similarity)
    stored = _stored(docs, size)
    texts = stored.where("z is not null").select("node", "fp", "n", "keys", "z").dropDuplicates(["node"])
    classes = cut(stored.groupBy("node").agg(F.min("doc_id").alias("first")))
    early = _verified(_star_pairs(texts), texts, size, exact)
    joined = components(early).withColumnRenamed("node", "member")
    known = cut(texts.join(joined, texts.node == joined.member, "left").where("n > 0").select("node", "fp", "n", "keys", F.coalesce("component", "node").alias("root")))
    met = known.select("node", "fp", "n", "root", F.explode("keys").alias("key"))
    dealt = pair_blocks(met, ["key"], "node", limit)
    found = cut(grouped(dealt, ["key", "i", "j"], _compare_wide(radius, exact), "a long, b long, key long, i long, j long, sub long", ["key", "i", "j", "sub", "node", "n", "root", "fp"]))
    pairs = found.where("b is not null").select("a", "b").distinct()
    links = early.union(_verified(pairs, texts, size, exact))
    dense = found.where("b is null").select(F.col("a").alias("node"), "key", "i", "j", "sub")
    if not dense.isEmpty():  # else the texts need not be sent for them
        links = links.union(grouped(dense.join(texts.select("node", "z"), "node"), ["key", "i", "j"], _within(exact, size), "a long, b long", ["key", "i", "j", "sub", "node", "z"]))
    linked = components(links).withColumnRenamed("node", "member")
    of_class = smallest_ids(classes.join(linked, classes.node == linked.member, "left").select(F.col("node").alias("fp"), "first", F.col("component").alias("root")))
    return stored.join(of_class, stored.node == of_class.f).select("doc_id", "v", stored.fp, "component_id")


def one_of_each_group(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that stand for their group in similar_groups(): the smallest doc_id, of several
    texts with that id the one with the smallest hash. Rows that repeat both are one document and stay together; a
    group without any doc_id keeps the text with the smallest hash."""
    groups = similar_groups(docs, size, similarity)
    # every row knows its group's component; a group of null ids is told by its fingerprint
    best = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")).alias("b"))
    kept = best.select(F.col("b.doc_id").alias("kept_id"), F.col("b.v").alias("kept_v"))
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    return given.join(kept, F.expr("id <=> kept_id AND hash = kept_v"), "left_semi").select("row.*")
