"""Token ids in compact binary files.

Layout: a folder with two Parquet tables that hold binary payloads, so that any store Spark writes to can hold them and
a lost task leaves nothing behind.

- header: one row; code_lengths: one byte an id (0: the id does not occur), limit: the longest code allowed.
- blocks: part, block (ascending document order), doc_ids, doc_lengths (token counts in this block), before (tokens of
  the part ahead of the block), begun and goes_on (see below), n_tokens (BLOCK_TOKENS at most), payload (canonical Huffman codes, most
  significant bit first), checkpoints (little-endian unsigned 32-bit bit offsets, one for each STEP tokens).

A block is decoded on its own: canonical codes follow from the lengths; the decoder looks limit bits up in a table and
runs all checkpoints of a block side by side. A document of more than BLOCK_TOKENS tokens
has blocks of its own: begun is how many of its tokens stand in earlier blocks, goes_on whether there are later ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, documents_of, kept, longs, new_path, partitions, pieces, trimmed
from ledgerloom.llm.units import Units, buffers

STEP = 256
BLOCK_TOKENS = 1 << 17
LIMIT = 18


# ---------------------------------------------------------------- tokenising


class WordTokens:
    """Ids of whole texts by the tokenizers library.

    A byte-level BPE whose splitting pattern starts a new piece at every single blank between two characters that are
    not white space gives the same ids unit by unit as for the whole text. Texts with other white space beside a
    blank, or with a special token in them, go to the library whole. New units go to it together, in one text; a
    token that starts with a blank starts a unit there.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        described = self.tokenizer.to_str()
        safe = '"use_regex":true' in described and '"normalizer":null' in described
        self.units = Units(self._learn, self._whole, special if safe else (b"",), limit=1_000_000)
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.starts[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True  # the byte-level sign for a blank

    def _whole(self, texts: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
        if first:
            found = self._whole(units)
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        ids, sizes = [], []
        for k in range(0, len(units), 20_000):
            block = units[k : k + 20_000]
            ids.append(np.array(self._whole([" " + " ".join(block)])[0], np.uint32))
            at = np.flatnonzero(self.starts[ids[-1]])
            if len(at) == len(block):
                sizes.append(np.diff(np.r_[at, len(ids[-1])]))
            else:  # a unit whose first token holds no blank: each one by itself
                apart = self._whole([f" {u}" for u in block])
                ids[-1] = np.array([i for x in apart for i in x], np.uint32)
                sizes.append(np.array([len(x) for x in apart], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, ends = self.units.encode(*buffers(pa.array(texts, pa.string())))
        return np.split(ids, ends[:-1]) if texts else []


# ---------------------------------------------------------------- canonical, length-limited Huffman codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of limit bits at most, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids can't have codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    levels = []  # of each level: which of the sorted entries are single ids
    packages = np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        m = len(merged) // 2 * 2
        packages = merged[0:m:2] + merged[1:m:2]
    take = 2 * (n - 1)
    lengths = np.zeros(n, np.int64)
    for single in reversed(levels):
        ids = int(single[:take].sum())
        lengths[:ids] += 1
        take = 2 * (take - ids)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, before = 0, 0
    by_length = np.bincount(lengths, minlength=int(lengths.max(initial=0)) + 1)
    at = int(by_length[0])
    for size in range(1, len(by_length)):
        code <<= size - before
        before = size
        n = int(by_length[size])
        codes[order[at : at + n]] = np.arange(code, code + n, dtype=np.uint64)
        code += n
        at += n
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of one block."""
    aligned = codes << (np.uint64(64) - np.maximum(lengths, 1).astype(np.uint64))  # each code at the high end of a word
    size = lengths[ids].astype(np.uint64)
    ends = np.cumsum(size, dtype=np.uint64)
    starts = ends - size
    bits = int(ends[-1]) if len(ids) else 0
    words = np.zeros(bits // 64 + 2, np.uint64)
    if len(ids):
        word, bit, code = (starts >> np.uint64(6)).astype(np.int64), starts & np.uint64(63), aligned[ids]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] = np.bitwise_or.reduceat(code >> bit, first)
        over = np.flatnonzero(bit + size > np.uint64(64))  # the code's low bits go to the next word
        words[word[over] + 1] |= code[over] << (np.uint64(64) - bit[over])
    return words.astype(">u8").tobytes()[: (bits + 7) // 8], starts[::STEP].astype("<u4").tobytes()


class Decoder:
    """Table-driven: the next limit bits give the id and the length of its code."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit = limit
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        sizes = lengths[order].astype(np.int64)
        spread = np.repeat((order << 5 | sizes).astype(np.uint32), 1 << (limit - sizes))  # a code has 31 bits at most
        self.table = np.ones(1 << limit, np.uint32)
        self.table[: len(spread)] = spread

    def block(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(checkpoints, "<u4").copy()
        raw = np.frombuffer(payload + bytes(STEP * self.limit // 8 + 8), np.uint8).astype(np.uint32)  # lanes run on past the end
        wide = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.empty((min(STEP, n), len(at)), np.uint32)
        low = np.uint32(32 - self.limit)
        for k in range(len(out)):
            found = self.table.take(wide.take(at >> 3) << (at & 7) >> low)
            np.right_shift(found, 5, out=out[k])
            at += found & 31
        return np.ascontiguousarray(out.T).reshape(-1)[:n] if len(out) == STEP else out[:, 0]


# ---------------------------------------------------------------- writing and reading


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, v, n, w, z): token ids with the end id as w-byte numbers, compressed, of whole texts. One more row for each
    task, with n = -1, has the counts of its ids."""

    def rows(batches):
        units = kept(("tokens", path), lambda: WordTokens(path)).units
        total = np.zeros(0, np.int64)
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in pieces(batches, limit=2 << 20):
            ids, ends = units.encode(*buffers(batch.column(1)))
            starts = np.r_[0, ends[:-1]]
            end = np.uint32(end_id)
            wide = np.insert(ids, ends, end)
            counts = np.bincount(wide, minlength=len(total))
            counts[: len(total)] += total
            total = counts
            small = wide.astype("<u2") if wide.max(initial=0) < 65536 else wide.astype("<u4")
            raw, w, n = memoryview(small.tobytes()), small.itemsize, len(ends)
            cuts = zip((w * (starts + np.arange(n))).tolist(), (w * (ends + np.arange(1, n + 1))).tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), longs(ends - starts + 1), pa.array(np.full(n, w, np.int32)), pa.array([pack(raw[a:b]) for a, b in cuts], pa.binary())], names=["doc_id", "v", "n", "w", "z"])
        yield pa.RecordBatch.from_arrays([longs([None]), longs([None]), longs([-1]), pa.array([8], pa.int32()), pa.array([pack(total.astype("<i8").tobytes())], pa.binary())], names=["doc_id", "v", "n", "w", "z"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("v")).mapInArrow(trimmed(rows, keeps=True), "doc_id long, v long, n long, w int, z binary")


def _ids(z: bytes, w: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), f"<u{w}")


def global_counts(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents: the tasks' counts are added up by id; a row an id reaches the driver."""

    def spread(batches):
        for batch in batches:
            for w, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = _ids(z, w)
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([longs(found), longs(total[found])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for i, n in encoded.where("n = -1").select("w", "z").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


_BLOCK_DDL = "part int, block int, doc_ids array<long>, doc_lengths array<long>, before long, begun long, goes_on boolean, n_tokens long, payload binary, checkpoints binary"
_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("before", pa.int64()), ("begun", pa.int64()), ("goes_on", pa.bool_()), ("n_tokens", pa.int64()), ("payload", pa.binary()), ("checkpoints", pa.binary())]
)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, limit: int = LIMIT, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the ids of all documents, ascending by doc_id (null first; ties by a hash of the text), to folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    encoded = cut(encode(documents_of(docs), tokenizer, end_id))
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    lengths = code_lengths(global_counts(encoded, vocabulary), max(limit, int(vocabulary).bit_length()))
    spark.createDataFrame([(bytearray(lengths.tobytes()), max(limit, int(vocabulary).bit_length()))], "code_lengths binary, bits int").coalesce(1).write.parquet(f"{folder}/header")

    def blocks(batches):
        from pyspark import TaskContext

        codes = canonical(lengths)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, np.ndarray]] = []

        def out(begun: int = 0, goes_on: bool = False):
            nonlocal block, before, held
            tokens = np.concatenate([x for _, x in held])
            payload, checkpoints = pack(tokens, lengths, codes)
            made = {"part": part, "block": block, "doc_ids": [i for i, _ in held], "doc_lengths": [len(x) for _, x in held], "before": before, "begun": begun, "goes_on": goes_on, "n_tokens": len(tokens), "payload": payload, "checkpoints": checkpoints}
            block, before, held = block + 1, before + len(tokens), []
            return pa.RecordBatch.from_pylist([made], schema=_BLOCK)

        total = 0
        for batch in batches:
            for doc, z, w in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("doc_id", "z", "w")), strict=True):
                ids = _ids(z, w)
                if held and total + len(ids) > block_tokens:
                    yield out()
                    total = 0
                if len(ids) <= block_tokens:
                    held.append((doc, ids))
                    total += len(ids)
                    continue
                for at in range(0, len(ids), block_tokens):
                    held = [(doc, ids[at : at + block_tokens])]
                    yield out(at, at + block_tokens < len(ids))
        if held:
            yield out()

    ordered = encoded.where("n >= 0").repartitionByRange(partitions(spark), "doc_id", "v").sortWithinPartitions("doc_id", "v").select("doc_id", "n", "w", "z")
    ordered.mapInArrow(trimmed(blocks), _BLOCK_DDL).write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids): the ids of each document and how many ids all documents before it have; with digest,
    n_tokens and ids_crc32 instead of the ids."""
    header = spark.read.parquet(f"{folder}/header").first()
    lengths, bits = np.frombuffer(bytes(header["code_lengths"]), np.uint8), header["bits"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    ahead, total = {}, 0
    for part, n in blocks.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():  # a row a partition
        ahead[part] = total
        total += n

    def decoded(batches):
        """(block as a dictionary, ids as little-endian unsigned 32-bit numbers) of each block."""
        decoder = Decoder(lengths, bits)
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1).to_pylist()[0]
                yield b, memoryview(decoder.block(b["payload"], b["checkpoints"], b["n_tokens"]).astype("<u4").tobytes())

    def result(ids, start, raw):
        n, more = longs([len(x) // 4 for x in raw]), longs([zlib.crc32(x) for x in raw]) if digest else pa.array([bytes(x) for x in raw], pa.binary())
        return pa.RecordBatch.from_arrays([longs(ids), longs(start), n, more], names=["doc_id", "start", "n_tokens", "found"])

    def documents(batches):
        for b, tokens in decoded(batches):
            ends = np.cumsum(b["doc_lengths"])
            first = np.r_[0, ends[:-1]]
            for a in range(0, len(ends), 512):
                at = slice(a, a + 512)
                raw = [tokens[4 * x : 4 * y] for x, y in zip(first[at].tolist(), ends[at].tolist(), strict=True)]
                yield result(b["doc_ids"][at], first[at] + ahead[b["part"]] + b["before"], raw)

    def long_parts(batches):
        for b, tokens in decoded(batches):
            yield pa.RecordBatch.from_arrays([longs(b["doc_ids"]), longs([ahead[b["part"]] + b["before"] - b["begun"]]), longs([b["begun"]]), pa.array([bytes(tokens)], pa.binary())], names=["doc_id", "start", "begun", "tokens"])

    def long_documents(batches):
        for batch in batches:
            for doc, start, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield result([doc], [start], [b"".join(p["tokens"] for p in parts)])

    schema = f"doc_id long, start long, n_tokens long, found {'long' if digest else 'binary'}"
    short = blocks.where("begun = 0 and not goes_on").mapInArrow(trimmed(documents), schema)
    parts = blocks.where("begun > 0 or goes_on").mapInArrow(trimmed(long_parts), "doc_id long, start long, begun long, tokens binary")
    # a row is a document: as long as a row of the input
    long = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("begun", "tokens"))).alias("parts"))
    found = short.union(long.select("doc_id", "start", "parts").mapInArrow(long_documents, schema))
    return found.withColumnRenamed("found", "ids_crc32") if digest else found.select("doc_id", "start", F.col("found").alias("ids"))


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encodes whole texts, writes the files, reads them back: doc_id, start, n_tokens, ids_crc32.

    docs: doc_id, text; other columns are ignored. Null or empty text: the end id alone. Repeated rows are separate
    documents; rows with one doc_id follow each other, in an order given by their text. A null doc_id comes first. An
    empty table gives empty files.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer, end_id, block_tokens=block_tokens)
    return read_token_files(spark, folder, digest=True)
