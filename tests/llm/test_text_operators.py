"""Corpus operators on small awkward tables, against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from ledgerloom.llm import decontaminate, line_dedup, sentencepiece_ops, simhash, substring_dedup, token_files
from ledgerloom.llm.queries import vocabulary

WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(f"x{i * 7919 % 5003}" for i in range(30_000))
TEXTS = [
    (1, " ".join(WORDS)), (2, " ".join(WORDS)), (3, "intro " + " ".join(WORDS[5:40]) + " outro"), (4, None), (5, ""), (6, " \t\n "), (7, "One"), (8, "one two"), (9, "a\nB \n\n a \nc"), (10, LONG), (11, LONG + " end"),
    (12, "ünï cödé " * 5), (12, "ünï cödé " * 5), (12, "another text with the same id"), (None, " ".join(WORDS)), (None, None), (13, "A\n" * 50 + "tail"), (14, "a" * 5000), (15, "x  double  blanks \n  <s> ▁ y"), (16, "\u0000 nul \U0001f600"),
]
TEXTS += [(100 + i, f"common line\nown {i}\n  COMMON line\t") for i in range(12)]
SCHEMA = "doc_id long, text string, v long, h string, ids string, row int, drops string, component_id string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, 0, "h", "i", 1, "d", "c", "k") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def distinct_documents():
    return sorted({(i, t) for i, t in TEXTS}, key=repr)


def test_line_dedup(docs, none):
    found = defaultdict(set)
    for i, t in distinct_documents():
        for line in (t or "").encode().split(b"\n"):
            found[line.strip(b" \t\n\x0b\x0c\r").lower()].add((i, t))
    want = []
    for i, t in TEXTS:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if not (k := x.strip(b" \t\n\x0b\x0c\r").lower()) or len(found[k]) < 10]
        want.append((i, len(lines), len(lines) - len(kept), sha(b"\n".join(kept))))
    assert rows(line_dedup.line_digest(docs)) == sorted(want, key=repr)
    assert sum(w[2] for w in want) == 24
    assert line_dedup.line_digest(none).count() == 0
    for r in line_dedup.line_dedup(docs).where("keep is not null").collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bytes(r.keep)), np.uint8), bitorder="little")[: r.n_lines]
        assert (bits == 0).sum() == r.n_dropped
        lines = dict(TEXTS)[r.doc_id].split("\n")
        assert r.kept_text == "\n".join(x for k, x in enumerate(lines) if k >= len(bits) or bits[k])
    kept = line_dedup.without_common_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_one_line_in_every_document(spark):
    docs = spark.createDataFrame([(i, "hot\nhot") for i in range(500)], "doc_id long, text string").repartition(20)
    assert {tuple(r)[1:3] for r in line_dedup.line_digest(docs).collect()} == {(2, 2)}
    docs = spark.createDataFrame([(i, "warm") for i in range(9)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.line_digest(docs).collect()} == {0}


def fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("size", "radius"), [(3, 2), (5, 8)])
def test_simhash(docs, none, size, radius):
    fps = {t: fingerprint(t, size) for _, t in TEXTS}
    group = {f: {f} for f in fps.values()}
    for a in list(group):
        for b in list(group):
            if bin(a ^ b).count("1") <= radius and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[a]:
                    group[x] = group[a]
    smallest = lambda f: min((i for i, t in TEXTS if i is not None and fps[t] in group[f]), default=None)
    want = [(i, f"{fps[t]:016x}", smallest(fps[t])) for i, t in TEXTS]
    assert rows(simhash.simhash_digest(docs, size, radius)) == sorted(want, key=repr)
    assert simhash.simhash_digest(none).count() == 0


def test_near_copies_in_large_blocks(spark):
    """More rows of one key than a block holds: all links are found."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[:1] ^ rng.integers(0, 2**20, 700, dtype=np.uint64), base]))
    df = spark.createDataFrame([(int(f.astype(np.int64)),) for f in fps], "fp long")
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= 2}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in want:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    edges = simhash.near_fingerprints(df, 2, limit=64)
    place = {int(f.astype(np.int64)): k for k, f in enumerate(fps)}
    got = list(range(len(fps)))

    def top(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in edges.collect():
        got[max(top(place[a]), top(place[b]))] = min(top(place[a]), top(place[b]))
    assert [top(k) for k in range(len(fps))] == [root(k) for k in range(len(fps))]


def test_similar_groups(spark, none):
    """Near copies at a Jaccard similarity of 0.85 or more are found, unrelated documents and halves stay apart."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, truth = [], {}
    for g in range(60):
        base = [word() for _ in range(rng.randrange(120, 500))]
        truth[len(rows)] = None
        rows.append((len(rows), " ".join(base)))
        for changes in (0, 1, 2):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            a, b = shingles(base), shingles(copy)
            truth[len(rows)] = (4 * g + g, len(a & b) / len(a | b))
            rows.append((len(rows), " ".join(copy)))
        truth[len(rows)] = None
        rows.append((len(rows), " ".join([*base[: len(base) // 2], *[word() for _ in range(len(base) // 2)]])))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    near = [(i, t[0]) for i, t in truth.items() if t and t[1] >= 0.85]
    assert sum(got[i] == base for i, base in near) >= 0.95 * len(near) and len(near) > 150
    assert all(got[i] == i for i, t in truth.items() if t is None)
    assert simhash.similar_groups(none).count() == 0


def test_one_of_each_group_stays(docs):
    kept = simhash.one_of_each_group(docs)
    ids = sorted(r.doc_id for r in kept.select("doc_id").where("doc_id is not null").collect())
    assert 1 in ids and 2 not in ids and 10 in ids and 11 not in ids and kept.columns == docs.columns


def test_substring_dedup(docs, none):
    first = {}
    for i, t in sorted(((i, t) for i, t in TEXTS if i is not None), key=lambda x: x[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, t in TEXTS:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    assert rows(substring_dedup.substring_dedup(docs)) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 30_000
    assert substring_dedup.substring_dedup(none).count() == 0


def test_many_shards_and_one(docs):
    assert rows(substring_dedup.substring_dedup(docs, shard_words=500)) == rows(substring_dedup.substring_dedup(docs))


def test_counters_overestimate():
    """Equal windows share a counter in each row, so a counter is never below the number of a window's documents."""
    words = [f"{k % 11}".encode() for k in range(300)]
    sketch = substring_dedup.Sketch(10_000, 4, 1000)
    found = list(substring_dedup.windows_of([(0, b" ".join(words)), (1, b" ".join(words[5:]))], 13))
    by = defaultdict(set)
    for w in found:
        counters = [sketch.counters(s).tolist() for s in w.smallest]
        for k in range(len(w.doc)):
            by[w.raw[w.start[k] : w.end[k]]].add(tuple(c[k] for c in counters))
    assert len(by) == 11 and all(len(x) == 1 for x in by.values())


def test_parts_that_come_mixed_lose_nothing():
    """Rows of several parts in one task, with and without an answer before them: every window that two documents have is
    sent or settled, whichever counters are loaded."""
    words = [f"w{k}" for k in range(40)]
    shared, other = " ".join(words[:20]), " ".join(words[20:])
    sketch = substring_dedup.Sketch(1000, 2, 1000)
    z = zstandard.ZstdCompressor().compress
    counters = []
    for line in (shared, other):  # an answer: the counters of one passage
        (w,) = substring_dedup.windows_of([(0, line.encode())], 13)
        counters.append([{"shard": 0, "row": r, "cells": substring_dedup.packed(np.unique(sketch.counters(w.smallest[r])))} for r in range(substring_dedup.ROWS)])
    rows = [(1, shared, 7, counters[0]), (2, other, 8, counters[1]), (3, shared, 7, None), (4, other, 8, None), (5, shared, 9, None)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "v": i, "z": z(t.encode()), "part": part, "answers": a} for i, t, part, a in rows])
    out = [x for b in substring_dedup._candidates(13, sketch)(iter([batch])) for x in b.to_pylist()]
    seen = {(x["ids"][k], at) for x in out for k, at in zip(np.frombuffer(x["row"], "<u4").tolist(), np.frombuffer(x["at"], "<u4").tolist(), strict=True)}
    assert seen >= {(i, at) for i in (1, 2, 4, 5) for at in range(8)}


def test_pieces_of_a_text_hold_all_its_windows():
    words = [f"w{k * 31 % 997}".encode() for k in range(5000)]
    line = b" ".join(words)
    for limit in (100, 1000, 1 << 20):
        seen = {}
        for word, piece in substring_dedup.segments(line, 13, limit):
            w = piece.split(b" ")
            for k in range(len(w) - 12):
                assert seen.setdefault(word + k, tuple(w[k : k + 13])) == tuple(words[word + k : word + k + 13])
        assert sorted(seen) == list(range(4988))


def test_numbers_are_packed():
    for x in ([], [0], [0, 1, 5, 70_000, 2**32 - 1]):
        assert substring_dedup.unpacked(substring_dedup.packed(np.array(x, np.uint64))).tolist() == x


ITEMS = [(1, " ".join(WORDS[10:30])), (2, "One, TWO"), (3, None), (4, ""), (5, "!!"), (6, "a"), (1, " ".join(WORDS[10:30])), (7, "not there at all")]


def test_decontamination(spark, docs, none):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    patterns = {}
    for i, t in ITEMS:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            patterns.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = []
    for i, t in TEXTS:
        w = split(t)
        hit, items = [False] * len(w), set()
        for p, owners in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit[k : k + len(p)] = [True] * len(p)
                    items |= owners
        want.append((i, len(w), sum(hit), len(items), sha(",".join(sorted(items)).encode()), 0 < sum(hit) and 20 * sum(hit) >= len(w)))
    assert rows(decontaminate.contamination_digest(docs, bench)) == sorted(want, key=repr)
    assert decontaminate.contamination_digest(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination_digest(docs, bench.where("false")).collect())
    text = dict(TEXTS[:3])
    for r in decontaminate.decontaminate(docs, bench).where("doc_id in (1, 3, 8)").collect():
        assert r.spans and all(WORDS[10] in text.get(r.doc_id, WORDS[10])[s.start : s.end] for s in r.spans if r.doc_id != 8)
    whole = rows(decontaminate.decontaminate(docs, bench))
    assert rows(decontaminate.decontaminate(docs, bench, max_bytes=60)) == whole  # in parts, whose hits are united
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    kept = decontaminate.drop_contaminated(docs, bench, max_bytes=60)
    assert kept.count() == sum(not w[-1] for w in want)


def test_blocks_find_every_window():
    """Random texts over few words against all windows of random items, of all lengths about the size of a window."""
    import random

    rng = random.Random(6)
    for size in (2, 3, 5, 13):
        items = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 3 * size)))) for k in range(12)]
        machine = decontaminate.Items(items, size)
        patterns = [(tuple(w[i : i + size]), k) for k, t in items for w in [t.split()] for i in range(max(1, len(w) - size + 1))]
        for _ in range(60):
            words = [rng.choice("aaabcd") for _ in range(rng.randrange(0, 4 * size))]
            hit, found = [False] * len(words), set()
            for p, k in patterns:
                for i in range(len(words) - len(p) + 1):
                    if tuple(words[i : i + len(p)]) == p:
                        hit[i : i + len(p)] = [True] * len(p)
                        found.add(k)
            got, ids = machine.hits([w.encode() for w in words])
            assert got.tolist() == hit and ids == found


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    got = rows(token_files.token_round_trip(docs, path))
    assert sorted((i, n, c) for i, _, n, c in got if i is not None) == sorted((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in TEXTS if i is not None)
    at = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [i for i, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.token_round_trip(none, path).count() == 0
    assert rows(token_files.token_round_trip(docs, path, block_tokens=500)) == got  # long documents cut over many blocks


def test_units_that_the_vocabulary_does_not_part():
    """Where a unit's ids can't be told from the ids of several units at once, each one goes to the library by itself."""
    words = token_files.WordTokens(vocabulary("byte_bpe_50k.json"))
    words.starts[:] = False
    assert words.texts(["some words here"])[0].tolist() == words.tokenizer.encode("some words here", add_special_tokens=False).ids


def test_whole_texts_and_units_agree():
    words = token_files.WordTokens(vocabulary("byte_bpe_50k.json"))
    odd = ["a  b", "a \n b", " lead", "trail ", "x 　y", "it's 5 o'clock <|endoftext|> z", "\x1c a", "a\x85 b", "Zß ñ\nq  w", "", " ", "a", "it 's don't", None, "y "]
    for batch in (odd, odd[::-1], [x for x in odd for _ in range(2)]):
        for t, got in zip(batch, words.texts(batch), strict=True):
            assert got.tolist() == words.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_huffman_codes():
    rng = np.random.default_rng(0)
    for counts in (np.bincount(rng.zipf(1.2, 20_000) % 3000), np.array([0, 5, 0]), np.array([1] * 300), 2 ** np.arange(40)):
        lengths = token_files.code_lengths(counts, 12)
        used = counts > 0
        assert (lengths[used] > 0).all() and (lengths[~used] == 0).all() and lengths.max() <= 12
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
        ids = rng.choice(np.flatnonzero(used), 1000)
        payload, checkpoints = token_files.pack(ids, lengths, token_files.canonical(lengths))
        assert (token_files.Decoder(lengths, 12).block(payload, checkpoints, len(ids)) == ids).all()


def test_sentencepiece(docs, none):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t in TEXTS:
        ids = lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(lib.decode(ids).encode())))
    assert rows(sentencepiece_ops.piece_digest(docs, path)) == sorted(want, key=repr)
    assert sentencepiece_ops.piece_digest(none, path).count() == 0
    assert {tuple(r.ids) for r in sentencepiece_ops.pieces_of(docs, path).where("doc_id = 8").collect()} == {tuple(lib.encode("one two"))}


def test_the_library_counts_where_the_agenda_differs(monkeypatch):
    agenda = sentencepiece_ops.Agenda(vocabulary("piece_bpe_32k.model"))
    texts = ["some words", "two  blanks", "", None]
    assert agenda.encode(pa.array(texts, pa.string()))[1].tolist() and agenda.differing == 0
    odd = sentencepiece_ops.Agenda(vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(odd, "merge", lambda text: [0])
    ids, ends = odd.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [odd.library.encode(t or "") for t in texts] and odd.differing == 3


def test_the_agenda_gives_the_ids(monkeypatch):
    """Not the library beside it: other merges give other ids, and units that it spells are not encoded a second time."""
    agenda = sentencepiece_ops.Agenda(vocabulary("piece_bpe_32k.model"))
    merge = agenda.merge
    monkeypatch.setattr(agenda, "merge", lambda text: [i for c in text for i in merge(c)])
    ids, _ = agenda.encode(pa.array(["some words", "two  blanks"], pa.string()))
    assert ids.tolist() == [i for c in "▁some▁words▁two▁▁blanks" for i in merge(c)] and agenda.differing == 0
    assert len(ids) > len(agenda.library.encode("some words") + agenda.library.encode("two  blanks"))
