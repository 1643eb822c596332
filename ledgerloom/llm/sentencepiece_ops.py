"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is a score-ordered agenda of adjacent symbol pairs: the pair whose joined piece scores best (leftmost on
ties) is merged first, and pairs that a merge has made stale are skipped. Merges can't cross a place that no piece of
the vocabulary spans, so a text is cut before each blank run and its units are merged on their own and remembered.
The agenda's ids are the result. A model is taken only if the agenda gives the library's ids for each piece of its
vocabulary and for odd characters, and new units are checked to be spelled by their ids; where they are not, or hold a
character that the model doesn't know, the library's ids count. Decoding is the library's.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import documents_of, kept, longs, pieces, trimmed
from ledgerloom.llm.units import Units, buffers

_BLANK = "▁"  # fixed value: the visible sign that stands for U+0020 in pieces
#: Characters that normalisations change, white space and controls, characters that few models know.
_ODD = "\ufb01 \u212b e\u0301 \u2460 \u3000 \uff71 \u00a0 \u00ad a\u200bb \t \n a\r\nb \x00 \x7f \u0130 \u00df \u1e9e \u0378 \U0001f600 \U00030000 \ue000"
_RUNS = re.compile(f"{_BLANK}+[^{_BLANK}]+|{_BLANK}+|[^{_BLANK}]+")


class Agenda:
    """Encoder for one model file; ids as in the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        #: piece: (rank, id); a better score has a smaller rank
        order = sorted((i for i in range(n) if i not in special), key=lambda i: -lib.get_score(i))
        rank, before = {}, None
        for i in order:
            if (score := lib.get_score(i)) != before:
                before, level = score, len(rank)
            rank[lib.id_to_piece(i)] = (level, i)
        self.rank = rank
        self.unknown = lib.unk_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(lib.is_byte(i) for i in self.bytes)
        if any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in rank):
            raise ValueError("a piece spans a blank between words; units can't be merged on their own")
        if "".join(lib.encode(" a  b ", out_type=str)) != f"{_BLANK * 2}a{_BLANK * 2}b{_BLANK}":
            raise ValueError("only models with a leading blank and no other normalisation are supported")
        spelled = {lib.piece_to_id(p): p.encode() for p in rank} | ({i: bytes([b]) for b, i in enumerate(self.bytes)} if self.fallback else {})
        self.spelled = [spelled.get(i) for i in range(n)]
        known = [p.replace(_BLANK, " ").strip(" ") for p in rank]
        probes = [p for p in [*known, *_ODD.split(" "), "".join(_ODD.split(" "))] if p]
        for text, ids in zip(probes, lib.encode(probes, num_threads=1), strict=True):
            if [i for u in _RUNS.findall(_BLANK + text.replace(" ", _BLANK)) for i in self.merge(u)] != ids:
                raise ValueError(f"this model encodes {text!r} by other rules than merges")
        self.differing = 0  # units and texts for which the library's ids were taken
        self.units = Units(self._learn, self._whole, (_BLANK.encode(),), limit=500_000)

    def merge(self, text: str) -> list[int]:
        """Ids of one unit, its blanks already in their visible form."""
        rank = self.rank
        symbols: list = list(text)
        n = len(symbols)
        if n > 1:
            right, left = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = []
            for i in range(n - 1):
                joined = symbols[i] + symbols[i + 1]
                if joined in rank:
                    agenda.append((rank[joined][0], i, joined))
            heapq.heapify(agenda)
            pop, push = heapq.heappop, heapq.heappush
            while agenda:
                _, i, joined = pop(agenda)
                if symbols[i] is None or (j := right[i]) >= n or len(symbols[i]) + len(symbols[j]) != len(joined) or symbols[i] + symbols[j] != joined:
                    continue  # stale
                symbols[i], symbols[j] = joined, None
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    if (new := joined + symbols[k]) in rank:
                        push(agenda, (rank[new][0], i, new))
                if (h := left[i]) >= 0 and (new := symbols[h] + joined) in rank:
                    push(agenda, (rank[new][0], h, new))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if s in rank:
                    out.append(rank[s][1])
                elif self.fallback:
                    out += [self.bytes[b] for b in s.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def _settled(self, made: list[list[int]], units: list[str], texts: list[str]) -> list[list[int]]:
        """The agenda's ids of units, their blanks in visible form. Those that don't spell their unit are replaced by the
        library's for the text, and the case is counted."""
        spelled = self.spelled
        odd = [k for k, (ids, u) in enumerate(zip(made, units, strict=True)) if None in (parts := [spelled[i] for i in ids]) or b"".join(parts) != u.encode()]
        if odd:
            self.differing += len(odd)
            for k, ids in zip(odd, self.library.encode([texts[k] for k in odd], num_threads=1), strict=True):
                made[k] = ids
        return made

    def _learn(self, units: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Merges new units (without their leading blank)."""
        visible = [_BLANK + u for u in units]
        made = self._settled([self.merge(u) for u in visible], visible, units)
        return np.array([i for x in made for i in x], np.uint32), np.array([len(x) for x in made], np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        """Texts with runs of blanks or with the visible sign, cut before each run."""
        visible = [_BLANK + t.replace(" ", _BLANK) if t else "" for t in texts]
        return self._settled([[i for u in _RUNS.findall(v) for i in self.merge(u)] for v in visible], visible, texts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of whole texts, one after the other."""
        return self.units.encode(*buffers(column))


def remembered(model: str) -> Agenda:
    """One per worker process: its units serve all tasks that the process runs."""
    return kept(("pieces", model), lambda: Agenda(model))


def _lists(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    flat, cuts = ids.tolist(), [0, *ends.tolist()]
    return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def pieces_of(docs: DataFrame, model: str) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    docs: doc_id, text; other columns are ignored. Null or empty text: no ids, an empty decoded text. Repeated rows
    are encoded one by one. No begin or end ids, no sampling. Returns doc_id, n_tokens, ids, decoded.
    """

    def rows(batches):
        agenda = remembered(model)
        for batch in pieces(batches, limit=1 << 20):
            ids, ends = agenda.encode(batch.column(1))
            offsets = np.r_[0, ends].astype(np.int32)
            decoded = agenda.library.decode(_lists(ids, ends), num_threads=1) if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), longs(np.diff(offsets)), pa.ListArray.from_arrays(offsets, ids.astype(np.int32)), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return documents_of(docs).mapInArrow(trimmed(rows, keeps=True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of pieces_of, digested in the same batches."""

    def rows(batches):
        agenda = remembered(model)
        decimal = [b"%d" % i for i in range(agenda.library.get_piece_size())]
        for batch in pieces(batches, limit=1 << 20):
            ids = _lists(*agenda.encode(batch.column(1)))
            decoded = agenda.library.decode(ids, num_threads=1) if ids else []
            spelled = [hashlib.sha256(b",".join(map(decimal.__getitem__, x))).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), longs([len(x) for x in ids]), pa.array(spelled), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_of(docs).mapInArrow(trimmed(rows, keeps=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
