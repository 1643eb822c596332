"""Ids of whole texts, put together from remembered blank-separated units, in numpy.

Tokenizers whose pieces never reach across a single blank between two characters that are not white space give the same
ids unit by unit as for the whole text. Units are told apart by two 64-bit hashes, so that frequent units cost a table
lookup, and only new ones go to the tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_BLANK = 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BASE = np.uint64(0x9DDFEA08EB382D6B)
_FIRST = np.uint64(0x5851F42D4C957F2D)
_BYTES = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)


class Powers:
    """Powers of the hash base and of its inverse, as far as they are needed."""

    def __init__(self):
        self.size, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.size <= n:
            self.size = max(n + 1, 1 << 16)
            self.up, self.down = (self._powers(int(_BASE)), self._powers(pow(int(_BASE), -1, 1 << 64)))
        return self.up, self.down

    def _powers(self, base: int) -> np.ndarray:
        x = np.full(self.size, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)


class Slots:
    """An open-addressing hash table from 64-bit keys (not 0) to numbers, for arrays of keys at a time."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct and new."""
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]  # of several keys for a slot one stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask


class Units:
    """learn(units, first): (ids of units (str) in one array, their sizes); first units of a text come without a blank
    before them. whole(texts): ids of whole texts, for texts with white
    space beside a blank and for those that hold something of avoid."""

    def __init__(self, learn: Callable, whole: Callable, avoid: tuple[bytes, ...] = (), limit: int = 1_500_000):
        self.learn, self.whole, self.avoid, self.limit = learn, whole, avoid, limit
        self.powers = Powers()
        self._clear()

    def _clear(self) -> None:
        self.slots, self.n = Slots(int(self.limit * 2).bit_length()), 0
        self.check, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)  # size -1: white space at an end
        self.flat, self.filled = np.empty(0, np.uint32), 0

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, check) of each unit: a polynomial hash of its bytes, and its first bytes with its length."""
        up, down = self.powers.upto(len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        key = (h ^ (h >> np.uint64(32))) + np.where(first, _FIRST, np.uint64(0))
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
        size = ends - starts
        return np.maximum(key, np.uint64(1)), (eight[starts] & _BYTES[np.minimum(size, 8)]) * np.uint64(0xC6A4A7935BD1E995) + size.astype(np.uint64)

    def _room(self, name: str, n: int) -> np.ndarray:
        """The named array with room for n entries."""
        old = getattr(self, name)
        if len(old) < n:
            new = np.zeros(max(n, 2 * len(old), 1 << 16), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def _add(self, key: np.ndarray, check: np.ndarray, words: list[str], first: np.ndarray) -> None:
        valid = np.fromiter((w == w.strip() for w in words), bool, len(words))
        a, b = self.n, self.n + len(words)
        check_, start, size = self._room("check", b), self._room("start", b), self._room("size", b)
        check_[a:b], size[a:b] = check, -1
        for kind in (False, True):
            chosen = np.flatnonzero(valid & (first == kind))
            if len(chosen):
                ids, sizes = self.learn([words[i] for i in chosen.tolist()], kind)
                start[a + chosen], size[a + chosen] = self.filled + np.cumsum(sizes) - sizes, sizes
                self._room("flat", self.filled + len(ids))[self.filled : self.filled + len(ids)] = ids
                self.filled += len(ids)
        self.slots.add(key, np.arange(a, b, dtype=np.int32))
        self.n = b

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts data[offsets[i]:offsets[i + 1]] (UTF-8)."""
        n = len(offsets) - 1
        if self.n > self.limit:
            self._clear()
        begin, end = offsets[:-1], offsets[1:]
        odd = np.zeros(n, bool)
        raw = data.tobytes()
        text = lambda i: raw[begin[i] : end[i]]
        if any(x in raw for x in self.avoid):
            odd |= np.fromiter((any(x in text(i) for x in self.avoid) for i in range(n)), bool, n)
        space = _SPACE[data]
        blank = np.flatnonzero(data == _BLANK)
        blank_doc = np.searchsorted(offsets, blank, "right") - 1
        beside = (blank == begin[blank_doc]) | (blank + 1 == end[blank_doc])
        beside |= space[np.maximum(blank - 1, 0)] | space[np.minimum(blank + 1, max(0, len(data) - 1))]
        odd[blank_doc[beside]] = True
        good = np.flatnonzero(~odd & (end > begin))
        blank = blank[~odd[blank_doc]]
        starts = np.concatenate([begin[good], blank + 1])
        order = np.argsort(starts, kind="stable")
        starts, first = starts[order], (order < len(good))
        doc = np.searchsorted(offsets, starts, "right") - 1
        ends = np.where(np.r_[first[1:], True], end[doc], np.r_[starts[1:], 1] - 1) if len(starts) else starts
        key, check = self._hashes(data, starts, ends, first)
        place = self.slots.find(key)
        new = np.flatnonzero(place < 0)
        if len(new):
            unique, one = np.unique(key[new], return_index=True)
            at = new[one]
            words = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._add(unique, check[at], words, first[at])
            place[new] = self.slots.find(key[new])
        odd[doc[self.check[place] != check]] = True  # another unit with this key: the text goes to the library whole
        size = self.size[place].astype(np.int64)
        odd[doc[size < 0]] = True
        if odd[doc].any():
            keep = ~odd[doc]
            place, doc, size = place[keep], doc[keep], size[keep]
        out_end = np.cumsum(size)
        ids = self.flat[np.arange(out_end[-1] if len(out_end) else 0) + np.repeat(self.start[place] - (out_end - size), size)]
        total = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
        if odd.any():
            at = np.flatnonzero(odd)
            theirs = [np.asarray(x, np.uint32) for x in self.whole([text(i).decode() for i in at])]
            own, cuts = [], np.r_[0, np.cumsum(total)]
            total[at] = [len(x) for x in theirs]
            before = 0
            for i, x in zip(at.tolist(), theirs, strict=True):
                own += [ids[cuts[before] : cuts[i]], x]
                before = i
            ids = np.concatenate([*own, ids[cuts[before] :]])
        return ids, np.cumsum(total)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty."""
    column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]
