"""Decoding .xls (BIFF8 in an OLE container) with the standard library: stored values, no formula texts."""

from __future__ import annotations

import struct
from datetime import datetime, timedelta

from ledgerloom.functions import values as V
from ledgerloom.functions.errors import LedgerError, UnreadableSource
from ledgerloom.functions.text import text
from ledgerloom.sources.cells import Area, SheetData
from ledgerloom.sources.xlsx import _DATE_SIGN, _QUOTED, BUILT_IN, DATE_FORMATS, Box

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")  # fixed value: an OLE container
_END = 0xFFFFFFFC  # sector numbers from here on are marks
# BIFF8 record numbers.
BOF, EOF, SHEET, SST, CONTINUE, DATEMODE, FORMAT, XF, FILEPASS = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x22, 0x41E, 0xE0, 0x2F
LABELSST, NUMBER, RK, MULRK, FORMULA, STRING, LABEL, BOOLERR, MERGED, ROW, COLINFO = 0xFD, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x204, 0x205, 0xE5, 0x208, 0x7D


def _chain(fat: list[int], start: int) -> list[int]:
    out, seen = [], set()
    while start < _END:
        if start in seen or start >= len(fat):
            raise UnreadableSource(".xls 容器的扇区链无效")
        seen.add(start)
        out.append(start)
        start = fat[start]
    return out


def workbook_stream(data: bytes) -> bytes:
    """The Workbook stream of an OLE container."""
    if not data.startswith(MAGIC):
        raise UnreadableSource(".xls 内容不是 OLE/BIFF 工作簿")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    directory, _, cutoff, mini_start, _, difat_next, _ = struct.unpack_from("<7I", data, 48)
    size = 1 << shift
    sector = lambda k: data[512 + k * size if size == 512 else (k + 1) * size :][:size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    difat = list(struct.unpack_from("<109I", data, 76))
    hops = 0
    while difat_next < _END and hops < 4096:
        part = numbers(sector(difat_next))
        difat, difat_next, hops = difat + part[:-1], part[-1], hops + 1
    fat = [n for k in difat if k < _END for n in numbers(sector(k))]
    read = lambda start: b"".join(sector(k) for k in _chain(fat, start))
    entries = read(directory)
    root, found = None, None
    for k in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, k + 64)
        name = entries[k : k + max(0, length - 2)].decode("utf-16-le", "replace")
        start, bytes_ = struct.unpack_from("<IQ", entries, k + 116)
        if kind == 5:
            root = start
        elif kind == 2 and name in ("Workbook", "Book") and found is None:
            found = start, bytes_ & 0xFFFFFFFF
    if found is None:
        raise UnreadableSource(".xls 内容不是 OLE/BIFF 工作簿")
    start, length = found
    if length >= cutoff or root is None:
        return read(start)[:length]
    mini, small = read(root), 1 << mini_shift
    links = numbers(read(mini_start))
    return b"".join(mini[k * small : (k + 1) * small] for k in _chain(links, start))[:length]


def _records(stream: bytes, at: int = 0):
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + size], at
        at += 4 + size


class _Pieces:
    """A record with its continuations: strings may be cut anywhere, their flags are repeated after a cut."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.k < len(self.parts):
            piece = self.parts[self.k][self.at : self.at + n - len(out)]
            out, self.at = out + piece, self.at + len(piece)
            if self.at >= len(self.parts[self.k]) and len(out) < n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = ""
        while count:
            if self.at >= len(self.parts[self.k]):
                if self.k + 1 >= len(self.parts):
                    raise UnreadableSource(".xls 字符串表不完整")
                self.k, self.at = self.k + 1, 1
                flags = self.parts[self.k][0]
            width = 2 if flags & 1 else 1
            n = min(count, (len(self.parts[self.k]) - self.at) // width)
            raw = self.parts[self.k][self.at : self.at + n * width]
            out += raw.decode("utf-16-le" if width == 2 else "latin-1")
            self.at += n * width
            count -= n
        self.take(4 * runs + more)
        return out


def _string(raw: bytes, head: str) -> str:
    """A string with its length in front."""
    count = struct.unpack_from(head, raw)[0]
    at = struct.calcsize(head)
    return raw[at + 1 : at + 1 + 2 * count].decode("utf-16-le") if raw[at] & 1 else raw[at + 1 : at + 1 + count].decode("latin-1")


def _rk(raw: int) -> float:
    value = float((raw if raw < 1 << 31 else raw - (1 << 32)) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def decode(data: bytes) -> list[SheetData]:
    stream = workbook_stream(data)
    bounds, strings, formats, styles, since_1904 = [], [], {}, [], False
    first = next(_records(stream), None)
    if first is None or first[0] != BOF or struct.unpack_from("<H", first[1])[0] != 0x600:
        raise UnreadableSource(".xls 不是 BIFF8 工作簿")
    parts: list[bytes] | None = None
    for kind, raw, _ in _records(stream):
        if kind == CONTINUE and parts is not None:
            parts.append(raw)
            continue
        if parts is not None:
            strings, parts = _shared(parts), None
        if kind == FILEPASS:
            raise UnreadableSource("不支持加密或带宏的工作簿")
        if kind == SHEET:
            bounds.append((*struct.unpack_from("<IBB", raw), _string(raw[6:], "<B")))
        elif kind == SST:
            parts = [raw]
        elif kind == DATEMODE:
            since_1904 = struct.unpack("<H", raw[:2])[0] == 1
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", raw)[0]] = _string(raw[2:], "<H")
        elif kind == XF:
            styles.append(struct.unpack_from("<H", raw, 2)[0])
        elif kind == EOF:
            break
    if len(bounds) > V.MAX_SHEETS:
        raise LedgerError("工作簿 Sheet 数超限")
    if any(sort != 0 for _, _, sort, _ in bounds):
        raise UnreadableSource("不支持的 Sheet 类型")
    shape = lambda xf: formats.get(styles[xf], BUILT_IN.get(styles[xf], "General")) if xf < len(styles) else "General"
    dated = lambda xf: xf < len(styles) and (styles[xf] in DATE_FORMATS or styles[xf] in formats and bool(_DATE_SIGN.search(_QUOTED.sub("", formats[styles[xf]]))))
    return [_sheet(stream, offset, SheetData(name, hidden=bool(state)), strings, shape, dated, since_1904) for offset, state, _, name in bounds]


def _shared(parts: list[bytes]) -> list[str]:
    pieces = _Pieces(parts)
    _, unique = struct.unpack("<II", pieces.take(8))
    return [pieces.string() for _ in range(unique)]


def _sheet(stream: bytes, offset: int, sheet: SheetData, strings, shape, dated, since_1904: bool) -> SheetData:
    box, waiting = Box(sheet.name), None

    def put(r: int, c: int, xf: int, value, error: bool = False):
        if isinstance(value, float) and dated(xf) and not error:
            start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31) if value < 60 else datetime(1899, 12, 30)
            value = start + timedelta(milliseconds=round(value * 86_400_000))
        if text(value):
            box.grow(Area(r + 1, c + 1, r + 1, c + 1), "内容单元格")
            sheet.cells[r + 1, c + 1] = (value, False, error, shape(xf))

    for kind, raw, _ in _records(stream, offset):
        if kind == EOF:
            break
        if kind in (LABELSST, NUMBER, RK, FORMULA, LABEL, BOOLERR):
            r, c, xf = struct.unpack_from("<HHH", raw)
        if kind == LABELSST:
            put(r, c, xf, strings[struct.unpack_from("<I", raw, 6)[0]])
        elif kind == NUMBER:
            put(r, c, xf, struct.unpack_from("<d", raw, 6)[0])
        elif kind == RK:
            put(r, c, xf, _rk(struct.unpack_from("<I", raw, 6)[0]))
        elif kind == MULRK:
            r, c = struct.unpack_from("<HH", raw)
            for k in range((len(raw) - 6) // 6):
                xf, value = struct.unpack_from("<HI", raw, 4 + 6 * k)
                put(r, c + k, xf, _rk(value))
        elif kind == LABEL:
            put(r, c, xf, _string(raw[6:], "<H"))
        elif kind == BOOLERR:
            put(r, c, xf, raw[6], bool(raw[7]))
        elif kind == FORMULA:
            result, waiting = raw[6:14], None
            if result[6:] != b"\xff\xff":
                put(r, c, xf, struct.unpack("<d", result)[0])
            elif result[0] == 0:
                waiting = r, c, xf
            elif result[0] in (1, 2):
                put(r, c, xf, result[2], result[0] == 2)
        elif kind == STRING and waiting:
            put(*waiting, _string(raw, "<H"))
            waiting = None
        elif kind == MERGED:
            for k in range(struct.unpack_from("<H", raw)[0]):
                top, bottom, left, right = struct.unpack_from("<4H", raw, 2 + 8 * k)
                if bottom >= V.MAX_ROWS or right >= V.MAX_COLS:
                    raise LedgerError("工作表合并结构规模超限")
                sheet.merges.append((top + 1, left + 1, bottom + 1, right + 1))
        elif kind == ROW and struct.unpack_from("<H", raw, 12)[0] & 0x20:
            sheet.hidden_rows.append(struct.unpack_from("<H", raw)[0] + 1)
        elif kind == COLINFO and struct.unpack_from("<H", raw, 8)[0] & 1:
            low, high = struct.unpack_from("<HH", raw)
            sheet.hidden_columns += [c + 1 for c in range(low, min(high, V.MAX_COLS - 1) + 1)]
    return sheet
