"""Binary Excel workbooks: the records of .xls (in a compound file) and of .xlsb (in an archive)."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator

from quillspark.blocks import ConversionError, escape_pipe, number

# Names of cell errors by code.
ERRORS = {0x00: "Null", 0x07: "Div0", 0x0F: "Value", 0x17: "Ref", 0x1D: "Name", 0x24: "Num", 0x2A: "NA", 0x2B: "GettingData"}

Cells = dict[tuple[int, int], str]


def shown(x: float) -> str:
    return f"{x:.0f}" if x == x and abs(x) < 2**63 and x == int(x) else number(x)


def rk(v: int) -> str:
    """A number in 30 bits: whole or the upper part of a double, perhaps in hundredths."""
    x = float((v - (1 << 32) if v >> 31 else v) >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & ~3) << 32))[0]
    return shown(x / 100 if v & 1 else x)


def error(code: int) -> str:
    return f"#{ERRORS.get(code, code)}"


def yes(v: int) -> str:
    return "true" if v else "false"


# Compound files


class Compound:
    """The streams of a compound file by name."""

    def __init__(self, data: bytes):
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        n_fat, at, _, self.cutoff, mini_fat, _, more, _ = struct.unpack_from("<8I", data, 44)
        tables = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while more < 0xFFFFFFFA and more not in seen:  # further tables of the allocation table's sectors
            seen.add(more)
            *some, more = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            tables += some
        fat = b"".join(map(self._sector, tables[:n_fat]))
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat)
        folder = self._chain(at)
        entries = {}
        for k in range(0, len(folder) - 127, 128):
            length, kind = struct.unpack_from("<HB", folder, k + 64)
            start, size = struct.unpack_from("<IQ", folder, k + 116)
            if kind in (2, 5) and length >= 2:
                entries[folder[k : k + length - 2].decode("utf-16-le", "replace")] = kind, start, size & 0xFFFFFFFF
        root = next((e for e in entries.values() if e[0] == 5), (5, 0xFFFFFFFE, 0))
        self.mini = self._chain(root[1])[: root[2]]
        mini_table = self._chain(mini_fat)
        self.mini_fat = struct.unpack(f"<{len(mini_table) // 4}I", mini_table)
        self.entries = entries

    def _sector(self, k: int) -> bytes:
        found = self.data[(k + 1) * self.size : (k + 2) * self.size]
        return found.ljust(self.size, b"\0")

    def _follow(self, at: int, table: tuple[int, ...]) -> Iterator[int]:
        for _ in range(len(table)):  # a chain that closes on itself ends there
            if at >= len(table):
                return
            yield at
            at = table[at]

    def _chain(self, at: int) -> bytes:
        return b"".join(map(self._sector, self._follow(at, self.fat)))

    def stream(self, *names: str) -> bytes:
        found = next((self.entries[n] for n in names if n in self.entries and self.entries[n][0] == 2), None)
        if found is None:
            raise ValueError(f"no stream {names[0]}")
        _, start, size = found
        if size < self.cutoff:
            return b"".join(self.mini[k * self.mini_size : (k + 1) * self.mini_size] for k in self._follow(start, self.mini_fat))[:size]
        return self._chain(start)[:size]


# .xls


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Kind and parts of each record: its own, and those that continue it."""
    kind, parts = None, []
    while at + 4 <= len(data):
        k, n = struct.unpack_from("<HH", data, at)
        part = data[at + 4 : at + 4 + n]
        at += 4 + n
        if k == 0x3C and kind is not None:
            parts.append(part)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = k, [part]
    if kind is not None:
        yield kind, parts


def _text(d: bytes, at: int, wide_count: bool = True) -> str:
    """A string with its count of characters and the byte that tells their width."""
    n = struct.unpack_from("<H", d, at)[0] if wide_count else d[at]
    at += 1 + wide_count
    return d[at + 1 : at + 1 + 2 * n].decode("utf-16-le", "replace") if d[at] & 1 else d[at + 1 : at + 1 + n].decode("latin-1")


def shared_strings(parts: list[bytes]) -> list[str]:
    """The strings of a workbook, which go on across parts; a part that cuts one begins with its width again."""
    part, at, out = 0, 8, []

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while len(got) < n and part < len(parts):
            some = parts[part][at : at + n - len(got)]
            got, at = got + some, at + len(some)
            if at >= len(parts[part]) and len(got) < n:
                part, at = part + 1, 0
        return got

    for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
        if part < len(parts) and at >= len(parts[part]):
            part, at = part + 1, 0
        if part >= len(parts):
            break
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while len(text) < n and part < len(parts):
            if at >= len(parts[part]):
                part, at = part + 1, 0
                if part < len(parts):
                    wide, at = parts[part][0] & 1, 1
                continue
            here = min((n - len(text)) * (1 + wide), len(parts[part]) - at)
            text += take(here).decode("utf-16-le" if wide else "latin-1", "replace")
        take(4 * runs + extra)
        out.append(text)
    return out


def _xls_cells(data: bytes, at: int, strings: list[str]) -> Cells:
    cells: Cells = {}
    waiting = None  # the formula whose text comes in a record of its own
    for kind, parts in records(data, at):
        d = parts[0]
        if kind == 0x0A:
            break
        if kind == 0x207 and waiting:
            cells[waiting] = escape_pipe(_text(b"".join([d, *(p[1:] for p in parts[1:])]), 0))
        elif kind == 0xBD:
            r, c = struct.unpack_from("<HH", d)
            for k in range((len(d) - 6) // 6):
                cells[r, c + k] = rk(struct.unpack_from("<I", d, 6 + 6 * k)[0])
        elif kind in (0x203, 0x27E, 0xFD, 0x204, 0x205, 0x06):
            place = struct.unpack_from("<HH", d)
            waiting = None
            if kind == 0x203:
                cells[place] = shown(struct.unpack_from("<d", d, 6)[0])
            elif kind == 0x27E:
                cells[place] = rk(struct.unpack_from("<I", d, 6)[0])
            elif kind == 0xFD:
                cells[place] = escape_pipe(strings[struct.unpack_from("<I", d, 6)[0]])
            elif kind == 0x204:
                cells[place] = escape_pipe(_text(d, 6))
            elif kind == 0x205:
                cells[place] = error(d[6]) if d[7] else yes(d[6])
            elif d[12:14] != b"\xff\xff":
                cells[place] = shown(struct.unpack_from("<d", d, 6)[0])
            elif d[6] == 0:
                waiting = place
            elif d[6] in (1, 2):
                cells[place] = yes(d[8]) if d[6] == 1 else error(d[8])
    return {k: v for k, v in cells.items() if v}


def xls_sheets(data: bytes) -> list[tuple[str, Cells]]:
    """Names and cells of the worksheets of an .xls workbook."""
    try:
        book = Compound(data).stream("Workbook", "Book")
        names, strings = [], []
        for kind, parts in records(book):
            if kind == 0x0A:
                break
            if kind == 0x2F:
                raise ConversionError("excel", "the workbook is encrypted")
            if kind == 0x85 and parts[0][5] == 0:
                names.append((struct.unpack_from("<I", parts[0])[0], _text(parts[0], 6, False)))
            elif kind == 0xFC:
                strings = shared_strings(parts)
        return [(name, _xls_cells(book, at, strings)) for at, name in names]
    except (struct.error, ValueError, IndexError, RecursionError) as e:
        raise ConversionError("excel", f"invalid workbook: {e}") from e


# .xlsb


def _bin_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0

    def packed(most: int) -> int:
        nonlocal at
        x = 0
        for k in range(most):
            b = data[at]
            at += 1
            x |= (b & 0x7F) << 7 * k
            if not b & 0x80:
                break
        return x

    while at < len(data):
        kind = packed(2)
        n = packed(4)
        yield kind, data[at : at + n]
        at += n


def _wide(d: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", d, at)[0]
    return ("", at + 4) if n == 0xFFFFFFFF else (d[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n)


def _xlsb_cells(data: bytes, strings: list[str]) -> Cells:
    cells: Cells = {}
    r = 0
    for kind, d in _bin_records(data):
        if kind == 0:
            r = struct.unpack_from("<I", d)[0]
        elif 2 <= kind <= 11:
            place = r, struct.unpack_from("<I", d)[0]
            if kind == 2:
                cells[place] = rk(struct.unpack_from("<I", d, 8)[0])
            elif kind in (3, 11):
                cells[place] = error(d[8])
            elif kind in (4, 10):
                cells[place] = yes(d[8])
            elif kind in (5, 9):
                cells[place] = shown(struct.unpack_from("<d", d, 8)[0])
            else:
                cells[place] = escape_pipe(strings[struct.unpack_from("<I", d, 8)[0]] if kind == 7 else _wide(d, 8)[0])
    return {k: v for k, v in cells.items() if v}


def xlsb_sheets(z: zipfile.ZipFile, targets: dict[str, str]) -> list[tuple[str, Cells]]:
    """Names and cells of the sheets of an .xlsb workbook; ``targets`` are its parts by relationship."""
    try:
        strings = [_wide(d, 1)[0] for kind, d in _bin_records(z.read("xl/sharedStrings.bin")) if kind == 19] if "xl/sharedStrings.bin" in z.namelist() else []
        out = []
        for kind, d in _bin_records(z.read("xl/workbook.bin")):
            if kind == 156:
                part, at = _wide(d, 8)
                target = targets.get(part, "")
                path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                out.append((_wide(d, at)[0], _xlsb_cells(z.read(path), strings)))
        return out
    except (struct.error, ValueError, IndexError, KeyError, zipfile.BadZipFile) as e:
        raise ConversionError("excel", f"invalid workbook: {e}") from e
