"""Excel workbooks (xlsx, ods; binary ones by ``legacy``), Word documents and PowerPoint presentations."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

from quillspark.blocks import Block, ConversionError, escape_pipe, grid, heading, number, para, trim
from quillspark.sources.legacy import xls_sheets, xlsb_sheets
from quillspark.sources.xml import Event, events


def archive(data: bytes, format: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, EOFError) as e:
        raise ConversionError(format, str(e)) from e


def member(z: zipfile.ZipFile, name: str, format: str) -> str:
    try:
        return z.read(name).decode("utf-8").removeprefix("﻿")
    except KeyError as e:
        raise ConversionError(format, f"Entry not found: {name}") from e
    except (UnicodeDecodeError, zipfile.BadZipFile, RuntimeError) as e:
        raise ConversionError(format, str(e)) from e


def relationships(z: zipfile.ZipFile, name: str, format: str) -> dict[str, str]:
    """Targets by id; empty where the part is missing."""
    try:
        found = [e.attrs for e in events(member(z, name, format), format) if e.kind in ("start", "empty") and e.local == "Relationship"]
    except ConversionError:
        return {}
    return {a["Id"]: a["Target"] for a in found if "Id" in a and "Target" in a}


# Excel

# Names of cell errors.
CELL_ERRORS = {"#DIV/0!": "Div0", "#N/A": "NA", "#NAME?": "Name", "#NULL!": "Null", "#NUM!": "Num", "#REF!": "Ref", "#VALUE!": "Value", "#GETTING_DATA": "GettingData"}

Cells = dict[tuple[int, int], str]


def cell_number(s: str) -> str:
    try:
        x = float(s)
    except ValueError:
        return escape_pipe(s)
    return f"{x:.0f}" if x == int(x) and abs(x) < 2**63 else number(x)


def _place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", ref)
    if not m:
        raise ConversionError("excel", f"cell reference {ref}")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out, here, skipped = [], None, 0
    for e in events(member(z, "xl/sharedStrings.xml", "excel"), "excel"):
        if e.local == "si":
            if e.kind == "end" or e.kind == "empty":
                out.append("".join(here or []))
            here = []
        elif e.local == "rPh":
            skipped += {"start": 1, "end": -1}.get(e.kind, 0)
        elif e.kind in ("text", "cdata") and here is not None and not skipped and inside == "t":
            here.append(e.text)
        inside = e.local if e.kind == "start" else "" if e.kind == "end" else inside if e.kind in ("text", "cdata") else ""
    return out


def _sheet_cells(xml: str, strings: list[str]) -> Cells:
    cells: Cells = {}
    at, kind, part, parts = (0, -1), "", "", {}
    for e in events(xml, "excel"):
        if e.kind in ("start", "empty") and e.local == "row":
            at = int(e.attrs["r"]) - 1 if "r" in e.attrs else at[0] + (at[1] >= 0), -1
        elif e.kind in ("start", "empty") and e.local == "c":
            at = _place(e.attrs["r"]) if "r" in e.attrs else (at[0], at[1] + 1)
            kind, parts = e.attrs.get("t", "n"), {}
        elif e.kind == "start" and e.local in ("v", "t"):
            part = e.local
        elif e.kind in ("text", "cdata") and part:
            parts[part] = parts.get(part, "") + e.text
        elif e.kind == "end" and e.local in ("v", "t"):
            part = ""
        elif e.kind == "end" and e.local == "c":
            v = parts.get("v", "")
            if kind == "s" and v:
                text = escape_pipe(strings[int(v)])
            elif kind == "inlineStr":
                text = escape_pipe(parts.get("t", ""))
            elif kind == "b":
                text = "true" if v == "1" else "false"
            elif kind == "e":
                text = "#" + CELL_ERRORS.get(v, v)
            elif kind in ("str", "d"):
                text = escape_pipe(v)
            else:
                text = cell_number(v) if v else ""
            if text:
                cells[at] = text
    return cells


def _dense(cells: Cells) -> list[list[str]]:
    """The rectangle from the first to the last used row and column."""
    if not cells:
        return []
    rows, columns = ({k[i] for k in cells} for i in (0, 1))
    return [[cells.get((r, c), "") for c in range(min(columns), max(columns) + 1)] for r in range(min(rows), max(rows) + 1)]


def _ods_sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, list[list[str]]]]:
    name, cells, r, c, texts, repeat, cell = "", {}, 0, 0, [], (1, 1), {}
    inside = False
    for e in events(member(z, "content.xml", "excel"), "excel"):
        if e.local == "table":
            if e.kind == "start":
                name, cells, r = e.attrs.get("table:name", ""), {}, 0
            else:
                yield name, _dense(cells)
        elif e.local == "table-row":
            if e.kind == "start":
                c, repeat = 0, (min(int(e.attrs.get("table:number-rows-repeated", 1)), 1 << 20), 1)
                first = {}
            elif e.kind == "empty":
                r += int(e.attrs.get("table:number-rows-repeated", 1))
            else:
                if first:
                    for k in range(repeat[0]):
                        cells |= {(r + k, col): t for col, t in first.items()}
                r += repeat[0]
        elif e.local in ("table-cell", "covered-table-cell"):
            if e.kind in ("start", "empty"):
                texts, cell = [], e.attrs
            if e.kind in ("end", "empty"):
                kind = cell.get("office:value-type", "")
                text = cell_number(cell["office:value"]) if kind in ("float", "percentage", "currency") and "office:value" in cell else cell.get("office:boolean-value", "") if kind == "boolean" else escape_pipe("\n".join(texts))
                for _ in range(min(int(cell.get("table:number-columns-repeated", 1)), 1 << 14) if text else 1):
                    if text:
                        first[c] = text
                        c += 1
                if not text:
                    c += int(cell.get("table:number-columns-repeated", 1))
        elif e.local == "p" and e.kind != "end":
            texts.append("")
            inside = e.kind == "start"
        elif e.local == "p":
            inside = False
        elif e.kind in ("text", "cdata") and inside and texts:
            texts[-1] += e.text


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Names and dense rows of a workbook's sheets, in its order."""
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return [(name, _dense(cells)) for name, cells in xls_sheets(data)]
    z = archive(data, "excel")
    names = set(z.namelist())
    if "content.xml" in names:
        return list(_ods_sheets(z))
    if "xl/workbook.bin" in names:
        return [(name, _dense(cells)) for name, cells in xlsb_sheets(z, relationships(z, "xl/_rels/workbook.bin.rels", "excel"))]
    targets, strings = relationships(z, "xl/_rels/workbook.xml.rels", "excel"), _strings(z)
    out = []
    for e in events(member(z, "xl/workbook.xml", "excel"), "excel"):
        if e.kind in ("start", "empty") and e.local == "sheet":
            target = targets.get(e.attrs.get("r:id", ""), "")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            out.append((e.attrs.get("name", ""), _dense(_sheet_cells(member(z, path, "excel"), strings))))
    return out


def islands(rows: list[list[str]]) -> list[list[list[str]]]:
    """Rows between blank rows."""
    return [list(run) for filled, run in itertools.groupby(rows, key=any) if filled]


def is_table(block: list[list[str]]) -> bool:
    """Two rows at least, of which more than half have two filled cells."""
    return len(block) >= 2 and 2 * sum(sum(map(bool, r)) >= 2 for r in block) > len(block)


def read_excel(data: bytes) -> list[Block]:
    out = []
    for k, (name, rows) in enumerate(sheets(data)):
        out.append(Block("heading", "\n" * bool(k) + f"# {name}\n", level=1, text=name))
        blocks = islands(rows)
        if not blocks:
            out.append(Block("para", "\n*Empty sheet*\n"))
        for b in blocks:
            if is_table(b):
                out.append(Block("table", "\n" + grid(b, escape=False), cells=b))
            else:
                lines = ["  ".join(filter(None, r)) for r in b]
                out.append(Block("para", "\n" + "\n".join(f"{x}\n" for x in lines if x), text="\n".join(lines)))
    return out


# Word


def styled(text: str, bold: bool, italic: bool) -> str:
    mark = "*" * (2 * bold + italic) if text else ""
    return f"{mark}{text}{mark}"


def style_level(style: str) -> int:
    m = re.fullmatch(r"(?:heading|titre)\s*\+?0*([1-6])\s*", style.translate(ASCII_LOWER))
    return int(m[1]) if m else 0


ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


@dataclass
class _Paragraph:
    text: str = ""
    style: str = ""
    listed: bool = False


class _Body:
    """What a Word document's events add up to: paragraphs and tables in order."""

    def __init__(self, targets: dict[str, str]):
        self.targets, self.out = targets, []
        self.now: _Paragraph | None = None
        self.bold = self.italic = False
        self.run = False
        self.link: list | None = None  # its target and text
        self.cell: str | None = None
        self.rows: list[list[str]] = []
        self.cells: list[str] = []
        self.last = _Paragraph()

    def take(self, e: Event) -> None:
        if e.kind in ("text", "cdata"):
            if e.kind == "text":
                self.text(e.text)
        elif (act := getattr(self, f"{e.kind}_{e.local}", None)) is not None:
            act(e)

    def text(self, s: str) -> None:
        if self.cell is not None:
            self.cell += s
        elif self.run and self.now is not None:
            s = styled(s, self.bold, self.italic)
            if self.link is not None:
                self.link[1] += s
            else:
                self.now.text += s

    def start_p(self, e: Event) -> None:
        self.now = self.last = _Paragraph()
        self.bold = self.italic = False

    def end_p(self, e: Event) -> None:
        if self.cell is None and self.now is not None:
            self.out.append(self.now)
        self.now = None

    def start_r(self, e: Event) -> None:
        self.run = True

    def end_r(self, e: Event) -> None:
        self.run = self.bold = self.italic = False

    def empty_b(self, e: Event) -> None:
        self.bold = True

    def empty_i(self, e: Event) -> None:
        self.italic = True

    def empty_pStyle(self, e: Event) -> None:  # noqa: N802
        self.last.style = e.attrs.get("w:val", e.attrs.get("val", self.last.style))

    def empty_numPr(self, e: Event) -> None:  # noqa: N802
        self.last.listed = True

    empty_ilvl = empty_numPr

    def start_hyperlink(self, e: Event) -> None:
        ref = next((v for k, v in e.attrs.items() if k in ("r:id", "id")), None)
        self.link = [self.targets.get(ref), ""]

    def end_hyperlink(self, e: Event) -> None:
        if self.link is not None and self.cell is None:
            target, text = self.link
            self.last.text += f"[{text}]({target})" if target is not None else text
        self.link = None

    def start_tbl(self, e: Event) -> None:
        self.rows = []

    def start_tr(self, e: Event) -> None:
        self.cells = []

    def start_tc(self, e: Event) -> None:
        self.cell = ""

    def end_tc(self, e: Event) -> None:
        self.cells.append(trim(self.cell or ""))
        self.cell = None

    def end_tr(self, e: Event) -> None:
        self.rows.append(self.cells)
        self.cells = []

    def end_tbl(self, e: Event) -> None:
        if self.rows:
            self.out.append(self.rows)
        self.rows = []


def read_word(data: bytes) -> list[Block]:
    z = archive(data, "word")
    body = _Body(relationships(z, "word/_rels/document.xml.rels", "word"))
    for e in events(member(z, "word/document.xml", "word"), "word"):
        body.take(e)
    out = []
    for k, p in enumerate(body.out):
        gap = "\n" * bool(k)
        if isinstance(p, list):
            out.append(Block("table", gap + grid(p), cells=p))
        elif level := style_level(p.style):
            out.append(Block("heading", f"{gap}{'#' * level} {p.text}\n", level=level, text=p.text))
        elif p.style.translate(ASCII_LOWER) in ("quote", "intensequote", "blockquote"):
            out.append(Block("quote", f"{gap}> {p.text}\n", text=p.text))
        elif p.listed:
            out.append(Block("list", f"- {p.text}\n", text=p.text))
        else:
            out.append(Block("para", f"{gap}{p.text}\n" if p.text else "", text=p.text))
    return out


# PowerPoint


@dataclass
class _Shape:
    role: str = ""
    bullets: bool = False
    paragraphs: list[str] = field(default_factory=list)


@dataclass
class _Slide:
    shapes: list[_Shape] = field(default_factory=list)
    tables: list[list[list[str]]] = field(default_factory=list)


def _slide(xml: str) -> _Slide:
    out, shape = _Slide(), _Shape()
    inside: set[str] = set()  # of the elements that matter, those that are open
    runs, text, bold, italic = [], "", False, False
    rows, cells, cell = [], [], ""
    on = lambda v: v in ("1", "true")
    for e in events(xml, "powerpoint"):
        name, opens = e.local, e.kind in ("start", "empty")
        if e.kind == "text":
            if "tc" in inside:
                cell += e.text
            elif "t" in inside:
                text += e.text
        elif opens and name in ("sp", "pic") and "tbl" not in inside and e.kind == "start":
            shape = _Shape()
        elif e.kind == "end" and name in ("sp", "pic") and "tbl" not in inside:
            if shape.paragraphs:
                out.shapes.append(shape)
            shape = _Shape()
        elif opens and name == "ph" and e.kind == "empty":
            shape.role = e.attrs.get("type", shape.role) or "body"
        elif e.kind == "empty" and name in ("buChar", "buAutoNum", "buFont") and "pPr" in inside:
            shape.bullets = True
        elif opens and name == "rPr" and "r" in inside:
            bold, italic = on(e.attrs["b"]) if "b" in e.attrs else bold, on(e.attrs["i"]) if "i" in e.attrs else italic
        elif e.kind == "start":
            if name == "p" and "txBody" in inside:
                inside.add("p")
                runs = []
            elif name == "r" and "p" in inside:
                inside.add("r")
                text, bold, italic = "", False, False
            elif name == "t" and "r" in inside or name == "pPr" and "p" in inside or name == "txBody":
                inside.add(name)
            elif name == "tbl":
                inside.add("tbl")
                rows = []
            elif name == "tr" and "tbl" in inside:
                inside.add("tr")
                cells = []
            elif name == "tc" and "tr" in inside:
                inside.add("tc")
                cell = ""
        elif e.kind == "end":
            if name == "r" and "tc" not in inside:
                if "r" in inside and text:
                    runs.append(styled(text, bold, italic))
                    text, bold, italic = "", False, False
            elif name == "p" and "txBody" in inside and "tc" not in inside:
                if "p" in inside and runs:
                    shape.paragraphs.append("".join(runs))
                runs = []
            elif name == "tc":
                cells.append(trim(cell))
                cell = ""
            elif name == "tr":
                rows.append(cells)
                cells = []
            elif name == "tbl":
                if rows:
                    out.tables.append(rows)
                rows = []
            if not (name in ("r", "p") and "tc" in inside):
                inside.discard(name)
    return out


def slide_number(name: str) -> int:
    n = name.removeprefix("ppt/slides/slide").removesuffix(".xml")
    return int(n) if n.isascii() and n.isdigit() and int(n) < 2**32 else 0


def slide_blocks(slide: _Slide, k: int) -> Iterator[Block]:
    shapes = slide.shapes
    titled = bool(shapes) and shapes[0].role in ("title", "ctrTitle")
    yield heading(1, " ".join(shapes[0].paragraphs) if titled else f"Slide {k + 1}")
    rest = shapes[titled:]
    if not rest and not slide.tables and not titled:
        yield Block("para", "*Empty slide*\n")
    for s in rest:
        if s.role == "subTitle":
            if text := " ".join(s.paragraphs):
                yield heading(2, text)
            continue
        for p in filter(None, map(trim, s.paragraphs)):
            yield Block("list", f"- {p}\n", text=p) if s.bullets else para(p)
        if s.bullets:
            yield Block("raw", "\n")
    for t in slide.tables:
        yield Block("table", grid(t) + "\n", cells=t)


def notes_text(slide: _Slide) -> str:
    """Paragraphs of the notes, without blank ones and those of digits alone."""
    texts = (trim(p) for s in slide.shapes for p in s.paragraphs)
    return "\n".join(t for t in texts if t and not (t.isascii() and t.isdigit()))


def read_powerpoint(data: bytes) -> list[Block]:
    z = archive(data, "powerpoint")
    names = [n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")]
    out = []
    for k, name in enumerate(sorted(names, key=slide_number)):
        if k:
            out.append(Block("hr", "\n---\n\n"))
        out += slide_blocks(_slide(member(z, name, "powerpoint")), k)
        notes = name.replace("ppt/slides/slide", "ppt/notesSlides/notesSlide")
        if notes in z.namelist() and (text := notes_text(_slide(member(z, notes, "powerpoint")))):
            out.append(Block("quote", f"> **Notes**: {text}\n\n", text=text))
    return out
