"""A lenient XML event stream, the XML reader, and the XML-based office formats' common ground."""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from quillspark.blocks import Block, ConversionError, escape_pipe, grid, heading, trim, utf8

TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!(?:[^<>\[]|\[.*?\])*>|</(?P<end>[^\s>]+)\s*>|<(?P<start>[^\s/>!?]+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|(?P<text>[^<]+)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


@dataclass(slots=True)
class Event:
    kind: str  # start, empty, end, text, cdata
    name: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]


def events(text: str, format: str) -> Iterator[Event]:
    """Tags and texts in order. End tags must match; attribute values stay as written; texts have entities decoded."""
    at, open_tags = 0, []
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ConversionError(format, f"Invalid XML at character {at}")
        at = m.end()
        if m["start"]:
            attrs: dict[str, str] = {}
            for k, a, b in ATTRIBUTE.findall(m["attrs"]):
                attrs.setdefault(k, a or b)
            if not m["empty"]:
                open_tags.append(m["start"])
            yield Event("empty" if m["empty"] else "start", m["start"], attrs)
        elif m["end"]:
            if not open_tags or open_tags.pop() != m["end"]:
                raise ConversionError(format, f"Invalid XML: unexpected end tag {m['end']}")
            yield Event("end", m["end"])
        elif m["cdata"] is not None:
            yield Event("cdata", text=m["cdata"])
        elif m["text"]:
            yield Event("text", text=html.unescape(m["text"]) if "&" in m["text"] else m["text"])


@dataclass(slots=True)
class Element:
    name: str
    attrs: dict[str, str]
    texts: list[str] = field(default_factory=list)
    children: list[Element] = field(default_factory=list)


def tree(text: str, format: str = "xml") -> Element:
    """The last root element; texts and children are kept apart."""
    root, path = None, []
    for e in events(text, format):
        if e.kind in ("start", "empty"):
            new = Element(e.local, e.attrs)
            if e.kind == "start":
                path.append(new)
                continue
        elif e.kind == "end":
            new = path.pop()
        else:
            if path and trim(e.text):
                path[-1].texts.append(trim(e.text))
            continue
        if path:
            path[-1].children.append(new)
        else:
            root = new
    if root is None:
        raise ConversionError(format, "Empty XML document")
    return root


def element_blocks(e: Element, depth: int) -> Iterator[Block]:
    yield heading(min(depth, 6), e.name)
    if e.attrs:
        cells = [list(x) for x in e.attrs.items()]
        yield Block("kv", grid([["Attribute", "Value"], *cells]) + "\n", cells=cells)
    if e.texts:
        yield Block("para", "".join(f"{t}\n" for t in e.texts) + "\n", text="\n".join(e.texts))
    for _, run in itertools.groupby(e.children, key=lambda c: c.name):
        run = list(run)
        if len(run) > 1 and not any(c.children for c in run):
            yield from _leaves(run, depth + 1)
        else:
            for c in run:
                yield from element_blocks(c, depth + 1)


def _leaves(run: list[Element], depth: int) -> Iterator[Block]:
    """Leaf elements of one name as a table: their attributes, and their text where any has some."""
    yield heading(min(depth, 6), run[0].name)
    columns = list(dict.fromkeys(k for e in run for k in e.attrs))
    if any(e.texts for e in run):
        columns.append("text")
    if columns:
        cells = [[" ".join(e.texts) if c == "text" else e.attrs.get(c, "") for c in columns] for e in run]
        yield Block("table", grid([columns, *cells]) + "\n", cells=[columns, *cells])


def read_xml(data: bytes) -> list[Block]:
    return list(element_blocks(tree(utf8(data, "xml").removeprefix("﻿")), 1))


__all__ = ["Element", "Event", "escape_pipe", "events", "read_xml", "tree"]
