"""A small Markdown parser (CommonMark's and GFM's common forms) that yields flat nodes in order.

Paragraphs are dissolved into their inline nodes, list items and table cells are nodes of their own, and every node
knows its first and last line. Nesting of lists and quotations within blocks is not kept.
"""

from __future__ import annotations

import html
import re
from dataclasses import asdict, dataclass, field

from quillspark.blocks import lines_of, trim


@dataclass(slots=True)
class Node:
    kind: str  # text strong emphasis code_inline break link image delete | heading code list quote hr cell align html
    values: list[Node] = field(default_factory=list)
    value: str = ""
    depth: int = 0
    ordered: bool = False
    lang: str | None = None
    url: str = ""
    row: int = 0
    column: int = 0
    start: int = 0
    end: int = 0

    @property
    def inline(self) -> bool:
        return self.kind in INLINE


INLINE = ("text", "strong", "emphasis", "code_inline", "break", "link", "delete")
ESCAPABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL = re.compile(r"\\.|\\\n|`+|\*+|_+|~~|!?\[|<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*>|<[\w.+-]+@[\w-]+(?:\.[\w-]+)+>|&#?\w+;| {2,}\n|\n", re.S)


def _bracketed(s: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``."""
    depth = 0
    while at < len(s):
        if s[at] == "\\":
            at += 2
            continue
        depth += (s[at] == "[") - (s[at] == "]")
        if not depth:
            return at
        at += 1
    return -1


TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'))?\s*\)")


def _closing(s: str, at: int, mark: str) -> int:
    """Where an emphasis that ``mark`` opened before ``at`` closes."""
    k = at
    while (k := s.find(mark, k)) >= 0:
        run = len(s) - k - len(s[k:].lstrip(mark[0]))
        before, after = s[k - 1 : k], s[k + run : k + run + 1]
        if s[k - 1 : k] == "\\" or before.isspace() or k == at or run < len(mark) or (len(mark) == 1 and run == 2) or (mark[0] == "_" and after.isalnum()):
            k += run
            continue
        return k + run - len(mark) if run > len(mark) else k
    return -1


def inline(s: str, line: int = 0) -> list[Node]:
    out: list[Node] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            out.append(Node("text", value="".join(text), start=line, end=line))
            text.clear()

    def add(node: Node) -> None:
        flush()
        node.start = node.end = line
        out.append(node)

    at = 0
    while m := SPECIAL.search(s, at):
        text.append(s[at : m.start()])
        at, t = m.end(), m[0]
        if t in ("\\\n", "\n") or t.isspace():
            if t == "\n":
                text.append(t)
            else:
                add(Node("break"))
            continue
        if t[0] == "\\":
            text.append(t[1] if t[1] in ESCAPABLE else t)
            continue
        if t[0] == "`":
            end = re.compile(rf"(?<!`){t}(?!`)").search(s, at)
            if end:
                code = s[at : end.start()].replace("\n", " ")
                add(Node("code_inline", value=code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code))
                at = end.end()
                continue
        elif t[0] == "&":
            text.append(html.unescape(t))
            continue
        elif t[0] == "<":
            add(Node("link", [Node("text", value=t[1:-1])], url=t[1:-1] if ":" in t else f"mailto:{t[1:-1]}"))
            continue
        elif t in ("[", "!["):
            close = _bracketed(s, m.end() - 1)
            target = TARGET.match(s, close + 1) if close >= 0 else None
            if target:
                url = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", target[1] if target[1] is not None else target[2])
                inner = s[m.end() : close]
                add(Node("image", value=inner, url=url) if t == "![" else Node("link", inline(inner, line), url=url))
                at = target.end()
                continue
        else:
            kinds = {1: "emphasis", 2: "delete" if t == "~~" else "strong"}
            before, after = s[m.start() - 1 : m.start()] if m.start() else "", s[at : at + 1]
            opens = bool(after) and not after.isspace() and not (t[0] == "_" and before.isalnum())
            if opens and (t == "~~" or len(t) <= 3):
                widths = (2,) if t == "~~" else (3,) if len(t) == 3 else (len(t),)
                done = False
                for n in widths:
                    mark = t[0] * n
                    end = _closing(s, at, mark)
                    if end >= 0:
                        inner = inline(s[at:end], line)
                        add(Node("emphasis", [Node("strong", inner)]) if n == 3 else Node(kinds[n], inner))
                        at, done = end + n, True
                        break
                if done:
                    continue
        text.append(t)
    text.append(s[at:])
    if not any(text):
        text.clear()
    flush()
    return [n for n in out if n.kind != "text" or n.value]


FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
HR = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"(\s*)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|)$")
DIVIDER = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")


def _cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", trim(line).removeprefix("|"))
    if len(parts) > 1 and not trim(parts[-1]):
        parts.pop()
    return [trim(p).replace("\\|", "|") for p in parts]


def parse(text: str) -> list[Node]:
    lines, out, at = lines_of(text), [], 0

    def plain(k: int) -> bool:
        """Whether line k goes on with a paragraph."""
        x = lines[k]
        if not trim(x) or FENCE.match(x) or ATX.match(x) or HR.match(x) or x.lstrip().startswith(">"):
            return False
        m = ITEM.match(x)
        return not (m and m[3] and (m[2] in "-*+" or m[2] in ("1.", "1)")))

    while at < len(lines):
        x, n = lines[at], at + 1
        if not trim(x):
            at += 1
        elif m := FENCE.match(x):
            close = re.compile(rf" {{0,3}}{m[1][0]}{{{len(m[1])},}}\s*$")
            end = next((k for k in range(at + 1, len(lines)) if close.match(lines[k])), len(lines))
            out.append(Node("code", value="\n".join(lines[at + 1 : end]), lang=m[2] or None, start=n, end=min(end + 1, len(lines))))
            at = end + 1
        elif m := ATX.match(x):
            out.append(Node("heading", inline(trim(m[2] or ""), n), depth=len(m[1]), start=n, end=n))
            at += 1
        elif HR.match(x):
            out.append(Node("hr", start=n, end=n))
            at += 1
        elif x.lstrip().startswith(">"):
            start, part = at, []
            while at < len(lines) and (lines[at].lstrip().startswith(">") or part and part[-1] and plain(at)):
                part.append(re.sub(r"^\s*> ?", "", lines[at]))
                at += 1
            out.append(Node("quote", inline("\n".join(part).strip("\n"), start + 1), start=start + 1, end=at))
        elif (m := ITEM.match(x)) and (m[3] or m[2]):
            start, part, left = at, [m[3] or ""], len(m[1])
            at += 1
            while at < len(lines) and trim(lines[at]) and not ITEM.match(lines[at]) and (plain(at) or len(lines[at]) - len(lines[at].lstrip()) > left):
                part.append(trim(lines[at]))
                at += 1
            body = re.sub(r"^\[[ xX]\]\s+", "", "\n".join(part))
            out.append(Node("list", inline(body, start + 1), ordered=m[2][0].isdigit(), depth=left // 2, start=start + 1, end=at))
        elif "|" in x and at + 1 < len(lines) and "-" in lines[at + 1] and DIVIDER.match(lines[at + 1]) and len(_cells(x)) == len(_cells(lines[at + 1])):
            width, r = len(_cells(x)), 0
            out += [Node("cell", inline(c, n), row=0, column=k, start=n, end=n) for k, c in enumerate(_cells(x))]
            out.append(Node("align", value=trim(lines[at + 1]), start=n + 1, end=n + 1))
            at += 2
            while at < len(lines) and trim(lines[at]) and "|" in lines[at]:
                r += 1
                cells = (_cells(lines[at]) + [""] * width)[:width]
                out += [Node("cell", inline(c, at + 1), row=r, column=k, start=at + 1, end=at + 1) for k, c in enumerate(cells)]
                at += 1
        elif x.startswith("    ") or x.startswith("\t"):
            start = at
            while at < len(lines) and (lines[at].startswith(("    ", "\t")) or not trim(lines[at])):
                at += 1
            part = [re.sub(r"^(?: {4}|\t)", "", y) for y in lines[start:at]]
            while part and not trim(part[-1]):
                part.pop()
            out.append(Node("code", value="\n".join(part), start=start + 1, end=start + len(part)))
        elif re.match(r" {0,3}<(?:!--|[A-Za-z/?!])", x) and not re.match(r" {0,3}<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*>", x):
            start = at
            while at < len(lines) and trim(lines[at]):
                at += 1
            out.append(Node("html", value="\n".join(lines[start:at]), start=start + 1, end=at))
        else:
            start, part = at, [x.strip(" \t")]
            at += 1
            title = None
            while at < len(lines):
                if SETEXT.match(lines[at]):
                    title = 1 if trim(lines[at])[0] == "=" else 2
                    at += 1
                    break
                if not plain(at):
                    break
                part[-1] = part[-1] if not lines[at - 1].endswith("  ") else part[-1] + "  "
                part.append(lines[at].strip(" \t"))
                at += 1
            found = inline("\n".join(part), start + 1)
            if title:
                out.append(Node("heading", found, depth=title, start=start + 1, end=at))
            else:
                for node in found:
                    node.end = at
                out += found
    return out


def text_of(nodes: list[Node]) -> str:
    """Plain text of inline nodes; a break is a blank."""
    return "".join(" " if n.kind == "break" else n.value if n.kind in ("text", "code_inline") else text_of(n.values) if n.kind in ("strong", "emphasis", "link", "delete") else "" for n in nodes)


def as_dicts(nodes: list[Node]) -> list[dict]:
    """Nodes as plain values without empty fields, for the JSON tree."""
    out = []
    for n in nodes:
        d = {k: v for k, v in asdict(n).items() if v not in (None, "", [], 0, False) and k not in ("kind", "values", "start", "end", "row", "column")}
        d = {"type": n.kind} | d
        if n.kind == "cell":
            d |= {"row": n.row, "column": n.column}
        if n.values:
            d["values"] = as_dicts(n.values)
        if n.start:
            d["position"] = {"start": n.start, "end": n.end}
        out.append(d)
    return out
