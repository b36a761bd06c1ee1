"""reStructuredText, Org, MediaWiki and AsciiDoc: line grammars that yield blocks.

Each grammar is a list of rules tried in order at each line that is not blank. A rule looks at the cursor and either
returns the blocks it has read, having moved on, or None. What no rule takes is a paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quillspark.blocks import Block, fence, grid, heading, item, lines_of, para, rule, trim, utf8

PUNCTUATION = r"!-/:-@\[-`{-~"


class Cursor:
    """A place in a document's lines."""

    def __init__(self, text: str):
        self.lines, self.at = lines_of(text), 0
        self.state: dict = {}

    def __bool__(self) -> bool:
        return self.at < len(self.lines)

    def line(self, ahead: int = 0) -> str | None:
        k = self.at + ahead
        return self.lines[k] if k < len(self.lines) else None

    @property
    def bare(self) -> str:
        return trim(self.lines[self.at])

    def skip(self, n: int = 1) -> None:
        self.at += n

    def until(self, stop: Callable[[str], bool]) -> list[str]:
        """Lines before the first that stops, which is passed over too."""
        out = []
        while self and not stop(self.lines[self.at]):
            out.append(self.lines[self.at])
            self.at += 1
        self.at += 1
        return out

    def paragraph(self, ends: Callable[[str], bool]) -> str:
        """This line and those that follow without a blank line or one that ends it, trimmed and joined by blanks."""
        out = [self.bare]
        self.at += 1
        while self and self.bare and not ends(self.lines[self.at]):
            out.append(self.bare)
            self.at += 1
        return " ".join(out)


Rule = Callable[[Cursor], "list[Block] | None"]


def read(text: str, rules: list[Rule], default: Rule) -> list[Block]:
    cursor, out = Cursor(text), []
    while cursor:
        if not cursor.bare:
            cursor.skip()
            continue
        found = next((x for r in rules if (x := r(cursor)) is not None), None)
        out += default(cursor) if found is None else found
    return out


def quoted(lines: list[str], inline: Callable[[str], str], keep: bool = False) -> Block:
    """Lines as one quotation; blank ones stay in it."""
    text = [inline(x if keep else trim(x)) if trim(x) else "" for x in lines]
    return Block("quote", "".join(f"> {x}\n" if trim(y) else ">\n" for x, y in zip(text, lines, strict=True)) + "\n", text="\n".join(text))


def boxed(rows: list[list[str]]) -> list[Block]:
    md = grid(rows, dashes=" --- ", escape=False)
    return [Block("table", md + "\n", cells=rows)] if md else []


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def same(s: str, c: str, least: int) -> bool:
    """Whether s is c alone, ``least`` times or more."""
    return len(s) >= least and s == c * len(s)


ENUMERATED = re.compile(r"[0-9]+[.)] ")


def emphasis(s: str, mark: str, wrap: str) -> str:
    """Text between two marks that stand at the edges of words, wrapped anew."""
    m = re.escape(mark)
    pattern = rf"(?:(?<=[\s{PUNCTUATION}])|(?<![\s\S])){m}(?=[^\s])([\s\S]*?)(?<=[^\s]){m}(?=[\s{PUNCTUATION}]|\Z)"
    out, at = [], 0
    while (k := s.find(mark, at)) >= 0:
        found = re.compile(pattern).match(s, k)
        # the closing mark is a character after the opening one at least, and may be the very next
        if found:
            out += [s[at:k], wrap, found[1], wrap]
            at = found.end()
        else:
            out.append(s[at : k + 1])
            at = k + 1
    return "".join(out) + s[at:]


# reStructuredText

UNDERLINES = "=-~^\"'`#*+.:_"
# Directives that are admonitions.
RST_ADMONITIONS = ("note", "warning", "important", "tip", "caution", "attention", "danger", "error", "hint")
#: What is rewritten within a line: the name of a role, literal text, and what stands between backquotes with its underscores.
RST_INLINE = re.compile(r":\w+:(?=`)|``(?P<literal>.*?)``|`(?!`)(?:(?P<label>[^`]*) <(?P<target>[^`]*)>|(?P<plain>[^`]*))`_*", re.DOTALL)


def underline(line: str | None) -> str:
    """The character that a line consists of, if it can underline."""
    s = (line or "").rstrip()
    return s[0] if s and s[0] in UNDERLINES and s == s[0] * len(s) else ""


def rst_inline(s: str) -> str:
    def shown(m: re.Match) -> str:
        literal, label, target, plain = m.group("literal", "label", "target", "plain")
        return f"`{literal}`" if literal is not None else f"[{label}]({target})" if label is not None else plain or ""

    return RST_INLINE.sub(shown, s)


def indented(cursor: Cursor, base: int) -> list[str]:
    """The lines further in than ``base`` that follow, moved to the left edge, without blank lines around."""
    while cursor and not cursor.bare:
        cursor.skip()
    out = []
    while cursor and (not cursor.bare or indent(cursor.lines[cursor.at]) > base):
        out.append(cursor.lines[cursor.at] if cursor.bare else "")
        cursor.skip()
    while out and not out[-1]:
        out.pop()
    left = min((indent(x) for x in out if x), default=0)
    return [x[left:] if len(x) >= left else x.lstrip() for x in out]


def _rst_title(cursor: Cursor, mark: str, text: str, n: int) -> list[Block]:
    order = cursor.state.setdefault("order", [])
    if mark not in order:
        order.append(mark)
    cursor.skip(n)
    return [heading(min(order.index(mark) + 1, 6), rst_inline(trim(text)))]


def rst_overlined(cursor: Cursor) -> list[Block] | None:
    over, title = underline(cursor.line()), cursor.line(1)
    if over and cursor.line(2) is not None and underline(cursor.line(2)) == over and trim(title) and len(cursor.bare) >= len(trim(title)):
        return _rst_title(cursor, over, title, 3)
    return None


def rst_underlined(cursor: Cursor) -> list[Block] | None:
    line, mark = cursor.line(), underline(cursor.line(1))
    if mark and len(cursor.line(1).rstrip()) >= len(line.rstrip()) > 0:
        return _rst_title(cursor, mark, line, 2)
    return None


def rst_transition(cursor: Cursor) -> list[Block] | None:
    if underline(cursor.line()) and len(cursor.bare) >= 4:
        cursor.skip()
        return [rule()]
    return None


def rst_directive(cursor: Cursor) -> list[Block] | None:
    line = cursor.line()
    if not line.lstrip().startswith(".. "):
        return None
    text, base = line.lstrip()[3:], indent(line)
    cursor.skip()
    block = indented(cursor, base)
    name, marked, rest = text.partition("::")
    rest = trim(rest)
    if marked and name in ("code-block", "sourcecode"):
        return [fence(block, rest)]
    if marked and name == "list-table":
        rows: list[list[str]] = []
        for x in map(str.lstrip, block):
            if x.startswith("* - "):
                rows.append([rst_inline(trim(x[4:]))])
            elif x.startswith("- ") and rows:
                rows[-1].append(rst_inline(trim(x[2:])))
        return boxed(rows)
    if marked and name in RST_ADMONITIONS:
        body = quoted(block, rst_inline, keep=True)
        lead = f"> **{name.capitalize()}:**" + (f" {rst_inline(rest)}" if rest else "") + "\n"
        return [Block("quote", lead + body.md, text=rest + "\n" * bool(rest and block) + body.text)]
    if marked and name in ("image", "figure"):
        return [para(f"![]({rest})")]
    return []


def rst_item(cursor: Cursor) -> list[Block] | None:
    line = cursor.line()
    s = line.lstrip()
    ordered = s.startswith("#. ") or ENUMERATED.match(s)
    if not ordered and s[:2] not in ("* ", "- ", "+ "):
        return None
    cursor.skip()
    return [item(rst_inline(trim(s[s.index(" ") :])), indent(line) // 3, bool(ordered))]


def rst_literal(cursor: Cursor) -> list[Block] | None:
    line, start = cursor.line(), cursor.at
    if not line.rstrip().endswith("::"):
        return None
    cursor.skip()
    block = indented(cursor, indent(line))
    if not block:
        cursor.at = start
        return None
    text = trim(line.rstrip()[:-2])
    return [*([para(rst_inline(text) + ":")] if text else []), fence(block)]


def rst_paragraph(cursor: Cursor) -> list[Block]:
    base = indent(cursor.line())
    text = rst_inline(cursor.paragraph(lambda x: bool(underline(x)) or indent(x) != base))
    return [Block("quote", f"> {text}\n\n", text=text) if base else para(text)]


def read_rst(data: bytes) -> list[Block]:
    return read(utf8(data, "rst"), [rst_overlined, rst_underlined, rst_transition, rst_directive, rst_item, rst_literal], rst_paragraph)


# Org


def org_inline(s: str) -> str:
    def link(m: re.Match) -> str:
        url, two, text = m[1].partition("][")
        return f"[{text if two else url}]({url})"

    s = re.sub(r"\[\[([\s\S]*?)\]\]", link, s)
    for mark, wrap in (("*", "**"), ("/", "*"), ("~", "`"), ("=", "`"), ("+", "~~")):
        s = emphasis(s, mark, wrap)
    return s


def org_special(line: str) -> bool:
    t = trim(line)
    return t.startswith(("*", "#+", "|", "- ", "+ ")) or bool(ENUMERATED.match(t)) or same(t, "-", 5)


def org_drawer(cursor: Cursor) -> list[Block] | None:
    if cursor.bare != ":PROPERTIES:":
        return None
    cursor.until(lambda x: trim(x) == ":END:")
    return []


def org_keyword(cursor: Cursor) -> list[Block] | None:
    t = cursor.bare
    if not t.startswith("#+"):
        return None
    if t.startswith(("#+TITLE:", "#+title:")):
        cursor.skip()
        return [heading(1, org_inline(trim(t[8:])))]
    low = t.lower()
    for name in ("src", "example", "quote"):
        if low.startswith(f"#+begin_{name}"):
            cursor.skip()
            body = cursor.until(lambda x: trim(x).lower().startswith(f"#+end_{name}"))
            return [quoted(body, org_inline) if name == "quote" else fence(body, trim(t[11:]) if name == "src" else "")]
    if low.startswith("#+begin_"):
        return None
    cursor.skip()
    return []


def org_heading(cursor: Cursor) -> list[Block] | None:
    m = re.match(r"(\*+) (.*)\Z", cursor.bare, re.S)
    if not m:
        return None
    cursor.skip()
    return [heading(min(len(m[1]), 6), org_inline(trim(m[2])))]


def org_rule(cursor: Cursor) -> list[Block] | None:
    if not same(cursor.bare, "-", 5):
        return None
    cursor.skip()
    return [rule()]


def org_table(cursor: Cursor) -> list[Block] | None:
    if not cursor.bare.startswith("|"):
        return None
    rows = []
    while cursor and cursor.bare.startswith("|"):
        if cursor.bare.strip("|-+"):
            rows.append([org_inline(trim(c)) for c in cursor.bare.strip("|").split("|")])
        cursor.skip()
    return boxed(rows)


def org_item(cursor: Cursor) -> list[Block] | None:
    t = cursor.bare
    ordered = ENUMERATED.match(t)
    if not ordered and t[:2] not in ("- ", "+ "):
        return None
    depth = indent(cursor.line()) // 2
    cursor.skip()
    return [item(org_inline(t[ordered.end() if ordered else 2 :]), depth, bool(ordered))]


def org_paragraph(cursor: Cursor) -> list[Block]:
    return [para(org_inline(cursor.paragraph(org_special)))]


def read_org(data: bytes) -> list[Block]:
    return read(utf8(data, "org"), [org_drawer, org_keyword, org_heading, org_rule, org_table, org_item], org_paragraph)


# MediaWiki


def without_spans(s: str, tag: str) -> str:
    """Without elements of a name, and what they hold."""
    out, at = [], 0
    while (start := s.find(f"<{tag}", at)) >= 0:
        out.append(s[at:start])
        gt = s.find(">", start)
        if gt < 0:
            return "".join(out)
        close = -1 if s[gt - 1] == "/" else s.find(f"</{tag}>", gt + 1)
        at = gt + 1 if close < 0 else close + len(tag) + 3
    return "".join(out) + s[at:]


def without_templates(s: str) -> str:
    """Without nested ``{{ }}``."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}", s):
        if m.start() < at:
            continue
        if m[0] == "{{" or depth:
            if not depth:
                out.append(s[at : m.start()])
            depth += 1 if m[0] == "{{" else -1
            at = m.end()
    return "".join(out) + ("" if depth else s[at:])


WIKI_LINK = re.compile(r"\[\[(?P<inner>[\s\S]*?)\]\]|\[(?P<url>https?://[^\]]*)\]")


def wiki_links(s: str) -> str:
    def link(m: re.Match) -> str:
        if m["inner"] is not None:
            inner = m["inner"]
            if inner.lower().startswith("category:"):
                return ""
            target, bar, text = inner.partition("|")
            return f"{'!' * inner.lower().startswith(('file:', 'image:'))}[{text if bar else target}]({target})"
        url, _, text = m["url"].partition(" ")
        return f"[{trim(text) or url}]({url})"

    return WIKI_LINK.sub(link, s)


def wiki_inline(s: str) -> str:
    s = wiki_links(without_templates(without_spans(s, "ref")))
    for old, new in (("'''''", "***"), ("'''", "**"), ("''", "*"), ("<code>", "`"), ("</code>", "`"), ("<nowiki>", ""), ("</nowiki>", ""), ("<br />", "  \n"), ("<br/>", "  \n"), ("<br>", "  \n")):
        s = s.replace(old, new)
    return s


def wiki_special(line: str) -> bool:
    t = trim(line)
    return t.startswith(("=", "*", "#", ":", "{|", "<pre>")) or same(t, "-", 4)


def wiki_heading(cursor: Cursor) -> list[Block] | None:
    m = re.match(r"(=+)([^=].*?)(=+)\Z", cursor.bare, re.S)
    if not m:
        return None
    cursor.skip()
    return [heading(min(len(m[1]), 6), wiki_inline(trim(m[2])))]


def wiki_rule(cursor: Cursor) -> list[Block] | None:
    if not same(cursor.bare, "-", 4):
        return None
    cursor.skip()
    return [rule()]


def wiki_table(cursor: Cursor) -> list[Block] | None:
    if not cursor.bare.startswith("{|"):
        return None
    cursor.skip()
    rows: list[list[str]] = [[]]
    for t in map(trim, cursor.until(lambda x: trim(x).startswith("|}"))):
        if t.startswith("|-"):
            rows.append([])
        elif t[:1] in ("!", "|"):
            rows[-1] += [wiki_inline(trim(c)) for c in t[1:].split(t[0] * 2)]
    return boxed([r for r in rows if r])


def wiki_pre(cursor: Cursor) -> list[Block] | None:
    t = cursor.bare
    if not t.startswith("<pre>"):
        return None
    first = t[5:]
    cursor.skip()
    if first.endswith("</pre>"):
        return [fence(filter(None, [first[:-6]]))]
    body = cursor.until(lambda x: "</pre>" in x)
    last = cursor.lines[cursor.at - 1].partition("</pre>")[0] if cursor.at <= len(cursor.lines) else ""
    return [fence([*([first] if first else []), *body, *([last] if last else [])])]


def wiki_code(cursor: Cursor) -> list[Block] | None:
    body = []
    while cursor and cursor.line().startswith(" ") and cursor.bare:
        body.append(cursor.line()[1:])
        cursor.skip()
    return [fence(body)] if body else None


def wiki_item(cursor: Cursor) -> list[Block] | None:
    t = cursor.bare
    if t[0] not in "*#:":
        return None
    depth = len(t) - len(t.lstrip(t[0]))
    text = wiki_inline(trim(t[depth:]))
    cursor.skip()
    return [Block("quote", f"> {text}\n", text=text) if t[0] == ":" else item(text, depth - 1, t[0] == "#")]


def wiki_category(cursor: Cursor) -> list[Block] | None:
    if not cursor.bare.lower().startswith("[[category:"):
        return None
    cursor.skip()
    return []


def wiki_paragraph(cursor: Cursor) -> list[Block]:
    return [para(wiki_inline(cursor.paragraph(wiki_special)))]


def read_mediawiki(data: bytes) -> list[Block]:
    return read(utf8(data, "mediawiki"), [wiki_heading, wiki_rule, wiki_table, wiki_pre, wiki_code, wiki_item, wiki_category], wiki_paragraph)


# AsciiDoc

# Labels of admonitions.
ADOC_ADMONITIONS = ("NOTE", "TIP", "WARNING", "IMPORTANT", "CAUTION")
ADOC_LINK = re.compile(r"(?:link:([^\s\[]*)|(https?://[^\s\[]*))\[([^\]]*)\]")


def adoc_inline(s: str) -> str:
    s = ADOC_LINK.sub(lambda m: f"[{m[3] or m[1] or m[2] or ''}]({m[1] if m[1] is not None else m[2]})", s)
    return emphasis(emphasis(s, "*", "**"), "_", "*")


def adoc_special(line: str) -> bool:
    t = trim(line)
    return t.startswith(("=", "*", "[", "|===", "image::", "//", ". ")) or any(same(t, c, 4) for c in "-._/") or t == "'''"


def adoc_comment(cursor: Cursor) -> list[Block] | None:
    if not cursor.bare.startswith("//"):
        return None
    block = same(cursor.bare, "/", 4)
    cursor.skip()
    if block:
        cursor.until(lambda x: same(trim(x), "/", 4))
    return []


def adoc_attribute(cursor: Cursor) -> list[Block] | None:
    if not re.match(r":[\w!-]+:", cursor.bare):
        return None
    cursor.skip()
    return []


def _fenced(cursor: Cursor, c: str) -> list[str]:
    return cursor.until(lambda x: same(trim(x), c, 4))


def adoc_attributes(cursor: Cursor) -> list[Block] | None:
    """A line in brackets: it says how to read the block after it, or nothing."""
    t = cursor.bare
    if not (t.startswith("[") and t.endswith("]")):
        return None
    inner = t[1:-1]
    if m := re.search(r'cols="([^"]*)"', inner):
        cursor.state["columns"] = m[1].count(",") + 1
    name, opens = trim(inner).upper(), trim(cursor.line(1) or "")
    cursor.skip()
    if name in ADOC_ADMONITIONS and same(opens, "=", 4):
        cursor.skip()
        body = quoted(_fenced(cursor, "="), adoc_inline)
        return [Block("quote", f"> **{name.capitalize()}:**\n{body.md}", text=body.text)]
    if name.startswith("QUOTE") and same(opens, "_", 4):
        cursor.skip()
        return [quoted(_fenced(cursor, "_"), adoc_inline)]
    if inner.startswith("source") and same(opens, "-", 4):
        cursor.skip()
        return [fence(_fenced(cursor, "-"), trim(inner[6:].lstrip(",")))]
    return []


def adoc_heading(cursor: Cursor) -> list[Block] | None:
    m = re.match(r"(={1,6}) (.*)\Z", cursor.bare, re.S)
    if not m:
        return None
    cursor.skip()
    return [heading(len(m[1]), adoc_inline(trim(m[2])))]


def adoc_delimited(cursor: Cursor) -> list[Block] | None:
    c = next((c for c in "-._" if same(cursor.bare, c, 4)), None)
    if c is None:
        return None
    cursor.skip()
    body = _fenced(cursor, c)
    return [quoted(body, adoc_inline, keep=True) if c == "_" else fence(body)]


def adoc_table(cursor: Cursor) -> list[Block] | None:
    if not cursor.bare.startswith("|==="):
        return None
    cursor.skip()
    cells: list[str] = []
    first = 0  # cells before the first blank line
    for t in map(trim, cursor.until(lambda x: trim(x) == "|===")):
        if not t:
            first = first or len(cells)
        cells += [adoc_inline(trim(c)) for c in t.split("|") if trim(c)]
    n = cursor.state.pop("columns", 0) or first or max(len(cells), 1)
    return boxed([cells[k : k + n] for k in range(0, len(cells), n)])


def adoc_rule(cursor: Cursor) -> list[Block] | None:
    if cursor.bare not in ("'''", "---"):
        return None
    cursor.skip()
    return [rule()]


def adoc_image(cursor: Cursor) -> list[Block] | None:
    m = re.match(r"image::([^\[]*)\[(.*)\Z", cursor.bare, re.S)
    if not m:
        return None
    cursor.skip()
    return [para(f"![{m[2].rstrip(']')}]({m[1]})")]


def adoc_admonition(cursor: Cursor) -> list[Block] | None:
    name, colon, text = cursor.bare.partition(": ")
    if not colon or name not in ADOC_ADMONITIONS:
        return None
    cursor.skip()
    return [Block("quote", f"> **{name.capitalize()}:** {adoc_inline(text)}\n\n", text=text)]


def adoc_item(cursor: Cursor) -> list[Block] | None:
    m = re.match(r"(\*+|\.{1,3}) (.*)\Z", cursor.bare, re.S)
    if not m:
        return None
    cursor.skip()
    return [item(adoc_inline(trim(m[2])), len(m[1]) - 1, m[1][0] == ".")]


def adoc_paragraph(cursor: Cursor) -> list[Block]:
    return [para(adoc_inline(cursor.paragraph(adoc_special)))]


def read_asciidoc(data: bytes) -> list[Block]:
    rules = [adoc_comment, adoc_attribute, adoc_attributes, adoc_heading, adoc_delimited, adoc_table, adoc_rule, adoc_image, adoc_admonition, adoc_item]
    return read(utf8(data, "asciidoc"), rules, adoc_paragraph)
