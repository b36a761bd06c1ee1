"""HTML to Markdown, by rules of our own.

Front matter (title, and the meta elements description, keywords, author) where the head has any; the title as the
first heading; headings, paragraphs, lists (nested by two blanks), quotations, preformatted code, tables, rules, links,
images, emphasis; scripts with content as code blocks; styles, templates and comments are left out. A character
reference is one of a known name or of a number and ends with a semicolon; anything else after an ampersand is text.
The first title element is the title. A title that the first heading repeats, a heading without text and one in a table
are blocks with no Markdown of their own.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

from quillspark.blocks import Block, fence, grid, heading, markdown, para, rule, trim, utf8

INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~", "code": "`", "kbd": "`", "samp": "`", "tt": "`"}
BREAKS = frozenset("p div section article header footer nav aside main figure figcaption address form fieldset dl dt dd html body head details summary center".split())
SILENT = frozenset("style template noscript iframe object svg math select textarea".split())
META = ("description", "keywords", "author")
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
#: A script's type to the language of its code block.
SCRIPTS = {"": "javascript", "text/javascript": "javascript", "application/javascript": "javascript", "module": "javascript", "application/json": "json", "application/ld+json": "json"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.titles: list[str] = []
        self.meta: dict[str, str] = {}
        self.text: list[str] = []
        self.lists: list[list] = []  # ordered, next number
        self.quotes = self.silent = 0
        self.links: list[tuple[str, int]] = []
        self.marks: list[tuple[str, int]] = []
        self.level = self.before = 0  # of the open heading: its level, the blocks before it
        self.pre: list[str] | None = None
        self.lang = ""
        self.script: list[str] | None = None
        self.in_title = False
        self.item: tuple[int, str] | None = None
        self.rows: list[list[str]] | None = None

    def flush(self) -> None:
        """What inline text has gathered becomes a block."""
        if not self.text:
            return
        text = trim(re.sub(r"[ \t\n\r\f]+", " ", "".join(self.text)).replace(" \\\n", "\\\n").replace("\x00 ", "\x00").replace("\x00", "  \n"))
        self.text, self.marks, self.links = [], [], []
        if self.rows is not None:
            if self.rows and self.rows[-1] and text:
                self.rows[-1][-1] = (self.rows[-1][-1] + " " + text.replace("  \n", " ")).strip()
            if self.level and text:
                self.blocks.append(Block("heading", "", level=self.level, text=text))
            return
        if not text:
            return
        if self.level:
            self.blocks.append(heading(self.level, text))
        elif self.item:
            depth, mark = self.item
            self.blocks.append(Block("list", f"{'  ' * depth}{mark} {text}\n", level=depth, ordered=mark != "-", text=text))
            self.item = (depth, " ")
        elif self.quotes:
            lead = "> " * self.quotes
            self.blocks.append(Block("quote", lead + text.replace("\n", "\n" + lead) + "\n\n", level=self.quotes, text=text))
        else:
            self.blocks.append(para(text))

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: (v or "").replace("\x00", "") for k, v in attrs}
        if tag == "script":
            self.script, self.lang = [], SCRIPTS.get(a.get("type", "").lower(), "javascript")
        elif tag in SILENT:
            self.silent += 1
        elif self.silent:
            return
        elif tag == "title":
            self.in_title = True
            self.titles.append("")
        elif tag == "meta":
            if a.get("name", "").lower() in META and a.get("content"):
                self.meta[a["name"].lower()] = a["content"]
        elif tag == "pre":
            self.flush()
            self.pre, self.lang = [], ""
        elif self.pre is not None:
            if tag == "code" and (m := re.search(r"\blang(?:uage)?-([\w+#-]+)", a.get("class", ""))):
                self.lang = m[1]
        elif tag in INLINE:
            self.marks.append((tag, len(self.text)))
            self.text.append(INLINE[tag])
        elif tag == "a":
            self.links.append((a.get("href", ""), len(self.text)))
        elif tag == "img":
            self.text.append(f"![{a.get('alt', '')}]({a.get('src', '')})")
        elif tag == "br":
            self.text.append("\x00")
        else:
            self.open_block(tag)

    def open_block(self, tag: str) -> None:
        self.flush()
        if re.fullmatch("h[1-6]", tag):
            self.level, self.before = int(tag[1]), len(self.blocks)
        elif tag in ("ul", "ol"):
            self.lists.append([tag == "ol", 1])
            self.item = None
        elif tag == "li":
            ordered, n = self.lists[-1] if self.lists else (False, 1)
            self.item = (max(len(self.lists) - 1, 0), f"{n}." if ordered else "-")
            if self.lists:
                self.lists[-1][1] += 1
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "hr":
            self.blocks.append(rule())
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            code = "".join(self.script or ()).strip()
            self.script = None
            if code:
                self.flush()
                self.blocks.append(fence(code.split("\n"), self.lang))
        elif tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag == "title":
            self.in_title = False
        elif tag == "pre" and self.pre is not None:
            code = "".join(self.pre).strip("\n")
            self.pre = None
            self.blocks.append(fence(code.split("\n"), self.lang))
        elif self.pre is not None:
            return
        elif tag in INLINE:
            self.close_mark(tag)
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            inner = trim("".join(self.text[at:]))
            self.text[at:] = [f"[{inner}]({href})" if inner and href else inner]
        else:
            self.close_block(tag)

    def close_mark(self, tag: str) -> None:
        if any(t == tag for t, _ in self.marks):
            while self.marks:
                t, at = self.marks.pop()
                inner = "".join(self.text[at + 1 :])
                body = trim(inner)
                lead, tail = (" " * inner[:1].isspace(), " " * inner[-1:].isspace()) if body else ("", " " * bool(inner))
                self.text[at:] = [f"{lead}{INLINE[t]}{body}{INLINE[t]}{tail}" if body else tail]
                if t == tag:
                    break

    def close_block(self, tag: str) -> None:
        self.flush()
        if re.fullmatch("h[1-6]", tag):
            if self.level and len(self.blocks) == self.before:
                self.blocks.append(Block("heading", "", level=self.level))
            self.level = 0
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.item = None
            last = next((b for b in reversed(self.blocks) if b.md), None)
            if not self.lists and last and last.kind == "list":
                last.md += "\n"
        elif tag == "li":
            self.item = None
        elif tag == "blockquote":
            self.quotes = max(0, self.quotes - 1)
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                self.blocks.append(Block("table", grid(rows) + "\n", cells=rows))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # of no known kind: a comment up to the next >
            return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        data = data.replace("\x00", "")
        if self.script is not None:
            self.script.append(data)
        elif self.silent:
            return
        elif self.in_title:
            self.titles[-1] += data
        elif self.pre is not None:
            self.pre.append(data)
        else:
            self.text.append(data)


def _apart(m: re.Match) -> str:
    """An ampersand that begins no reference, with a mark after it by which the parser takes none for one."""
    name = m[1] or ""
    return m[0] if name.startswith("#") or name in html5 else "&\x00" + name


def html_blocks(text: str) -> list[Block]:
    reader = _Reader()
    reader.feed(REFERENCE.sub(_apart, text) if "&" in text else text)
    reader.close()
    reader.flush()
    title = trim(re.sub(r"\s+", " ", "".join(reader.titles[:1])))
    out = []
    fields = {"title": title} | reader.meta
    if reader.meta:
        out.append(Block("raw", "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items() if v) + "---\n\n"))
    if title:
        first = next((b for b in reader.blocks if b.md), None)
        again = first is not None and first.kind == "heading" and first.text == title
        out.append(Block("heading", "", level=1, text=title) if again else heading(1, title))
    return out + reader.blocks


def to_markdown(text: str) -> str:
    return markdown(html_blocks(text))


def read_html(data: bytes) -> list[Block]:
    out = html_blocks(utf8(data, "html"))
    if not trim(markdown(out)):
        return [*(b for b in out if not b.md), Block("para", "*Empty HTML document*\n")]
    # the document ends with one line end
    written = [b for b in out if b.md]
    written[0].md = written[0].md.lstrip()
    while len(written) > 1 and not trim(written[-1].md):
        written.pop().md = ""
    written[-1].md = written[-1].md.rstrip() + "\n"
    return out
