"""Markdown to other formats: one dialect table for the markup languages, and the packaged formats.

In the markup languages each inline node outside of a block is a paragraph of its own, tables are closed by what comes
after them, and the nesting of lists is not kept.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from quillspark.blocks import ConversionError, lines_of
from quillspark.mdast import Node, as_dicts, parse, text_of

# What LaTeX writes for characters of its own.
LATEX_ESCAPES = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}
_LATEX = re.compile(f"[{re.escape(''.join(LATEX_ESCAPES))}]")


def latex_escape(s: str) -> str:
    return _LATEX.sub(lambda m: LATEX_ESCAPES[m[0]], s)


def html_escape(s: str) -> str:
    return escape(s)


def dense(cells: list[Node]) -> list[list[str]]:
    """Table cells as a full grid of texts."""
    found = {(c.row, c.column): text_of(c.values) for c in cells}
    rows, columns = max(r for r, _ in found) + 1, max(c for _, c in found) + 1
    return [[found.get((r, c), "") for c in range(columns)] for r in range(rows)]


@dataclass
class Dialect:
    """How a markup language writes nodes. Templates of inline nodes hold ``{0}`` for the text and ``{url}``."""

    inline: dict[str, str]
    heading: Callable[[int, list[Node], Callable], str]
    code: Callable[[str, str | None], str]
    items: tuple[str, str]
    quote: Callable[[str], str]
    hr: str
    table: Callable[[list[list[str]]], str]
    escape: Callable[[str], str] = str

    def text(self, nodes: list[Node]) -> str:
        out = []
        for n in nodes:
            if n.kind in ("text", "code_inline"):
                part = self.escape(n.value)
            elif n.kind == "break":
                part = " "
            elif n.kind in self.inline:
                part = self.text(n.values)
            else:
                continue
            out.append(self.inline.get(n.kind, "{0}").replace("{url}", n.url).replace("{0}", part) if n.kind in self.inline else part)
        return "".join(out)


RST_UNDERLINES = "=-~^\""


def _rst_heading(depth: int, nodes: list[Node], text: Callable) -> str:
    title = text_of(nodes)
    return f"{title}\n{RST_UNDERLINES[min(depth, 5) - 1] * max(len(title), 1)}\n\n"


def _prefixed(mark: str):
    return lambda depth, nodes, text: f"{mark * depth} {text(nodes)}\n\n"


def _rst_table(rows: list[list[str]]) -> str:
    body = "".join(f"   {'* ' if not k else '  '}- {c}\n" for r in rows for k, c in enumerate(r))
    return f".. list-table::\n   :header-rows: 1\n\n{body}\n"


def _org_table(rows: list[list[str]]) -> str:
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    lines.insert(1, "|-" + "-+-".join("-" * max(len(c.encode()), 3) for c in rows[0]) + "-|")
    return "\n".join(lines) + "\n\n"


def _adoc_table(rows: list[list[str]]) -> str:
    body = "".join(" ".join(f"| {c}" for c in r) + "\n" for r in rows)
    return f'[%header,cols="{",".join("1" * len(rows[0]))}"]\n|===\n{body}|===\n\n'


def _latex_table(rows: list[list[str]]) -> str:
    head, *rest = [" & ".join(r) + " \\\\\n" for r in [[rf"\textbf{{{c}}}" for c in rows[0]], *rows[1:]]]
    return rf"\begin{{tabular}}{{{' '.join('l' * len(rows[0]))}}}" + "\n\\hline\n" + head + "\\hline\n" + "".join(rest) + "\\hline\n\\end{tabular}\n\n"


RST = Dialect(
    {"strong": "**{0}**", "emphasis": "*{0}*", "code_inline": "``{0}``", "link": "`{0} <{url}>`_", "delete": "{0}"},
    _rst_heading,
    lambda code, lang: f".. code-block::{f' {lang}' if lang else ''}\n\n" + "".join(f"   {x}\n" for x in lines_of(code)) + "\n",
    ("* ", "#. "),
    lambda text: "".join(f"   {x}\n" for x in lines_of(text)) + "\n",
    "----\n\n",
    _rst_table,
)
ASCIIDOC = Dialect(
    {"strong": "*{0}*", "emphasis": "_{0}_", "code_inline": "`{0}`", "link": "{url}[{0}]", "delete": "[line-through]#{0}#"},
    _prefixed("="),
    lambda code, lang: (f"[source,{lang}]\n" if lang else "") + f"----\n{code}\n----\n\n",
    ("* ", ". "),
    lambda text: f"[quote]\n____\n{text}\n____\n\n",
    "'''\n\n",
    _adoc_table,
)
ORG = Dialect(
    {"strong": "*{0}*", "emphasis": "/{0}/", "code_inline": "~{0}~", "link": "[[{url}][{0}]]", "delete": "+{0}+"},
    _prefixed("*"),
    lambda code, lang: f"#+BEGIN_{f'SRC {lang}' if lang else 'EXAMPLE'}\n{code}\n#+END_{'SRC' if lang else 'EXAMPLE'}\n\n",
    ("- ", "1. "),
    lambda text: f"#+BEGIN_QUOTE\n{text}\n#+END_QUOTE\n\n",
    "-----\n\n",
    _org_table,
)
LATEX_HEADINGS = ("section", "subsection", "subsubsection", "paragraph")
LATEX = Dialect(
    {"strong": r"\textbf{{0}}", "emphasis": r"\textit{{0}}", "code_inline": r"\texttt{{0}}", "link": r"\href{{url}}{{0}}", "delete": r"\sout{{0}}"},
    lambda depth, nodes, text: f"\\{LATEX_HEADINGS[min(depth, 4) - 1]}{{{text(nodes)}}}\n\n",
    lambda code, lang: (f"\\begin{{lstlisting}}[language={lang}]\n{code}\n\\end{{lstlisting}}" if lang else f"\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}") + "\n\n",
    (r"\item ", r"\item "),
    lambda text: f"\\begin{{quote}}\n{text}\n\\end{{quote}}\n\n",
    "\\noindent\\rule{\\linewidth}{0.4pt}\n\n",
    _latex_table,
    latex_escape,
)
LATEX_HEAD = "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage{hyperref}\n\\usepackage{ulem}\n\\usepackage{listings}\n\\usepackage{graphicx}\n\\begin{document}\n\n"


def tables_joined(nodes: list[Node]) -> Iterator[tuple[str, list[Node]]]:
    """Nodes one by one, the cells of a table together; what has no form anywhere closes a table and is left out."""
    for cells, run in itertools.groupby((n for n in nodes if n.kind != "align"), key=lambda n: n.kind == "cell"):
        run = list(run)
        if cells:
            yield "table", run
        else:
            yield from ((n.kind, [n]) for n in run)


def write_markup(nodes: list[Node], d: Dialect) -> Iterator[tuple[str, str]]:
    """Kind and text of each piece."""
    for kind, run in tables_joined(nodes):
        n = run[0]
        if kind == "table":
            yield kind, d.table(dense(run))
        elif kind == "heading":
            yield kind, d.heading(n.depth, n.values, d.text)
        elif kind == "code":
            yield kind, d.code(n.value, n.lang)
        elif kind == "list":
            yield "enumerate" if n.ordered else "itemize", f"{d.items[n.ordered]}{d.text(n.values)}\n"
        elif kind == "quote":
            yield kind, d.quote(d.text(n.values))
        elif kind == "hr":
            yield kind, d.hr
        elif n.inline:
            yield "para", d.text([n]) + "\n\n"


def to_rst(md: str) -> str:
    return "".join(s for _, s in write_markup(parse(md), RST))


def to_asciidoc(md: str) -> str:
    return "".join(s for _, s in write_markup(parse(md), ASCIIDOC))


def to_org(md: str) -> str:
    return "".join(s for _, s in write_markup(parse(md), ORG))


def to_latex(md: str) -> str:
    out = [LATEX_HEAD]
    for kind, run in itertools.groupby(write_markup(parse(md), LATEX), key=lambda x: x[0]):
        body = "".join(s for _, s in run)
        out.append(f"\\begin{{{kind}}}\n{body}\\end{{{kind}}}\n\n" if kind in ("enumerate", "itemize") else body)
    return "".join(out) + "\\end{document}\n"


# HTML, text and JSON

HTML_INLINE = {"strong": "strong", "emphasis": "em", "delete": "del"}


def _html_inline(nodes: list[Node]) -> str:
    out = []
    for n in nodes:
        if n.kind == "text":
            out.append(escape(n.value))
        elif n.kind == "code_inline":
            out.append(f"<code>{escape(n.value)}</code>")
        elif n.kind == "break":
            out.append("<br />\n")
        elif n.kind == "link":
            out.append(f'<a href="{escape(n.url, {chr(34): "&quot;"})}">{_html_inline(n.values)}</a>')
        elif n.kind == "image":
            out.append(f'<img src="{escape(n.url, {chr(34): "&quot;"})}" alt="{escape(n.value, {chr(34): "&quot;"})}" />')
        elif n.kind in HTML_INLINE:
            out.append(f"<{HTML_INLINE[n.kind]}>{_html_inline(n.values)}</{HTML_INLINE[n.kind]}>")
    return "".join(out)


def _html_group(n: Node) -> tuple:
    """Nodes alike in this belong to one element."""
    if n.inline or n.kind == "image":
        return "p", n.start, n.end
    if n.kind == "list":
        return "ol" if n.ordered else "ul"
    return ("table",) if n.kind in ("cell", "align") else (n.kind, id(n))


def html_body(nodes: list[Node]) -> str:
    out = []
    for key, run in itertools.groupby(nodes, key=_html_group):
        run = list(run)
        n = run[0]
        if key[0] == "p" and not isinstance(key, str):
            out.append(f"<p>{_html_inline(run)}</p>\n")
        elif key in ("ol", "ul"):
            out.append(f"<{key}>\n" + "".join(f"<li>{_html_inline(x.values)}</li>\n" for x in run) + f"</{key}>\n")
        elif key == ("table",):
            cells = {(x.row, x.column): _html_inline(x.values) for x in run if x.kind == "cell"}
            width = max(c for _, c in cells) + 1
            rows = [[cells.get((r, c), "") for c in range(width)] for r in range(max(r for r, _ in cells) + 1)]
            line = lambda r, tag: "<tr>\n" + "".join(f"<{tag}>{c}</{tag}>\n" for c in r) + "</tr>\n"
            body = "<tbody>\n" + "".join(line(r, "td") for r in rows[1:]) + "</tbody>\n" if rows[1:] else ""
            out.append(f"<table>\n<thead>\n{line(rows[0], 'th')}</thead>\n{body}</table>\n")
        elif n.kind == "heading":
            out.append(f"<h{n.depth}>{_html_inline(n.values)}</h{n.depth}>\n")
        elif n.kind == "code":
            lang = f' class="language-{escape(n.lang)}"' if n.lang else ""
            out.append(f"<pre><code{lang}>{escape(n.value)}\n</code></pre>\n")
        elif n.kind == "quote":
            out.append(f"<blockquote>\n<p>{_html_inline(n.values)}</p>\n</blockquote>\n")
        elif n.kind == "hr":
            out.append("<hr />\n")
        elif n.kind == "html":
            out.append(n.value + "\n")
    return "".join(out)


def to_html(md: str) -> str:
    return html_body(parse(md))


def to_text(md: str) -> str:
    """Text alone: a line for each block, a table's cells apart by tabs."""
    out = []
    for key, run in itertools.groupby(parse(md), key=lambda n: ("p", n.start, n.end) if n.inline else (n.kind, n.row if n.kind == "cell" else id(n))):
        run = list(run)
        if key[0] == "cell":
            out.append("\t".join(text_of(x.values) for x in run))
        elif key[0] == "p":
            out.append(text_of(run))
        elif run[0].kind in ("heading", "list", "quote"):
            out.append(text_of(run[0].values))
        elif run[0].kind == "code":
            out.append(run[0].value)
    return "".join(f"{x}\n" for x in out)


def to_json(md: str) -> str:
    return json.dumps(as_dicts(parse(md)), ensure_ascii=False) + "\n"


# Packaged formats


def _packed(parts: list[tuple[str, str]]) -> bytes:
    """A ZIP archive that is the same for the same parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    return out.getvalue()


XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@dataclass
class Run:
    text: str
    bold: bool = False
    italic: bool = False
    code: bool = False

    def xml(self) -> str:
        how = "<w:b/>" * self.bold + "<w:i/>" * self.italic + '<w:rFonts w:ascii="Courier New"/>' * self.code
        return f"<w:r>{f'<w:rPr>{how}</w:rPr>' if how else ''}<w:t xml:space=\"preserve\">{escape(self.text)}</w:t></w:r>"


def runs(nodes: list[Node], bold: bool = False, italic: bool = False) -> list[Run]:
    out = []
    for n in nodes:
        if n.kind == "text":
            out.append(Run(n.value, bold, italic))
        elif n.kind == "code_inline":
            out.append(Run(n.value, code=True))
        elif n.kind == "break":
            out.append(Run(" "))
        elif n.kind in ("strong", "emphasis", "link", "delete"):
            out += runs(n.values, bold or n.kind == "strong", italic or n.kind == "emphasis")
    return out


def _p(some: list[Run], style: str = "", numbered: bool = False) -> str:
    how = f'<w:pStyle w:val="{style}"/>' * bool(style) + '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>' * numbered
    return f"<w:p>{f'<w:pPr>{how}</w:pPr>' if how else ''}{''.join(r.xml() for r in some)}</w:p>"


def word_body(nodes: list[Node]) -> str:
    """Paragraphs and tables. Inline nodes are joined until a gap of lines is seen after a block with a place."""
    out: list[str] = []
    waiting: list[Run] = []
    last: int | None = None
    count = 0

    def flush() -> None:
        if waiting:
            out.append(_p(waiting))
            waiting.clear()

    for kind, run in tables_joined(nodes):
        n = run[0]
        if n.inline:
            count = 0
            if last is not None:
                if n.start > last + 1:
                    flush()
                last = n.end
            waiting.extend(runs([n]))
            continue
        if kind in ("image", "html"):
            continue
        flush()
        count = count + 1 if kind == "list" and n.ordered else 0
        last = None if kind in ("table", "hr") else n.end
        if kind == "table":
            cell = lambda text, head: f'<w:tc><w:tcPr/><w:p><w:pPr><w:jc w:val="left"/></w:pPr>{Run(text, bold=head).xml()}</w:p></w:tc>'
            out.append("<w:tbl><w:tblPr/>" + "".join(f"<w:tr>{''.join(cell(c, not k) for c in r)}</w:tr>" for k, r in enumerate(dense(run))) + "</w:tbl>")
        elif kind == "heading":
            out.append(_p([Run(text_of(n.values))], f"Heading{min(n.depth, 6)}"))
        elif kind == "code":
            out += [_p([Run(x, code=True)]) for x in lines_of(n.value)]
        elif kind == "list":
            text = text_of(n.values)
            out.append(_p([Run(f"{count}. {text}")]) if n.ordered else _p([Run(text)], numbered=True))
        elif kind == "quote":
            out.append(_p([Run(text_of(n.values))], "Quote"))
        elif kind == "hr":
            out.append(_p([Run("─" * 40)]))
    flush()
    return "".join(out)


def to_docx(md: str) -> bytes:
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/></w:style>' for i, name in [*((f"Heading{k}", f"heading {k}") for k in range(1, 7)), ("Quote", "Quote")])
    level = '<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/><w:lvlJc w:val="left"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl>'
    office, kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.wordprocessingml"
    rel = lambda *x: XML + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{office}/{t}" Target="{p}"/>' for k, (t, p) in enumerate(x, 1)) + "</Relationships>"
    parts = {"document": "document.main", "styles": "styles", "numbering": "numbering"}
    types = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/word/{p}.xml" ContentType="{kind}.{t}+xml"/>' for p, t in parts.items())
    return _packed(
        [
            ("[Content_Types].xml", f'{XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{types}</Types>'),
            ("_rels/.rels", rel(("officeDocument", "word/document.xml"))),
            ("word/_rels/document.xml.rels", rel(("styles", "styles.xml"), ("numbering", "numbering.xml"))),
            ("word/document.xml", f"{XML}<w:document {W_NS}><w:body>{word_body(parse(md))}<w:sectPr/></w:body></w:document>"),
            ("word/styles.xml", f"{XML}<w:styles {W_NS}>{styles}</w:styles>"),
            ("word/numbering.xml", f'{XML}<w:numbering {W_NS}><w:abstractNum w:abstractNumId="0">{level}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'),
        ]
    )


def chapters(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    """Titles and nodes, cut before each heading of the first level; what comes before the first is "Document"."""
    out: list[tuple[str, list[Node]]] = []
    for n in nodes:
        if n.kind == "heading" and n.depth == 1:
            out.append((text_of(n.values), []))
        elif not out:
            out.append(("Document", []))
        out[-1][1].append(n)
    return out or [("Document", [])]


def chapter_markdown(nodes: list[Node]) -> str:
    """A chapter's plain form: tables, code in lines, breaks and deletions outside of blocks are not kept."""
    out = []
    for n in nodes:
        text = text_of(n.values)
        if n.kind == "heading":
            out.append(f"{'#' * n.depth} {text}\n\n")
        elif n.kind == "code":
            out.append(f"```{n.lang or ''}\n{n.value}\n```\n\n")
        elif n.kind == "list":
            out.append(f"{'1.' if n.ordered else '-'} {text}\n")
        elif n.kind == "quote":
            out.append(f"> {text}\n\n")
        elif n.kind == "hr":
            out.append("---\n\n")
        elif n.kind == "text":
            out.append(n.value + "\n")
        elif n.kind in ("strong", "emphasis"):
            mark = "**" if n.kind == "strong" else "*"
            out.append(f"{mark}{text}{mark}")
        elif n.kind == "link":
            out.append(f"[{text}]({n.url})")
    return "".join(out)


def to_epub(md: str) -> bytes:
    nodes = parse(md)
    title = escape(next((text_of(n.values) for n in nodes if n.kind == "heading" and n.depth == 1), "Untitled"))
    some = [(f"chapter_{k}.xhtml", escape(name), html_body(parse(chapter_markdown(part)))) for k, (name, part) in enumerate(chapters(nodes))]
    page = lambda body: f'{XML}<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head><meta charset="UTF-8"/></head>\n<body>\n{body}\n</body>\n</html>'
    manifest = "".join(f'<item id="c{k}" href="{f}" media-type="application/xhtml+xml"/>' for k, (f, _, _) in enumerate(some))
    opf = f'{XML}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{title}</dc:identifier><dc:title>{title}</dc:title><dc:language>en</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{manifest}</manifest><spine>{"".join(f"""<itemref idref="c{k}"/>""" for k in range(len(some)))}</spine></package>'
    nav = "".join(f'<li><a href="{f}">{name}</a></li>' for f, name, _ in some)
    return _packed(
        [
            ("mimetype", "application/epub+zip"),
            ("META-INF/container.xml", f'{XML}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
            ("OEBPS/content.opf", opf),
            ("OEBPS/nav.xhtml", page(f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{nav}</ol></nav>')),
            *((f"OEBPS/{f}", page(body)) for f, _, body in some),
        ]
    )


def utf8_markdown(data: bytes, target: str) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ConversionError(target, f"Input is not valid UTF-8: {e}") from e
