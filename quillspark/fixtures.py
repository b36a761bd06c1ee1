"""Small inputs with known conversions, for the fixture queries and the tests."""

from __future__ import annotations

import io
import struct
import zipfile

KV = "| Key | Value |\n|---|---|\n"

# Inputs and outputs that conversions must give, by format.
TEXT_FIXTURES: list[tuple[str, str, str, str]] = [
    ("json", "simple_object", '{"name":"Alice","age":30}', KV + "| name | Alice |\n| age | 30 |\n\n"),
    ("json", "nested_object", '{"name":"Alice","address":{"city":"Tokyo","zip":"100"}}', KV + "| name | Alice |\n\n# address\n\n" + KV + "| city | Tokyo |\n| zip | 100 |\n\n"),
    ("json", "array_of_strings", '{"tags":["rust","cli"]}', "# tags\n\n- rust\n- cli\n\n"),
    ("json", "array_of_objects", '[{"id":1,"name":"x"},{"id":2,"name":"y"}]', "| id | name |\n|---|---|\n| 1 | x |\n| 2 | y |\n\n"),
    ("json", "empty_array", "[]", "*empty*\n"),
    ("json", "null", "null", "\n"),
    ("json", "string", '"hello"', "hello\n"),
    ("json", "number", "42", "42\n"),
    ("json", "boolean", "true", "true\n"),
    ("json", "pipe", '{"cmd":"a|b"}', KV + "| cmd | a\\|b |\n\n"),
    ("json", "pi", "3.141592653589793", "3.141592653589793\n"),
    ("yaml", "simple", "name: Alice\nage: 30", KV + "| name | Alice |\n| age | 30 |\n\n"),
    ("yaml", "list", "users:\n  - name: Alice\n    id: 1\n  - name: Bob\n    id: 2", "# users\n\n| name | id |\n|---|---|\n| Alice | 1 |\n| Bob | 2 |\n\n"),
    ("yaml", "null", "key: null", KV + "| key |  |\n\n"),
    ("toml", "nested", '[a]\n[a.b]\nkey = "val"', "# a\n\n## b\n\n" + KV + "| key | val |\n\n"),
    ("toml", "array_of_tables", '[[items]]\nid = 1\nname = "a"\n\n[[items]]\nid = 2\nname = "b"', "# items\n\n| id | name |\n|---|---|\n| 1 | a |\n| 2 | b |\n\n"),
    ("xml", "text", "<root>hello</root>", "# root\n\nhello\n\n"),
    ("xml", "attributes", '<item id="1" name="test"/>', "# item\n\n| Attribute | Value |\n|---|---|\n| id | 1 |\n| name | test |\n\n"),
    ("xml", "repeated", '<list><item id="1">A</item><item id="2">B</item></list>', "# list\n\n## item\n\n| id | text |\n|---|---|\n| 1 | A |\n| 2 | B |\n\n"),
    ("xml", "attributes_only", '<data><row x="1" y="2"/><row x="3" y="4"/></data>', "# data\n\n## row\n\n| x | y |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n"),
    ("rst", "title", "Title\n=====\n\nBody text.\n", "# Title\n\nBody text.\n\n"),
    ("rst", "code_block", ".. code-block:: rust\n\n   fn main() {}\n", "```rust\nfn main() {}\n```\n\n"),
    ("rst", "literal_block", "Example::\n\n    foo bar\n", "Example:\n\n```\nfoo bar\n```\n\n"),
    ("rst", "bullets", "* one\n* two\n", "- one\n- two\n"),
    ("rst", "numbers", "#. one\n#. two\n", "1. one\n1. two\n"),
    ("org", "title", "#+TITLE: Doc\n", "# Doc\n\n"),
    ("org", "source", "#+BEGIN_SRC rust\nfn main() {}\n#+END_SRC\n", "```rust\nfn main() {}\n```\n\n"),
    ("org", "inline", "*bold* /italic/ ~code~ +gone+ [[https://x.io][link]]\n", "**bold** *italic* `code` ~~gone~~ [link](https://x.io)\n\n"),
    ("org", "table", "| A | B |\n|---+---|\n| 1 | 2 |\n", "| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"),
    ("mediawiki", "link", "[[Main Page|Home]]\n", "[Home](Main Page)\n\n"),
    ("mediawiki", "table", "{|\n|-\n! A !! B\n|-\n| 1 || 2\n|}\n", "| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"),
    ("mediawiki", "reference", "Text<ref>cite</ref> more.\n\n[[Category:Foo]]\n", "Text more.\n\n"),
    ("asciidoc", "title", "= Title\n\nBody.\n", "# Title\n\nBody.\n\n"),
    ("asciidoc", "subtitle", "== Sub\n", "## Sub\n\n"),
    ("asciidoc", "source", "[source,rust]\n----\nfn main() {}\n----\n", "```rust\nfn main() {}\n```\n\n"),
    ("asciidoc", "note", "NOTE: Something important.\n", "> **Note:** Something important.\n\n"),
    ("asciidoc", "table", '[cols="1,1"]\n|===\n|A |B\n\n|1 |2\n|===\n', "| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"),
    ("asciidoc", "link", "See https://example.com[Example] for more.\n", "See [Example](https://example.com) for more.\n\n"),
    ("rst", "roles_and_links", "See :ref:`the pond <pond>`_ and ``a `b``, :doc:`plain` or `x`__.\n", "See [the pond](pond) and `a `b`, plain or x.\n\n"),
    ("html", "inline", "<h2>Birds</h2><p>A <b>grey</b> heron &amp; its <a href='n.html'>nest</a>.</p>", "## Birds\n\nA **grey** heron & its [nest](n.html).\n"),
    ("html", "nested_list", "<ul><li>reed</li><li>mud<ul><li>eel</li></ul></li></ul>", "- reed\n- mud\n  - eel\n"),
    ("html", "numbers_rule_code", "<ol><li>one</li><li>two</li></ol><hr><pre><code>x = 1\n</code></pre>", "1. one\n2. two\n\n---\n\n```\nx = 1\n```\n"),
    ("html", "table_and_quote", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table><blockquote><p>q</p></blockquote>", "| a | b |\n|---|---|\n| 1 | 2\\|3 |\n\n> q\n"),
    ("html", "breaks_and_images", "<p>x<br>y <code>z</code> <em>e</em> <img src='i.png' alt='I'></p>", "x  \ny `z` *e* ![I](i.png)\n"),
    ("csv", "ragged", "a,b\n1\n2,3,4\n", "| a | b |\n|---|---|\n| 1 |  |\n| 2 | 3 |\n"),
    ("csv", "quotes", 'a,b\n"x|y","say ""hi"""\n', '| a | b |\n|---|---|\n| x\\|y | say "hi" |\n'),
    ("csv", "empty", "", "*Empty CSV*\n"),
]

# Fixed value: how LaTeX documents begin.
LATEX_HEAD = "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage{hyperref}\n\\usepackage{ulem}\n\\usepackage{listings}\n\\usepackage{graphicx}\n\\begin{document}\n\n"

# Markdown and what each target's rules make of it.
WRITER_FIXTURES: list[tuple[str, str, str, str]] = [
    ("markdown-rst", "heading", "# Title\n", "Title\n=====\n\n"),
    ("markdown-rst", "code", "```py\nx = 1\n```\n", ".. code-block:: py\n\n   x = 1\n\n"),
    ("markdown-rst", "lists", "- a\n\n1. b\n", "* a\n#. b\n"),
    ("markdown-rst", "table", "| A | B |\n|---|---|\n| 1 | 2 |\n", ".. list-table::\n   :header-rows: 1\n\n   * - A\n     - B\n   * - 1\n     - 2\n\n"),
    ("markdown-asciidoc", "heading", "## Sub\n", "== Sub\n\n"),
    ("markdown-asciidoc", "code", "```py\nx = 1\n```\n", "[source,py]\n----\nx = 1\n----\n\n"),
    ("markdown-asciidoc", "quote", "> q\n", "[quote]\n____\nq\n____\n\n"),
    ("markdown-asciidoc", "table", "| A | B |\n|---|---|\n| 1 | 2 |\n", '[%header,cols="1,1"]\n|===\n| A | B\n| 1 | 2\n|===\n\n'),
    ("markdown-org", "heading", "### Deep\n", "*** Deep\n\n"),
    ("markdown-org", "code", "```\nx\n```\n", "#+BEGIN_EXAMPLE\nx\n#+END_EXAMPLE\n\n"),
    ("markdown-org", "rule", "---\n", "-----\n\n"),
    ("markdown-org", "table", "| A | Bcdef |\n|---|---|\n| 1 | 2 |\n", "| A | Bcdef |\n|-----+-------|\n| 1 | 2 |\n\n"),
    ("markdown-org", "inline", "**b**\n", "*b*\n\n"),
    ("markdown-html", "inline", "# Birds & reeds\n\nA **grey** *heron* with `legs`, ~~not~~ [here](n.html).\n", '<h1>Birds &amp; reeds</h1>\n<p>A <strong>grey</strong> <em>heron</em> with <code>legs</code>, <del>not</del> <a href="n.html">here</a>.</p>\n'),
    ("markdown-html", "lists", "- reed\n- mud\n\n1. one\n", "<ul>\n<li>reed</li>\n<li>mud</li>\n</ul>\n<ol>\n<li>one</li>\n</ol>\n"),
    ("markdown-html", "quote_and_code", "> quoted\n\n```py\nx < 1\n```\n", '<blockquote>\n<p>quoted</p>\n</blockquote>\n<pre><code class="language-py">x &lt; 1\n</code></pre>\n'),
    ("markdown-html", "table", "| a | b |\n|---|---|\n| 1 | 2 |\n", "<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td>2</td>\n</tr>\n</tbody>\n</table>\n"),
    ("markdown-text", "everything", "# Birds & reeds\n\nA **grey** [heron](h.html).\n\n- reed\n\n> quoted\n\n```py\nx < 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "Birds & reeds\nA grey heron.\nreed\nquoted\nx < 1\na\tb\n1\t2\n"),
    ("markdown-json-ast", "heading_and_code", "# B\n\n```py\nx\n```\n", '[{"type": "heading", "depth": 1, "values": [{"type": "text", "value": "B", "position": {"start": 1, "end": 1}}], "position": {"start": 1, "end": 1}}, {"type": "code", "value": "x", "lang": "py", "position": {"start": 3, "end": 5}}]\n'),
    ("markdown-latex", "heading", "# A & B\n", LATEX_HEAD + "\\section{A \\& B}\n\n\\end{document}\n"),
    ("markdown-latex", "list", "- a\n- b\n", LATEX_HEAD + "\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\n\\end{document}\n"),
    ("markdown-latex", "rule", "---\n", LATEX_HEAD + "\\noindent\\rule{\\linewidth}{0.4pt}\n\n\\end{document}\n"),
    ("markdown-latex", "link", "[t](https://a.b/c_d)\n", LATEX_HEAD + "\\href{https://a.b/c_d}{t}\n\n\\end{document}\n"),
]


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def xlsx(sheets: dict[str, dict[str, str]]) -> bytes:
    """A workbook of inline strings by cell reference."""
    import re
    from itertools import groupby

    parts = {"[Content_Types].xml": "<Types/>"}
    book, rels = "", ""
    for k, (name, cells) in enumerate(sheets.items(), 1):
        rows = ""
        for r, group in groupby(sorted(cells.items(), key=lambda c: int(re.sub("[A-Z]", "", c[0]))), key=lambda c: re.sub("[A-Z]", "", c[0])):
            rows += f'<row r="{r}">' + "".join(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' for ref, v in group) + "</row>"
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{rows}</sheetData></worksheet>"
        book += f'<sheet name="{name}" sheetId="{k}" r:id="rId{k}"/>'
        rels += f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>'
    parts["xl/workbook.xml"] = f"<workbook><sheets>{book}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{rels}</Relationships>"
    return packed(parts)


def docx(body: str, rels: str = "") -> bytes:
    parts = {"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>"}
    if rels:
        parts["word/_rels/document.xml.rels"] = f"<Relationships>{rels}</Relationships>"
    return packed(parts)


def slide(*shapes: str) -> str:
    return f"<p:sld><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"


def shape(text: str, role: str = "", bullets: bool = False, how: str = "") -> str:
    ph = f'<p:nvSpPr><p:nvPr><p:ph type="{role}"/></p:nvPr></p:nvSpPr>' if role else ""
    bullet = '<a:pPr><a:buChar char="•"/></a:pPr>' if bullets else ""
    return f"<p:sp>{ph}<p:txBody><a:p>{bullet}<a:r><a:rPr {how}/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"


def pdf(pages: list[list[str]], title: str = "") -> bytes:
    """Pages of lines in one font, from the top down."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, lines in enumerate(pages):
        text = "BT /F1 10 Tf 14 TL 20 700 Td " + " ".join(f"({x}) Tj T*" for x in lines) + " ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>")
        objects.append(f"<< /Length {len(text)} >>\nstream\n{text}\nendstream")
    objects.append(f"<< /Title ({title}) >>")
    body = "%PDF-1.4\n" + "".join(f"{k} 0 obj\n{o}\nendobj\n" for k, o in enumerate(objects, 1))
    return (body + f"trailer\n<< /Root 1 0 R /Info {len(objects)} 0 R >>\n").encode("latin-1")


#: Packaged inputs and their conversions.
BINARY_FIXTURES: list[tuple[str, str, bytes, str]] = [
    ("excel", "simple_table", xlsx({"Sales": {"A1": "Name", "B1": "Age", "C1": "City", "A2": "Alice", "B2": "30", "C2": "Tokyo"}}), "# Sales\n\n| Name | Age | City |\n|---|---|---|\n| Alice | 30 | Tokyo |\n"),
    ("excel", "title_and_table", xlsx({"S": {"A1": "Report", "A3": "Name", "B3": "Age", "A4": "Bob", "B4": "40"}}), "# S\n\nReport\n\n| Name | Age |\n|---|---|\n| Bob | 40 |\n"),
    ("word", "hyperlink", docx('<w:p><w:hyperlink r:id="rId1"><w:r><w:t>text</w:t></w:r></w:hyperlink></w:p>', '<Relationship Id="rId1" Target="https://example.com"/>'), "[text](https://example.com)\n"),
    ("word", "hyperlink_without_target", docx('<w:p><w:hyperlink r:id="rId1"><w:r><w:t>text</w:t></w:r></w:hyperlink></w:p>'), "text\n"),
    ("word", "bold_link", docx('<w:p><w:hyperlink r:id="r1"><w:r><w:rPr><w:b/></w:rPr><w:t>bold link</w:t></w:r></w:hyperlink></w:p>', '<Relationship Id="r1" Target="https://example.com"/>'), "[**bold link**](https://example.com)\n"),
    ("powerpoint", "slide_order", packed({f"ppt/slides/slide{k}.xml": slide(shape(t, "title")) for k, t in ((3, "Third"), (1, "First"), (2, "Second"))}), "# First\n\n\n---\n\n# Second\n\n\n---\n\n# Third\n\n"),
    ("powerpoint", "empty_slide", packed({"ppt/slides/slide1.xml": slide()}), "# Slide 1\n\n*Empty slide*\n"),
    ("zip", "one_stored", packed({"a.txt": "x" * 2048}), "# Archive\n\n**Total entries**: 1\n\n| # | Name | Size | Compressed | Method |\n|---|------|------|------------|--------|\n| 1 | a.txt | 2.0 KB | 2.0 KB | Stored |\n\n**Total size**: 2.0 KB (compressed: 2.0 KB, ratio: 0.0%)\n"),
]


def _tar() -> bytes:
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, kind, data in (("d", tarfile.DIRTYPE, b""), ("d/a.txt", tarfile.REGTYPE, b"x" * 1536), ("l", tarfile.SYMTYPE, b"")):
            info = tarfile.TarInfo(name)
            info.type, info.size, info.linkname = kind, len(data), "d/a.txt"
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _sqlite() -> bytes:
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v REAL, s TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, k / 2, "x|y" if k else None) for k in range(2)])
    db.commit()
    return db.serialize()


def _png() -> bytes:
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 6, 0, 0, 0)


def _wav() -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + 16000) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 16000) + b"\0" * 16000


def _mp4() -> bytes:
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1, 3725) + b"\0" * 80))


def _epub() -> bytes:
    opf = '<package><metadata><dc:title>Book</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="1" href="a.xhtml"/><item id="2" href="b.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="9"/><itemref idref="1"/></spine></package>'
    return packed({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": opf, "o/a.xhtml": "<p>first</p>", "o/b.xhtml": "<p>second</p>"})


BINARY_FIXTURES += [
    ("tar", "three_kinds", _tar(), "# Archive\n\n**Total entries**: 3\n\n| # | Name | Size | Type |\n|---|------|------|------|\n| 1 | d/ | - | dir |\n| 2 | d/a.txt | 1.5 KB | file |\n| 3 | l | 0 B | symlink |\n\n**Total size**: 1.5 KB\n"),
    ("sqlite", "one_table", _sqlite(), "# Database\n\n**Tables**: 1\n\n## t\n\n| Column | Type | PK |\n|--------|------|----|\n| id | INTEGER | yes |\n| v | REAL |  |\n| s | TEXT |  |\n\n**Rows**: 2\n\n| id | v | s |\n|---|---|---|\n| 0 | 0 | NULL |\n| 1 | 0.5 | x\\|y |\n"),
    ("image", "png_header", _png(), "# Image\n\n| Property | Value |\n|----------|-------|\n| Format | Png |\n| Size | 29 B |\n| Dimensions | 640x480 |\n| Color Type | Rgba8 |\n"),
    ("image", "svg", b"<svg xmlns='x'/>", "# Image\n\n| Property | Value |\n|----------|-------|\n| Format | SVG |\n| Size | 16 B |\n"),
    ("audio", "one_second", _wav(), "# Audio\n\n## File Info\n\n| Property | Value |\n|----------|-------|\n| Format | Wav |\n| Size | 15.7 KB |\n| Duration | 0:01 |\n| Bitrate | 128 kbps |\n| Sample Rate | 8000 Hz |\n| Channels | 1 (Mono) |\n\n"),
    ("video", "over_an_hour", _mp4(), "# Video\n\n## File Info\n\n| Property | Value |\n|----------|-------|\n| Format | Mp4 |\n| Size | 132 B |\n| Duration | 1:02:05 |\n\n"),
    ("epub", "spine_order", _epub(), "# Book\n\n**Author**: A\n\n---\n\nsecond\n\n---\n\nfirst\n"),
    ("pdf", "no_text", pdf([[]]), "*PDF contains no extractable text (may be scanned/image-based)*\n"),
]


def xls(sheets: dict[str, list[bytes]], strings: list[str], part: int = 8224) -> bytes:
    """An .xls workbook of cell records, shared strings cut into parts."""
    record = lambda kind, d: struct.pack("<HH", kind, len(d)) + d
    table = struct.pack("<II", len(strings), len(strings)) + b"".join(struct.pack("<HB", len(s), 0) + s.encode("latin-1") for s in strings)
    shared = record(0xFC, table[:part]) + b"".join(record(0x3C, b"\0" + table[k : k + part]) for k in range(part, len(table), part))
    names = [bytes([len(n), 0]) + n.encode("latin-1") for n in sheets]
    at = 20 + sum(10 + len(n) for n in names) + len(shared) + 4
    listed, bodies = b"", b""
    for name, cells in zip(names, sheets.values(), strict=True):
        listed += record(0x85, struct.pack("<IH", at + len(bodies), 0) + name)
        bodies += record(0x809, bytes(16)) + b"".join(record(kind, d) for kind, d in cells) + record(0x0A, b"")
    book = record(0x809, bytes(16)) + listed + shared + record(0x0A, b"") + bodies
    book = book.ljust(max(4096, -(-len(book) // 512) * 512), b"\0")
    n = len(book) // 512
    fat = struct.pack("<128I", *range(1, n), 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFD, *[0xFFFFFFFF] * (126 - n))
    entry = lambda name, kind, at, size: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB12s36sIQ", 2 * len(name) + 2, kind, 1, b"\xff" * 12, bytes(36), at, size)
    folder = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 0, len(book))).ljust(512, b"\0")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<8I", 1, n, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", n + 1, *[0xFFFFFFFF] * 108) + book + folder + fat


def xlsb(sheets: dict[str, list[tuple[int, bytes]]], strings: list[str]) -> bytes:
    """An .xlsb workbook of sheet records."""
    few = lambda x: bytes([x]) if x < 128 else bytes([x & 0x7F | 0x80, x >> 7])
    record = lambda kind, d: few(kind) + few(len(d)) + d
    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    parts = {"xl/workbook.bin": b"".join(record(156, struct.pack("<II", 0, k) + wide(f"r{k}") + wide(n)) for k, n in enumerate(sheets, 1))}
    parts["xl/_rels/workbook.bin.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.bin"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/sharedStrings.bin"] = b"".join(record(19, b"\0" + wide(s)) for s in strings)
    return packed(parts | {f"xl/worksheets/s{k}.bin": b"".join(record(*r) for r in rows) for k, rows in enumerate(sheets.values(), 1)})


def _cells(place, kinds: dict[str, int]) -> list[tuple[int, bytes]]:
    """One table in the records of either kind of workbook: words, a whole number, hundredths, a double, a truth and an error."""
    text = lambda r, c, k: (kinds["text"], place(r, c) + struct.pack("<I", k))
    return [
        text(0, 0, 0), text(0, 1, 1), text(0, 2, 2), text(1, 0, 3), (kinds["rk"], place(1, 1) + struct.pack("<I", 7 << 2 | 2)), (kinds["rk"], place(1, 2) + struct.pack("<I", 1234 << 2 | 3)),
        (kinds["real"], place(2, 1) + struct.pack("<d", -0.5)), (kinds["bool"], place(2, 2) + kinds["true"]), (kinds["error"], place(2, 3) + kinds["div0"]),
    ]


_WORDS = ["item", "count", "price|each", "caf\xe9"]
_TABLE_MD = "| item | count | price\\|each |  |\n|---|---|---|---|\n| caf\xe9 | 7 | 12.34 |  |\n|  | -0.5 | true | #Div0 |\n"
_XLS = _cells(lambda r, c: struct.pack("<HHH", r, c, 0), {"text": 0xFD, "rk": 0x27E, "real": 0x203, "bool": 0x205, "error": 0x205, "true": b"\1\0", "div0": b"\7\1"})
_XLSB = [x for r in range(3) for x in [(0, struct.pack("<I", r)), *[c for c in _cells(lambda r, c: struct.pack("<BII", r, c, 0), {"text": 7, "rk": 2, "real": 5, "bool": 4, "error": 3, "true": b"\1", "div0": b"\7"}) if c[1][0] == r]]]
_XLSB = [(kind, d if kind == 0 else d[1:]) for kind, d in _XLSB]


def _sqlite_two() -> bytes:
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE zoo (name TEXT)")
    db.execute("CREATE TABLE ark (id INTEGER)")
    db.execute("INSERT INTO ark VALUES (4)")
    db.commit()
    return db.serialize()


def _aac(frames: int) -> bytes:
    return b"".join(bytes([0xFF, 0xF1, 0x50, 0x80, 0x0C, 0x9F, 0xFC]) + bytes(93) for _ in range(frames))


BINARY_FIXTURES += [
    ("excel", "xls", xls({"Stock": _XLS, "Bare": []}, _WORDS), f"# Stock\n\n{_TABLE_MD}\n# Bare\n\n*Empty sheet*\n"),
    ("excel", "xls_with_strings_in_parts", xls({"Stock": _XLS, "Bare": []}, _WORDS, 13), f"# Stock\n\n{_TABLE_MD}\n# Bare\n\n*Empty sheet*\n"),
    ("excel", "xlsb", xlsb({"Stock": _XLSB, "Bare": []}, _WORDS), f"# Stock\n\n{_TABLE_MD}\n# Bare\n\n*Empty sheet*\n"),
    ("sqlite", "two_tables_by_name", _sqlite_two(), "# Database\n\n**Tables**: 2\n\n## ark\n\n| Column | Type | PK |\n|--------|------|----|\n| id | INTEGER |  |\n\n**Rows**: 1\n\n| id |\n|---|\n| 4 |\n\n## zoo\n\n| Column | Type | PK |\n|--------|------|----|\n| name | TEXT |  |\n\n**Rows**: 0\n"),
    ("audio", "raw_aac", _aac(100), "# Audio\n\n## File Info\n\n| Property | Value |\n|----------|-------|\n| Format | Aac |\n| Size | 9.8 KB |\n| Duration | 0:02 |\n| Bitrate | 34 kbps |\n| Sample Rate | 44100 Hz |\n| Channels | 2 (Stereo) |\n\n"),
    ("pdf", "repeated_edges", pdf([["Field Notes", "A heron stood", "1"], ["Field Notes", "in the reeds", "2"], ["Field Notes", "until dusk", "3"]], "Birds"), "# Birds\n\n---\n\n<!-- page 1 -->\n\nA heron stood\n\n<!-- page 2 -->\n\nin the reeds\n\n<!-- page 3 -->\n\nuntil dusk\n"),
]

#: Archives by what tells their format.
ARCHIVES = [("docx", packed({"a": "", "word/document.xml": ""}), "word"), ("xlsx", packed({"xl/workbook.xml": ""}), "excel"), ("pptx", packed({"ppt/presentation.xml": ""}), "powerpoint"), ("epub", packed({"META-INF/container.xml": ""}), "epub"), ("plain", packed({"a.txt": "x"}), "zip"), ("broken", b"PK\x03\x04nothing", None)]
#: Markdown that is written to a binary target and read again.
WRITTEN = "# Birds\n\nA **grey** *heron* [here](n.html).\n\n- reed\n- mud\n\n> quoted\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
