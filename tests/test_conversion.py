"""Readers, the Markdown parser and the writers."""

import gzip
import io
import json
import sqlite3
import struct
import tarfile
import wave
import zipfile

import pytest

from quillspark import fixtures
from quillspark.blocks import ConversionError, lines_of, number, size_label
from quillspark.mdast import parse, text_of
from quillspark.plans import registry
from quillspark.plans.registry import blocks, convert

ALL = fixtures.TEXT_FIXTURES + fixtures.WRITER_FIXTURES


@pytest.mark.parametrize("format, name, source, expected", ALL, ids=[f"{f[0]}-{f[1]}" for f in ALL])
def test_text_fixtures(format, name, source, expected):
    assert convert(source.encode(), format) == expected


@pytest.mark.parametrize("format, name, source, expected", fixtures.BINARY_FIXTURES, ids=[f"{f[0]}-{f[1]}" for f in fixtures.BINARY_FIXTURES])
def test_binary_fixtures(format, name, source, expected):
    assert convert(source, format) == expected


@pytest.mark.parametrize(
    "format, data",
    [("json", b"{"), ("json", b"[NaN]"), ("json", b"\xff"), ("yaml", b"a: [1"), ("toml", b"a ="), ("xml", b""), ("xml", b"<a></b>"), ("word", b"no"), ("word", fixtures.packed({"x": ""})), ("powerpoint", b"PK"), ("excel", b"no"), ("excel", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("epub", fixtures.packed({"a": "b"})), ("zip", b"no"), ("tar", b"no tar" * 200), ("tar", b"\x1f\x8bno"), ("sqlite", b"no database" * 60), ("pdf", b"no"), ("image", b"\x89PNG"), ("image", b"nothing"), ("audio", b"nothing"), ("video", b"\x1aE\xdf\xa3...."), ("rst", b"\xff"), ("html", b"\xff"), ("ocr", b""), ("nonsense", b""), ("markdown-rst", b"\xff")],
)
def test_errors(format, data):
    with pytest.raises(ConversionError):
        convert(data, format)


def test_numbers_and_sizes():
    assert [number(x) for x in (1.0, 0.1, 1e21, 1e-7, -2.5, 123456789.125)] == ["1", "0.1", "1000000000000000000000", "0.0000001", "-2.5", "123456789.125"]
    assert [size_label(n) for n in (0, 1023, 1024, 1280, 1536, 1 << 20, 5 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1.0 MB", "5.0 GB"]
    assert size_label(5 << 30, ("KB", "MB")) == "5120.0 MB"
    assert lines_of("a\r\nb\n") == ["a", "b"] and lines_of("") == [] and lines_of("a\x0bb c") == ["a\x0bb c"]


# Structured values


def test_nesting_stops_at_six_hashes():
    v = "1"
    for k in "gfedcba":
        v = f'{{"{k}":{v}}}'
    out = convert(v.encode(), "json")
    assert "###### f" in out and "#######" not in out


def test_mixed_arrays_have_numbered_headings():
    out = convert(b'[1,{"key":"val"},[true]]', "json")
    assert out == "- 1\n# 2\n\n| Key | Value |\n|---|---|\n| key | val |\n\n# 3\n\n- true\n\n"


def test_key_order_and_unions():
    assert convert(b'[{"b":1,"a":2},{"c":3,"b":null}]', "json") == "| b | a | c |\n|---|---|---|\n| 1 | 2 |  |\n|  |  | 3 |\n\n"
    assert "| 9 |" in convert(b'{"a":1,"a":9}', "json")
    assert "| 18446744073709552000 |" in convert(b'{"a":18446744073709551615}', "json")


def test_yaml_keeps_words_and_dates_as_text():
    out = convert(b"a: yes\nb: off\nc: 2020-01-02\nd: true\n1: x\ntrue: y\ne: !tag 5\nf: .inf\ng: 0x1F\n", "yaml")
    for cell in ("| a | yes |", "| b | off |", "| c | 2020-01-02 |", "| d | true |", "| 1 | x |", "| true | y |", "| e | 5 |", "| f | inf |", "| g | 31 |"):
        assert cell in out


def test_toml_dates_and_order():
    out = convert(b"b = 1979-05-27T07:32:00Z\na = 1.5\n", "toml")
    assert out.index("| a | 1.5 |") < out.index("| b | 1979-05-27T07:32:00Z |")


def test_csv_delimiter_is_a_comma():
    assert convert(b"a\tb\n1\t2\n", "csv") == "| a\tb |\n|---|\n| 1\t2 |\n"


def test_xml_texts_and_nesting():
    out = convert(b'<?xml version="1.0"?><!-- c --><n:root a="1|2"> t &amp; u <![CDATA[<x>]]><b><c/></b><b/></n:root>', "xml")
    assert out == "# root\n\n| Attribute | Value |\n|---|---|\n| a | 1\\|2 |\n\nt & u\n<x>\n\n## b\n\n### c\n\n## b\n\n"


# Office formats


def test_excel_numbers_errors_and_sparse_rows():
    cells = '<row r="1"><c r="B1"><v>2</v></c><c r="C1"><v>2.50</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="e"><v>#DIV/0!</v></c></row><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="str"><v>x|y</v></c></row>'
    book = {
        "xl/workbook.xml": '<workbook><sheets><sheet name="One" r:id="rId1"/><sheet name="Two" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><r><t>sha</t></r><r><t>red</t></r></si></sst>",
        "xl/worksheets/a.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
        "xl/worksheets/b.xml": "<worksheet><sheetData/></worksheet>",
    }
    assert convert(fixtures.packed(book), "excel") == "# One\n\n| 2 | 2.5 | true | #Div0 |\n|---|---|---|---|\n| shared | x\\|y |  |  |\n\n# Two\n\n*Empty sheet*\n"


def test_excel_reads_ods():
    row = lambda *cells: "<table:table-row>" + "".join(cells) + "</table:table-row>"
    text = lambda s: f'<table:table-cell office:value-type="string"><text:p>{s}</text:p></table:table-cell>'
    num = lambda s: f'<table:table-cell office:value-type="float" office:value="{s}"/>'
    xml = f'<office:document-content><office:body><office:spreadsheet><table:table table:name="S">{row(text("a"), text("b"))}{row(num("1"), num("2.5"))}</table:table></office:spreadsheet></office:body></office:document-content>'
    assert convert(fixtures.packed({"mimetype": "x", "content.xml": xml}), "excel") == "# S\n\n| a | b |\n|---|---|\n| 1 | 2.5 |\n"


def test_excel_few_wide_rows_are_text():
    out = convert(fixtures.xlsx({"S": {"A1": "one", "A2": "two", "B2": "x", "A3": "three"}}), "excel")
    assert out == "# S\n\none\n\ntwo  x\n\nthree\n"


def test_word_blocks():
    p = lambda text, how="", run="": f"<w:p><w:pPr>{how}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"
    body = p("Head", '<w:pStyle w:val="Heading2"/>') + p("one", '<w:numPr/>') + p("q", '<w:pStyle w:val="Quote"/>') + p("b", run="<w:b/><w:i/>") + "<w:tbl><w:tr><w:tc>" + p("x|y") + "</w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc></w:tr></w:tbl>"
    assert convert(fixtures.docx(body), "word") == "## Head\n- one\n\n> q\n\n***b***\n\n| x\\|y |  |\n|---|---|\n| 1 |  |\n"


def test_powerpoint_subtitles_bullets_tables_and_notes():
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>A</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    parts = {"ppt/slides/slide1.xml": fixtures.slide(fixtures.shape("T", "ctrTitle"), fixtures.shape("Sub", "subTitle"), fixtures.shape("item", bullets=True, how='b="1"'), table), "ppt/notesSlides/notesSlide1.xml": fixtures.slide(fixtures.shape("say this"), fixtures.shape("12"))}
    assert convert(fixtures.packed(parts), "powerpoint") == "# T\n\n## Sub\n\n- **item**\n\n| A |\n|---|\n\n> **Notes**: say this\n\n"


# PDF


def test_pdf_text_and_metadata():
    out = convert(fixtures.pdf([["Hello world", "second line"]], "My Title"), "pdf")
    assert out.startswith("# My Title\n\n---\n") and "<!-- page 1 -->" in out and "Hello world\nsecond line" in out
    assert convert(fixtures.pdf([[]]), "pdf").startswith("*PDF contains no extractable text")


def test_pdf_compressed_streams_and_unicode_maps():
    import zlib

    cmap = b"1 beginbfchar <01> <65E5> endbfchar 1 beginbfrange <02> <03> <0041> endbfrange"
    text = zlib.compress(b"BT /F 12 Tf 10 10 Td <010203> Tj ET")
    body = b"%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]/Count 1>> endobj 3 0 obj <</Type/Page/Contents 4 0 R/Resources<</Font<</F 5 0 R>>>>>> endobj\n"
    body += b"4 0 obj <</Length %d/Filter/FlateDecode>> stream\n" % len(text) + text + b"\nendstream endobj 5 0 obj <</Subtype/Type1/ToUnicode 6 0 R>> endobj 6 0 obj <</Length %d>> stream\n" % len(cmap) + cmap + b"\nendstream endobj\ntrailer <</Root 1 0 R>>"
    assert "日AB" in convert(body, "pdf")


def test_pdf_tables():
    from quillspark.sources.pdf import fix_tables

    assert fix_tables("| Name | Age |\n| Alice | 30 |\n| Bob | 40 |") == "| Name | Age |\n| --- | --- |\n| Alice | 30 |\n| Bob | 40 |"
    assert fix_tables("| a | b |\n| --- | --- |\n| 1 | 2 |") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert fix_tables("x\n| Sales |  |\n\n| Name | Q1 |\n| A | 1 |\n\nend") == "x\n## Sales\n\n| Name | Q1 |\n| --- | --- |\n| A | 1 |\n\nend"


def test_pdf_repeated_lines():
    from quillspark.sources.pdf import normal, strip_repeated

    pages = lambda lines: "\n".join(f"<!-- page {k} -->\n\n{x}\n" for k, x in enumerate(lines, 1))
    out = strip_repeated(pages([f"Confidential\nbody {c}\nPage {k} of 3" for k, c in enumerate("abc", 1)]), 3)
    assert "Confidential" not in out and "Page" not in out and all(f"body {c}" in out for c in "abc")
    few = pages(["Stamp\na", "Stamp\nb", "c\nd", "e\nf", "g\nh"])
    assert strip_repeated(few, 5) == few and strip_repeated(pages(["x", "x"]), 2) == pages(["x", "x"])
    assert normal("Page 3 of 42") == "page # of #"


# Containers and media


def test_tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, kind, data in (("d", tarfile.DIRTYPE, b""), ("d/a.txt", tarfile.REGTYPE, b"x" * 1500), ("l", tarfile.SYMTYPE, b"")):
            info = tarfile.TarInfo(name)
            info.type, info.size, info.linkname = kind, len(data), "d/a.txt"
            t.addfile(info, io.BytesIO(data))
    want = "# Archive\n\n**Total entries**: 3\n\n| # | Name | Size | Type |\n|---|------|------|------|\n| 1 | d/ | - | dir |\n| 2 | d/a.txt | 1.5 KB | file |\n| 3 | l | 0 B | symlink |\n\n**Total size**: 1.5 KB\n"
    assert convert(out.getvalue(), "tar") == convert(gzip.compress(out.getvalue()), "tar") == want


def test_zip_totals():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("d")
        z.writestr("d/a", "y" * 4096)
    text = convert(out.getvalue(), "zip")
    assert "| 1 | d/ | - | - | Stored |" in text and "| 2 | d/a | 4.0 KB |" in text and "Deflated |" in text and "ratio: 9" in text
    assert "ratio: N/A" in convert(fixtures.packed({}), "zip")


def test_sqlite(tmp_path):
    path = tmp_path / "x.db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE b (id INTEGER PRIMARY KEY, v REAL, s TEXT, d BLOB)")
    db.executemany("INSERT INTO b VALUES (?, ?, ?, ?)", [(k, k / 2, "x|y" if k else None, b"12") for k in range(12)])
    db.execute("CREATE TABLE a (x)")
    db.commit()
    db.close()
    out = convert(path.read_bytes(), "sqlite")
    assert out.startswith("# Database\n\n**Tables**: 2\n\n## a\n\n| Column | Type | PK |\n|--------|------|----|\n| x |  |  |\n\n**Rows**: 0\n\n## b\n")
    assert "| id | INTEGER | yes |" in out and "| 0 | 0 | NULL | [BLOB 2 bytes] |" in out and "| 1 | 0.5 | x\\|y |" in out and out.endswith("\n*Showing 10 of 12 rows*\n")


def test_epub():
    opf = '<package><metadata><dc:title>Book</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:description>About</dc:description></metadata><manifest><item id="1" href="a.xhtml"/><item id="2" href="b.xhtml"/><item id="3" href="gone.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="3"/><itemref idref="x"/><itemref idref="1"/></spine></package>'
    parts = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": opf, "o/a.xhtml": "<p>first</p>", "o/b.xhtml": "<p>second</p>"}
    assert convert(fixtures.packed(parts), "epub") == "# Book\n\n**Author**: B\n\n> About\n\n---\n\nsecond\n\n---\n\nfirst\n"


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 6, 0, 0, 0)
    assert convert(png, "image").endswith("| Format | Png |\n| Size | 29 B |\n| Dimensions | 640x480 |\n| Color Type | Rgba8 |\n")
    assert "| Dimensions | 3x2 |" in convert(b"GIF89a" + struct.pack("<HH", 3, 2) + b"\0" * 8, "image")
    assert "| Format | SVG |" in convert(b"<svg xmlns='x'/>", "image")
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 20, 10, 3) + b"\0" * 9
    assert "| Format | Jpeg |" in convert(jpeg, "image") and "| Dimensions | 10x20 |" in convert(jpeg, "image")


def test_audio():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 8000 * 4 * 65)
    assert "| Duration | 1:05 |\n| Bitrate | 256 kbps |\n| Sample Rate | 8000 Hz |\n| Channels | 2 (Stereo) |" in convert(out.getvalue(), "audio")
    title = b"TIT2" + struct.pack(">I", 5) + b"\0\0" + b"\x03Song"
    mp3 = b"ID3\x03\0\0\0\0\0" + bytes([len(title)]) + title + b"\xff\xfb\x90\xc0" + b"\0" * 16000
    text = convert(mp3, "audio")
    assert "| Format | Mpeg |" in text and "| Bitrate | 128 kbps |" in text and "(Mono)" in text and "| Title | Song |" in text


def test_video():
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    mvhd = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 3_725_000) + b"\0" * 80)
    sound = box(b"mp4a", b"\0" * 16 + struct.pack(">HH", 6, 16) + b"\0" * 4 + struct.pack(">I", 48000 << 16))
    stsd = box(b"stsd", b"\0" * 8 + sound)
    data = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", mvhd + box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stsd)))))
    out = convert(data, "video")
    assert out.startswith("# Video\n\n## File Info\n\n") and "| Duration | 1:02:05 |" in out and "| Audio Channels | 6 (5.1 Surround) |\n| Audio Sample Rate | 48000 Hz |" in out


# HTML


@pytest.mark.parametrize(
    "source, expected",
    [
        ("", "*Empty HTML document*\n"),
        ("<p>a <b>b</b> <i>c</i> <code>d</code> <del>e</del></p>", "a **b** *c* `d` ~~e~~\n"),
        ("<h2>T</h2><p>x<br>y</p>", "## T\n\nx  \ny\n"),
        ('<a href="/u">t</a><img src="s" alt="a">', "[t](/u)![a](s)\n"),
        ("<ol><li>one<li>two</ol>", "1. one\n2. two\n"),
        ("<ul><li>a<ul><li>b</ul></ul>", "- a\n  - b\n"),
        ("<blockquote><p>q</p></blockquote>", "> q\n"),
        ('<pre><code class="language-py">x\n y</code></pre>', "```py\nx\n y\n```\n"),
        ("<table><tr><th>A<th>B<tr><td>1<td>2</table>", "| A | B |\n|---|---|\n| 1 | 2 |\n"),
        ("<style>p{}</style><script>f()</script><p>x</p>", "```javascript\nf()\n```\n\nx\n"),
        ("<title>T</title><p>x</p>", "# T\n\nx\n"),
        ('<title>T</title><meta name="author" content="A"><h1>T</h1>', "---\ntitle: T\nauthor: A\n---\n\n# T\n"),
        ("<p>a &lt; b</p><hr>", "a < b\n\n---\n"),
    ],
)
def test_html(source, expected):
    assert convert(source.encode(), "html") == expected


@pytest.mark.parametrize(
    "source, expected, headings",
    [
        ("<title>T</title><h1></h1><h1>T</h1>", "# T\n", ["T", "", "T"]),
        ("<title>T</title><title>U</title><p>x</p>", "# T\n\nx\n", ["T"]),
        ("<ul><li>a<h1></h1></ul><p>x</p>", "- a\n\nx\n", [""]),
        ("<table><tr><th><h1>A</h1></table>", "| A |\n|---|\n", ["A"]),
        ("<h1></h1>", "*Empty HTML document*\n", [""]),
        ("<![x[y]]><p>a", "a\n", []),
    ],
)
def test_html_headings_that_markdown_does_not_write(source, expected, headings):
    found = blocks(source.encode(), "html")
    assert convert(source.encode(), "html") == expected == "".join(b.md for b in found)
    assert [b.text for b in found if b.kind == "heading"] == headings


def test_html_references_end_with_a_semicolon():
    source = "<title>a &amp;&amp;&amp; b &copy; &copy</title><p>x &ampx; &#65; &#65 &lt;&lt &nosuch; & &&amp;<a href='?a=1&amp;b=2&copy=3&lt'>l</a><script>a&&b&amp;c &amp</script><pre>a &lt b &lt;</pre>"
    assert convert(source.encode(), "html") == "# a &&& b © &copy\n\nx &ampx; A &#65 <&lt &nosuch; & &&[l](?a=1&b=2&copy=3&lt)\n\n```javascript\na&&b&amp;c &amp\n```\n\n```\na &lt b <\n```\n"


# Markup details


@pytest.mark.parametrize(
    "format, source, expected",
    [
        ("rst", "====\nTop\n====\n\nSub\n---\n\nAgain\n=====\n", "# Top\n\n## Sub\n\n# Again\n\n"),
        ("rst", ":func:`foo` ``x`` `t <u>`_ `plain`\n", "foo `x` [t](u) plain\n\n"),
        ("rst", ".. note:: Hi\n\n   more\n", "> **Note:** Hi\n> more\n\n"),
        ("rst", ".. image:: a.png\n   :alt: x\n\n.. comment\n   y\n\nend\n", "![](a.png)\n\nend\n\n"),
        ("rst", "   quoted\n   text\n", "> quoted text\n\n"),
        ("rst", ".. list-table::\n   :header-rows: 1\n\n   * - A\n     - B\n   * - 1\n     - 2\n", "| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"),
        ("rst", "a\n\n-----\n\nb\n", "a\n\n---\n\nb\n\n"),
        ("org", "** Two\n:PROPERTIES:\n:x: y\n:END:\n#+AUTHOR: z\ntext\nmore\n- a\n  - b\n1) c\n-----\n", "## Two\n\ntext more\n\n- a\n  - b\n1. c\n---\n\n"),
        ("org", "#+begin_quote\nq\n\nr\n#+end_quote\n#+begin_example\n *x*\n#+end_example\n", "> q\n>\n> r\n\n```\n *x*\n```\n\n"),
        ("org", "a*b*c and *b*, /i/.\n", "a*b*c and **b**, *i*.\n\n"),
        ("mediawiki", "== H ==\n'''b''' ''i'' [http://x.y text] {{t|{{u}}}}end\n* a\n** b\n# c\n: d\n----\n code\n", "## H\n\n**b** *i* [text](http://x.y) end\n\n- a\n  - b\n1. c\n> d\n---\n\n```\ncode\n```\n\n"),
        ("mediawiki", "<pre>a\nb</pre>\n[[File:x.png|alt]]\n", "```\na\nb\n```\n\n![alt](File:x.png)\n\n"),
        ("mediawiki", "====\n", "====\n\n"),
        ("asciidoc", ":attr: v\n// comment\n////\nx\n////\n=== H\n* a\n** b\n. c\n\n'''\n\n....\nlit\n....\n", "### H\n\n- a\n  - b\n1. c\n---\n\n```\nlit\n```\n\n"),
        ("asciidoc", "[NOTE]\n====\nA *b*\n====\n[quote]\n____\nq\n____\nimage::p.png[Alt]\n", "> **Note:**\n> A **b**\n\n> q\n\n![Alt](p.png)\n\n"),
        ("asciidoc", "|===\n|A |B\n\n|1\n|2\n|===\n", "| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"),
    ],
)
def test_markup(format, source, expected):
    assert convert(source.encode(), format) == expected


def test_blocks_make_up_the_markdown():
    for format, _, source, expected in fixtures.TEXT_FIXTURES:
        found = blocks(source.encode(), format)
        assert "".join(b.md for b in found) == expected and all(b.kind for b in found)


# Markdown


def test_markdown_nodes():
    nodes = parse("# T\n\na **b *c*** `d` [e](f \"t\") ~~g~~ <http://h.i> \\*j\\*\n\nSet\n---\n\n> q\n> r\n\n1. x\n   y\n- z\n\n~~~js\nk\n~~~\n\n| A | B |\n|:--|--:|\n| 1 \\| 2 |\n\n***\n\n    code\n")
    assert [n.kind for n in nodes if not n.inline] == ["heading", "heading", "quote", "list", "list", "code", "cell", "cell", "align", "cell", "cell", "hr", "code"]
    assert [n.kind for n in nodes if n.inline] == ["text", "strong", "text", "code_inline", "text", "link", "text", "delete", "text", "link", "text"]
    assert text_of([n for n in nodes if n.inline]) == "a b c d e g http://h.i *j*"
    assert [n.depth for n in nodes if n.kind == "heading"] == [1, 2] and [n.ordered for n in nodes if n.kind == "list"] == [True, False]
    assert [text_of(n.values) for n in nodes if n.kind == "cell"] == ["A", "B", "1 | 2", ""]


def test_headings_survive_a_round_trip():
    md = "# One\n\ntext\n\n## Two\n\n- a\n- b\n\n### Three\n"
    for target, format in (("markdown-rst", "rst"), ("markdown-org", "org"), ("markdown-asciidoc", "asciidoc"), ("markdown-html", "html")):
        back = convert(convert(md.encode(), target).encode(), format)
        assert [x for x in back.split("\n") if x.startswith("#")] == ["# One", "## Two", "### Three"], target
    assert convert(convert(md.encode(), "markdown-docx"), "word").startswith("# One\n\ntext\n\n## Two\n- a\n- b\n\n### Three\n")


def test_packaged_writers():
    md = b"before\n\n# A & B\n\n1. x\n2. y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n\n# C\n\nend\n"
    word = zipfile.ZipFile(io.BytesIO(convert(md, "markdown-docx")))
    body = word.read("word/document.xml").decode()
    assert "1. x" in body and "2. y" in body and "─" * 40 in body and "A &amp; B" in body and "<w:tbl>" in body
    book = zipfile.ZipFile(io.BytesIO(convert(md, "markdown-epub")))
    assert book.namelist()[0] == "mimetype" and [n for n in book.namelist() if "chapter" in n] == [f"OEBPS/chapter_{k}.xhtml" for k in range(3)]
    assert b"<table>" not in book.read("OEBPS/chapter_1.xhtml") and b"A &amp; B" in book.read("OEBPS/content.opf")
    assert convert(md, "markdown-docx") == convert(md, "markdown-docx")


def test_json_tree():
    assert json.loads(convert(b"# T\n", "markdown-json-ast"))[0]["type"] == "heading"


def test_registration_and_targets():
    registry.register_reader("shout", lambda d: [__import__("quillspark.blocks", fromlist=["para"]).para(d.decode().upper())], ("shout",))
    assert convert(b"hey", "shout") == "HEY\n\n" and registry.EXTENSIONS["shout"] == "shout"
    registry.register_writer("markdown-len", lambda md: str(len(md)), "len")
    assert convert(b"abc", "markdown-len") == "3" and registry.extension_of("markdown-len") == "len"
    del registry.READERS["shout"], registry.WRITERS["markdown-len"], registry.EXTENSIONS["shout"]
    assert registry.target_of("markdown-docx", "latex") == "markdown-latex" and registry.extension_of("pdf") == "md"
    with pytest.raises(ConversionError):
        registry.target_of("json", "latex")
