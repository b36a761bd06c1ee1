"""Scalar functions of document conversion as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For regular expressions: white space in the Unicode sense.
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same as characters.
_WHITES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_white(s: Column) -> Column:
    return F.btrim(s, F.lit(_WHITES))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def lines_of(s: Column) -> Column:
    """Lines ended by LF or CRLF alone; a last line end starts no further line, and an empty text has no lines."""
    whole = F.split(s, "\n", -1)
    kept = F.when(F.element_at(whole, -1) == "", F.slice(whole, 1, F.size(whole) - 1)).otherwise(whole)
    return F.transform(kept, lambda x: F.regexp_replace(x, r"\r\z", ""))


def escape_pipe(s: Column) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


#: Stands for a backslash while the other characters are escaped; a text that holds it itself is escaped by character.
_STAND_IN = "\ue000"


def latex_escape(s: Column) -> Column:
    """Each special character is replaced in all of the text, in an order in which nothing written is escaped again.

    The backslash is set aside first; braces come before the commands that end in braces.
    """
    from quillspark.sinks.writers import LATEX_ESCAPES

    table = F.create_map(*[F.lit(x) for pair in LATEX_ESCAPES.items() for x in pair])
    slow = F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    out = F.replace(s, F.lit("\\"), F.lit(_STAND_IN))
    for c in ("{", "}", *(c for c in LATEX_ESCAPES if c not in "{}\\")):
        out = F.replace(out, F.lit(c), F.lit(LATEX_ESCAPES[c]))
    out = F.replace(out, F.lit(_STAND_IN), F.lit(LATEX_ESCAPES["\\"]))
    return F.when(F.contains(s, F.lit(_STAND_IN)), slow).otherwise(F.when(s.rlike(r"[\\{}&%$#_~^]"), out).otherwise(s))


def strip_tag(s: Column, tag: str) -> Column:
    """Without spans of a tag: to the first end tag, or the tag alone if it has none or ends itself; to the end if it is not closed."""
    return F.regexp_replace(s, f"(?s)<{tag}(?:[^>]*/>|[^>]*>(?:.*?</{tag}>)?|[^>]*\\z)", "")


def size_label(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB")) -> Column:
    """Bytes in units of 1024 with one decimal, halves to even."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1024**k, F.concat(F.bround(n / F.lit(float(1024**k)), 1).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def number_label(x: Column) -> Column:
    """A double's shortest form without an exponent, whole numbers without a point."""
    s = x.cast("double").cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    digits = F.replace(F.regexp_replace(F.regexp_extract(s, r"\A-?([0-9.]+)E", 1), r"\.0\z", ""), F.lit("."), F.lit(""))
    power = F.regexp_extract(s, r"E(-?[0-9]+)\z", 1).try_cast("int")
    whole = power + 1
    large = F.concat(sign, F.rpad(F.substring(digits, F.lit(1), whole), whole, F.lit("0")), F.when(F.length(digits) > whole, F.concat(F.lit("."), F.substring(digits, whole + 1, F.length(digits)))).otherwise(""))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    odd = F.when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").otherwise(F.when(power >= 0, large).otherwise(small))
    plain = F.when(s.endswith(".0"), F.substring(s, F.lit(1), F.length(s) - 2)).otherwise(s)
    return F.when(F.contains(s, F.lit("E")) | F.contains(s, F.lit("y")), odd).otherwise(plain)  # few have an exponent


def primitive_label(x: Column) -> Column:
    """Null is empty."""
    return F.coalesce(x.cast("string"), F.lit(""))


def clock(seconds: Column, hours: bool = False) -> Column:
    s = F.floor(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    short = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), two(s % 60))
    if not hours:
        return short
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))).otherwise(short)


def channel_label(n: Column, surround: bool = False) -> Column:
    out = F.when(n == 1, "Mono").when(n == 2, "Stereo")
    if surround:
        out = out.when(n == 6, "5.1 Surround").when(n == 8, "7.1 Surround")
    return out.otherwise("Multi-channel")


def repeat_key(line: Column) -> Column:
    """A line without case, with each run of digits as one mark."""
    return ascii_lower(F.regexp_replace(trim_white(line), "[0-9]+", "#"))


def is_page_marker(line: Column) -> Column:
    return line.startswith("<!-- page ") & line.endswith(" -->")


def table_cells(line: Column) -> Column:
    """Trimmed cells of a ``| a | b |`` row, null for other lines."""
    t = trim_white(line)
    return F.when((F.length(t) >= 2) & t.startswith("|") & t.endswith("|"), F.transform(F.split(F.substring(t, F.lit(2), F.length(t) - 2), r"\|", -1), trim_white))


def is_separator_row(cells: Column) -> Column:
    return (F.size(cells) > 0) & F.forall(cells, lambda c: (c != "") & (F.translate(c, "-:", "") == ""))


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


#: Separator rows differ by source: without blanks, with blanks in each cell, and joined like a row.
def separator_row(n: Column, dialect: str = "tight") -> Column:
    if dialect == "row":
        return pipe_row(F.array_repeat(F.lit("---"), n))
    cell = "---|" if dialect == "tight" else " --- |"
    return F.concat(F.lit("|"), F.repeat(F.lit(cell), n))


def fit_width(cells: Column, n: Column) -> Column:
    """Cells cut or filled up with empty ones to n."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.coalesce(F.get(cells, k), F.lit("")))).otherwise(F.array().cast("array<string>"))


def is_blank_row(cells: Column) -> Column:
    return F.forall(cells, lambda c: c == "")


def filled_text(cells: Column) -> Column:
    return F.array_join(F.filter(cells, lambda c: c != ""), "  ")


def local_name(s: Column) -> Column:
    return F.substring_index(s, ":", -1)


def style_level(style: Column) -> Column:
    """The level of a heading style's name, 0 for others."""
    found = F.regexp_extract(ascii_lower(style), r"\A(?:heading|titre)\s*\+?0*([1-6])\s*\z", 1)
    return F.when(found == "", 0).otherwise(found.try_cast("int"))


def is_quote_style(style: Column) -> Column:
    return ascii_lower(style).isin("quote", "intensequote", "blockquote")


def styled(text: Column, bold: Column, italic: Column) -> Column:
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.when(text == "", "").otherwise(F.concat(mark, text, mark))


def underline_char(line: Column) -> Column:
    """The character a line consists of, where it can underline a title; else null."""
    found = F.regexp_extract(F.regexp_replace(line, rf"{WHITE}+\z", ""), "\\A([=\\-~^\"'`#*+.:_])\\1*\\z", 1)
    return F.when(found != "", found)


def indent_of(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"\A *", 0))


def min_indent(lines: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: trim_white(x) != ""), indent_of)), F.lit(0))


def strip_enumeration(s: Column, hash_mark: bool = False) -> Column:
    """The text after ``1. ``, ``1) `` or, if asked for, ``#. ``; null where there is none."""
    pattern = r"\A(?:#\. |[0-9]+[.)] )" if hash_mark else r"\A[0-9]+[.)] "
    return F.when(s.rlike(pattern), F.regexp_replace(s, pattern, ""))


def wiki_marks(s: Column) -> Column:
    for a, b in (("'''''", "***"), ("'''", "**"), ("''", "*"), ("<code>", "`"), ("</code>", "`"), ("<nowiki>", ""), ("</nowiki>", ""), ("<br />", "  \n"), ("<br/>", "  \n"), ("<br>", "  \n")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def is_delimiter(line: Column, c: str, least: int = 4) -> Column:
    return line.rlike(rf"\A\Q{c}\E{{{least},}}\z")


def capitalised(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def heading_underline(depth: Column) -> Column:
    return F.when(depth == 1, "=").when(depth == 2, "-").when(depth == 3, "~").when(depth == 4, "^").otherwise('"')


def heading_style(depth: Column) -> Column:
    return F.concat(F.lit("Heading"), F.least(depth, F.lit(6)).cast("string"))


def member_label(kind: Column) -> Column:
    return F.when(kind == "d", "dir").when(kind == "f", "file").when(kind == "l", "symlink").when(kind == "h", "hardlink").otherwise("other")


def is_gzip(data: Column) -> Column:
    return F.startswith(data, F.lit(b"\x1f\x8b"))


def is_svg(data: Column) -> Column:
    head = F.decode(F.substring(data, 1, 256), "ISO-8859-1")
    return head.contains("<svg") | head.startswith("<?xml")


def slide_number(path: Column) -> Column:
    """The number in a slide's path, 0 where there is none."""
    n = F.regexp_replace(F.regexp_replace(path, r"\Appt/slides/slide", ""), r"\.xml\z", "")
    return F.when(n.rlike(r"\A[0-9]+\z") & (n.try_cast("long") < 2**32), n.try_cast("long")).otherwise(F.lit(0).cast("long"))


def wiki_url_links(s: Column) -> Column:
    """Bracketed web addresses as links; one without a text names itself."""
    s = F.regexp_replace(s, r"\[(https?://[^ \]]*) +([^\]]+?)\s*\]", r"[$2]($1)")
    return F.regexp_replace(s, r"\[(https?://[^ \]]*)\](?!\()", r"[$1]($1)")
