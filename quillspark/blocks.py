"""Document blocks: what every reader yields and what Markdown is made of.

A block has its kind, its content, and its own piece of Markdown. A document's Markdown is the concatenation of its
blocks' pieces in order, so rendering is an ordered string aggregate and needs no knowledge of the source format.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

#: White space in the Unicode sense; Python's strip() without arguments would also take U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


class ConversionError(Exception):
    def __init__(self, format: str, message: str):
        super().__init__(f"{format}: {message}")
        self.format, self.message = format, message


@dataclass(slots=True)
class Block:
    kind: str  # heading, para, list, quote, code, hr, table, kv, raw
    md: str
    level: int = 0
    ordered: bool = False
    lang: str | None = None
    text: str = ""
    cells: list[list[str]] | None = None


BLOCK_TYPE = T.StructType(
    [
        T.StructField("block_id", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("ordered", T.BooleanType()),
        T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("md", T.StringType()),
    ]
)


def trim(s: str) -> str:
    return s.strip(WHITE)


def lines_of(text: str) -> list[str]:
    """Lines ended by LF or CRLF alone; a last line end starts no further line."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def number(x: float) -> str:
    """The shortest decimal form that reads back, never with an exponent; whole numbers without a point."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    s = format(Decimal(repr(x)), "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


def size_label(n: int, units: Sequence[str] = ("KB", "MB", "GB")) -> str:
    """Bytes in units of 1024 with one decimal."""
    power = max((k for k in range(len(units) + 1) if n >= 1024**k), default=0)
    return f"{n / 1024**power:.1f} {units[power - 1]}" if power else f"{n} B"


def escape_pipe(s: str) -> str:
    return s.replace("|", "\\|")


def row(cells: Iterable[str]) -> str:
    return "|" + "".join(f" {c} |" for c in cells) + "\n"


def grid(rows: Sequence[Sequence[str]], dashes: str = "---", width: int | None = None, escape: bool = True) -> str:
    """A pipe table whose first row is the header; rows are filled up or cut to one width.

    ``dashes`` is what a separator cell holds: some formats have blanks around it, some not.
    """
    n = max(map(len, rows), default=0) if width is None else width
    if not n:
        return ""
    clean = escape_pipe if escape else str
    out = [row(clean(r[k]) if k < len(r) else "" for k in range(n)) for r in rows]
    return out[0] + "|" + f"{dashes}|" * n + "\n" + "".join(out[1:])


def heading(level: int, text: str, end: str = "\n\n") -> Block:
    return Block("heading", f"{'#' * level} {text}{end}", level=level, text=text)


def para(text: str, end: str = "\n\n") -> Block:
    return Block("para", text + end, text=text)


def item(text: str, depth: int = 0, ordered: bool = False) -> Block:
    return Block("list", f"{'  ' * depth}{'1.' if ordered else '-'} {text}\n", level=depth, ordered=ordered, text=text)


def fence(lines: Iterable[str], lang: str = "") -> Block:
    lines = list(lines)
    return Block("code", f"```{lang}\n" + "".join(f"{x}\n" for x in lines) + "```\n\n", lang=lang or None, text="\n".join(lines))


def rule() -> Block:
    return Block("hr", "---\n\n")


def table(rows: Sequence[Sequence[str]], end: str = "\n", **how) -> Block:
    return Block("table", grid(rows, **how) + end, cells=[list(r) for r in rows])


def utf8(data: bytes, format: str) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ConversionError(format, str(e)) from e


def markdown(blocks: Iterable[Block]) -> str:
    return "".join(b.md for b in blocks)
