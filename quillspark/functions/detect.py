"""Formats by file name and by first bytes, as column expressions.

Only archives need more than an expression: what a ZIP file holds is read by an Arrow function, which is given the
bytes of ZIP files alone.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.text import ascii_lower
from quillspark.plans.registry import EXTENSIONS

# First bytes and formats, in the order in which they are tried; some are looked up further on as well.
MAGIC = (
    (b"%PDF", "pdf"), (b"\x89PNG", "image"), (b"\xff\xd8\xff", "image"), (b"GIF87a", "image"), (b"GIF89a", "image"), ((b"RIFF", b"WAVE"), "audio"), (b"fLaC", "audio"), (b"OggS", "audio"),
    (b"ID3", "audio"), (b"\xff\xfb", "audio"), (b"\xff\xf3", "audio"), (b"\xff\xf2", "audio"), (b"BM", "image"), (b"II*\x00", "image"), (b"MM\x00*", "image"), ((b"RIFF", b"WEBP"), "image"),
    (b"SQLite format 3\x00", "sqlite"), (b"\x1f\x8b", "tar"),
)
ZIP = b"PK\x03\x04"
# Starts of names of archive members and what they tell.
MEMBERS = (("word/", "word"), ("ppt/", "powerpoint"), ("xl/", "excel"))
EPUB_MEMBERS = ("mimetype", "META-INF/container.xml")


def extension(path: Column) -> Column:
    """The last extension of a file name in lower case; null where there is none."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    found = F.regexp_extract(name, r"(?s).\.([^.]*)\z", 1)
    return F.when(found != "", ascii_lower(found))


def extension_format(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.element_at(table, extension(path))


def zip_format(data: bytes) -> str | None:
    """The format of the first member that tells one; null for what is no archive."""
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except (zipfile.BadZipFile, ValueError, EOFError, OSError):
        return None
    for name in names:
        for start, format in MEMBERS:
            if name.startswith(start):
                return format
        if name in EPUB_MEMBERS:
            return "epub"
    return "zip"


@F.arrow_udf(StringType())
def zip_format_udf(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else zip_format(d) for d in data.to_pylist()], pa.string())


def magic_format(data: Column, sniff: bool = True) -> Column:
    """The format that the first bytes tell; null for short and unknown data."""
    out = F.lit(None).cast("string")
    if sniff:
        out = zip_format_udf(F.when(F.startswith(data, F.lit(ZIP)), data))
    for start, format in reversed(MAGIC):
        if isinstance(start, tuple):
            fits = F.startswith(data, F.lit(start[0])) & (F.substring(data, 9, 4) == F.lit(start[1]))
        else:
            fits = F.startswith(data, F.lit(start))
        out = F.when(fits, format).otherwise(out)
    return F.when(F.length(data) >= 4, out)


def magic_rules(spark: SparkSession) -> DataFrame:
    """The formats by first bytes as a table of rules for ``first_prefix``, without archives, which take more than their first bytes."""
    rows = [(bytearray(a[0]), 9, bytearray(a[1]), k, f) if isinstance(a, tuple) else (bytearray(a), None, None, k, f) for k, (a, f) in enumerate(MAGIC)]
    return spark.createDataFrame(rows, "prefix binary, more_at int, more binary, priority int, value string")


def detect(path: Column, data: Column) -> Column:
    """By name first, else by content."""
    known = extension_format(path)
    return F.coalesce(known, magic_format(F.when(known.isNull(), data)))
