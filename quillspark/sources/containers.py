"""ZIP and TAR listings, SQLite databases and EPUB books."""

from __future__ import annotations

import gzip
import io
import os
import sqlite3
import tarfile
import tempfile
import zipfile
import zlib

from quillspark.blocks import Block, ConversionError, escape_pipe, grid, number, row, size_label, trim
from quillspark.sources.office import archive, member
from quillspark.sources.xml import events

# Names of compression methods and of kinds of archive members.
METHODS = {0: "Stored", 8: "Deflated", 9: "Deflate64", 12: "Bzip2", 14: "Lzma", 93: "Zstd", 95: "Xz", 99: "AES"}
MEMBER_KINDS = {"f": "file", "d": "dir", "l": "symlink", "h": "hardlink"}


def zip_entries(data: bytes) -> list[tuple[str, int, int, str, bool]]:
    """Name, size, compressed size, method, and whether it is a folder, of each entry."""
    return [(i.filename, i.file_size, i.compress_size, METHODS.get(i.compress_type, f"Unsupported({i.compress_type})"), i.is_dir()) for i in archive(data, "zip").infolist()]


def ratio(size: int, compressed: int) -> str:
    return f"{(1 - compressed / size) * 100:.1f}%" if size else "N/A"


def _archive_head(n: int) -> Block:
    return Block("heading", f"# Archive\n\n**Total entries**: {n}\n\n", level=1, text="Archive")


def read_zip(data: bytes) -> list[Block]:
    entries = zip_entries(data)
    cells = [[str(k), name, "-" if folder else size_label(size), "-" if folder else size_label(packed), method] for k, (name, size, packed, method, folder) in enumerate(entries, 1)]
    size, packed = sum(e[1] for e in entries), sum(e[2] for e in entries)
    md = row(["#", "Name", "Size", "Compressed", "Method"]) + "|---|------|------|------------|--------|\n" + "".join(map(row, cells))
    total = f"**Total size**: {size_label(size)} (compressed: {size_label(packed)}, ratio: {ratio(size, packed)})"
    return [_archive_head(len(entries)), Block("table", md + "\n", cells=cells), Block("para", total + "\n", text=total)]


def tar_entries(data: bytes) -> list[tuple[str, int, str]]:
    """Path, size and kind of each entry."""
    try:
        raw = io.BytesIO(data)
        with tarfile.open(fileobj=gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw, mode="r|") as t:  # a stream: never unpacked as a whole
            return [(m.name + "/" * (m.isdir() and not m.name.endswith("/")), m.size, "f" if m.isreg() else "d" if m.isdir() else "l" if m.issym() else "h" if m.islnk() else "?") for m in t]
    except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
        if isinstance(e, tarfile.ReadError) and "empty" in str(e):
            return []
        raise ConversionError("tar", str(e)) from e


def read_tar(data: bytes) -> list[Block]:
    entries = tar_entries(data)
    cells = [[str(k), name, "-" if kind == "d" else size_label(size), MEMBER_KINDS.get(kind, "other")] for k, (name, size, kind) in enumerate(entries, 1)]
    md = row(["#", "Name", "Size", "Type"]) + "|---|------|------|------|\n" + "".join(map(row, cells))
    total = f"**Total size**: {size_label(sum(e[1] for e in entries))}"
    return [_archive_head(len(entries)), Block("table", md + "\n", cells=cells), Block("para", total + "\n", text=total)]


PREVIEW_ROWS = 10


def _cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bytes):
        return f"[BLOB {len(v)} bytes]"
    return number(v) if isinstance(v, float) else v.replace("|", "\\|") if isinstance(v, str) else str(v)


def read_sqlite(data: bytes) -> list[Block]:
    handle, path = tempfile.mkstemp(suffix=".db")  # a file of its own: workers share a host
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        try:
            return _database(db)
        finally:
            db.close()
    except sqlite3.Error as e:
        raise ConversionError("sqlite", str(e)) from e
    finally:
        os.unlink(path)


def _database(db: sqlite3.Connection) -> list[Block]:
    names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type='table' ORDER BY name")]
    out = [Block("heading", f"# Database\n\n**Tables**: {len(names)}\n\n", level=1, text="Database")]
    for k, name in enumerate(names):
        quoted = '"' + name.replace('"', '""') + '"'
        columns = [(r[1], r[2], "yes" if r[5] else "") for r in db.execute(f"PRAGMA table_info({quoted})")]
        out.append(Block("heading", "\n" * bool(k) + f"## {name}\n\n", level=2, text=name))
        out.append(Block("table", row(["Column", "Type", "PK"]) + "|--------|------|----|\n" + "".join(map(row, columns)) + "\n", cells=[list(c) for c in columns]))
        try:
            n = db.execute(f"SELECT COUNT(*) FROM {quoted}").fetchone()[0]
        except sqlite3.Error:
            n = 0
        out.append(Block("para", f"**Rows**: {n}\n", text=f"Rows: {n}"))
        if n and columns:
            cells = [list(map(_cell, r)) for r in db.execute(f"SELECT * FROM {quoted} LIMIT {PREVIEW_ROWS}")]
            out.append(Block("table", "\n" + grid([[c[0] for c in columns], *cells], escape=False), cells=cells))
            if n > PREVIEW_ROWS:
                out.append(Block("para", f"\n*Showing {PREVIEW_ROWS} of {n} rows*\n"))
    return out


# EPUB

# Metadata elements and their labels, in the order shown.
EPUB_FIELDS = {"creator": "Author", "language": "Language", "publisher": "Publisher", "date": "Date"}


def opf_path(z: zipfile.ZipFile) -> str:
    for e in events(member(z, "META-INF/container.xml", "epub"), "epub"):
        if e.kind in ("start", "empty") and e.name == "rootfile" and "full-path" in e.attrs:
            return e.attrs["full-path"]
    raise ConversionError("epub", "Could not find rootfile in container.xml")


def package(xml: str) -> tuple[dict[str, str], list[str]]:
    """Metadata by element, the last of a kind counts, and the hrefs of the spine that the manifest has."""
    meta, manifest, spine, inside, tag = {}, {}, [], False, ""
    for e in events(xml, "epub"):
        if e.kind == "text":
            if tag:
                meta[tag] = e.text
        elif e.kind == "end":
            inside, tag = inside and e.local != "metadata", ""
        elif e.local == "metadata" and e.kind == "start":
            inside = True
        elif e.local == "item" and e.attrs.get("id") and e.attrs.get("href"):
            manifest.setdefault(e.attrs["id"], e.attrs["href"])
        elif e.local == "itemref" and e.kind == "empty" and "idref" in e.attrs:
            spine.append(e.attrs["idref"])
        elif inside and e.kind == "start" and e.local in ("title", "description", *EPUB_FIELDS):
            tag = e.local
    return meta, [manifest[i] for i in spine if i in manifest]


def read_epub(data: bytes) -> list[Block]:
    from quillspark.sources.html import to_markdown

    z = archive(data, "epub")
    opf = opf_path(z)
    meta, spine = package(member(z, opf, "epub"))
    folder = opf[: opf.rfind("/") + 1]
    title = meta.get("title", "EPUB")
    out = [Block("heading", f"# {title}\n\n", level=1, text=title)]
    out += [Block("para", f"**{label}**: {meta[k]}\n", text=meta[k]) for k, label in EPUB_FIELDS.items() if k in meta]
    if "description" in meta:
        out.append(Block("quote", f"\n> {meta['description']}\n", text=meta["description"]))
    out.append(Block("hr", "\n---\n"))
    chapters = 0
    for href in spine:
        try:
            text = trim(to_markdown(member(z, href[1:] if href.startswith("/") else folder + href, "epub")))
        except ConversionError:
            continue
        if text:
            out.append(Block("raw", "\n---\n" * bool(chapters) + f"\n{text}\n", text=text))
            chapters += 1
    return out


__all__ = ["escape_pipe", "read_epub", "read_sqlite", "read_tar", "read_zip", "tar_entries", "zip_entries"]
