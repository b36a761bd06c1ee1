"""Formats, and the readers and writers registered for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from quillspark.blocks import Block, ConversionError


@dataclass(frozen=True)
class Reader:
    name: str
    load: Callable[[], Callable[[bytes], list[Block]]]
    enabled: bool = True


@dataclass(frozen=True)
class Writer:
    name: str
    extension: str
    load: Callable[[], Callable[[str], str | bytes]]
    binary: bool = False


def _at(module: str, name: str):
    return lambda: getattr(import_module(f"quillspark.{module}"), name)


READERS: dict[str, Reader] = {}
WRITERS: dict[str, Writer] = {}
EXTENSIONS: dict[str, str] = {}


def register_reader(name: str, read: Callable[[bytes], list[Block]], extensions: tuple[str, ...] = ()) -> None:
    """Add a format: a function from bytes to blocks, and the file name extensions that tell it."""
    READERS[name] = Reader(name, lambda: read)
    EXTENSIONS.update(dict.fromkeys(extensions, name))


def register_writer(name: str, write: Callable[[str], str | bytes], extension: str, binary: bool = False) -> None:
    """Add a target: a function from Markdown to text or bytes."""
    WRITERS[name] = Writer(name, extension, lambda: write, binary)


# Formats by file name extension.
_FORMATS = {
    "excel": ("sources.office", "read_excel", "xlsx xls xlsb ods"), "pdf": ("sources.pdf", "read_pdf", "pdf"), "powerpoint": ("sources.office", "read_powerpoint", "pptx"),
    "word": ("sources.office", "read_word", "docx"), "image": ("sources.media", "read_image", "png jpg jpeg gif webp svg bmp tiff tif"), "zip": ("sources.containers", "read_zip", "zip"),
    "epub": ("sources.containers", "read_epub", "epub"), "audio": ("sources.media", "read_audio", "mp3 wav flac ogg m4a aac wma"), "csv": ("sources.structured", "read_csv", "csv tsv"),
    "html": ("sources.html", "read_html", "html htm"), "json": ("sources.structured", "read_json", "json"), "yaml": ("sources.structured", "read_yaml", "yaml yml"),
    "toml": ("sources.structured", "read_toml", "toml"), "xml": ("sources.xml", "read_xml", "xml"), "sqlite": ("sources.containers", "read_sqlite", "sqlite sqlite3 db"),
    "tar": ("sources.containers", "read_tar", "tar tgz"), "video": ("sources.media", "read_video", "mp4 mkv avi mov webm m4v wmv flv"), "rst": ("sources.markup", "read_rst", "rst"),
    "org": ("sources.markup", "read_org", "org"), "mediawiki": ("sources.markup", "read_mediawiki", "wiki mediawiki"), "asciidoc": ("sources.markup", "read_asciidoc", "adoc asciidoc"),
}
# Targets of Markdown, their extensions and whether they are bytes.
_TARGETS = {
    "markdown-docx": ("to_docx", "docx", True), "markdown-html": ("to_html", "html", False), "markdown-text": ("to_text", "txt", False), "markdown-latex": ("to_latex", "tex", False), "markdown-rst": ("to_rst", "rst", False),
    "markdown-asciidoc": ("to_asciidoc", "adoc", False), "markdown-org": ("to_org", "org", False), "markdown-epub": ("to_epub", "epub", True), "markdown-json-ast": ("to_json", "json", False),
}
MARKDOWN = "markdown-docx"  # what Markdown input is converted to unless told otherwise
SHORT = {"docx": "markdown-docx", "html": "markdown-html", "text": "markdown-text", "txt": "markdown-text", "latex": "markdown-latex", "rst": "markdown-rst", "asciidoc": "markdown-asciidoc", "org": "markdown-org", "epub": "markdown-epub", "json-ast": "markdown-json-ast", "json": "markdown-json-ast"}

for _name, (_module, _function, _extensions) in _FORMATS.items():
    READERS[_name] = Reader(_name, _at(_module, _function))
    EXTENSIONS.update(dict.fromkeys(_extensions.split(), _name))
EXTENSIONS.update({"md": MARKDOWN, "markdown": MARKDOWN})
#: Text recognition needs an engine that is not part of this library; the format is known and not enabled.
READERS["ocr"] = Reader("ocr", lambda: None, enabled=False)
for _name, (_function, _extension, _binary) in _TARGETS.items():
    WRITERS[_name] = Writer(_name, _extension, _at("sinks.writers", _function), _binary)


def target_of(format: str, to: str | None) -> str:
    """The converter of an input's format, given the target asked for, which only Markdown input can have."""
    if to is None:
        return format
    target = SHORT.get(to, to)
    if target not in WRITERS:
        raise ConversionError(to, "unknown target")
    if format != MARKDOWN:
        raise ConversionError(format, "a target can be given for Markdown input only")
    return target


def blocks(data: bytes, format: str) -> list[Block]:
    reader = READERS.get(format)
    if reader is None:
        raise ConversionError(format, "unknown format")
    if not reader.enabled:
        raise ConversionError(format, "format is not enabled")
    return reader.load()(data)


def convert(data: bytes, format: str) -> str | bytes:
    """Markdown of an input, or what a writer makes of Markdown where ``format`` is a target."""
    if format in WRITERS:
        from quillspark.sinks.writers import utf8_markdown

        return WRITERS[format].load()(utf8_markdown(data, format))
    return "".join(b.md for b in blocks(data, format))


def extension_of(format: str) -> str:
    return WRITERS[format].extension if format in WRITERS else "md"
