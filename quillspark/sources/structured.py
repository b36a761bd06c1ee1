"""JSON, YAML, TOML and CSV, and the rendering of nested values."""

from __future__ import annotations

import csv as csv_module
import io
import itertools
import json as json_module
from collections.abc import Iterator

from quillspark.blocks import Block, ConversionError, escape_pipe, grid, heading, number, row, utf8


def scalar(v) -> bool:
    return not isinstance(v, dict | list)


def show(v) -> str:
    """A scalar's text; null is empty."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return number(v)
    return str(v)


def key_union(objects: list[dict]) -> list[str]:
    """All keys, in the order of their first place."""
    return list(dict.fromkeys(itertools.chain.from_iterable(objects)))


def blocks_of(v, depth: int = 1) -> Iterator[Block]:
    """Nested values: runs of scalars become tables or lists, all else gets a heading a level deeper."""
    if isinstance(v, dict):
        for flat, entries in itertools.groupby(v.items(), key=lambda e: scalar(e[1])):
            if flat:
                cells = [[k, show(x)] for k, x in entries]
                yield Block("kv", grid([["Key", "Value"], *cells]) + "\n", cells=cells)
            else:
                for k, x in entries:
                    yield heading(min(depth, 6), k)
                    yield from blocks_of(x, depth + 1)
    elif isinstance(v, list):
        yield from _list_blocks(v, depth)
    else:
        yield Block("para", show(v) + "\n", text=show(v))


def _list_blocks(items: list, depth: int) -> Iterator[Block]:
    if not items:
        yield Block("para", "*empty*\n", text="")
    elif all(isinstance(x, dict) and all(map(scalar, x.values())) for x in items):
        keys = key_union(items)
        cells = [[show(x.get(k)) for k in keys] for x in items]
        head = row(map(escape_pipe, keys)) + "|" + "---|" * len(keys) + "\n" if keys else "|\n|\n"
        yield Block("table", head + "".join(row(map(escape_pipe, r)) if keys else "|\n" for r in cells) + "\n", cells=[keys, *cells])
    elif all(map(scalar, items)):
        for k, x in enumerate(items, 1):
            yield Block("list", f"- {show(x)}\n" + "\n" * (k == len(items)), text=show(x))
    else:
        for k, x in enumerate(items, 1):
            if scalar(x):
                yield Block("list", f"- {show(x)}\n", text=show(x))
            else:
                yield heading(min(depth, 6), str(k))
                yield from blocks_of(x, depth + 1)


def _wide(n: int) -> int | float:
    """Whole numbers beyond 64 bits are floating-point numbers."""
    return n if -(2**63) <= n < 2**63 else float(n)


def read_json(data: bytes) -> list[Block]:
    def constant(name: str):
        raise ValueError(f"{name} is not JSON")

    def real(s: str) -> float:
        x = float(s)
        if x in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        return x

    try:
        v = json_module.loads(data.decode("utf-8"), parse_int=lambda s: _wide(int(s)), parse_float=real, parse_constant=constant)
    except (ValueError, RecursionError) as e:
        raise ConversionError("json", str(e)) from e
    return list(blocks_of(v))


def _yaml_loader():
    import re

    import yaml

    class Loader(yaml.SafeLoader):
        """Core schema: only true and false are booleans, and there are neither dates nor merge keys."""

        yaml_implicit_resolvers: dict = {}

    add = Loader.add_implicit_resolver
    add("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    add("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
    add("tag:yaml.org,2002:int", re.compile(r"^(?:[-+]?(?:0|[1-9][0-9]*)|[-+]?0x[0-9a-fA-F]+|[-+]?0o[0-7]+|[-+]?0b[01]+)$"), list("-+0123456789"))
    add("tag:yaml.org,2002:float", re.compile(r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"), list("-+0123456789."))

    def integer(loader, node):
        s = node.value.replace("_", "")
        return _wide(int(s, 0)) if s.lstrip("+-")[:2] in ("0x", "0o", "0b") else _wide(int(s))

    def real(loader, node):
        s = node.value.lower().replace("_", "")
        return float(s.replace(".inf", "inf").replace(".nan", "nan"))

    def mapping(loader, node):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            name = key if isinstance(key, str) else "Null" if key is None else show(key) if scalar(key) else repr(key)
            if name in out:
                raise yaml.YAMLError(f"duplicate entry with key {name!r}")
            out[name] = loader.construct_object(v, deep=True)
        return out

    def other(loader, suffix, node):
        """A tag of the document's own: the value within."""
        if isinstance(node, yaml.MappingNode):
            return mapping(loader, node)
        if isinstance(node, yaml.SequenceNode):
            return loader.construct_sequence(node, deep=True)
        return loader.construct_object(yaml.ScalarNode(loader.resolve(yaml.ScalarNode, node.value, (True, False)), node.value))

    Loader.add_constructor("tag:yaml.org,2002:int", integer)
    Loader.add_constructor("tag:yaml.org,2002:float", real)
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    Loader.add_multi_constructor("!", other)
    return Loader


def read_yaml(data: bytes) -> list[Block]:
    import yaml

    text = utf8(data, "yaml")
    try:
        v = yaml.load(text, _yaml_loader())  # noqa: S506  a SafeLoader
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        raise ConversionError("yaml", str(e)) from e
    return list(blocks_of(v))


def read_toml(data: bytes, sort: bool = True) -> list[Block]:
    """``sort``: tables by key, as an ordered map has them; else in the order of the document."""
    import datetime
    import tomllib

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in (sorted(v.items()) if sort else v.items())}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, datetime.datetime | datetime.date | datetime.time):
            return v.isoformat().replace("+00:00", "Z")
        return v

    try:
        return list(blocks_of(plain(tomllib.loads(utf8(data, "toml")))))
    except tomllib.TOMLDecodeError as e:
        raise ConversionError("toml", str(e)) from e


def read_csv(data: bytes, delimiter: str = ",") -> list[Block]:
    """The first record is the header and gives the width. The delimiter is a comma unless told otherwise."""
    text = utf8(data, "csv").removeprefix("﻿")
    csv_module.field_size_limit(1 << 30)
    rows = [r for r in csv_module.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    if not rows:
        return [Block("para", "*Empty CSV*\n")]
    return [Block("table", grid(rows, width=len(rows[0])), cells=rows)]
