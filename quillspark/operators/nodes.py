"""Inline Markdown as nested intervals: a table of nodes, and what they render to, without recursion.

A text becomes its tokens, in order. Marks of a kind pair up by turns, a link's brackets with each other; pairs that cross others,
and marks without a partner, are text. A node is the interval of places from its opening token to its closing one, and
depth is a running sum over the marks that are left. Rendering a tree in order is then one ordered aggregate
over its tokens: an opening gives what stands before a node's text, a closing what stands after it, whatever the depth.

All windows are partitioned by the keys first, so that a text is sent once. Not told apart: emphasis by underscores, links by
reference, brackets within brackets of a link.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = Sequence[str]
#: What a node begins and ends with; the column is its value: an address, or the text of a leaf.
Wrap = tuple[Callable[[Column], Column], Callable[[Column], Column]]

_LINK = r"\]\([^()\s]*\)"
_TOKENS = rf"\\[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]|`[^`]+`| {{2,}}\n|\\\n|!\[[^\[\]]*{_LINK}|\*\*\*|\*\*|\*|~~|{_LINK}|(?:[^\\`*~\[\]! \n]++| (?! *\n)|!(?!\[))++|[\\`~\[\]! \n]"
_KINDS = {"***": "strong_emphasis", "**": "strong", "*": "emphasis", "~~": "delete"}


def _between(start: str, end: str) -> Wrap:
    return (lambda _: F.lit(start)), (lambda _: F.lit(end))


#: Plain text: images have none, a break is a blank.
PLAIN: Mapping[str, Wrap] = {}
LATEX: Mapping[str, Wrap] = {
    "strong": _between("\\textbf{", "}"), "emphasis": _between("\\textit{", "}"), "strong_emphasis": _between("\\textbf{\\textit{", "}}"), "code_inline": _between("\\texttt{", "}"),
    "delete": _between("\\sout{", "}"), "link": ((lambda url: F.concat(F.lit("\\href{"), url, F.lit("}{"))), (lambda _: F.lit("}"))),
}


def _events(df: DataFrame, keys: Keys, text: str, parts: int | None = None) -> DataFrame:
    """``__k, pos, end, move, depth, kind, value``: tokens by their struct of keys, with 1 for a node's opening, -1 for its closing, 0 for a leaf."""
    plain = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[\\`*~\[]| {2}\n")
    tokens = F.when(plain, F.array(F.coalesce(F.col(text), F.lit("")))).otherwise(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)))
    texts = df.select(F.struct(*keys).alias("__k"), F.col(text).alias(text))
    rows = (texts.repartition(parts, "__k") if parts else texts).select("__k", F.posexplode(tokens).alias("pos", "t"))
    w = W.partitionBy("__k").orderBy("pos")
    space = lambda c: F.coalesce(c, F.lit(" ")).rlike(r"\A\s\z")
    mark = F.col("t").isin(*_KINDS)
    rows = rows.withColumns({"opens": mark & ~space(F.substr(F.lead("t").over(w), F.lit(1), F.lit(1))), "closes": mark & ~space(F.right(F.lag("t").over(w), F.lit(1)))})
    ends_link = F.startswith("t", F.lit("]("))
    group = F.when(F.col("opens") | F.col("closes"), F.col("t")).when(F.col("t").isin("[", "]") | ends_link, "[")
    rows = rows.withColumns({"g": group, "ends": ends_link})
    # A pair is two tokens of a group side by side: the first of each two marks, or a bracket before the end of a link.
    in_group = W.partitionBy("__k", "g").orderBy("pos")
    rows = rows.withColumn("odd", F.pmod(F.row_number().over(in_group), F.lit(2)) == 1)
    last = F.lag(F.struct("pos", "t", "opens")).over(in_group)
    after = F.lead(F.struct("pos", "t", "closes", "ends")).over(in_group)
    rows = rows.withColumns({"last": last, "after": after})
    bracket, some = F.col("g") == "[", F.col("g").isNotNull()
    starts = some & F.when(bracket, (F.col("t") == "[") & F.col("after.ends")).otherwise(F.col("odd") & F.col("opens") & F.col("after.closes"))
    stops = some & F.when(bracket, F.col("ends") & (F.col("last.t") == "[")).otherwise(~F.col("odd") & F.col("closes") & F.col("last.opens"))
    move = F.when(F.coalesce(starts, F.lit(False)), 1).when(F.coalesce(stops, F.lit(False)), -1).otherwise(0)
    rows = rows.withColumn("move", move).withColumn("pair", F.when(F.col("move") == 1, F.col("pos")).when(F.col("move") == -1, F.col("last.pos")))
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("depth", F.sum("move").over(up_to)).withColumn("level", F.when(F.col("move") == 1, F.col("depth")).when(F.col("move") == -1, F.col("depth") + 1))
    # On a level openings and closings take turns; one whose neighbour is not its partner crosses another.
    on_level = W.partitionBy("__k", "level").orderBy("pos")
    partner = F.when(F.col("move") == 1, F.lead("pair").over(on_level)).otherwise(F.lag("pair").over(on_level))
    rows = rows.withColumn("partner", partner)
    rows = rows.withColumn("move", F.when(F.col("pair") == F.col("partner"), F.col("move")).otherwise(0))
    end = F.when(F.col("move") == 1, F.col("after.pos")).otherwise(F.col("pos"))
    t, moves = F.col("t"), F.col("move") != 0
    code = F.startswith(t, F.lit("`")) & (F.length(t) > 2)
    image = F.startswith(t, F.lit("![")) & (F.length(t) > 2)
    escaped = F.startswith(t, F.lit("\\")) & (F.length(t) == 2) & ~F.endswith(t, F.lit("\n"))
    is_break = t.rlike(r"\A(?: {2,}|\\)\n\z")
    kind = F.when(moves & bracket, "link").when(moves, F.element_at(F.create_map(*[F.lit(x) for p in _KINDS.items() for x in p]), t)).when(code, "code_inline").when(image, "image").when(is_break, "break").otherwise("text")
    address = F.when(F.col("move") == 1, F.col("after.t")).otherwise(t)
    value = F.when(moves & bracket, F.substr(address, F.lit(3), F.length(address) - 3)).when(moves, "").when(code, F.substr(t, F.lit(2), F.length(t) - 2))
    value = value.when(image, F.regexp_extract(t, r"\A!\[([^\]]*)", 1)).when(is_break, "").when(escaped, F.substr(t, F.lit(2))).otherwise(t)
    return rows.select("__k", "pos", end.alias("end"), "move", F.sum("move").over(up_to).alias("depth"), kind.alias("kind"), value.alias("value"))


def _unpacked(keys: Keys) -> list[Column]:
    return [F.col("__k")[k].alias(k) for k in keys]


def inline_nodes(df: DataFrame, keys: Keys, text: str) -> DataFrame:
    """``keys, lo, hi, depth, kind, value`` of the nodes of a text: their intervals of tokens, and their depth from 1.

    A node holds another if its interval does. Leaves are intervals of one token: ``text``, ``code_inline``, ``image`` (its value is the
    alternative text) and ``break``. An empty or null text is one empty leaf. ``keys`` tell texts apart.
    """
    events = _events(df, keys, text).filter("move >= 0")
    depth = F.when(F.col("move") == 1, F.col("depth")).otherwise(F.col("depth") + 1)
    return events.select(*_unpacked(keys), F.col("pos").alias("lo"), F.col("end").alias("hi"), depth.alias("depth"), "kind", "value")


def inline_rendered(df: DataFrame, keys: Keys, text: str, targets: Mapping[str, Mapping[str, Wrap]], leaves: Mapping[str, Callable[[Column], Column]] | None = None, parts: int | None = None) -> DataFrame:
    """``keys`` and a column for each of ``targets``: texts with nodes written by the target's wraps, leaves by its function in ``leaves``.

    Kinds without a wrap are their text alone. The tree is made once for all targets. With ``parts`` texts are dealt out to so many
    tasks before they become tokens; without, tokens are, and tasks of few bytes of them are put together, which take up many times these bytes.
    """
    value, out = F.col("value"), {}
    for name, wraps in targets.items():
        leaf = (leaves or {}).get(name, lambda c: c)
        shown = F.when(F.col("kind") == "break", F.lit(" ")).when(F.col("kind") == "image", F.lit(""))
        for kind, (start, end) in wraps.items():
            of = F.col("kind") == kind
            shown = shown.when(of & (F.col("move") == 1), start(value)).when(of & (F.col("move") == -1), end(value))
            if kind == "code_inline":
                shown = shown.when(of, F.concat(start(value), leaf(value), end(value)))
        out[name] = shown.when(F.col("move") != 0, F.lit("")).otherwise(leaf(value))
    events = _events(df, keys, text, parts).select("__k", F.struct("pos", *[c.alias(n) for n, c in out.items()]).alias("__x"))
    ordered = events.groupBy("__k").agg(F.array_sort(F.collect_list("__x")).alias("__all"))
    return ordered.select(*_unpacked(keys), *[F.array_join(F.col("__all")[n], "").alias(n) for n in out])


def headings_and_items(df: DataFrame, line: str) -> DataFrame:
    """``df`` with ``kind, level, content`` for lines that are headings or list items; other lines go.

    The level of a heading is its number of signs; that of an item grows by one for each two blanks before it.
    """
    heading, item = r"(?s)^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t\r]*$", r"(?s)^([ ]*)(?:[-*+]|[0-9]{1,9}[.)])[ \t]+(.*?)[ \t\r]*$"
    is_heading = F.col(line).rlike(heading)
    level = F.when(is_heading, F.length(F.regexp_extract(line, heading, 1))).otherwise(1 + F.floor(F.length(F.regexp_extract(line, item, 1)) / 2)).cast("int")
    content = F.when(is_heading, F.regexp_extract(line, heading, 2)).otherwise(F.regexp_extract(line, item, 2))
    told = df.withColumns({"kind": F.when(is_heading, "heading").when(F.col(line).rlike(item), "item"), "level": level, "content": content})
    return told.filter("kind IS NOT NULL")
