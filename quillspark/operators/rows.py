"""Relational operators of document conversion as DataFrame transforms.

Windows are always partitioned by the document (``keys``), so that no task sees more than one document's rows beyond
its share; none of them collects to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as X

Keys = Sequence[str]


def _window(keys: Keys, order: Sequence[str | Column]):
    return W.partitionBy(*keys).orderBy(*order)


def _up_to_here(keys: Keys, order):
    return _window(keys, order).rowsBetween(W.unboundedPreceding, 0)


# Islands and runs


def islands(df: DataFrame, keys: Keys, order, is_break: Column, name: str = "island") -> DataFrame:
    """Rows between breaks, numbered from 1 within each document; the breaks are left out."""
    marked = df.withColumn("__break", is_break.cast("int"))
    marked = marked.withColumn("__n", F.sum("__break").over(_up_to_here(keys, order))).filter("__break = 0")
    return marked.withColumn(name, F.dense_rank().over(_window(keys, ["__n"]))).drop("__break", "__n")


def runs(df: DataFrame, keys: Keys, order, value: Column, name: str = "run") -> DataFrame:
    """Rows with the number of their run of equal values; nulls equal each other."""
    w = _window(keys, order)
    marked = df.withColumn("__v", value).withColumn("__first", F.row_number().over(w) == 1)
    starts = (F.col("__first") | ~F.col("__v").eqNullSafe(F.lag("__v").over(w))).cast("int")
    marked = marked.withColumn("__start", starts)
    return marked.withColumn(name, F.sum("__start").over(_up_to_here(keys, order))).drop("__v", "__first", "__start")


def counters(df: DataFrame, keys: Keys, order, value: Column, name: str = "counter") -> DataFrame:
    """Rows with their place within their run, as ordered lists are numbered."""
    return runs(df, keys, order, value, "__run").withColumn(name, F.row_number().over(_window([*keys, "__run"], order))).drop("__run")


def sections(df: DataFrame, keys: Keys, order, is_start: Column, name: str = "section") -> DataFrame:
    """Rows with the number of starts up to them: chapters and pages; 0 is what comes before the first."""
    return df.withColumn(name, F.sum(is_start.cast("int")).over(_up_to_here(keys, order)))


def collapse_blanks(df: DataFrame, keys: Keys, order, is_blank: Column) -> DataFrame:
    """Without blank rows that follow blank rows."""
    marked = df.withColumn("__b", is_blank)
    return marked.withColumn("__p", F.lag("__b", 1, False).over(_window(keys, order))).filter(~(F.col("__b") & F.col("__p"))).drop("__b", "__p")


def composed(df: DataFrame, keys: Keys, order: str, step: str, chunk: int = 4096) -> DataFrame:
    """``df`` with ``step`` replaced by the composition of all steps up to a row, in the order of ``order``.

    A step is a transition of a finite automaton: an array that holds, for each state, the state after the row. Composition is
    associative, so a document is cut into chunks of rows that are scanned side by side, each in as many rounds as twos
    multiply to its length, over one window; the chunks' totals are scanned in the same way, and where each begins is joined back.
    """
    named = df.withColumn("__k", F.struct(*keys)).withColumn("__n", F.row_number().over(W.partitionBy("__k").orderBy(order)) - 1)
    longest = (named.agg(F.max("__n")).first()[0] or 0) + 1
    named = named.withColumn("__c", F.floor(F.col("__n") / chunk))
    w = W.partitionBy("__k", "__c").orderBy("__n")
    then = lambda first, second: F.transform(first, lambda s: F.col(second)[s])
    shift = 1
    while shift < min(longest, chunk):
        named = named.withColumn("__before", F.lag(step, shift).over(w))
        named = named.withColumn(step, F.when(F.col("__before").isNull(), F.col(step)).otherwise(then(F.col("__before"), step)))
        shift *= 2
    if longest > chunk:
        totals = named.groupBy(F.col("__k").alias("__doc"), F.col("__c").alias("__part")).agg(F.max_by(step, "__n").alias("__total"))
        totals = composed(totals, ["__doc"], "__part", "__total", chunk)
        starts = totals.select(F.col("__doc").alias("__sk"), (F.col("__part") + 1).alias("__sc"), F.col("__total").alias("__start"))
        named = named.join(starts, (F.col("__c") == F.col("__sc")) & F.col("__k").eqNullSafe(F.col("__sk")), "left")
        named = named.withColumn(step, F.when(F.col("__start").isNull(), F.col(step)).otherwise(then(F.col("__start"), step)))
    return named.select(*df.columns)


def fenced(df: DataFrame, keys: Keys, order: str, line: str, name: str = "fenced", chunk: int = 4096) -> DataFrame:
    """Lines with whether they are of a fenced code block, its fences included.

    A fence is three or more backticks or tildes after up to three blanks. One that opens may have an info string (without
    backticks, if it is of backticks); one that closes has none, is of the same character and no shorter. States are: outside, or
    inside a fence of a character and a length, by the rank of the length among those of its document. Only lines with
    fences are scanned; other lines have the state of the last fence before them.
    """
    mark = F.regexp_extract(line, "^ {0,3}(`{3,}|~{3,})([^\\n]*)$", 1)
    info = F.regexp_extract(line, "^ {0,3}(`{3,}|~{3,})([^\\n]*)$", 2)
    tilde = F.startswith(mark, F.lit("~"))
    bare = info.rlike(r"^[ \t\r]*$")
    marked = df.withColumns({"__mark": mark, "__fence": (mark != "") & (tilde | ~F.contains(info, F.lit("`"))), "__tilde": tilde.cast("int"), "__bare": bare})
    fences = marked.filter("__fence").select(*keys, F.col(order).alias("__at"), F.length("__mark").alias("__long"), "__tilde", "__bare")
    ranked = fences.withColumn("__rank", F.dense_rank().over(W.partitionBy(*keys).orderBy("__long")))
    ranked = ranked.withColumn("__ranks", F.max("__rank").over(W.partitionBy(*keys)))
    own = 1 + F.col("__tilde") * F.col("__ranks") + F.col("__rank") - 1
    closes = lambda s: F.col("__bare") & (s > F.col("__tilde") * F.col("__ranks")) & (s <= own)  # noqa: E731  of its character, and no longer than it
    ranked = ranked.withColumn("__step", F.transform(F.sequence(F.lit(0), 2 * F.col("__ranks")), lambda s: F.when(s == 0, own).when(closes(s), 0).otherwise(s).cast("int")))
    states = composed(ranked, keys, "__at", "__step", chunk).select(F.struct(*keys).alias("__sk"), "__at", F.col("__step")[0].alias("__state"))
    joined = marked.withColumn("__k", F.struct(*keys)).join(states, (F.col(order) == F.col("__at")) & F.col("__k").eqNullSafe(F.col("__sk")), "left")
    w = W.partitionBy("__k").orderBy(order)
    joined = joined.withColumn("__after", F.coalesce(F.last("__state", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    joined = joined.withColumn("__before", F.lag("__after", 1, 0).over(w))
    return joined.select(*df.columns, ((F.col("__after") > 0) | (F.col("__before") > 0)).alias(name))


def chapters(df: DataFrame, keys: Keys, order: str, line: str, name: str = "chapter") -> DataFrame:
    """Lines with the number of first-level headings up to them; what looks like one inside a fence is none."""
    told = fenced(df, keys, order, line, "__fenced")
    return sections(told, keys, [order], F.col(line).rlike(r"^ {0,3}#(?:[ \t]|$)") & ~F.col("__fenced"), name).drop("__fenced")


def without_nested(df: DataFrame, keys: Keys, text: str, opening: str = "{", closing: str = "}") -> DataFrame:
    """``keys`` and ``text`` without spans between two of ``opening`` and two of ``closing``, however they are nested.

    A text becomes its events, in order: doubled openings and closings, and what lies between them. Depth is a running sum
    that does not fall below zero, which is the sum less its least value so far; what stands at depth zero stays, closings
    there as well. What an opening without a closing hides ends with the text. Texts without an opening are one event. ``keys`` tell rows apart.
    """
    a, b = (rf"\x{ord(c):02x}" for c in (opening, closing))
    events = F.when(F.contains(text, F.lit(opening * 2)), F.regexp_extract_all(text, F.lit(f"[^{a}{b}]+|{a}{a}|{b}{b}|[{a}{b}]"), F.lit(0))).otherwise(F.array(F.col(text)))
    w, within = _window(keys, ["__pos"]), _up_to_here(keys, ["__pos"])
    rows = df.select(*keys, F.posexplode_outer(events).alias("__pos", "__event"))
    opens, closes = F.col("__event") == opening * 2, F.col("__event") == closing * 2
    rows = rows.withColumn("__sum", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(within))
    rows = rows.withColumn("__depth", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(within)))
    rows = rows.withColumn("__before", F.lag("__depth", 1, 0).over(w))
    shown = F.when(~opens & (F.col("__depth") == 0) & (F.col("__before") == 0), F.struct("__pos", "__event"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["__event"]), "")
    return rows.groupBy(*keys).agg(F.when(F.count("__event") > 0, whole).alias(text))


def markup_texts(df: DataFrame, keys: Keys, markup: str, names: Sequence[str], attribute: str = "href") -> DataFrame:
    """``keys, pos, path, attribute, text`` of every text in markup that is not blank: ``path`` are the tags around it, from outside in.

    A markup becomes its tags and texts, in order. Only tags of ``names`` count, which have end tags: depth is the running sum of
    starts and ends, never below zero, and the tag open at a level is the last one that started there. ``attribute`` is that of the
    innermost tag of the path, as written between quotes, and empty where it has none. Comments, scripts and styles are left out.
    """
    bare = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    rows = df.select(*keys, F.posexplode(F.regexp_extract_all(bare, F.lit("<[^>]*>|[^<]+"), F.lit(0))).alias("pos", "__e"))
    name = X.ascii_lower(F.regexp_extract("__e", "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    rows = rows.withColumn("__name", name).withColumn("__own", F.col("__name").isin(*names))
    rows = rows.withColumn("__move", F.when(F.col("__own") & F.startswith("__e", F.lit("</")), -1).when(F.col("__own") & ~F.endswith("__e", F.lit("/>")), 1).otherwise(0))
    within = _up_to_here(keys, ["pos"])
    rows = rows.filter((F.col("__move") != 0) | ~F.startswith("__e", F.lit("<"))).withColumn("__sum", F.sum("__move").over(within))
    rows = rows.withColumn("__depth", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(within)))
    deepest = rows.agg(F.max("__depth")).first()[0] or 0
    found = F.regexp_extract("__e", rf"(?is)\b{attribute}\s*=\s*[\"']([^\"']*)", 1)
    opened = F.struct(F.col("__name").alias("name"), found.alias("value"))
    levels = [F.last(F.when((F.col("__move") == 1) & (F.col("__depth") == k), opened), ignorenulls=True).over(within) for k in range(1, deepest + 1)]
    rows = rows.withColumn("__open", F.slice(F.array(*levels), F.lit(1), F.col("__depth").cast("int")) if levels else F.array().cast("array<struct<name:string,value:string>>"))
    texts = rows.filter((F.col("__move") == 0) & (X.trim_white(F.col("__e")) != ""))
    return texts.select(*keys, "pos", F.array_join(F.transform("__open", lambda x: x["name"]), "/").alias("path"), F.when(F.size("__open") > 0, F.element_at("__open", -1)["value"]).alias("attribute"), F.col("__e").alias("text"))


def json_paths(df: DataFrame, keys: Keys, json: str) -> DataFrame:
    """``keys, path, kind, value`` of every value in a JSON text, at any depth: each round opens the objects and arrays of the one before.

    There are as many rounds as levels, which a first pass counts; a text is parsed once in either. What is found in a text, and what is
    still to be opened, are arrays in its row, so that the rounds are one pass over the texts. Paths are like ``$.a.b[0]``; kinds are
    object, array, string, number, boolean and null; objects and arrays have no value. A text that is no JSON, or has a key twice in an
    object, is of the kind invalid.
    """
    parsed = df.filter(F.col(json).isNotNull()).withColumn("__v", F.try_parse_json(json))
    brackets = F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++', "")
    step = lambda a, c: F.struct((a["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("d"), F.greatest(a["m"], a["d"] + 1).alias("m"))
    levels = F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("d"), F.lit(1).alias("m")), step)["m"]
    rounds = parsed.filter("__v IS NOT NULL").agg(F.max(levels).alias("n")).first()["n"] or 0
    none = F.lit(None).cast("string")

    def told(x: Column) -> Column:
        v = x["v"]
        type = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
        kind = F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), "object").when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), "array")
        kind = kind.when(type.isin("STRING", "BOOLEAN"), F.lower(type)).when(type == "VOID", "null").otherwise("number")
        return F.struct(x["path"].alias("path"), kind.alias("kind"), v.alias("v"))

    def valued(x: Column) -> Column:
        value = F.when(~x["kind"].isin("object", "array"), F.try_variant_get(x["v"], "$", "string"))
        return F.struct(x["path"].alias("path"), x["kind"].alias("kind"), value.alias("value"))

    def opened(x: Column) -> Column:
        at = lambda step, v: F.struct(F.concat(x["path"], step).alias("path"), v.alias("v"))
        members = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: at(F.concat(F.lit("."), e["key"]), e["value"]))
        elements = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda e, k: at(F.concat(F.lit("["), k.cast("string"), F.lit("]")), e))
        return F.coalesce(members, elements)

    root = F.array(F.struct(F.lit("$").alias("path"), F.col("__v").alias("v")))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("invalid").alias("kind"), none.alias("value")))
    rows = parsed.select(*keys, F.when(F.col("__v").isNull(), broken).otherwise(F.slice(broken, 1, 0)).alias("__found"), F.when(F.col("__v").isNotNull(), root).alias("__open"))
    for _ in range(rounds):
        inner = F.flatten(F.filter(F.transform("__open", opened), lambda x: x.isNotNull()))
        rows = rows.select(*keys, F.concat("__found", F.coalesce(F.transform(F.transform("__open", told), valued), F.slice(broken, 1, 0))).alias("__found"), inner.alias("__open"))
    whole = F.when(F.coalesce(F.size("__open"), F.lit(0)) > 0, F.raise_error(F.lit("a JSON text has more levels than were counted"))).otherwise(F.col("__found"))
    return rows.select(*keys, F.inline(whole))


def first_seen_rank(df: DataFrame, keys: Keys, order: str, value: str, most: int = 6, name: str = "level") -> DataFrame:
    """A row for each value with its rank by first appearance, at most ``most``."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("__first"))
    return first.withColumn(name, F.least(F.row_number().over(_window(keys, ["__first"])), F.lit(most))).drop("__first")


# Page edges


def edges(df: DataFrame, keys: Keys, order: str, line: str, name: str = "edge") -> DataFrame:
    """The first and last lines of each page that are not blank: a row each, or one where they are the same row."""
    filled = df.filter(X.trim_white(F.col(line)) != "")
    ends = filled.groupBy(*keys).agg(F.min_by(line, order).alias("a"), F.min(order).alias("__a"), F.max_by(line, order).alias("b"), F.max(order).alias("__b"))
    both = F.array(F.struct(F.col("__a").alias(order), F.col("a").alias(line), F.lit("first").alias(name)), F.struct(F.col("__b").alias(order), F.col("b").alias(line), F.lit("last").alias(name)))
    return ends.select(*keys, F.inline(both))


def repeated_edges(df: DataFrame, document: Keys, page: str, order: str, line: str, longest: int = 80, least: int = 3, tenths: int = 6) -> DataFrame:
    """Edge lines (without case and numbers) that most pages of a document share: ``document, repeat_key, n_pages``."""
    some = edges(df, [*document, page], order, line).filter(F.length(X.trim_white(F.col(line))) <= longest)
    keyed = some.select(*document, page, X.repeat_key(F.col(line)).alias("repeat_key")).filter("repeat_key <> ''").distinct()
    counted = keyed.groupBy(*document, "repeat_key").agg(F.count(F.lit(1)).alias("n_pages"))
    pages = df.groupBy(*document).agg(F.countDistinct(page).alias("__pages")).filter(F.col("__pages") >= least)
    enough = F.greatest(F.floor(F.col("__pages") * tenths / 10), F.lit(least))
    return counted.join(pages, list(document)).filter(F.col("n_pages") >= enough).drop("__pages")


def strip_repeated_edges(df: DataFrame, document: Keys, page: str, order: str, line: str, **how) -> DataFrame:
    """``df`` without edge lines that most pages share: the rows stay, their lines are emptied."""
    repeated = repeated_edges(df, document, page, order, line, **how).select(*document, "repeat_key")
    at = edges(df, [*document, page], order, line).withColumn("repeat_key", X.repeat_key(F.col(line)))
    drop = at.join(repeated, [*document, "repeat_key"], "left_semi").select(*document, page, order).distinct().withColumn("__drop", F.lit(True))
    return df.join(drop, [*document, page, order], "left").withColumn(line, F.when(F.col("__drop"), "").otherwise(F.col(line))).drop("__drop")


def table_blocks(df: DataFrame, keys: Keys, order: str, line: str) -> DataFrame:
    """Lines with their pipe tables put right: ``keys, order, part, line``.

    Rows that follow each other, or are one blank line apart, are a table. A first row with a single filled cell before
    one with several is a title and moves out; a table without a separator gets one after its header.
    """
    w = _window(keys, [order])
    rows = df.select(*keys, order, line, X.table_cells(F.col(line)).alias("__c"))
    bridge = F.col("__c").isNull() & (X.trim_white(F.col(line)) == "") & F.lag("__c").over(w).isNotNull() & F.lead("__c").over(w).isNotNull()
    rows = runs(rows.withColumn("__t", F.col("__c").isNotNull() | bridge), keys, [order], F.col("__t"), "__run")
    rows = rows.filter(~F.col("__t") | F.col("__c").isNotNull())
    within = _window([*keys, "__run"], [order])
    filled = lambda c: F.size(F.filter(c, lambda x: x != ""))
    rows = rows.withColumns({"__k": F.row_number().over(within), "__next": F.lead("__c").over(within)})
    title = (F.col("__k") == 1) & (F.size("__c") > 1) & (filled(F.col("__c")) == 1) & F.col("__next").isNotNull() & ~X.is_separator_row(F.col("__next")) & (filled(F.col("__next")) > 1)
    rows = rows.withColumn("__title", F.coalesce(title, F.lit(False)))
    header = ~F.col("__title") & ((F.col("__k") == 1) | F.lag("__title", 1, False).over(within))
    bare = header & (F.col("__next").isNull() | ~X.is_separator_row(F.col("__next")))
    shown = F.when(F.col("__c").isNull(), F.array(F.col(line)))
    shown = shown.when(F.col("__title"), F.array(F.concat(F.lit("## "), F.array_join("__c", "")), F.lit("")))
    shown = shown.when(bare, F.array(X.pipe_row(F.col("__c")), X.separator_row(F.size("__c"), "row"))).otherwise(F.array(X.pipe_row(F.col("__c"))))
    return rows.withColumn("__lines", shown).select(*keys, order, F.posexplode("__lines").alias("part", line))


# Grids, keys and lookups


#: Columns of a grid: what spreadsheets allow.
MOST_COLUMNS = 16_384


def densify(cells: DataFrame, rows: str, columns: str, value: str, empty: str = "", most: int = MOST_COLUMNS) -> DataFrame:
    """All pairs of a row and a column that occur, missing cells filled: a grid's cells, whose number is its size.

    Column names are counted before they go to all rows; more than ``most`` are an error, and are no grid.
    """
    every = cells.groupBy(rows).agg(F.lit(1).alias("__one")).drop("__one")
    names = [r[0] for r in cells.select(columns).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"a grid of more than {most} columns")
    kind = cells.schema[columns].dataType.simpleString()
    listed = cells.sparkSession.createDataFrame([(names,)], f"`{columns}` array<{kind}>")
    full = every.join(F.broadcast(listed)).select(rows, F.explode(columns).alias(columns))
    return full.join(cells, [rows, columns], "left").withColumn(value, F.coalesce(value, F.lit(empty)))


def key_union(df: DataFrame, keys: Keys, order: str, names: str) -> DataFrame:
    """Names in arrays, each once, in the order of first appearance: ``keys, key, position``."""
    each = df.select(*keys, order, F.posexplode(names).alias("__p", "key"))
    first = each.groupBy(*keys, "key").agg(F.min(F.struct(order, "__p")).alias("__first"))
    return first.withColumn("position", F.row_number().over(_window(keys, ["__first"]))).drop("__first")


def majority_tables(df: DataFrame, keys: Keys, cells: str) -> DataFrame:
    """Whether a block is a table: two rows at least, of which more than half have two filled cells."""
    wide = F.size(F.filter(cells, lambda c: c != "")) >= 2
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wide).alias("n_wide"))
    return counted.withColumn("is_table", (F.col("n_rows") >= 2) & (F.col("n_wide") * 2 > F.col("n_rows")))


def chunk(df: DataFrame, keys: Keys, position: str, n: Column, value: str) -> DataFrame:
    """Cells in order as rows of n: ``keys, row, cells``."""
    placed = df.withColumn("__row", F.floor(F.col(position) / n))
    ordered = F.array_sort(F.collect_list(F.struct(position, value)))
    return placed.groupBy(*keys, "__row").agg(F.transform(ordered, lambda x: x[value]).alias("cells")).withColumnRenamed("__row", "row")


def first_match(left: DataFrame, right: DataFrame, on: str, order: str, how: str = "inner") -> DataFrame:
    """A lookup in which of several right rows the first by ``order`` counts."""
    columns = [c for c in right.columns if c not in (on, order)]
    first = right.groupBy(on).agg(F.min_by(F.struct(*columns), order).alias("__r"))
    return left.join(first, on, how).select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in columns])


#: Lengths of prefixes in a table of rules, each of which makes a row's lookups one more.
MOST_LENGTHS = 64


def first_prefix(df: DataFrame, keys: Keys, data: str, rules: DataFrame, name: str = "format", least: int = 0) -> DataFrame:
    """``keys`` and ``name``: of the rules that bytes begin with, the value of the one with the least ``priority``; null where there is none.

    ``rules`` has ``prefix, more_at, more, priority, value``; with ``more``, these bytes have to be at ``more_at`` as well. A row is looked up
    once for each length of a prefix that occurs (``MOST_LENGTHS`` at most), by equality, so rules may be as many as they like; only the
    first bytes of a row are sent. Data with fewer than ``least`` bytes has no value. ``keys`` tell rows apart.
    """
    lengths = [r[0] for r in rules.select(F.length("prefix")).distinct().limit(MOST_LENGTHS + 1).collect() if r[0]]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"prefixes of more than {MOST_LENGTHS} lengths")
    reach = rules.agg(F.max(F.greatest(F.length("prefix"), F.coalesce(F.col("more_at") + F.length("more") - 1, F.lit(0))))).first()[0] or 0
    heads = df.select(F.struct(*keys).alias("__k"), F.substring(F.when(F.length(data) >= least, F.col(data)), 1, int(reach)).alias("__head"))
    fitting = F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("__head"))
    each = heads.select("__k", "__head", F.explode_outer(fitting).alias("__n")).withColumn("__prefix", F.when(F.col("__n").isNotNull(), F.substr("__head", F.lit(1), F.coalesce("__n", F.lit(0)))))
    told = rules.select(F.col("prefix").alias("__rule"), F.col("more_at").alias("__at"), F.col("more").alias("__more"), F.col("priority").alias("__first"), F.col("value").alias("__value"))
    joined = each.join(told, F.col("__prefix") == F.col("__rule"), "left")
    fits = F.col("__more").isNull() | (F.substr("__head", F.coalesce("__at", F.lit(1)), F.coalesce(F.length("__more"), F.lit(0))) == F.col("__more"))
    best = joined.groupBy("__k").agg(F.min_by(F.when(fits, F.col("__value")), F.when(fits, F.col("__first"))).alias(name))
    return best.select(*[F.col("__k")[k].alias(k) for k in keys], name)


def key_values(df: DataFrame, keys: Keys, names: Sequence[str]) -> DataFrame:
    """Columns as rows ``key, value, position``, as scalars of an object are shown."""
    pairs = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("key"), X.primitive_label(F.col(n)).alias("value")) for k, n in enumerate(names, 1)])
    return df.select(*keys, F.inline(pairs))


def archive_totals(df: DataFrame, keys: Keys, size: str, packed: str) -> DataFrame:
    """Entries, sizes and the share saved, of archives."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entries"), F.sum(size).alias("total_size"), F.sum(packed).alias("total_packed"))
    share = F.bround((1 - F.col("total_packed") / F.col("total_size")) * 100, 1).cast("decimal(20,1)").cast("string")
    return out.withColumns({"size_label": X.size_label(F.col("total_size")), "ratio": F.when(F.col("total_size") > 0, F.concat(share, F.lit("%"))).otherwise("N/A")})


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """A row for each column: its place, name and type, and the number of rows."""
    columns = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type")) for k, f in enumerate(df.schema, 1)])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.inline(columns))


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 10) -> DataFrame:
    """The first n rows in order, each with its place."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("position", F.row_number().over(W.orderBy(*order)))


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> Column:
    """Rows of a pipe table as text."""
    return X.pipe_row(F.array(*[X.escape_pipe(X.primitive_label(F.col(c))) for c in columns]))
