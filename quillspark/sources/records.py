"""Records of delimited files that are read in byte ranges, by expressions and windows alone.

A file is cut wherever its byte ranges end, also within a quoted field that holds line ends. What a line does to a reader has
two cases: it began outside of quotes, or inside. So each line is a transition of two states, and transitions
compose: those that forget where they began decide, and after them only the number of those that turn the state counts. Lines are
composed within runs of at most 65,536 lines of a range by running sums and a last value, runs of a file in the same way, a row
each; then the state at each line is known, and with it where records begin. What a task reads is dealt out by runs, so that it does
not hang on how long the byte ranges are and how many of them meet in a task.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as X

_RUN = 16  # bits of a line's number within its run
QUOTED = '"[^"]*+(?:""[^"]*+)*+'


def _patterns(delimiter: str) -> tuple[str, str, str]:
    """Lines that end outside of quotes, begun outside and begun inside, and a cell with the delimiter before it."""
    d = re.escape(delimiter)
    field = rf'(?:{QUOTED}"[^{d}]*+|(?!")[^{d}]*+)'
    rest = rf"(?:{field}(?:{d}|\z))*+\z"
    return rf"\A{rest}", rf'\A{QUOTED[1:]}"[^{d}]*+(?:{d}|\z){rest}', rf'{d}(?:{QUOTED}"?[^{d}]*+|(?!")[^{d}]*+)'


def _composed(df: DataFrame, within, zero: Column, one: Column) -> DataFrame:
    """``df`` with ``__zero`` and ``__one``, the states after all rows of ``within`` for both states before them."""
    df = df.withColumn("__turns", F.coalesce(F.sum((zero & ~one).cast("long")).over(within), F.lit(0)))  # of zero into one and of one into zero
    df = df.withColumn("__fixed", F.last(F.when(zero == one, F.struct(zero.alias("state"), F.col("__turns").alias("turns"))), ignorenulls=True).over(within))
    turned = F.pmod(F.col("__turns") - F.coalesce("__fixed.turns", F.lit(0)), F.lit(2)) == 1
    state = lambda s: F.coalesce("__fixed.state", F.lit(s)) != turned
    return df.withColumns({"__zero": state(False), "__one": state(True)}).drop("__turns", "__fixed")


def csv_records(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """``path, block, record, cells`` of every record in files of quoted text.

    A record is known by the byte range in which it begins (the offset of that range) and its number there, which order the records of a
    file. Fields are quoted by ``"``, doubled within; a quote elsewhere in a field is itself. Records end with ``\\n`` or
    ``\\r\\n`` outside of quotes; empty ones are left out, and so is a byte order mark. What follows a quote that is never closed is one
    field. Texts are shuffled once, by runs of lines; only the records that lie across a cut, one a run, are sent again. What a
    run holds stays on disk until the cache is cleared. An empty file has no records. Compressed files are one range each.
    """
    if len(delimiter) != 1 or delimiter in '"\r\n':
        raise ValueError(f"no delimiter: {delimiter!r}")
    outside, inside, _ = _patterns(delimiter)
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    quoted = F.contains("line", F.lit('"'))
    lines = lines.withColumns({"__a": quoted & ~F.col("line").rlike(outside), "__b": ~(quoted & F.col("line").rlike(inside))})
    run = ["path", "block", "run"]
    lines = lines.withColumn("run", F.shiftright("n", _RUN))
    up_to = W.partitionBy(*run).orderBy("n")
    lines = _composed(lines, up_to.rowsBetween(W.unboundedPreceding, 0), F.col("__a"), F.col("__b")).drop("__a", "__b")
    # Whether a record begins at a line, for both states before its run.
    lines = lines.withColumns({"__z": ~F.lag("__zero", 1, False).over(up_to), "__o": ~F.lag("__one", 1, True).over(up_to)})
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    runs = lines.groupBy(*run).agg(F.max_by(F.struct("__zero", "__one"), "n").alias("x"), count("__z"), count("__o")).select(*run, F.col("x.__zero").alias("__a"), F.col("x.__one").alias("__b"), "__z", "__o")
    in_file = W.partitionBy("path").orderBy("block", "run")
    begins = _composed(runs, in_file.rowsBetween(W.unboundedPreceding, -1), F.col("__a"), F.col("__b")).withColumnRenamed("__zero", "__begun")
    in_range = W.partitionBy("path", "block").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.when(F.col("__begun"), F.col("__o")).otherwise(F.col("__z"))).over(in_range), F.lit(0))
    begins = begins.select(*run, "__begun", earlier.alias("__earlier"))
    # Co-partitioned with the lines, which are not sent again.
    told = lines.join(begins.hint("merge"), run)
    first = F.when(F.col("__begun"), F.col("__o")).otherwise(F.col("__z"))
    told = told.withColumn("__open", F.when(F.col("__begun"), F.col("__one")).otherwise(F.col("__zero")))
    told = told.withColumn("__own", F.sum(first.cast("long")).over(up_to.rowsBetween(W.unboundedPreceding, 0)))
    told = told.select(*run, "__own", (F.col("__own") + F.col("__earlier")).alias("record"), "n", "line", "__open")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    pieces = told.groupBy(*run, "__own").agg(text.alias("text"), F.max("record").alias("record"), F.max_by("__open", "n").alias("__open")).persist(StorageLevel.DISK_ONLY)
    cut = (F.col("__own") == 0) | F.col("__open")  # begun before its run, or not ended within it
    whole = pieces.filter(~cut).select("path", "block", "record", "text")
    # Of a run there are at most two such pieces; a record is one that begins, and all that follow it up to the next beginning.
    start = F.last(F.when(F.col("__own") > 0, F.struct("block", "record")), ignorenulls=True).over(W.partitionBy("path").orderBy("block", "run", "__own").rowsBetween(W.unboundedPreceding, 0))
    across = pieces.filter(cut).withColumn("__start", start)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "run", "text"))), lambda x: x["text"]), "\n")
    across = across.groupBy("path", "__start").agg(joined.alias("text")).select("path", F.col("__start.block").alias("block"), F.col("__start.record").alias("record"), "text")
    records = whole.unionByName(across)
    bare = F.when((F.col("block") == 0) & (F.col("record") == 1), F.regexp_replace("text", "\\A\ufeff", "")).otherwise(F.col("text"))
    records = records.withColumn("text", F.regexp_replace(bare, r"\r\z", "")).filter("text <> ''")
    return records.select("path", "block", "record", csv_cells(F.col("text"), delimiter).alias("cells"))


def csv_cells(record: Column, delimiter: str = ",") -> Column:
    """The fields of one record."""
    start = rf'\A{QUOTED}"?'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(_patterns(delimiter)[2]), F.lit(0))

    def value(cell: Column) -> Column:
        field = F.substr(cell, F.lit(2))
        inner = F.regexp_replace(F.regexp_extract(field, start, 0), r'\A"|"\z', "")
        open_end = F.regexp_extract(field, rf"\A{QUOTED}\z", 0) != ""  # never closed: a last quote is one of two
        inner = F.when(open_end, F.substr(field, F.lit(2))).otherwise(inner)
        return F.when(F.startswith(field, F.lit('"')), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), F.regexp_replace(field, start, ""))).otherwise(field)

    return F.transform(found, value)


def csv_rows(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """``path, block, record, header, cells`` of every record but the first of its file, which names the columns and gives the width."""
    records = csv_records(spark, path, delimiter)
    first = records.groupBy("path").agg(F.min(F.struct("block", "record", "cells")).alias("__h"))
    rows = records.join(first, "path").filter((F.col("block") != F.col("__h.block")) | (F.col("record") != F.col("__h.record")))
    header = F.col("__h.cells")
    return rows.select("path", "block", "record", header.alias("header"), X.fit_width(F.col("cells"), F.size(header)).alias("cells"))
