"""Conversion of DataFrames of documents.

A document is a row with its bytes and, where there is one, its file name. Formats are found by expressions; parsing
runs in Python functions that see bytes and format alone; everything after that is expressions again. A document that
cannot be converted has an ``error`` and no output (PERMISSIVE), or ends the query (FAILFAST).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.blocks import BLOCK_TYPE, ConversionError
from quillspark.functions.detect import detect
from quillspark.plans import registry
from quillspark.plans.ship import ship

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])
BLOCKS = T.StructType([T.StructField("blocks", T.ArrayType(BLOCK_TYPE)), T.StructField("error", T.StringType())])


def _message(e: Exception) -> str:
    return str(e) if isinstance(e, ConversionError) else f"{type(e).__name__}: {e}"


def _convert_one(data: bytes | None, format: str | None) -> dict:
    if data is None or format is None:
        return {"text": None, "data": None, "error": "no data" if data is None else "format not detected"}
    try:
        out = registry.convert(data, format)
    except Exception as e:  # a broken document must not end the job
        return {"text": None, "data": None, "error": _message(e)}
    return {"text": out if isinstance(out, str) else None, "data": out if isinstance(out, bytes) else None, "error": None}


def _blocks_one(data: bytes | None, format: str | None) -> dict:
    if data is None or format is None:
        return {"blocks": None, "error": "no data" if data is None else "format not detected"}
    try:
        found = registry.blocks(data, format)
    except Exception as e:
        return {"blocks": None, "error": _message(e)}
    return {"blocks": [{"block_id": k, "kind": b.kind, "level": b.level, "ordered": b.ordered, "lang": b.lang, "text": b.text, "cells": b.cells, "md": b.md} for k, b in enumerate(found)], "error": None}


# Rows go to these functions a hundred at a time, and not by Arrow batches of up to 10,000: a worker holds the inputs and outputs of
# so many documents, however many there are.


@F.udf(RESULT, useArrow=False)
def _convert_udf(data: bytes | None, format: str | None) -> dict:
    return _convert_one(None if data is None else bytes(data), format)


@F.udf(BLOCKS, useArrow=False)
def _blocks_udf(data: bytes | None, format: str | None) -> dict:
    return _blocks_one(None if data is None else bytes(data), format)


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """Whole files: ``path, modificationTime, length, content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def route(df: DataFrame, content: str = "content", path: str | None = "path", format: str | None = None, to: str | None = None) -> DataFrame:
    """``df`` with ``format`` (found, or as told), ``target`` (the converter), ``ext`` and ``error``."""
    if format is not None:
        found: Column = F.lit(format)
    elif path is not None:
        found = detect(F.col(path), F.col(content))
    else:
        found = detect(F.lit(None).cast("string"), F.col(content))
    out = df.withColumn("format", found)
    error = F.when(F.col("format").isNull(), "format not detected")
    target = F.col("format")
    if to is not None:
        target = F.when(target == registry.MARKDOWN, registry.target_of(registry.MARKDOWN, to))
        error = error.when(F.col("format") != registry.MARKDOWN, "a target can be given for Markdown input only")
    extensions = F.create_map(*[F.lit(x) for name, w in registry.WRITERS.items() for x in (name, w.extension)])
    out = out.withColumn("target", target)
    return out.withColumns({"ext": F.coalesce(F.element_at(extensions, F.col("target")), F.lit("md")), "error": error})


def convert(df: DataFrame, content: str = "content", path: str | None = "path", format: str | None = None, to: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """``df`` without its content, with ``format, target, ext, output`` (text), ``output_data`` (bytes) and ``error``."""
    ship(df.sparkSession)
    routed = route(df, content, path, format, to).withColumn("__r", _convert_udf(F.when(F.col("error").isNull(), F.col(content).cast("binary")), "target"))
    error = F.coalesce("error", "__r.error")
    out = routed.withColumns({"output": F.col("__r.text"), "output_data": F.col("__r.data"), "error": error}).drop("__r", content)
    if mode.upper() == "FAILFAST":
        return out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("string"))
    if mode.upper() != "PERMISSIVE":
        raise ValueError(f"mode {mode}: PERMISSIVE or FAILFAST")
    return out


def document_blocks(df: DataFrame, content: str = "content", path: str | None = "path", format: str | None = None) -> DataFrame:
    """A row for each block of each document, after the columns of ``df`` without its content."""
    ship(df.sparkSession)
    routed = route(df, content, path, format).drop("target", "ext", "error")
    found = routed.withColumn("__b", _blocks_udf(F.col(content).cast("binary"), "format")).drop(content)
    kept = [c for c in found.columns if c != "__b"]
    return found.select(*kept, F.col("__b.error").alias("error"), F.inline_outer("__b.blocks"))


def render(blocks: DataFrame, *keys: str) -> DataFrame:
    """Markdown of the documents whose blocks these are: an ordered aggregate, without Python."""
    ordered = F.array_sort(F.collect_list(F.struct("block_id", "md")))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda b: b["md"]), "").alias("output"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its input is so small that it has fewer partitions than there are cores.

    Parsing is what takes time, so moving a few megabytes is worth it; larger inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@F.udtf(returnType=T.StructType([*BLOCK_TYPE.fields, T.StructField("error", T.StringType())]))
class DocumentBlocks:
    """The blocks of one document as rows; a document that cannot be read gives one row with its error."""

    def eval(self, content: bytes, format: str):
        found = _blocks_one(None if content is None else bytes(content), format)
        if found["error"] is not None:
            yield (*[None] * len(BLOCK_TYPE.fields), found["error"])
        for b in found["blocks"] or ():
            yield (*(b[f.name] for f in BLOCK_TYPE.fields), None)


def register_sql(spark: SparkSession) -> None:
    """For SQL: ``quill_convert(data, format)``, ``quill_blocks(data, format)``, and the table function ``blocks(data, format)``."""
    ship(spark)
    spark.udf.register("quill_convert", _convert_udf)
    spark.udf.register("quill_blocks", _blocks_udf)
    spark.udtf.register("blocks", DocumentBlocks)
