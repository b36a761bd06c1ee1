"""Where converted documents go: one text, or a file for each document."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATOR = "\n---\n\n"


def concatenated(df: DataFrame, order: str, text: str = "output", *keys: str) -> DataFrame:
    """All texts in order with a separator between them, for each value of ``keys``.

    A row holds all texts of its keys, and without keys all there are: for many there are ``concatenated_parts`` and ``write_concatenated``.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(text, F.lit("")).alias("__text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["__text"]), SEPARATOR).alias("document"))


def concatenated_parts(df: DataFrame, order: str, text: str = "output", *keys: str, part_bytes: int = 8 << 20, ranges: int | None = None) -> DataFrame:
    """``keys, part, start, document``: what ``concatenated`` gives, cut between texts into parts that follow each other.

    Where a text begins is a prefix sum of lengths in bytes: rows are dealt out by ranges of keys and ``order``, lengths are summed up by
    range, and these sums, a row for each key and range, give every range its start. So no task holds a key's texts, however many
    it has; a part holds the texts that begin within its ``part_bytes``. ``start`` is the byte at which a part begins. The
    dealt rows stay on disk until the cache is cleared.
    """
    named = df.select(F.struct(*keys).alias("__k") if keys else F.lit(0).alias("__k"), F.col(order).alias("__o"), F.coalesce(text, F.lit("")).alias("__t"))
    dealt = named.repartitionByRange(ranges, "__k", "__o") if ranges else named.repartitionByRange("__k", "__o")
    dealt = dealt.withColumns({"__p": F.spark_partition_id(), "__n": F.octet_length("__t") + len(SEPARATOR)}).persist(StorageLevel.DISK_ONLY)
    sums = dealt.groupBy("__k", "__p").agg(F.sum("__n").alias("__n"))
    base = sums.select(F.col("__k").alias("__bk"), F.col("__p").alias("__bp"), F.coalesce(F.sum("__n").over(W.partitionBy("__k").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    rows = dealt.join(base, (F.col("__p") == F.col("__bp")) & F.col("__k").eqNullSafe(F.col("__bk")))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__k", "__p").orderBy("__o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__at", F.col("__base") + before)  # of the text itself; its separator comes before it
    first = F.col("__at") == 0
    rows = rows.select("__k", "__o", F.when(first, 0).otherwise(F.col("__at") - len(SEPARATOR)).alias("__at"), F.when(first, F.col("__t")).otherwise(F.concat(F.lit(SEPARATOR), F.col("__t"))).alias("__t"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__t"))), lambda x: x["__t"]), "")
    parts = rows.groupBy("__k", F.floor(F.col("__at") / part_bytes).alias("part")).agg(F.min("__at").alias("start"), texts.alias("document"))
    return parts.select(*[F.col(f"__k.{k}").alias(k) for k in keys], "part", "start", "document")


def write_concatenated(df: DataFrame, folder: str, order: str, text: str = "output", parts: int | None = None) -> None:
    """All texts in order with a separator between them, as text files that follow each other by name.

    Texts are dealt out by ranges of ``order``, so that no task holds all of them. A line end follows each text.
    """
    first = df.agg(F.min(order).alias("first")).first()["first"]
    rest = F.when(~F.col(order).eqNullSafe(F.lit(first)), SEPARATOR[1:]).otherwise("")
    ordered = (df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)).sortWithinPartitions(order)
    ordered.select(F.concat(rest, F.coalesce(text, F.lit(""))).alias("value")).write.text(folder)


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver may leave files for each other: ``spark.checkpoint.dir``, which has to be set on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_csv(df: DataFrame, folder: str, delimiter: str = ",", header: bool = True) -> None:
    """Rows as files of quoted fields, each with its header, as ``csv_records`` reads them; nulls are empty."""
    fields = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    names = delimiter.join('"' + c.replace('"', '""') + '"' for c in df.columns)
    line = F.concat_ws(delimiter, *fields)
    # The first row of a task brings its file's header.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    df.select((F.when(first, F.concat(F.lit(names + "\n"), line)).otherwise(line) if header else line).alias("value")).write.text(folder)


def output_names(df: DataFrame, path: str = "path", ext: str = "ext") -> DataFrame:
    """``df`` with ``output_name``: the file name's stem, or "output", and the extension."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")
    return df.withColumn("output_name", F.concat(F.when(stem == "", "output").otherwise(stem), F.lit("."), F.col(ext)))


def write_files(df: DataFrame, folder: str, path: str = "path", order: str | None = None) -> None:
    """Write each converted document to a folder that all executors reach, by its output name.

    Of documents with the same name the last by ``order`` (the path if not given) is written. All files are moved into
    place when all have been written: a job that fails leaves none.
    """
    from quillspark.sources.files import register_files

    named = output_names(df.filter(F.col("error").isNull()), path)
    last = F.max(F.struct(F.col(order or path).alias("o"), "output", "output_data")).alias("x")
    rows = named.groupBy("output_name").agg(last).select("output_name", F.coalesce(F.col("x.output_data"), F.encode("x.output", "UTF-8")).alias("output_data"))
    register_files(df.sparkSession)
    rows.write.format("quill").mode("append").save(folder)
