"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts may be long, so batches are kept short.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``. Only where that is unset and driver and executors are one process,
    as in tests, a temporary folder of this machine stands in, and the setting is filled with it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        try:
            spark.conf.set("spark.checkpoint.dir", found)
        except Exception:  # a core setting of a running session: keep it on the session object instead
            found = getattr(spark, "_quill_shared", found)
            spark._quill_shared = found
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quill-{tag}-{uuid.uuid4().hex}"


def _kept(spark: SparkSession) -> dict[str, list]:
    if not hasattr(spark, "_quill_kept"):
        spark._quill_kept = {"frames": [], "paths": [], "tables": []}
    return spark._quill_kept


def clear(spark: SparkSession) -> None:
    """Drop what operators of this session have held and written on the way, and the names of index tables.

    For when their results have been written or are no longer needed: a result that is read later needs them. The files
    of ledgers and indexes stay.
    """
    kept = _kept(spark)
    for df in kept["frames"]:
        df.unpersist()
    for path in kept["paths"]:
        fs, at = _files(spark, path)
        fs.delete(at, True)
    for name in kept["tables"]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for some in kept.values():
        some.clear()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and no executor's loss loses it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    _kept(spark)["paths"].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, made: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Write what ``made`` gives and read it back; all that was held and written on the way to it is let go of."""
    kept = _kept(spark)
    before = {k: len(v) for k, v in kept.items()}
    out = materialize(made(), tag)
    for df in kept["frames"][before["frames"] :]:
        df.unpersist()
    for path in kept["paths"][before["paths"] : -1]:
        fs, at = _files(spark, path)
        fs.delete(at, True)
    for name in kept["tables"][before["tables"] :]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    del kept["frames"][before["frames"] :], kept["paths"][before["paths"] : -1], kept["tables"][before["tables"] :]
    return out


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Let go of what is held within, and of its shuffle files, when what it was for has been written."""
    frames = _kept(spark)["frames"]
    before = len(frames)
    yield
    for df in frames[before:]:
        df.unpersist(True)
    del frames[before:]
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Collect the driver's garbage now: Spark deletes the files of shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hold(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """Keep ``df`` on the executors' disks for the reads that follow; what a lost executor held is computed again.

    For results that depend on their input alone and whose lineage is short: others are to be materialized. Rows are
    packed ``rows`` at a time, so that a pack of long texts fits in memory.
    """
    name = "spark.sql.inMemoryColumnarStorage.batchSize"
    conf = df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, str(rows))
    try:
        held = df.persist(StorageLevel.DISK_ONLY)
    finally:
        conf.set(name, before)
    _kept(df.sparkSession)["frames"].append(held)
    return held


def apart(column, binary: bool = False):
    """A whole-number or binary key in a form that Spark does not recognise as what the rows are already dealt by.

    A join on it deals out both sides anew. Without that, a side that was just aggregated by the key is joined where it
    lies, and Spark cannot split the partition of a hot key on the other side.
    """
    return F.concat(column, F.lit(b"")) if binary else F.bitwise_not(F.bitwise_not(column))


def tune(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Short Arrow batches, so that a batch of long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_hash(doc, text_col: str = "text"):
    """With its doc_id, this tells a row's text from all others."""
    return F.xxhash64(whole_text(text_col), doc.isNull())


#: Rows of keys that are sent to all executors, at about 40 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def part(rows: DataFrame, keys: DataFrame, how: str, on: list[str], most: int | None = None) -> DataFrame:
    """The rows that have one of ``keys`` (``left_semi``) or none (``left_anti``); keys are counted, and broadcast only if few.

    ``rows`` may hold whole texts: where the keys are few, no text is shuffled. Keys are compared as they are, so nulls
    are to be replaced before.
    """
    keys = hold(keys.select(*on).distinct())
    few = keys.count() <= (BROADCAST_ROWS if most is None else most)
    return rows.join(F.broadcast(keys) if few else keys.hint("merge"), on, how)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """What a small file in the shared folder holds, or None where there is none."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file under another name and rename it, so that it is there whole or not at all."""
    fs, at = _files(spark, path)
    half = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(half)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if not fs.rename(half, at):
        fs.delete(half, False)


@contextlib.contextmanager
def alone(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold the right to write to the table at ``path``: a second writer is refused as long as the first is at it."""
    name = f"{path}/_writing"
    fs, at = _files(spark, name)
    if not fs.createNewFile(at):
        raise RuntimeError(f"another writer is at {path}; if it broke off, delete {name}")
    try:
        yield
    finally:
        fs.delete(at, False)


def boxed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that an operator's own columns clash with none of theirs; see ``unboxed``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("row.*")
