"""Exact deduplication through a persistent digest index, by DataFrame operations only.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Of equal texts the row with
the most code points in the original text stays, then the one with the smallest doc_id.

The index is a Parquet table ``(digest, keep_id, copies, keep_at, batch)``, bucketed and sorted by ``digest``, with the number of the row that stays and its batch. New data are
summed up to one row a digest before they are shuffled (a group of copies costs one row for each task), deduplicated
against the index by a sort-merge anti-join that reads the index without an exchange, and appended.

One writer at a time adds to an index; a second one is refused.

Defined results: a null text counts as empty, and all texts without other characters are equal; a null doc_id sorts
behind all others; of repeated rows exactly one stays, however many there are; an empty table gives no rows; extra columns are ignored.
Rows of an earlier batch are never displaced: a later copy, however long, is a duplicate of what the index holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._common import _kept, alone, apart, boxed, hold, materialize, new_path, part, row_hash, unboxed, whole_text

#: Rows of a batch for each bucket of an index that is made for it, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 32

#: The beginning of the name of a file in an index that tells its number of buckets; Spark's readers pass over it.
BUCKETS_FILE = "_buckets-"

SCHEMA = "digest binary, keep_id long, copies long, keep_at long, batch string"


def normalised(text):
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def digest_of(text_col: str = "text"):
    return F.unhex(F.sha2(normalised(whole_text(text_col)).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, th, digest, n_chars, at)`` for each row, written: no text is shuffled, and a row's number is fixed."""
    doc = F.col(id_col).cast("long")
    slim = docs.select(doc.alias("doc_id"), row_hash(doc, text_col).alias("th"), digest_of(text_col).alias("digest"), F.char_length(whole_text(text_col)).alias("n_chars"), F.monotonically_increasing_id().alias("at"))
    return materialize(slim, "digested")


class DigestIndex:
    """A digest index in a bucketed table; ``path`` names where its files lie, an existing index there is opened.

    The number of buckets is kept with the files, by the name of an empty one, and an existing index is opened with it;
    another number is refused. An index without that file is opened with the number that it was made with, if given.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digests")
        self.buckets = buckets = self._buckets(buckets)
        self.name = f"quill_digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        _kept(spark)["tables"].append(self.name)

    def _buckets(self, given: int | None) -> int:
        """The number of buckets of the index at ``path``, where it is kept from now on; ``given`` or the least for a new one."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        kept = [int(x.removeprefix(BUCKETS_FILE)) for x in names if x.startswith(BUCKETS_FILE)]
        if kept:
            if given not in (None, kept[0]):
                raise ValueError(f"the digest index at {self.path} has {kept[0]} buckets, not {given}")
            return kept[0]
        if any(x.startswith("part-") for x in names):
            if given is None:
                raise ValueError(f"the digest index at {self.path} does not tell its number of buckets: give the one it was made with")
            bucket = F.regexp_extract(F.input_file_name(), r"_(\d+)\.c\d+[^/]*$", 1).cast("int")
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
            if rows.filter(~bucket.eqNullSafe(F.pmod(F.hash("digest"), F.lit(given)))).limit(1).count():
                raise ValueError(f"the digest index at {self.path} was not made with {given} buckets")
        fs.createNewFile(jvm.org.apache.hadoop.fs.Path(top, f"{BUCKETS_FILE}{given or LEAST_BUCKETS}"))
        return given or LEAST_BUCKETS

    @classmethod
    def made_for(cls, digested: DataFrame) -> DigestIndex:
        """A new index with as many buckets as a batch of this size asks for."""
        return cls(digested.sparkSession, buckets=max(LEAST_BUCKETS, digested.count() // BUCKET_ROWS))

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, digested: DataFrame) -> str:
        """Append the digests that are new; what ``digested`` holds is ``digests()`` of a batch. Returns its name."""
        name = uuid.uuid4().hex
        best = F.max(F.struct("n_chars", F.bitwise_not(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("low"), F.bitwise_not("at").alias("at"), F.col("doc_id").alias("doc_id")))
        batch = digested.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
        with alone(self.spark, self.path):
            new = batch.hint("merge").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
            rows = new.select("digest", F.col("best.doc_id").alias("keep_id"), "copies", F.bitwise_not("best.at").alias("keep_at"), F.lit(name).alias("batch"))
            rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        return name

    def look_up(self, digested: DataFrame) -> DataFrame:
        """What the index holds of the digests of a batch: the index is read without an exchange, one row a digest comes."""
        batch = digested.groupBy("digest").agg(F.count(F.lit(1)).alias("here")).select("digest")
        return hold(batch.hint("merge").join(self.table().select("digest", "keep_id", "copies", "keep_at", "batch").hint("merge"), "digest"))


def _judged(rows: DataFrame, index: DigestIndex, name: str) -> DataFrame:
    """``rows`` with what the index holds of their digests, and ``kept``.

    Both sides are dealt out by a form of the digest that Spark does not know to be how one of them lies already, so
    that it can split the rows of a hot digest.
    """
    held = index.look_up(rows).select(apart("digest", True).alias("key"), "keep_id", "copies", "keep_at", "batch")
    kept = (F.col("keep_at") == F.col("at")) & (F.col("batch") == name)
    return rows.withColumn("key", apart("digest", True)).hint("merge").join(held.hint("merge"), "key").withColumn("kept", kept)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row, after adding the batch to the index.

    ``group_size`` counts the rows of the batch that first brought the text. ``kept`` marks rows of this batch.
    """
    rows = digests(docs, id_col, text_col)
    index = index or DigestIndex.made_for(rows)
    judged = _judged(rows, index, index.add(rows))
    return judged.select("doc_id", "keep_id", F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    What is decided on narrow rows comes back to the texts as the list of rows to drop, by doc_id and text: while that
    list is short enough to be broadcast, no text is shuffled. Rows alike in both are summed up to one.
    """
    rows = digests(docs, id_col, text_col)
    index = index or DigestIndex.made_for(rows)
    judged = _judged(rows, index, index.add(rows))
    judged = judged.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("th").alias("__th"), "kept")
    seen = hold(judged.groupBy("__id", "__th").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    doc = F.col(f"row.`{id_col}`").cast("long")
    texts = boxed(docs).withColumns({"__id": F.coalesce(doc, F.lit(0)), "__th": row_hash(doc, f"row.`{text_col}`")})
    repeated = seen.filter("kept and n > 1")
    once = part(texts, seen.filter("not kept").unionByName(repeated), "left_anti", ["__id", "__th"])
    if repeated.isEmpty():
        return unboxed(once)
    one = part(texts, repeated, "left_semi", ["__id", "__th"]).groupBy("__id", "__th").agg(F.first("row").alias("row"))
    return unboxed(once.select("row").unionByName(one.select("row")))
