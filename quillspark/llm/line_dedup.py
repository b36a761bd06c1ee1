"""Line deduplication: lines that many documents share go, except where they stay by rule.

A text is split at ``\\n``. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Keys
of at least ``min_chars`` code points are exploded as 128-bit hashes and counted by distinct documents: first a row for
each hash and document, dealt out by both, then sums by hash, so that a line in a third of all documents costs one row a
task. Keys in at least ``min_documents`` documents lose all their lines except in the document with the largest id that
holds them. The lines that go are joined as (document, position), an uneven join that Spark may split; each text is
shuffled once, to meet its list of positions, and put together from the positions that are left. Only built-in functions.

Defined results: a null text is one empty line, and stays null where nothing is dropped; rows of one doc_id are one
document; a null doc_id is a document of its own, smaller than all others; repeated rows stay repeated, each without the
same lines; of a text that loses all its lines the empty text stays; an empty table gives no rows; other columns come along.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import apart, boxed, hold, row_hash, whole_text

MIN_CHARS, MIN_DOCUMENTS = 20, 3
_BLANKS = " \t\n\x0b\f\r"


def line_key(line):
    """What tells equal lines: stripped, and A-Z lower-cased; letters beyond ASCII stay as they are."""
    stripped = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, string.ascii_uppercase, string.ascii_lowercase))


def _hashed(key):
    return F.substring(F.unhex(F.sha2(key.cast("binary"), 256)), 1, 16)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, th, pos, hash)`` for each line whose key is long enough; ``th`` tells texts of one document apart."""
    doc = F.col(id_col).cast("long")
    texts = docs.select(doc.alias("doc"), row_hash(doc, text_col).alias("th"), F.split(whole_text(text_col), "\n", -1).alias("lines"))  # hashed once a text, not once a line
    lines = texts.select("doc", "th", F.posexplode("lines").alias("pos", "line"))
    keys = lines.filter(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return keys.filter(F.char_length("key") >= min_chars).select("doc", "th", "pos", _hashed(F.col("key")).alias("hash"))


def repeated_lines(hashes: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(hash, documents, keeper)`` of each key in enough documents; ``keeper`` is the largest doc_id that holds it."""
    each = hashes.groupBy("hash", "doc").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("documents"), F.max("doc").alias("keeper")).filter(F.col("documents") >= min_documents)


def dropped_lines(hashes: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(doc, th, gone)``: for each text that loses lines the positions of these, from 0, in no order."""
    keys = repeated_lines(hashes, min_documents).select(apart("hash", True).alias("key"), "keeper")
    lines = hashes.withColumn("key", apart("hash", True)).hint("merge").join(keys.hint("merge"), "key")
    lost = lines.filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))


def deduplicated(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, kept_text, n_lines, n_dropped)`` for each row of ``docs``; ``row`` has all its columns."""
    hashes = hold(line_hashes(docs, min_chars, id_col, text_col), 8192)
    gone = dropped_lines(hashes, min_documents)
    gone = gone.select(apart(F.coalesce("doc", F.lit(0))).alias("__id"), F.col("th").alias("__th"), "gone")
    doc = F.col(f"row.`{id_col}`").cast("long")
    rows = boxed(docs).withColumns({"__id": apart(F.coalesce(doc, F.lit(0))), "__th": row_hash(doc, f"row.`{text_col}`")})
    met = rows.hint("merge").join(gone.hint("merge"), ["__id", "__th"], "left")
    split = met.select("row", "gone", F.split(whole_text(f"row.`{text_col}`"), "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(F.transform(left, lambda k: F.col("lines")[k]), "\n"))
    return split.select("row", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def without_repeated_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns and the lines that repeat taken out of its texts."""
    made = deduplicated(docs, min_documents, min_chars, id_col, text_col)
    return made.select(*[F.col("kept_text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
