"""Audit of how filters interact: what each of them removes in every order, as products of incidence matrices.

Five filters fail a document by conditions A to E, so a document is one of 32 masks. Documents are counted by part and
mask, three times: all of them, those that are labelled good and those labelled toxic. Such a histogram is a row of 32
numbers. What happens to a mask at each step of each order is known beforehand: four integer matrices of 32 rows and 600
columns (120 orders of five steps) tell whether it is kept after the step, removed there, fails there but went earlier,
or fails that filter alone. Histograms, stacked as rows, times these matrices are the audit. The products are made
where the histograms lie, some rows at a time, so parts may be many; only histograms are shuffled.

Masks come from built-in functions over whole texts. For E, equal texts are those of one SHA-256; a row passes if it has
the least doc_id of its text: minima by digest are joined back by digest and doc_id, so that copies of one text, however
many, lie in many tasks.

Defined results: a null text is empty; a null ``lang`` is the part of the empty string; a null doc_id is larger than all
others and has no label; rows that repeat count each (of one text and doc_id none is a copy of the other); of several labels
of one doc_id any that is 1 counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import apart, tune, whole_text

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
_LAST = 2**63 - 1


def matrices() -> dict[str, np.ndarray]:
    """The 32 x 600 matrices ``kept``, ``removed``, ``redundant`` and ``unique``; a column is five times its order plus its step."""
    masks = np.arange(MASKS)[:, None]
    bits = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    own = bits.reshape(1, -1)
    before = (np.cumsum(bits, axis=1) - bits).reshape(1, -1)  # the filters of earlier steps
    fails, gone = (masks & own) > 0, (masks & before) > 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": (masks == own)}
    return {name: m.astype(np.int64) for name, m in made.items()}


def same_filter() -> np.ndarray:
    """600 x 600: whether two columns are of one filter, at whatever step of whatever order."""
    which = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    return (which[:, None] == which[None, :]).astype(np.int64)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, doc_id, mask)`` for each row, bit k of the mask for failing filter k."""
    text = whole_text(text_col)
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.select("part", "doc_id", "text", words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    conditions = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.char_length("text"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions)), F.lit(0))
    rows = rows.select("part", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = least.select(apart("digest", True).alias("digest"), apart("doc_id").alias("doc_id"), F.lit(0).alias("copy"))
    keyed = rows.select("part", apart("digest", True).alias("digest"), apart("doc_id").alias("doc_id"), "mask")
    told = keyed.hint("merge").join(first.hint("merge"), ["digest", "doc_id"], "left")
    return told.select("part", "doc_id", (F.col("mask") + F.coalesce("copy", F.lit(1 << 4))).alias("mask"))


def histograms(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part and mask, and how many of these are labelled so."""
    known = labels.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("doc_id", "good", "toxic")
    known = known.groupBy("doc_id").agg(*[F.coalesce(F.max(c), F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")])
    known = known.select(F.when(F.col("doc_id") < _LAST, apart("doc_id")).alias("doc_id"), "good", "toxic")
    rows = failed.withColumn("doc_id", apart("doc_id")).hint("merge").join(known.hint("merge"), "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows for each part (part, masks, n, good, toxic: lists of the masks that occur and their counts)."""
    m, same = matrices(), same_filter()
    orders = pa.array([o for o in ORDERS for _ in range(STEPS)])
    steps = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
    for b in batches:
        for at in range(0, b.num_rows, 64):  # a block of parts: 64 x 600 rows
            part, masks, *counts = (c.to_pylist() for c in b.slice(at, 64).columns)
            stacked = np.zeros((3, len(part), MASKS), np.int64)
            for k, which in enumerate(masks):
                for h, c in zip(stacked, counts, strict=True):
                    h[k, which] = c[k]
            n, good, toxic = stacked
            removed = n @ m["removed"]
            columns = [n @ m["kept"], removed, n @ m["redundant"], n @ m["unique"], good @ m["removed"], toxic @ m["removed"], removed @ same]
            for k, name in enumerate(part):
                arrays = [pa.array([name] * len(orders), pa.string()), orders, steps, *(pa.array(c[k]) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step."""
    tune(docs.sparkSession)
    counted = histograms(failures(docs, id_col, text_col, part_col), labels)
    row = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # 32 at most
    stacked = counted.groupBy("part").agg(row.alias("h")).select("part", *[F.col(f"h.{c}").alias(c) for c in ("mask", "n", "good", "toxic")])
    return stacked.mapInArrow(products, AUDIT)
