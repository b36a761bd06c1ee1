"""Ranked lexical search over a two-level quantised index.

The index is a table ``(segment, term, docs, bound, tf)``. A segment is a run of whole documents that one task read, about
``SEGMENT_BYTES`` of text; a term of a segment has the places of its documents there, and two levels: a byte for
each, its impact divided by ``STEP`` and rounded upward, and its exact number of occurrences. A row without a term has the
segment's doc_ids and numbers of terms. An impact is ``(10^9 tf) div (1000 tf + 12 m)``, where m grows with a
document's length relative to the mean; so corpus totals are counted first.

A search adds weights times bytes over an item's terms. That gives for each document of the segment an upper bound and,
a step less for each term, a lower bound of its score. Every document whose upper bound reaches the kth largest lower bound
of the documents that the task has met is scored anew with exact integers; that lower bound is never above the one of
the whole table, so no document of the result is missed, in one pass and with no threshold to be agreed upon by all tasks.
The best k of a task go on to the best k of all.

Items are dealt into blocks of ``BLOCK_TERMS`` terms. A term of a block brings its items' weights along, so postings meet items
by a join on the term: weights are broadcast while they are few, and else joined by a shuffle that Spark may split. What meets
in a task is a segment and a block, both bounded; a word in all documents has a row for each segment.

Defined results: a text that is null or has no term is found by no item, and an item without terms finds nothing; repeated
documents rank as rows of their own, a null doc_id after all others of its score; rows alike in item_id and text are one
item, others of one item_id are items of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import hold, materialize, tune, whole_text

#: Most an impact can be, and how much of it a byte's unit stands for: 255 of them are no less than the most.
MOST_IMPACT = 1_000_000
STEP = -(-MOST_IMPACT // 255)
#: Bytes of text in a segment (one longer document is a segment), and terms of a block of items.
SEGMENT_BYTES = 16 << 20
BLOCK_TERMS = 20_000
#: Bytes of terms and weights that are sent to all executors; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

#: What lies between terms; A-Z are then lower-cased.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: What becomes of a byte of text: A-Z are lower-cased, other ASCII characters that no term has are blanks.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_IS_TERM = np.frombuffer(_BYTES, np.uint8) != 32


def _buffer(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lengths(texts: pa.BinaryArray) -> np.ndarray:
    """The number of terms of each text."""
    data, offsets = _buffer(texts)
    inside = _IS_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begins[edge] = inside[edge]
    total = np.append(0, np.cumsum(begins, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def terms(texts: pa.BinaryArray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, in order, and the text of each."""
    data, offsets = _buffer(texts)
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes().translate(_BYTES))])
    words = pc.ascii_split_whitespace(clean)
    text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(words.offsets)))
    flat = words.flatten()
    full = pc.not_equal(flat, "")
    return flat.filter(full), text[full.to_numpy(zero_copy_only=False)]


def length_marks(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """m of each length: 75 and a quarter of a hundredth of the mean length; beyond 64 bits on the way by Python's integers."""
    if len(n) and 25 * int(n.max()) * total_docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * total_docs // total_terms for x in n], np.int64)
    return 75 + 25 * n * total_docs // max(1, total_terms)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and the number of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            if b.num_rows:
                found = lengths(b.column(0))
                n, total = n + int((found > 0).sum()), total + int(found.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    tune(docs.sparkSession)
    counted = docs.select(whole_text(text_col).cast("binary").alias("text")).mapInArrow(run, "n long, total long")
    row = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return row[0], row[1]


INDEX = "segment long, term string, docs binary, bound binary, tf binary"


def _segment(number: int, batches: list[pa.RecordBatch], total_docs: int, total_terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: its documents with terms, then the postings of each of its terms."""
    ids, ns, place, word, at = [], [], [], [], 0
    for b in batches:
        n = lengths(b.column(1))
        rows, found = terms(b.column(1)), n > 0
        if not found.any():
            continue
        ids.append(b.column(0).filter(pa.array(found)))
        ns.append(n[found])
        place.append((np.cumsum(found) - 1)[rows[1]] + at)
        word.append(rows[0])
        at += len(ns[-1])
    if not ids:
        return
    ids, n, place = pa.chunked_array(ids, pa.int64()), np.concatenate(ns), np.concatenate(place)
    coded = pa.chunked_array(word).combine_chunks().dictionary_encode()
    code, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    pair, tf = np.unique(code * at + place, return_counts=True)
    code, place = pair // at, pair % at
    bound = -(-impacts(tf, length_marks(n, total_docs, total_terms)[place]) // STEP)
    starts = np.searchsorted(code, np.arange(len(names) + 1)).astype(np.int64)

    def packed(values: np.ndarray, kind, starts=starts) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * np.dtype(kind).itemsize), pa.py_buffer(values.astype(kind).tobytes())]).cast(pa.binary())

    none = ids.is_null().combine_chunks().to_numpy(zero_copy_only=False)
    whole = np.array([0, at])
    head = [pa.array([number]), pa.array([None], pa.string()), packed(ids.fill_null(0).combine_chunks().to_numpy(), np.int64, whole), packed(none, np.uint8, whole), packed(n, np.int64, whole)]
    yield pa.RecordBatch.from_arrays(head, ["segment", "term", "docs", "bound", "tf"])
    rows = [pa.array(np.full(len(names), number)), names.cast(pa.string()), packed(place, np.int32), packed(bound, np.uint8), packed(tf, np.int32)]
    yield from pa.Table.from_arrays(rows, ["segment", "term", "docs", "bound", "tf"]).to_batches(max_chunksize=8192)


class Index:
    """The index of all rows of a table, written to the shared folder."""

    def __init__(self, rows: DataFrame, total_docs: int, total_terms: int):
        self.rows, self.total_docs, self.total_terms = rows, total_docs, total_terms

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> Index:
        total_docs, total_terms = totals(docs, text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number, held, size = TaskContext.get().partitionId() << 32, [], 0
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    some = b.slice(at, 64)
                    held.append(some)
                    size += len(_buffer(some.column(1))[0])
                    if size >= segment_bytes:
                        yield from _segment(number, held, total_docs, total_terms)
                        number, held, size = number + 1, [], 0
            yield from _segment(number, held, total_docs, total_terms)

        slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
        return cls(materialize(slim.mapInArrow(run, INDEX), "lexical"), total_docs, total_terms)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, item_id, term, q)``: how often each term is in each item; ``item`` tells items apart, ``item_id`` is its own."""
    one = items.select(F.col(id_col).cast("long").alias("item_id"), whole_text(text_col).alias("text")).distinct()
    name = F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text"), 256)
    words = F.split(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), NO_TERM)
    named = one.select(F.substring(F.unhex(name), 1, 16).alias("item"), "item_id", words.alias("words"))
    each = named.select("item", "item_id", F.explode("words").alias("term"))
    return each.filter("term <> ''").groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("q"))


def _met(rows: DataFrame, keys: DataFrame, size, how: str) -> DataFrame:
    """Rows of the index and what ``keys`` has of their terms; keys are broadcast if their bytes, which are counted, are few."""
    few = (keys.agg(F.sum(size + F.octet_length("term"))).first()[0] or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(keys), "term", how) if few else rows.hint("merge").join(keys.hint("merge"), "term", how)


def _weighed(index: Index, wanted: DataFrame, blocks: int) -> DataFrame:
    """``(block, term, items)``: for each block and term its items, as structs of item, item_id and weight times q."""
    counted = index.rows.filter("term IS NOT NULL").select("term", F.octet_length("bound").alias("df"))
    counted = _met(counted, wanted.select("term").distinct(), F.lit(16), "left_semi")
    df = counted.groupBy("term").agg(F.sum("df").cast("double").alias("df"))
    weight = F.floor(1000 * F.log((2 * index.total_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(df, "term").withColumn("w", weight).filter("w > 0")
    rows = weighed.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "term", F.struct("item", "item_id", (F.col("w") * F.col("q")).alias("wq")).alias("x"))
    return rows.groupBy("block", "term").agg(F.collect_list("x").alias("items"))


FOUND = "item binary, item_id long, doc_id long, score long"


class _Best:
    """For each item the best k documents that a task has met, and the k largest lower bounds of scores."""

    def __init__(self, k: int):
        self.k, self.low, self.rows, self.ids = k, {}, {}, {}

    def add(self, item: bytes, item_id: int | None, docs: list[np.ndarray], bounds: list[np.ndarray], tfs: list[np.ndarray], wq: list[int], segment) -> None:
        ids, none, m = segment
        upper, units = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for d, b, w in zip(docs, bounds, wq, strict=True):
            upper[d] += w * STEP * b.astype(np.int64)
            units[d] += w
        met = np.flatnonzero(units)
        lower = upper[met] - (STEP - 1) * units[met]
        best = np.append(self.low.get(item, np.zeros(0, np.int64)), lower)
        best = np.partition(best, len(best) - self.k)[-self.k :] if len(best) > self.k else best
        self.low[item], self.ids[item] = best, item_id
        reach = met[upper[met] >= best.min()] if len(best) == self.k else met
        if not len(reach):
            return
        place = np.full(len(ids), -1)
        place[reach] = np.arange(len(reach))
        score = np.zeros(len(reach), np.int64)
        for d, t, w in zip(docs, tfs, wq, strict=True):
            at = place[d]
            own = at >= 0
            score[at[own]] += w * impacts(t[own], m[d[own]])
        found = np.stack([-score, none[reach].astype(np.int64), ids[reach]])
        found = found[:, score > 0]
        found = np.concatenate([self.rows.get(item, np.zeros((3, 0), np.int64)), found], axis=1)
        self.rows[item] = found[:, np.lexsort(found[::-1])[: self.k]]

    def out(self) -> Iterator[pa.RecordBatch]:
        for item, (score, none, ids) in self.rows.items():
            n = len(score)
            columns = [pa.array([item] * n, pa.binary()), pa.array([self.ids[item]] * n, pa.int64()), pa.array(ids, mask=none.astype(bool)), pa.array(-score)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])


def _search(k: int, total_docs: int, total_terms: int):
    """The best k of what a task has; rows (block, segment, term, docs, bound, tf, items) come by block and segment, the one without a term first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, segment, now, items = _Best(k), None, (None, None), {}

        def end() -> None:
            for (item, item_id), (docs, bounds, tfs, wq) in items.items():
                best.add(item, item_id, docs, bounds, tfs, wq, segment)
            items.clear()

        for b in batches:
            for block, number, term, docs, bound, tf, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, number) != now:
                    end()
                    if block != now[0]:
                        yield from best.out()
                        best = _Best(k)
                    now = block, number
                if term is None:
                    n = np.frombuffer(tf, np.int64)
                    segment = np.frombuffer(docs, np.int64), np.frombuffer(bound, np.uint8), length_marks(n, total_docs, total_terms)
                    continue
                arrays = np.frombuffer(docs, np.int32), np.frombuffer(bound, np.uint8), np.frombuffer(tf, np.int32)
                for x in wanted:
                    held = items.setdefault((x["item"], x["item_id"]), ([], [], [], []))
                    for some, a in zip(held, (*arrays, x["wq"]), strict=True):
                        some.append(a)
        end()
        yield from best.out()

    return run


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item, or all with a score if fewer."""
    tune(items.sparkSession)
    wanted = hold(item_terms(items, id_col, text_col), 8192)
    blocks = max(1, -(-wanted.count() // block_terms))
    weighed = hold(_weighed(index, wanted, blocks), 8192)
    met = _met(index.rows.filter("term IS NOT NULL"), weighed, 48 * F.size("items"), "inner")
    heads = index.rows.filter("term IS NULL").withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "items": F.lit(None).cast(weighed.schema["items"].dataType)})
    columns = ["block", "segment", "term", "docs", "bound", "tf", "items"]
    rows = met.select(*columns).unionByName(heads.select(*columns))
    dealt = rows.repartition("block", "segment").sortWithinPartitions("block", "segment", F.col("term").isNotNull())
    found = dealt.mapInArrow(_search(k, index.total_docs, index.total_terms), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
