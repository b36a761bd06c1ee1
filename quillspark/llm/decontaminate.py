"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training token window.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. A window is ``n`` consecutive
words of a benchmark item; an item with fewer words, but some, is one window. A document word inside any occurrence of
a window is hit. A document is contaminated when at least one in ``1 / threshold`` of its words is hit.

The hash set holds the hash of each window in sorted arrays, built once on the driver, and is broadcast only in blocks of
at most ``block_bytes`` of text; a longer item is cut into parts that overlap by a window less a word. Hits of a hash
are verified word by word. A benchmark of one block takes one map over the documents, without any shuffle. A larger one
takes a scan for each block, of which only what hit texts have is kept, by the texts' hashes, and joined back once.

Defined results: a null or blank text has no words and is never contaminated; null, blank and repeated items: blank
ones never occur, repeated ones each count, a null item_id is left out of the list of ids but counts as an item;
repeated documents are judged alike; an empty benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import BROADCAST_ROWS, boxed, hold, tune, unboxed, whole_text

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of benchmark text in one broadcast hash set, which takes about four times as many.
BLOCK_BYTES = 8 << 20
#: Slots of the bitmap that is looked up first, for each window.
SLOTS = 8


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Windows:
    """The windows of some parts of items ``(number, item_id, copies, words)``: by length their sorted hashes and first words."""

    def __init__(self, parts: list[tuple[int, str | None, int, list[bytes]]], n: int):
        every = [w for part in parts for w in part[3]]
        self.text = b" ".join(every)
        ends = np.cumsum(np.fromiter(map(len, every), np.int64, len(every)) + 1) - 1
        self.ends, self.starts = ends, np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.items = [part[:3] for part in parts]
        self.first = np.cumsum([0, *(len(part[3]) for part in parts)])  # of each part, and the end
        numbers = word_hashes(every)
        windows: dict[int, list[np.ndarray]] = {}
        for k, part in enumerate(parts):
            size = min(n, len(part[3]))
            if size:
                windows.setdefault(size, []).append(np.arange(self.first[k], self.first[k + 1] - size + 1))
        self.by_length = {}
        for size, lists in windows.items():
            at = np.concatenate(lists)
            h = window_hashes(numbers, size)[at]
            order = np.argsort(h, kind="stable")
            self.by_length[size] = h[order], at[order].astype(np.int32)
        self.bitmaps: dict[int, tuple[np.ndarray, np.uint64]] = {}

    def __getstate__(self):
        return self.__dict__ | {"bitmaps": {}}

    def _bitmap(self, size: int) -> tuple[np.ndarray, np.uint64]:
        if size not in self.bitmaps:
            hashes = self.by_length[size][0]
            bits = max(10, (SLOTS * len(hashes)).bit_length())
            shift = np.uint64(64 - bits)
            slots = np.zeros(1 << bits, bool)
            slots[hashes >> shift] = True
            self.bitmaps[size] = slots, shift
        return self.bitmaps[size]

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """The number of words, the hit runs of words (start, end), and the parts found, by their places in ``items``."""
        w = words(text)
        if not w or not self.by_length:
            return len(w), [], set()
        numbers = word_hashes(w)
        hit, found = np.zeros(len(w) + 1, np.int32), set()
        for size, (known, first) in self.by_length.items():
            if len(w) < size:
                continue
            slots, shift = self._bitmap(size)
            hashes = window_hashes(numbers, size)
            some = np.flatnonzero(slots[hashes >> shift])
            low, high = np.searchsorted(known, hashes[some], "left"), np.searchsorted(known, hashes[some], "right")
            for at, a, b in zip(some.tolist(), low.tolist(), high.tolist(), strict=True):
                if a == b:
                    continue
                window = b" ".join(w[at : at + size])
                same = [k for k in first[a:b].tolist() if self.text[self.starts[k] : self.ends[k + size - 1]] == window]
                if same:
                    hit[at] += 1
                    hit[at + size] -= 1
                    found.update((np.searchsorted(self.first, same, "right") - 1).tolist())
        if not found:
            return len(w), [], found
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit[:-1]) > 0, [0]]).astype(np.int8)))
        return len(w), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), found


def word_hashes(some: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some))


def window_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` numbers."""
    out = np.zeros(max(0, len(numbers) - size + 1), np.uint64)
    for k in range(size):
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += numbers[k : len(numbers) - size + 1 + k]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x94D049BB133111EB)


def blocks_of(items: Iterator[tuple[str | None, bytes, int]], n: int, block_bytes: int) -> Iterator[list[tuple[int, str | None, int, list[bytes]]]]:
    """Parts of items, as many at a time as have ``block_bytes`` of words in all."""
    block, size = [], 0
    for number, (item_id, text, copies) in enumerate(items):
        rest = words(text)
        while rest:
            k = room = 0
            while k < len(rest) and (k < n or room + len(rest[k]) < block_bytes):  # a window at least
                room += len(rest[k]) + 1
                k += 1
            if block and size + room > block_bytes:
                yield block
                block, size = [], 0
            block.append((number, item_id, copies, rest[:k]))
            size += room + 64
            rest = rest[k - n + 1 :] if k < len(rest) else []
    if block:
        yield block


RUNS = "array<struct<start: int, end: int>>"
ITEMS = "array<struct<number: long, id: string, copies: long>>"
#: Columns that verdicts add; a document's own columns of these names give way.
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
WORD_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def find(docs: DataFrame, benchmark: DataFrame, n: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` as one column ``row``, with ``n_words``, the hit ``runs`` of words, the items ``found``, ``n_items`` and ``n_hit``."""
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), whole_text(item_text_col).cast("binary").alias("text"))
    items = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    blocks = blocks_of(((x["item_id"], bytes(x["text"]), x["copies"]) for x in items.toLocalIterator()), n, block_bytes)
    held = [spark.sparkContext.broadcast(Windows(block, n)) for block in blocks]
    rows = boxed(docs)
    if len(held) <= 1:
        held = held or [spark.sparkContext.broadcast(Windows([], n))]
        schema = rows.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.lit(None).cast(RUNS), "found": F.lit(None).cast(ITEMS)}).schema
        out = rows.mapInArrow(_all_rows(held[0], text_col), schema)
    else:
        out = _by_blocks(rows, held, f"row.`{text_col}`")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    n_items = F.aggregate("found", F.lit(0).cast("long"), lambda acc, x: acc + x["copies"])
    return out.withColumns({"n_hit": F.coalesce(n_hit, F.lit(0).cast("long")), "n_items": F.coalesce(n_items, F.lit(0).cast("long"))})


def _found(windows: Windows, parts: set[int]) -> list[dict]:
    every = {windows.items[k] for k in parts}
    return [{"number": number, "id": item_id, "copies": copies} for number, item_id, copies in sorted(every, key=lambda x: x[0])]


def _runs(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in runs]


def _all_rows(held, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held.value
        for b in batches:
            counts, runs, items = [], [], []
            for text in b.column(0).field(text_col).cast(pa.binary()).to_pylist():
                size, new, parts = windows.find(text or b"")
                counts.append(size)
                runs.append(_runs(new))
                items.append(_found(windows, parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(runs, RUN_TYPE), pa.array(items, ITEM_TYPE)], ["row", "n_words", "runs", "found"])

    return run


RUN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
ITEM_TYPE = pa.list_(pa.struct([("number", pa.int64()), ("id", pa.string()), ("copies", pa.int64())]))


def _by_blocks(rows: DataFrame, held: list, text_col: str) -> DataFrame:
    """A scan of the texts for each block; what hit texts have is told by two hashes of the text and joined back."""
    text = whole_text(text_col)
    keyed = rows.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})

    def scan(windows):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                some, runs, items = [], [], []
                for k, t in enumerate(b.column(2).to_pylist()):
                    _, new, parts = windows.value.find(t)
                    if parts:
                        some.append(k)
                        runs.append(_runs(new))
                        items.append(_found(windows.value, parts))
                keys = [b.column(c).take(pa.array(some, pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(runs, RUN_TYPE), pa.array(items, ITEM_TYPE)], ["k1", "k2", "runs", "found"])

        return run

    slim = keyed.select("k1", "k2", text.cast("binary").alias("text"))
    per_block = None
    for block, windows in enumerate(held):  # copies of a hit text are summed up to one row before they are shuffled
        one = slim.mapInArrow(scan(windows), f"k1 long, k2 long, runs {RUNS}, found {ITEMS}").groupBy("k1", "k2").agg(F.first("runs").alias("runs"), F.first("found").alias("found"))
        one = hold(one.withColumn("block", F.lit(block)))
        one.count()  # a block at a time, so that a worker holds one hash set
        per_block = one if per_block is None else per_block.unionByName(one)
    hits = per_block.groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    starts = F.array_sort(F.col("runs"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    hits = hold(hits.withColumn("runs", F.aggregate(starts, F.array().cast(RUNS), step)))
    few = hits.count() <= BROADCAST_ROWS // 10  # hits are wider than keys
    joined = keyed.join(F.broadcast(hits) if few else hits.hint("merge"), ["k1", "k2"], "left")
    n_words = F.regexp_count(whole_text(text_col), F.lit(WORD_SQL)).cast("long")
    return joined.select("row", n_words.alias("n_words"), "runs", "found")


def contaminated(one_in: int):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))


def verdicts(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int = 20, **names) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = find(docs, benchmark, n, **names)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ADDED]
    ids = F.flatten(F.transform("found", lambda x: F.array_repeat(x["id"], x["copies"].cast("int"))))
    ids = F.array_sort(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    digest = F.sha2(F.array_join(ids, ",").cast("binary"), 256)
    return found.select(*own, "n_words", "n_hit", "n_items", digest.alias("items_sha256"), contaminated(one_in).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int | None = None, **names) -> DataFrame:
    """The documents in which no window occurs, with their own columns; with ``one_in``, those that are not contaminated."""
    found = find(docs, benchmark, n, **names)
    return unboxed(found.filter(F.col("n_hit") == 0 if one_in is None else ~contaminated(one_in)))


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, text_col: str = "text", **names) -> DataFrame:
    """``docs`` whose texts have lost each hit run of words, from its first word's first byte to its last word's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = b.column(0), []
            for t, r in zip(rows.field(text_col).to_pylist(), b.column(1).to_pylist(), strict=True):
                if r:
                    data = t.encode()
                    at = [m.span() for m in WORD.finditer(data.lower())]
                    for x in reversed(r):
                        data = data[: at[x["start"]][0]] + data[at[x["end"] - 1][1] :]
                    t = data.decode()
                out.append(t)
            fields = list(rows.type)
            columns = [pa.array(out, f.type) if f.name == text_col else rows.field(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=fields), b.column(1)], schema=b.schema)

    found = find(docs, benchmark, n, text_col, **names).select("row", "runs")
    return unboxed(found.mapInArrow(run, found.schema))


def items_sha256(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
