"""Removal of every byte that lies in a repeated string of ``length`` bytes, by column-wise construction of the
Burrows-Wheeler order and the common prefixes of a collection of strings.

Which strings the collection holds. Of the window of ``length`` bytes at any place, the smallest hash of ``GRAM``
bytes in it marks an anchor; the choice depends on those bytes alone, so two equal strings have the same anchor at the
same place in them. Each anchor has a context: the bytes around it that such strings can cover. Anchors whose gram
occurs once are dropped after counting. Contexts that are equal as a whole are counted by their digest, one of each
stays (copies cost one narrow row each), and only anchors with different contexts need to be compared: one context of
each kind goes into the collection, lined up at the anchor.

Construction. Contexts are written by columns to external files, the last column first. Each round reads one column,
that is one symbol a string, inserts it before all suffixes made so far, and updates the order of the suffixes
(a stable distribution of the order by symbol, the step of the inverse Burrows-Wheeler transform) and the common
prefixes of neighbours (one more than the least of those between them before, or none). A suffix that has ``length``
bytes in common with a neighbour starts a repeated string. A task holds a few numbers a string in memory; the bytes stay
in the files, which it deletes as it ends.

A gram with more than ``SPLIT`` kinds of contexts is split, exactly: the strings of ``length`` bytes around an anchor
fall into ``PARTS`` by how far left of it they start, all strings of a part cover the same middle bytes, and only
contexts that agree in those can share one. So each part is a collection by those bytes. A symbol that UTF-8 does not
have, in place of the anchor's first byte, keeps the parts of a context apart.

A full transform of all documents would take as many passes over all data as the longest document has bytes; the
anchors bound the rounds by twice ``length``.

Texts are UTF-8 bytes, matches never cross documents, and strings are judged on the input. Defined results: a null text
is empty; documents shorter than ``length`` never lose a byte; repeated rows are occurrences of each other; null
doc_ids are documents like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm._common import apart, forget, hold, materialize, part, released, tune, whole_text

LENGTH = 400
GRAM = 48
#: Strings of a collection that are built at once, unless one anchor's alone are more.
COLLECTION = 30_000
#: Bytes of text whose anchors are found at once.
BLOCK = 1 << 20
#: Kinds of contexts of one gram beyond which they are split, and the parts that each context then has.
SPLIT, PARTS = 4096, 8
#: A passage has more words than this; its bytes are at least PASSAGE_LENGTH, at about five a word.
PASSAGE_WORDS, PASSAGE_LENGTH = 50, 256
#: Stands for what is beyond a document's ends; no UTF-8 text has it.
BEYOND = 0xFF
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Anchors:
    """Finds the anchors of texts."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.up, self.down = _powers(BASE, BLOCK + length + 1), _powers(INVERSE, BLOCK + length + 1)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors in ``data`` and their grams' hashes."""
        places, hashes = [], []
        step = BLOCK - self.length
        for start in range(0, max(1, len(data) - self.length + 1), step):  # windows start in [start, start + step)
            part = data[start : start + step + self.length - 1]
            if len(part) >= self.length:
                p, h = self._block(np.frombuffer(part, np.uint8))
                places.append(p + start)
                hashes.append(h)
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        p, h = np.concatenate(places), np.concatenate(hashes)
        p, first = np.unique(p, return_index=True)
        return p, h[first]

    def _block(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, w = self.gram, self.width
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.down[: len(b)], out=sums[1:])
        n = len(b) - k + 1
        h = _mixed((sums[k:] - sums[:-k]) * self.up[:n])
        # The key orders by the high bits of the hash and then from the right; the place is in its low bits.
        key = (h & np.uint64(_MASK ^ (2 * BLOCK - 1))) | (np.uint64(2 * BLOCK - 1) - np.arange(n, dtype=np.uint64))
        pad = -n % w
        rows = np.concatenate([key, np.full(pad, _MASK, np.uint64)]).reshape(-1, w)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[: n - w + 1], before[w - 1 : n])
        chosen = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
        places = np.unique((np.uint64(2 * BLOCK - 1) - (chosen & np.uint64(2 * BLOCK - 1))).astype(np.int64))
        return places, h[places]


def context(data: bytes, place: int, length: int, gram: int) -> tuple[int, int]:
    """Where the context of an anchor starts and ends in ``data``."""
    return max(0, place - (length - gram)), min(len(data), place + length)


def _padded(data: bytes, place: int, length: int, gram: int) -> bytes:
    """A context of full width, lined up at the anchor; what lies beyond the document is ``BEYOND``."""
    low, high = context(data, place, length, gram)
    left, right = length - gram - (place - low), place + length - high
    return bytes([BEYOND]) * left + data[low:high] + bytes([BEYOND]) * right


class Columns:
    """A collection's symbols by columns, each in an external file of its own block, read and written in sequence."""

    def __init__(self, width: int):
        self.width = width
        self.folder = tempfile.mkdtemp(prefix="columns-")
        self.parts: list[tuple[str, int]] = []

    def add(self, strings: list[bytes]) -> None:
        path = f"{self.folder}/{len(self.parts)}"
        rows = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), self.width)
        np.ascontiguousarray(rows.T[::-1]).tofile(path)
        self.parts.append((path, len(strings)))

    def __len__(self) -> int:
        return sum(n for _, n in self.parts)

    def __iter__(self) -> Iterator[np.ndarray]:
        files = [(open(path, "rb"), n) for path, n in self.parts]
        try:
            for _ in range(self.width):
                yield np.concatenate([np.frombuffer(f.read(n), np.uint8) for f, n in files])
        finally:
            for f, _ in files:
                f.close()

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def repeats(columns: Columns, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each place of the contexts from the last on: the strings whose ``length`` bytes from there occur in another.

    ``order`` holds the strings in the order of their suffixes, ``common[i]`` how many symbols the i-th has in common
    with the one before it.
    """
    n, width = len(columns), columns.width
    order, common = np.arange(n), np.zeros(n, np.int32)
    valid = np.zeros(n, np.int32)  # symbols from here on up to the document's end
    for done, symbols in enumerate(columns):
        inside = symbols != BEYOND
        valid = np.where(inside, valid + 1, 0)
        there = symbols[order]
        by_symbol = np.argsort(there, kind="stable")
        sorted_symbols = there[by_symbol]
        # Between two strings that the same symbol is put before lie those with other symbols: their least common counts.
        starts = np.flatnonzero(np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]]))
        if done == 0:
            least = np.zeros(n, np.int32)
        elif len(starts) == 1:
            least = common
        else:
            least = np.empty(n, np.int32)
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                if b - a > 1:
                    at = by_symbol[a:b]
                    least[a + 1 : b] = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1)
        order = order[by_symbol]
        common = least + 1
        common[starts] = 0
        if done + 1 >= length:
            equal = common >= length
            hit = equal | np.concatenate([equal[1:], [False]])
            found = order[hit]
            found = found[valid[found] >= length]
            if len(found):
                yield width - done - 1, found


#: A document: its doc_id (0 if null) and a hash of its text and of whether its doc_id is null.
KEY = "doc_id long, th long"


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, gram)
        for b in batches:
            places, hashes = [], []
            for text in b.column(2).to_pylist():
                p, h = finder.of(text)
                places.append(p)
                hashes.append(h.view(np.int64))
            if b.num_rows:
                ends = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x), t)) for x, t in ((places, pa.int32()), (hashes, pa.int64()))]
                full = [pa.array([hashlib.sha256(t).hexdigest() for t in b.column(2).to_pylist()]), pa.array([len(t) for t in b.column(2).to_pylist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *full, *lists], ["doc_id", "th", "no_id", "full_sha256", "n_bytes", "places", "grams"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are packed before they are sent and held, each on its own."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t) for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "th", "text"])


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    return map(zstandard.ZstdDecompressor().decompress, column.to_pylist())


def _digest_contexts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, places, grams, firsts, seconds, sizes = [], [], [], [], [], []
            for k, (text, ps, gs) in enumerate(zip(_unpacked(b.column(2)), *(b.column(c).to_pylist() for c in (3, 4)), strict=True)):
                for p, g in zip(ps, gs, strict=True):
                    low, high = context(text, p, length, gram)
                    h = hashlib.blake2b(b"%d:" % (p - low), digest_size=16)
                    h.update(text[low:high])
                    d = np.frombuffer(h.digest(), np.int64)
                    at.append(k)
                    places.append(p)
                    grams.append(g)
                    firsts.append(int(d[0]))
                    seconds.append(int(d[1]))
                    sizes.append(high - low)
            if at:
                keys = [b.column(c).take(pa.array(at)) for c in (0, 1)]
                made = [pa.array(places, pa.int32()), *(pa.array(x, pa.int64()) for x in (grams, firsts, seconds)), pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays([*keys, *made], ["doc_id", "th", "place", "gram", "w1", "w2", "size"])

    return run


def _in_parts(text: bytes, place: int, padded: bytes, length: int, gram: int) -> Iterator[tuple[int, bytes]]:
    """The key and the marked context of each part that a context has in its document."""
    step = -(-(length - gram + 1) // PARTS)
    for part in range(PARTS):
        low, high = place - part * step, place + length - (part + 1) * step + 1
        if part * step > length - gram or low < 0 or high > len(text):
            continue
        h = hashlib.blake2b(b"%d:%d:" % (part, gram), digest_size=8)
        h.update(text[min(low, place) : max(high, place + gram)])
        marked = padded if not part else padded[: length - gram] + bytes([BEYOND - part]) + padded[length - gram + 1 :]
        yield int.from_bytes(h.digest(), "little", signed=True), marked


def _cut_contexts(length: int, gram: int):
    types = (*[pa.int64()] * 4, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, wanted in zip(_unpacked(b.column(0)), b.column(1).to_pylist(), strict=True):
                for x in wanted:
                    padded = _padded(text, x["place"], length, gram)
                    keys = _in_parts(text, x["place"], padded, length, gram) if x["split"] else [(x["gram"], padded)]
                    rows += [(key, x["gram"], x["w1"], x["w2"], marked) for key, marked in keys]
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "gram", "w1", "w2", "bytes"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "gram", "w1", "w2", "bytes"])

    return run


def _build(length: int, gram: int, collection: int):
    names = ["gram", "w1", "w2", "start", "stop"]

    def found(columns: Columns, keys: list) -> Iterator[pa.RecordBatch]:
        key = [np.concatenate(c) for c in zip(*keys, strict=True)]
        first, last = np.full(len(columns), -1, np.int32), np.full(len(columns), -1, np.int32)
        for place, strings in repeats(columns, length):  # from the last place on
            first[strings] = place
            last[strings] = np.where(last[strings] < 0, place, last[strings])
        # Places in a context are less than a length apart, so what they cover is one run; it is told from the anchor on.
        some = np.flatnonzero(first >= 0)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in key), pa.array(first[some] - (length - gram)), pa.array(last[some] + gram)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, keys = Columns(2 * length - gram), []
        try:
            last = None
            for b in batches:  # sorted by key
                if not b.num_rows:
                    continue
                g = b.column(0).to_numpy()
                if len(columns) >= collection and g[-1] != last:
                    cut = int(np.searchsorted(g, last, side="right"))
                    if cut:
                        _add(columns, keys, b.slice(0, cut))
                    yield from found(columns, keys)
                    columns.close()
                    columns, keys = Columns(2 * length - gram), []
                    b = b.slice(cut)
                if b.num_rows:
                    _add(columns, keys, b)
                    last = b.column(0)[-1].as_py()
            if keys:
                yield from found(columns, keys)
        finally:
            columns.close()

    return run


def _add(columns: Columns, keys: list, b: pa.RecordBatch) -> None:
    columns.add(b.column(4).to_pylist())
    keys.append([b.column(c).to_numpy() for c in (1, 2, 3)])


def _merged(covered, size: int) -> list[tuple[int, int]]:
    """Maximal runs of a text of so many bytes that are covered."""
    out: list[tuple[int, int]] = []
    for x in sorted(covered or (), key=lambda x: x["start"]):
        end = min(x["stop"], size)
        if out and x["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((x["start"], end))
    return out


def _remove(with_bytes: bool):
    """Cut the covered runs out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, digests, removed, spans = [], [], [], []
            for text, covered in zip(_unpacked(b.column(2)), b.column(3).to_pylist(), strict=True):
                runs = _merged(covered, len(text))
                rest = b"".join(text[a:z] for (_, a), (z, _) in zip([(0, 0), *runs], [*runs, (len(text), 0)], strict=True))
                kept.append(rest)
                digests.append(hashlib.sha256(rest).hexdigest())
                removed.append(len(text) - len(rest))
                spans.append(len(runs))
            made = [pa.array(digests, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), *([pa.array(kept, pa.binary())] if with_bytes else [])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "th", "cut_sha256", "n_removed", "n_spans", *["kept"] * with_bytes])

    return run


def _count_passages(words: int):
    """Covered runs of more than so many words, and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = []
            for text, covered in zip(_unpacked(b.column(2)), b.column(3).to_pylist(), strict=True):
                sizes = [len(text[a:z].split()) for a, z in _merged(covered, len(text))]
                counts.append([n for n in sizes if n > words])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(n) for n in counts], pa.int64()), pa.array([sum(n) for n in counts], pa.int64())], ["doc_id", "th", "n_passages", "n_passage_words"])

    return run


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", collection: int = COLLECTION, split: int = SPLIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: a line for each row of ``docs``, texts with repeated anchors, and covered runs of such texts.

    Rows alike in doc_id and text are alike in all results; of such rows one text has ``nth`` 1.
    """
    spark = docs.sparkSession
    tune(spark, 256)
    text, doc = whole_text(text_col), F.col(id_col).cast("long")
    slim = docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), F.xxhash64(text, doc.isNull()).alias("th"), text.cast("binary").alias("text"), doc.isNull().alias("no_id"))
    lines = hold(slim.mapInArrow(_find_anchors(length, gram), KEY + ", no_id boolean, full_sha256 string, n_bytes long, places array<int>, grams array<long>"))
    each = lines.select("doc_id", "th", F.explode(F.arrays_zip("places", "grams")).alias("a")).select("doc_id", "th", F.col("a.places").alias("place"), F.col("a.grams").alias("gram"))
    again = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(apart("gram").alias("gram"))
    wanted = each.hint("merge").join(again.hint("merge"), "gram").groupBy("doc_id", "th").agg(F.collect_set(F.struct("place", "gram")).alias("a"))
    wanted = wanted.select("doc_id", "th", F.col("a.place").alias("places"), F.col("a.gram").alias("grams"))
    wanted = hold(wanted)
    # Only these texts are packed and sent; the list of them is broadcast while it is short.
    packed = part(slim, wanted, "left_semi", ["doc_id", "th"]).select("doc_id", "th", "text").mapInArrow(_pack, KEY + ", text binary")
    texts = packed.hint("merge").join(wanted.hint("merge"), ["doc_id", "th"])
    texts = texts.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "th").orderBy("th")))
    texts = materialize(texts.select("doc_id", "th", "text", "places", "grams", "nth"), "anchored")
    wanted.unpersist()
    forget(spark)  # what was shuffled to find them

    contexts = hold(texts.mapInArrow(_digest_contexts(length, gram), KEY + ", place int, gram long, w1 long, w2 long, size int"))
    kinds = contexts.groupBy("gram", "w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("one"), F.max("size").alias("size"))
    kinds = hold(kinds)
    differ = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(apart("gram").alias("gram"), (F.col("kinds") > split).alias("split"))
    compare = kinds.hint("merge").join(differ.hint("merge"), "gram").filter(F.col("size") >= length)
    compare = compare.select("one.doc_id", "one.th", F.struct("gram", "w1", "w2", "one.place", "split").alias("x")).groupBy("doc_id", "th").agg(F.collect_list("x").alias("wanted"))
    cut = texts.filter("nth = 1").select("doc_id", "th", "text").hint("merge").join(compare.hint("merge"), ["doc_id", "th"]).select("text", "wanted")
    cut = cut.mapInArrow(_cut_contexts(length, gram), "key long, gram long, w1 long, w2 long, bytes binary")
    built = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_build(length, gram, collection), "gram long, w1 long, w2 long, start int, stop int")
    # The same context as often as twice is repeated as a whole; else what the construction has found counts.
    whole = kinds.filter((F.col("n") > 1) & (F.col("size") >= length)).select("gram", "w1", "w2", F.lit(gram - length).alias("start"), F.lit(length).alias("stop"))
    runs = whole.unionByName(built)
    covered = contexts.join(runs, ["gram", "w1", "w2"]).select("doc_id", "th", F.greatest(F.col("place") + F.col("start"), F.lit(0)).alias("start"), (F.col("place") + F.col("stop")).alias("stop"))
    return lines, texts, covered


def _hit(texts: DataFrame, covered: DataFrame) -> DataFrame:
    per_doc = covered.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("covered"))
    hit = texts.filter("nth = 1").select("doc_id", "th", "text").hint("merge").join(per_doc.hint("merge"), ["doc_id", "th"])
    return hit.select("doc_id", "th", "text", "covered")


def repeated_passages(docs: DataFrame, words: int = PASSAGE_WORDS, length: int = PASSAGE_LENGTH, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``(doc_id, th, n_passages, n_passage_words)`` of the texts with a passage of more than ``words`` words that repeats.

    A passage is a maximal run of bytes that lie in repeated strings of ``length`` bytes.
    """
    _, texts, covered = find_repeats(docs, length, id_col=id_col, text_col=text_col, **names)
    counted = _hit(texts, covered).mapInArrow(_count_passages(words), KEY + ", n_passages long, n_passage_words long")
    return materialize(counted.filter("n_passages > 0"), "passages")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True, with_passages: bool = False, split: int = SPLIT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for each row.

    ``kept`` holds the remaining bytes of texts that have lost some, and is null for all others; it is left out unless
    asked for by ``with_bytes``. ``with_passages`` adds ``n_passages`` and ``n_passage_words``, which nothing is removed for.
    """
    passages = None
    if with_passages:  # first, so that what it held is gone when the removal starts
        with released(docs.sparkSession):
            passages = repeated_passages(docs, id_col=id_col, text_col=text_col)
    lines, texts, covered = find_repeats(docs, length, gram, id_col, text_col, split=split)
    cut = _hit(texts, covered).mapInArrow(_remove(with_bytes), KEY + ", cut_sha256 string, n_removed long, n_spans long" + ", kept binary" * with_bytes)
    zero = F.lit(0).cast("long")
    out = lines.hint("merge").join(cut.hint("merge"), ["doc_id", "th"], "left")
    more = []
    if passages is not None:
        out = out.hint("merge").join(passages.hint("merge"), ["doc_id", "th"], "left")
        more = [F.coalesce(c, zero).alias(c) for c in ("n_passages", "n_passage_words")]
    doc = F.when(~F.col("no_id"), F.col("doc_id"))
    return out.select(doc.alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "full_sha256").alias("kept_sha256"), *["kept"] * with_bytes, *more)
