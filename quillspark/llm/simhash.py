"""SimHash near-duplicate detection with pivot distance tables.

A fingerprint has 64 bits: each bit is the majority vote of the XXH64 hashes of a text's word shingles. Two
fingerprints link at ``max_distance`` or fewer differing bits; near duplicates are the connected components.

How links are found. Distances to a fixed set of reference fingerprints (pivots) are precomputed. By the triangle
inequality a linked pair differs by at most ``max_distance`` in every coordinate of that table, so pairs with a larger
maximum coordinate difference are discarded, and survivors are verified by their true distance. The tables are kept
by block: with ``max_distance + 1`` blocks of bits, a linked pair agrees in at least one whole block, so only
fingerprints that share a block meet in one table, sorted by their first coordinate. A table with more than
``table_rows`` rows is split again, exactly, by blocks of the bits that are still free, up to ``levels`` times.

Only distinct fingerprints meet, so copies cost nothing; each table returns a spanning forest, never all its pairs;
components come from large-star and small-star rounds over those edges, each written to the shared folder.

Near duplicates by similarity (``similar_documents``): texts whose sets of word shingles have a Jaccard similarity of 0.8
or more; no such pair is left out. Of two similar sets, ordered alike, the first n - ceil(0.8 n) + 1 shingles have one in
common, so texts meet in a table for each of these; shingles that are frequent in a sample come last in the order, which
keeps tables small. Of a small table only rows stay that another one's size and place in the order allow to be similar with
this shingle as the first in common. Fingerprints are parities there: a shingle flips one bit, so sets differ in no fewer
shingles than their fingerprints in bits, and coordinates and then distances in a pivot table discard no similar pair. A
fingerprint has more bits for a larger set, so that long texts are told apart as well; of two widths the wider is folded to
the other. What they leave makes groups, and the sets of a group are compared as they are, from a file where they are many.
A row that has been reached is not compared again, so that a large group of near copies costs each of its rows about one
comparison in a table.

Defined results: a null or blank text has fingerprint zero and links like any other; repeated rows share their
component; a component whose doc_ids are all null has a null component_id; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import apart, boxed, forget, hold, materialize, part, row_hash, settled, tune, unboxed, whole_text

SEED = 42
PIVOTS = 16
TABLE_ROWS = 4096
LEVELS = 3
#: Pairs that a table holds before they are reduced to a forest; edges in a file between rounds.
EDGE_ROWS = 2_000_000


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=False)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit in a byte
        votes += np.add.reduce(np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words_per_shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    tune(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS, words: int = 1) -> np.ndarray:
    """Reference fingerprints of so many words: fixed pseudo-random ones."""
    return np.random.default_rng(64).integers(0, 2**64, (n, words), dtype=np.uint64)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the edges i-j."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def linked(key: np.ndarray, fp: np.ndarray, refs: np.ndarray, most: int) -> np.ndarray:
    """Rows of whole tables, each table one key: for each row, the row that stands for its component.

    Rows must come sorted by key and by the distance to the first pivot within it.
    """
    n = len(fp)
    fp, refs = fp.reshape(n, -1), refs.reshape(len(refs), -1)
    distance = lambda a, b: np.bitwise_count(a ^ b).sum(1, dtype=np.int16)
    coordinates = [distance(fp, p) for p in refs]
    first = coordinates[0]
    left, right, held, label = [], [], 0, np.arange(n)
    rows = np.arange(n)
    shift = 1
    while len(rows):
        rows = rows[rows + shift < n]
        other = rows + shift
        near = (key[rows] == key[other]) & (first[other] - first[rows] <= most)
        rows = rows[near]  # a row whose partner is out of reach has none further on: the rows are sorted
        other = rows + shift
        i, j = rows, other
        for c in coordinates[1:]:
            if not len(i):
                break
            keep = np.abs(c[i] - c[j]) <= most
            i, j = i[keep], j[keep]
        keep = distance(fp[i], fp[j]) <= most
        left.append(i[keep])
        right.append(j[keep])
        held += len(left[-1])
        if held > EDGE_ROWS:
            label = forest(n, np.concatenate([*left, np.arange(n)]), np.concatenate([*right, label]))
            left, right, held = [], [], 0
        shift += 1
    if held:
        label = forest(n, np.concatenate([*left, np.arange(n)]), np.concatenate([*right, label]))
    return label


def _search(most: int, n_pivots: int):
    """Edges within whole tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(n_pivots)

        def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((np.bitwise_count(fp ^ refs[0, 0]), key))
            key, fp = key[order], fp[order]
            label = linked(key, fp, refs, most)
            member = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[member].view(np.int64)), pa.array(fp[label[member]].view(np.int64))], ["a", "b"])

        keys, fps, size = [], [], 0
        for b in batches:  # sorted by key: all but the last table of what has come are whole
            if not b.num_rows:
                continue
            k = b.column(0).to_numpy(zero_copy_only=False)
            keys.append(k)
            fps.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(k)
            if size >= 1 << 16 and k[-1] != keys[0][0]:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield edges(key[:cut], fp[:cut])
                keys, fps, size = [key[cut:]], [fp[cut:]], 0
        if keys:
            yield edges(np.concatenate(keys), np.concatenate(fps))

    return run


def near_links(nodes: DataFrame, max_distance: int = 3, n_pivots: int = PIVOTS, table_rows: int = TABLE_ROWS, levels: int = LEVELS) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``max_distance`` of each other."""
    blocks = max_distance + 1
    spark = nodes.sparkSession
    run = _search(max_distance, n_pivots)
    found = None
    # The free bits of a table are a contiguous run list; level by level each block takes a part of them.
    waiting = nodes.select(F.col("fp"), F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"))
    for level in range(levels):
        masks = waiting.select("fp", "key", "free", F.explode(F.array(*[F.lit(b) for b in range(blocks)])).alias("block"))
        taken = _masks(F.col("free"), F.col("block"), blocks, level)
        keyed = masks.withColumn("mask", taken).select(
            "fp",
            F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"),
            F.col("free").bitwiseAND(F.bitwise_not(F.col("mask"))).alias("free"),
        )
        keyed = hold(keyed, 4096)
        sizes = hold(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), 4096)
        last = level == levels - 1
        small = sizes if last else sizes.filter(F.col("n") <= table_rows)
        ready = keyed.join(small.select(apart("key").alias("key")), "key").select("key", "fp")
        out = ready.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
        found = out if found is None else found.unionByName(out)
        if last:
            break
        large = sizes.filter(F.col("n") > table_rows).select("key")
        if large.isEmpty():
            break
        waiting = keyed.join(large.select(apart("key").alias("key")), "key")
    return found if found is not None else spark.createDataFrame([], "a long, b long")


def _masks(free, block, blocks: int, level: int):
    """The bits that ``block`` takes at ``level``: of 16 bits' worth of positions at first, then of what is left.

    Positions are dealt in turn: at each level a block is a set of bit positions with the same remainder, so that the
    free bits of any table split evenly.
    """
    out = F.lit(0).cast("long")
    for b in range(blocks):
        mask = sum(1 << p for p in range(64) if p // blocks**level % blocks == b)
        out = F.when(block == b, F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).otherwise(out)
    return out.bitwiseAND(free)


def components(edges: DataFrame, most_rounds: int = 50, written: bool = False) -> DataFrame:
    """``(fp, root)`` for each end of an edge: the smallest fingerprint that it reaches, itself included.

    ``written`` edges are distinct ones (a, b), a above b, that lie in files: they are read again instead of held.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        kept = e.join(low, "a")
        return kept.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0))).first()

    e = edges if written else hold(_downward(edges))
    before = mark(e)
    files = lambda: max(1, before[0] // EDGE_ROWS)  # noqa: E731  few rows need few files
    for _ in range(most_rounds):
        if not before[0]:
            break
        e = materialize(star(star(e, True), False).coalesce(files()), "simhash-edges")
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) with a above b."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _least(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(fp, component)`` for each of ``nodes`` (fp, least): the least of all nodes that have its root."""
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    least = least.select(apart("root").alias("root"), "component")  # a large component's rows can be split
    return rooted.hint("merge").join(least.hint("merge"), "root").select("fp", "component")


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, component)`` for each of ``nodes`` (fp, least): the least of all nodes that it reaches over ``edges``."""
    return _least(nodes, components(edges))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``."""
    prints = hold(fingerprints(docs, id_col, text_col, words_per_shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = _named(nodes, near_links(nodes.select("fp"), max_distance))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# By similarity


SIMILARITY = 0.8
#: Words of 64 bits in a parity fingerprint, at least and at most, shingles for each of them, and pivots of the tables.
SKETCH_WORDS, SKETCH_MOST, SKETCH_SHINGLES, SKETCH_PIVOTS = 8, 1024, 96, 4
#: Rows of a table all pairs of which are looked at; bytes of sets that a group keeps in memory, and that are compared at once.
SMALL_ROWS, GROUP_BYTES, COMPARED_BYTES = 64, 1 << 24, 1 << 22
#: Documents that are read to see which shingles are frequent; and the shingles that are then taken last, at 16 bytes each.
SAMPLE_ROWS, LATE_SHINGLES = 8192, 65_536
_SLACK = 1e-9  # of a count's product with a similarity, which is no exact binary number


def shingle_hashes(text: bytes, words_per_shingle: int = 5) -> np.ndarray:
    """The sorted hashes of a text's set of shingles; a text of fewer words is one shingle, one of none has no shingle."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(joined[a:b], SEED) for a, b in zip(starts, ends[min(n, words_per_shingle) - 1 :].tolist(), strict=False)], np.uint64))


def set_digest(h: np.ndarray) -> bytes:
    """What tells a set of shingles from all others: 128 bits."""
    import hashlib

    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def sketch_words(n: int) -> int:
    """Words in the parity fingerprint of n shingles: a power of two, so that unrelated sets differ in far more bits than similar ones may."""
    return min(SKETCH_MOST, max(SKETCH_WORDS, 1 << (-(-n // SKETCH_SHINGLES) - 1).bit_length()))


def sketch(h: np.ndarray, late: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> tuple[bytes, np.ndarray]:
    """The parity fingerprint of a set of shingle hashes, and the shingles whose tables it is in.

    ``late`` are hashes, sorted, and their places: these shingles come after all others, in the order of their places.
    """
    n = len(h)
    bits = 64 * sketch_words(n)
    parity = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    print_ = np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()
    least = int(np.ceil(similarity * n - _SLACK))
    if least == n and int(n / similarity + _SLACK) == n:  # no other set is similar to so small a one
        return print_, np.zeros(0, np.int64)
    which, place = late
    if len(which):
        at = np.minimum(np.searchsorted(which, h), len(which) - 1)
        is_late = which[at] == h
        h = h[np.lexsort((np.where(is_late, place[at], h), is_late))]
    return print_, h[: n - least + 1].view(np.int64)


def _late(slim: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are frequent in a sample, the most frequent last; results do not depend on which these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, words_per_shingle) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64))], ["h"])

    some = slim.filter(F.pmod("th", F.lit(max(1, slim.count() // SAMPLE_ROWS))) == 0).select("text")
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    found = [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(LATE_SHINGLES).collect()]
    which = np.array(found[::-1], np.int64).view(np.uint64)
    order = np.argsort(which)
    return which[order], order.astype(np.uint64)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc = F.col(id_col).cast("long")
    return docs.select(doc.alias("doc_id"), row_hash(doc, text_col).alias("th"), whole_text(text_col).cast("binary").alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, th, digest, size, fp, keys)`` for each row; ``th`` tells texts of one doc_id apart, ``digest`` sets of shingles."""
    tune(docs.sparkSession)
    slim = _slim(docs, id_col, text_col)
    late = _late(slim, words_per_shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t, words_per_shingle) for t in b.column(2).to_pylist()]
            made = [sketch(h, late, similarity) for h in sets]
            columns = [pa.array([set_digest(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "th", "digest", "size", "fp", "keys"])

    return slim.mapInArrow(run, "doc_id long, th long, digest binary, size long, fp binary, keys array<long>")


def distinct_sets(prints: DataFrame) -> DataFrame:
    """``(id, digest, least, size, fp, keys)`` for each set of ``sketches()``, written: ``least`` is its least row, ``id`` a number."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    one = prints.groupBy("digest").agg(F.min(row).alias("least"), F.first(F.struct("size", "fp", "keys")).alias("s"))
    return materialize(one.select(F.monotonically_increasing_id().alias("id"), "digest", "least", "s.size", "s.fp", "s.keys"), "similar-sets")


def _whole(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14, most: int = 1 << 24) -> Iterator[pa.Table]:
    """What comes sorted by its first column, cut between values of it only, after so many rows or bytes."""
    held, size, weight, first = [], 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        weight += b.nbytes
        first = b.column(0)[0].as_py() if first is None else first
        if (size >= rows or weight >= most) and b.column(0)[-1].as_py() != first:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.searchsorted(t.column(0).to_numpy(), t.column(0)[-1].as_py()))
            yield t.slice(0, cut)
            held, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
            weight, first = sum(x.nbytes for x in held), held[0].column(0)[0].as_py()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tables(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and its rows."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return starts, np.diff(np.append(starts, len(key)))


def _table_pairs(key: np.ndarray, counts: np.ndarray, small: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within the small tables."""
    rows = np.flatnonzero(np.repeat(small, counts))
    for shift in range(1, int(counts[small].max(initial=1))):
        rows = rows[rows + shift < len(key)]
        rows = rows[key[rows] == key[rows + shift]]
        yield rows, rows + shift


def _shared(similarity: float, table_rows: int):
    """Rows, sorted by key, that may be similar to another row of their key; all rows of a table that is not small.

    The first key that two sets have in common leaves them no more than it and the fewer of the shingles after it in both:
    a similar pair passes there, whatever becomes of it at its other keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            key, size, place = (t.column(k).to_numpy().astype(np.int64) for k in (0, 2, 3))
            _, counts = _tables(key)
            small = counts <= min(table_rows, SMALL_ROWS)
            keep = np.repeat(~small, counts)
            after = size - place
            for i, j in _table_pairs(key, counts, small):
                a, b = size[i], size[j]
                ok = np.minimum(a, b) >= similarity * np.maximum(a, b) - _SLACK
                ok &= np.minimum(after[i], after[j]) >= similarity / (1 + similarity) * (a + b) - _SLACK
                keep[i[ok]] = keep[j[ok]] = True
            yield from t.select(["key", "id"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def reached(n: int, near) -> np.ndarray:
    """The row that stands for each of n rows; ``near(row, others)`` tells which of the others link to a row.

    Rows that are reached are not compared again, so a group of near copies costs each of them about one comparison.
    """
    label, left = np.full(n, -1), np.arange(n)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        left = left[left != start]
        waiting = [start]
        while waiting and len(left):
            row = waiting.pop()
            found = near(row, left)
            label[left[found]] = start
            waiting += left[found].tolist()
            left = left[~found]
    return label


def _candidates(similarity: float, table_rows: int):
    """Edges that connect all rows of a table that may be similar: no pair of the similarity is left out.

    Sets of x and y shingles with the similarity s differ in at most (1 - s) / (1 + s) (x + y) of them, parity
    fingerprints in no more bits, and so do their distances to a pivot. Folding, which adds up halves, keeps parities.
    """
    share = (1 - similarity) / (1 + similarity)
    folds = int(np.ceil(np.log2(1 / similarity)))  # widths of sets whose sizes may be similar are no further apart
    distance = lambda a, b: np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)

    def by_width(words: np.ndarray, fps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each width: each row's place among the fingerprints of that width, these, and their coordinates."""
        rows, prints = {}, {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            fp = np.frombuffer(b"".join([fps[k] for k in own.tolist()]), np.uint64).reshape(-1, w)
            for fold in range(folds + 1):
                if fold:
                    w //= 2
                    if w < SKETCH_WORDS:
                        break
                    fp = fp[:, :w] ^ fp[:, w:]
                rows.setdefault(w, []).append(own)
                prints.setdefault(w, []).append(fp)
        out = {}
        for w in np.unique(words).tolist():
            at = np.zeros(len(words), np.int64)
            own, fp = np.concatenate(rows[w]), np.concatenate(prints[w])
            at[own] = np.arange(len(own))
            out[w] = at, fp, [distance(fp, p) for p in pivots(SKETCH_PIVOTS, w)]
        return out

    def pairs(i, j, size, words, widths):
        """Which of the pairs may be similar."""
        a, b = size[i], size[j]
        most = share * (a + b) + _SLACK
        ok = np.minimum(a, b) >= similarity * np.maximum(a, b) - _SLACK
        narrow = np.minimum(words[i], words[j])
        for w, (at, fp, coordinates) in widths.items():
            here = np.flatnonzero(ok & (narrow == w))
            step = max(1, (1 << 19) // w)
            for some in range(0, len(here), step):
                k = here[some : some + step]
                x, y = at[i[k]], at[j[k]]
                near = np.ones(len(k), bool)
                for c in coordinates:
                    near &= np.abs(c[x] - c[y]) <= most[k]
                left = np.flatnonzero(near)
                near[left] = distance(fp[x[left]], fp[y[left]]) <= most[k[left]]
                ok[k] = near
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            key, ids, size = (t.column(k).to_numpy() for k in range(3))
            fps = t.column(3).to_pylist()
            words = np.fromiter(map(len, fps), np.int64, len(fps)) // 8
            widths = by_width(words, fps)
            starts, counts = _tables(key)
            left, right = [], []
            small = counts <= min(table_rows, SMALL_ROWS)
            for i, j in _table_pairs(key, counts, small):
                ok = pairs(i, j, size, words, widths)
                left.append(i[ok])
                right.append(j[ok])
            for k in np.flatnonzero(~small):
                at, n = int(starts[k]), int(counts[k])
                near = lambda row, others, at=at: pairs(np.full(len(others), at + row), at + others, size, words, widths)
                label = reached(n, near)
                member = np.flatnonzero(label != np.arange(n))
                left.append(at + label[member])
                right.append(at + member)
            if left:
                ends = np.concatenate([ids[np.concatenate(left)], ids[np.concatenate(right)]]).reshape(2, -1)
                ends = np.unique(ends, axis=1)  # a pair meets in many tables
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])

    return run


def similar_links(nodes: DataFrame, similarity: float = SIMILARITY, table_rows: int = TABLE_ROWS) -> DataFrame:
    """Edges ``(a, b)``, some more than once, that connect all ids of ``nodes`` (id, size, fp, keys) that may be similar, and a few more."""
    keyed = nodes.select(F.posexplode("keys").alias("place", "key"), "id", F.col("size").cast("int").alias("size")).select("key", "id", "size", "place")
    shared = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared(similarity, table_rows), "key long, id long"), "similar-keys")
    tables = shared.join(nodes.select("id", "size", "fp"), "id").select("key", "id", "size", "fp").repartition("key").sortWithinPartitions("key")
    return tables.mapInArrow(_candidates(similarity, table_rows), "a long, b long")


class _Group:
    """The sets of one group, of which no more than a few are in memory: the rest lie in a temporary file."""

    def __init__(self, similarity: float):
        self.similarity, self.ids, self.size = similarity, [], []
        self.file = tempfile.SpooledTemporaryFile(GROUP_BYTES)

    def add(self, name: int, hashes: bytes) -> None:
        self.ids.append(name)
        self.size.append(len(hashes) // 8)
        self.file.write(hashes)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The hashes of the sets from row ``start`` to row ``stop``."""
        self.file.seek(8 * int(self.begin[start]))
        return np.frombuffer(self.file.read(8 * int(self.begin[stop] - self.begin[start])), np.uint64)

    def near(self, row: int, others: np.ndarray) -> np.ndarray:
        """Which of the other rows, in their order, are similar to a row."""
        size, total = self.size[others], self.size[others] + self.size[row]
        found = np.zeros(len(others), bool)
        fits = np.flatnonzero(np.minimum(size, self.size[row]) >= self.similarity * np.maximum(size, self.size[row]) - _SLACK)
        if not len(fits):
            return found
        mine, common = self.read(row, row + 1), np.zeros(len(others), np.int64)
        rows = others[fits]
        cuts = np.searchsorted(rows, self.cuts)
        for first, last, a, b in zip(self.cuts[:-1], self.cuts[1:], cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            runs = [(first, last)] if 8 * (b - a) > last - first else [(r, r + 1) for r in rows[a:b].tolist()]
            counts = []
            for start, stop in runs:
                tokens = self.read(start, stop)
                same = mine[np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)] == tokens
                counts.append(np.add.reduceat(same, self.begin[start:stop] - self.begin[start], dtype=np.int64))
            common[fits[a:b]] = counts[0][rows[a:b] - first] if runs[0] == (first, last) else np.concatenate(counts)
        found[fits] = common[fits] >= self.similarity * (total[fits] - common[fits]) - _SLACK
        return found

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and for each the one that stands for those that it reaches."""
        ids, self.size = np.array(self.ids, np.int64), np.array(self.size, np.int64)
        self.begin = np.append(0, np.cumsum(self.size))
        most = max(1, COMPARED_BYTES // 8)
        self.cuts = np.append(np.flatnonzero(np.append(True, np.diff(self.begin[:-1] // most))), len(ids)).tolist()
        with self.file:
            return ids, ids[reached(len(ids), self.near)]


def _exact(similarity: float):
    """For each set of a group (root, id, hashes) the one that stands for those that it reaches at the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, group, root = [], 0, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], ["fp", "root"])

        for batch in batches:
            for r, name, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if group is None or r != root:
                    if group is not None:
                        done.append(group.labels())
                        size += len(done[-1][0])
                    group, root = _Group(similarity), r
                group.add(name, hashes.as_py())
            if size >= 1 << 12:
                yield out()
                done, size = [], 0
        if group is not None:
            done.append(group.labels())
            yield out()

    return run


def _sets(batches: Iterator[pa.RecordBatch], words_per_shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_hashes(t, words_per_shingle) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([set_digest(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], ["digest", "hashes"])


def _stars(nodes: DataFrame, similarity: float, table_rows: int) -> DataFrame:
    """``(fp, root)``: candidates' links, and the groups that they make; each is written before the next begins."""
    spark = nodes.sparkSession
    links = settled(spark, lambda: _downward(similar_links(nodes, similarity, table_rows)), "similar-links")
    forget(spark)
    return components(links, written=True)


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """``(doc_id, th, component_id, stays)`` for each row: of each component the row with the least doc_id, then ``th``, stays.

    A null doc_id comes after all others. Rows alike in doc_id and text are one document. Each step reads files that the
    one before has written, so that plans stay short and no lost executor costs more than its step; what was written on
    the way is gone when the result is there.
    """
    spark = docs.sparkSession

    def exact(sets: DataFrame, groups: DataFrame) -> DataFrame:
        # Only texts of groups are read again, each for its set once.
        members = groups.join(sets.select(F.col("id").alias("fp"), "digest", "least"), "fp")
        wanted = members.select(F.coalesce("least.doc_id", F.lit(0)).alias("doc_id"), F.col("least.th").alias("th"))
        again = part(_slim(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(0))), wanted, "left_semi", ["doc_id", "th"])
        hashes = again.select("text").mapInArrow(lambda batches: _sets(batches, words_per_shingle), "digest binary, hashes binary").dropDuplicates(["digest"])
        grouped = members.join(hashes, "digest").select("root", "fp", "hashes").repartition("root").sortWithinPartitions("root", "fp")
        return grouped.mapInArrow(_exact(similarity), "fp long, root long")

    def named() -> DataFrame:
        prints = materialize(sketches(docs, id_col, text_col, words_per_shingle, similarity), "similar-sketches")
        sets = distinct_sets(prints)
        forget(spark)
        groups = settled(spark, lambda: _stars(sets.select("id", "size", "fp", "keys"), similarity, table_rows), "similar-groups")
        roots = settled(spark, lambda: exact(sets, groups), "similar-roots")
        forget(spark)
        nodes = sets.select(F.col("id").alias("fp"), "least")
        of_set = sets.select(F.col("id").alias("fp"), "digest").join(_least(nodes, roots), "fp").select(apart("digest", True).alias("digest"), "component")
        rows = prints.select("doc_id", "th", apart("digest", True).alias("digest"))
        stays = F.col("component.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("component.th") == F.col("th"))
        return rows.hint("merge").join(of_set.hint("merge"), "digest").select("doc_id", "th", F.col("component.doc_id").alias("component_id"), stays.alias("stays"))

    out = settled(spark, named, "similar")
    forget(spark)
    return out


def without_similar(docs: DataFrame, similarity: float = SIMILARITY, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the list of those that go is broadcast while it is short."""
    found = similar_documents(docs, similarity, words_per_shingle, id_col, text_col)
    gone = found.filter(~F.col("stays")).select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("th").alias("__th"))
    doc = F.col(f"row.`{id_col}`").cast("long")
    rows = boxed(docs).withColumns({"__id": F.coalesce(doc, F.lit(0)), "__th": row_hash(doc, f"row.`{text_col}`")})
    return unboxed(part(rows, gone, "left_anti", ["__id", "__th"]))
