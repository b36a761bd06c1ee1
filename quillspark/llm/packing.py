"""Best-fit packing of token sequences by a configuration linear program.

Each document is its token ids and one end id. Only longer ones are cut, into pieces of ``capacity`` tokens, of which
the first may be shorter. The lengths of the pieces form a histogram of at most ``capacity`` entries, which is all that
the driver sees. Over it, a configuration is a multiset of lengths that fits into one sequence; the program that covers
the histogram with the fewest configurations is solved by multiplicative weights, whose oracle prices a configuration
by dynamic programming for the knapsack. The rounds form a fractional mix of configurations; a bound from dual prices
tells how far it can be from the optimum, and prices are learned anew where that is too far. The mix is rounded down,
what that leaves is mixed and rounded again, and the few pieces that are left at last (their number depends on the
number of configurations, not on the input) are placed best-fit, longest first. There is no other plan.

The plan has ranges: "pieces of length l with ranks from a to b go to sequences from s on, at offset o". Pieces get
their ranks within a length by counts per chunk of the written piece table, so that a very common length is dealt to
many tasks, and look their places up in the broadcast plan, whose size is bounded by the number of configurations.

Defined results: a null or empty text is the end id alone; repeated rows and null doc_ids are documents like any other;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm._common import hold, materialize, tune, whole_text

CAPACITY = 1024
END_ID = 2
#: Rounds of the fractional mix: most, and the share of a length that one of few lengths gives in a round.
MIX_ROUNDS, LEAST_SHARE = 2500, 0.005
#: Rounds in which prices are learned, and how far above the dual bound a mix may be without that.
LEARNING_ROUNDS, GAP = 400, 5e-4
#: Steps of the finest closed prices of the dual bound.
DUAL_STEPS = 100
#: Configurations that are taken of one table of prices, and the share of the best value that they have at least.
SEVERAL, NEARLY = 16, 0.999
#: The share of a mix that has to be whole for it to be rounded once more.
LEAST_WHOLE = 0.02


# Tokens


class Encoder:
    """Token ids of texts by one of the public byte-level vocabularies.

    The vocabulary's JSON file is what defines the ids. Its twin of plain ranks gives the same ids several times faster
    for texts of Latin letters, digits, punctuation and white space below U+0250, without the names of special tokens;
    other texts take the JSON file's own tokenizer.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        import base64
        import os
        import re

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.fast = None
        if ranks:
            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.other = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]" + "".join(f"|{re.escape(x.content)}" for x in self.slow.get_added_tokens_decoder().values()))

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.other.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, chunk)`` for each piece, and ``ids`` if asked for."""
    cached = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            cached.append(Encoder(vocabulary, ranks))
        encode = cached[0].ids
        for b in batches:
            rows = []
            for doc, text, chunk in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[start:stop]
                    rows.append((doc, k, start, stop - start, zlib.crc32(part.tobytes()), chunk, *([part.astype(np.int32)] if with_ids else [])))
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", *["ids"] * with_ids]
    tune(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), F.shiftright(F.monotonically_increasing_id(), 18).alias("chunk"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long" + ", ids array<int>" * with_ids)


# The configuration program


def price(values: np.ndarray, most: np.ndarray, capacity: int, several: int = 1) -> list[dict[int, int]]:
    """The configuration of the largest value: length -> how many, none more than there are pieces of it.

    The same table gives the best configuration with each length in it: of those worth ``NEARLY`` as much, up to
    ``several`` that have no length in common are given, the best one first.
    """
    lengths = np.flatnonzero((values > 0) & (most > 0))
    if not len(lengths):
        return []
    low, high = int(lengths[0]), int(lengths[-1])
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = values[lengths]
    best = np.zeros(capacity + 1)  # from the end: best[capacity - room], so that what is added lies side by side
    took = np.zeros(capacity + 1, np.int64)
    for room in range(low, capacity + 1):
        top = min(room, high)
        gain = best[capacity - room + low : capacity - room + top + 1] + worth[low : top + 1]
        k = int(gain.argmax())
        here, before = capacity - room, best[capacity - room + 1]
        if gain[k] > before:
            best[here], took[room] = gain[k], k + low
        else:
            best[here] = before
    value = worth[lengths] + best[lengths]  # of the best configuration with each length
    out: list[dict[int, int]] = []
    taken: set[int] = set()
    for at in np.argsort(-value, kind="stable").tolist():
        if value[at] < NEARLY * best[0] or len(out) == several:
            break
        config = Counter([int(lengths[at])])
        room = capacity - int(lengths[at])
        while room >= low and best[capacity - room] > 0:
            if took[room] == 0:
                room -= 1
                continue
            config[int(took[room])] += 1
            room -= int(took[room])
        if taken.isdisjoint(config):
            taken.update(config)
            out.append({k: int(min(n, most[k])) for k, n in config.items()})
    return out


def dual_bound(counts: np.ndarray, capacity: int) -> float:
    """Sequences that no plan undercuts, by prices known in closed form: no configuration is worth more than 1 at any of them.

    These are proportion to the length; 1, the proportion or a half, and 0 for long, middle and short pieces; and the
    proportion stepped down to multiples of 1/k.
    """
    at = np.arange(len(counts))
    even = at / capacity
    best = float(counts @ even)
    for short in range(1, capacity // 2 + 1):
        middle = [even] if 3 * short <= capacity else [even, np.full(len(counts), 0.5)]  # beyond a third two fit, not three
        best = max(best, *(float(counts @ np.where(at > capacity - short, 1.0, np.where(at < short, 0.0, m))) for m in middle))
    for k in range(1, DUAL_STEPS + 1):
        best = max(best, float(counts @ np.where((k + 1) * at % capacity == 0, even, (k + 1) * at // capacity / k)))
    return best


def learned(counts: np.ndarray, capacity: int, rounds: int = LEARNING_ROUNDS, first: float = 0.1, last: float = 0.001) -> tuple[list[np.ndarray], float]:
    """Prices by multiplicative weights, the best of all rounds and the mean of the second half, and the better one's bound.

    Each round prices by the weights, and a length's weight falls by how much more than the mean of all it is covered by
    the configurations of the largest prices; the steps shrink. Prices divided by the value of the best configuration
    are a solution of the dual program, so their worth of all pieces is a bound.
    """
    some = counts > 0
    all_of = np.where(some, capacity, 0)
    y = np.where(some, np.arange(len(counts)) / capacity, 0.0)
    best, bound, mean = y, 0.0, np.zeros(len(counts))
    for k in range(rounds):
        configs = price(y, all_of, capacity, SEVERAL)
        y = y / sum(y[length] * n for length, n in configs[0].items())
        worth = float(counts @ y)
        if worth > bound:
            best, bound = y, worth
        if 2 * k >= rounds:
            mean += y
        covered = np.zeros(len(counts))
        for config in configs:
            times = min(counts[length] / n for length, n in config.items())
            for length, n in config.items():
                covered[length] += n * times / counts[length]
        y = y * np.exp(-first * (last / first) ** (k / rounds) * (covered - (covered * counts) @ y / worth))
        y = np.where(some, np.maximum(y, 1e-6 * y.max()), 0.0)
    top = price(mean, all_of, capacity)[0]
    mean /= sum(mean[length] * n for length, n in top.items())
    return [best, mean], max(bound, float(counts @ mean))


def mix(counts: np.ndarray, capacity: int, prices: np.ndarray, step: float = 0.003, rounds: int = MIX_ROUNDS, convex: float = 0.05) -> dict[tuple[tuple[int, int], ...], float]:
    """A fractional solution: configurations and how often each is used; each length is covered exactly.

    A configuration's multiplicities are not held to the counts, so that rare lengths are no tighter than in the
    program. Each round prices by ``prices``, slightly more for long pieces, times the weights; it uses the
    configurations of the largest prices, each for a small share of its scarcest length, so that a configuration comes
    again among others. A length's weight falls by ``exp(-step)`` for each such share of its count that is covered, so
    that what lags comes first and all lengths run out together.
    """
    used: Counter[tuple[tuple[int, int], ...]] = Counter()
    left, weights = counts.astype(float), np.ones(len(counts))
    base = prices * (np.arange(len(counts)) / capacity) ** convex
    share = min(1.0, max(LEAST_SHARE, 1.3 * np.count_nonzero(counts) / rounds))
    for _ in range(rounds):
        configs = price(np.where(left > 0, base * weights, 0), np.where(left > 0, capacity, 0), capacity, SEVERAL)
        if not configs:
            break
        for config in configs:
            times = min(min(share * counts[k] / n, left[k] / n) for k, n in config.items())
            used[tuple(sorted(config.items()))] += times
            for k, n in config.items():
                left[k] = left[k] - n * times if left[k] - n * times > 1e-9 * counts[k] else 0
                weights[k] *= np.exp(-step / share * n * times / counts[k])
        weights /= weights[left > 0].max() if (left > 0).any() else 1
    for k in np.flatnonzero(left > 0).tolist():  # where the rounds did not suffice
        used[((k, capacity // k),)] += left[k] / (capacity // k)
    return dict(used)


def cover(counts: np.ndarray, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float, np.ndarray, float]:
    """The covering program: the mix of the least value that was found, a dual bound, and the mix's prices and step.

    The first mix prices in proportion to length. While the least value is over ``GAP`` above the bound, the mix is made
    again with prices that were learned.
    """
    bound = dual_bound(counts, capacity)
    even = np.arange(len(counts)) / capacity
    found, prices, step = mix(counts, capacity, even), even, 0.003
    if sum(found.values()) > (1 + GAP) * bound and counts.any():
        (best, mean), other = learned(counts, capacity)
        bound = max(bound, other)
        for y, eta in ((mean, 0.003), (best, 0.01), (best, 0.003)):
            if sum(found.values()) <= (1 + GAP) * bound:
                break
            again = mix(counts, capacity, y, eta)
            if sum(again.values()) < sum(found.values()):
                found, prices, step = again, y, eta
    return found, bound, prices, step


def rounded(counts: np.ndarray, capacity: int) -> Counter[tuple[tuple[int, int], ...]]:
    """Whole numbers of configurations that cover every length exactly: the mix rounded down, again and again, then best-fit.

    What a rounding leaves is a program of its own, for which the mix is made anew at the same prices; once a mix has
    hardly a whole configuration in it, the pieces that are left are placed best-fit.
    """
    out: Counter[tuple[tuple[int, int], ...]] = Counter()
    left = counts.astype(np.int64).copy()
    found, _, prices, step = cover(left, capacity)
    while left.any():
        whole = {config: int(times + 1e-9) for config, times in found.items() if times >= 1 - 1e-9}
        if sum(whole.values()) < LEAST_WHOLE * sum(found.values()):
            break
        out.update(whole)
        for config, times in whole.items():
            for length, n in config:
                left[length] -= n * times
        found = mix(left, capacity, prices, step)
    out.update(_best_fit(left, capacity))
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Ranges ``(length, first rank, end rank, first sequence, offset)`` by length and rank, and the number of sequences."""
    left = counts.astype(np.int64).copy()
    ranges: list[tuple[int, int, int, int, int]] = []
    done = np.zeros(len(counts), np.int64)
    sequences = 0

    def use(config: tuple[tuple[int, int], ...], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length, n in config:
            for _ in range(n):
                ranges.append((length, int(done[length]), int(done[length]) + times, sequences, offset))
                done[length] += times
                left[length] -= times
                offset += length
        sequences += times

    if capacity < len(left) and left[capacity]:
        use(((capacity, 1),), int(left[capacity]))
    for config, times in sorted(rounded(left, capacity).items(), key=lambda c: -c[1]):
        use(config, times)
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    return table, sequences


def _best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing: the longest piece opens a sequence, the longest that still fits follows, by the histogram."""
    left, out = left.copy(), Counter()
    lengths = np.flatnonzero(left)[::-1].tolist()
    rest = {k: int(left[k]) for k in lengths}
    while rest:
        room, config = capacity, Counter()
        for k in sorted(rest, reverse=True):
            if k > room:
                continue
            n = min(rest[k], room // k)
            config[k] += n
            room -= k * n
            if not room:
                break
        times = min(rest[k] // n for k, n in config.items())
        out[tuple(sorted(config.items()))] += times
        for k, n in config.items():
            rest[k] -= n * times
            if not rest[k]:
                del rest[k]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """A row for each piece: its document, its place there, its sequence and its place in that."""
    spark = docs.sparkSession
    rows = materialize(pieces(docs, capacity=capacity, **options), "pieces")
    per_chunk = hold(rows.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for x in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[x["length"]] = x["n"]
    table, _ = plan(counts, capacity)
    base = per_chunk.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))).select("length", "chunk", F.coalesce("base", F.lit(0)).alias("base"))
    order = W.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(base.hint("merge"), ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "chunk")
    held = spark.sparkContext.broadcast(table)
    keep = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        keys = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.names.index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            place = [pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in keep), *place], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in keep)
    out = ranked.mapInArrow(run, schema + ", sequence_id long, offset long")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *[c for c in keep if c == "ids"])
