"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, by DataFrame operations only.

The input is cut into ranges of a scan partition (at most ``2**chunk_bits`` rows each), and ranges are dealt out to source chunks
by a hash, so that there are at most ``MOST_CHUNKS``, however many partitions a scan has. How many rows of each
chunk go to each shard is drawn from the multivariate hypergeometric law, given the exact shard sizes: that matrix has
one row a chunk and is all that the driver sees, whatever the input's size; it is dealt out as a small file in the shared folder. Each chunk is permuted on its own and dealt out by its row of the
matrix; rows are exchanged; each shard is permuted again, in ranges of a random key, so that no task holds a shard.

Law: ``rows`` (shard counts are at most one apart). Sizes are UTF-8 bytes of the text plus 1.

Defined results: a null text has size 1 and the CRC of an empty text; null doc_ids and repeated rows are rows like any
other; with fewer rows than shards some shards are empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm._common import materialize, new_path, whole_text, write_bytes

CHUNK_BITS = 18
#: Rows of the matrix; 10 billion documents make chunks of some 600,000 narrow rows, which a window sorts and spills.
MOST_CHUNKS = 16_384
RANGE_ROWS = 1 << 18


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows, taken without replacement from ``good + bad``, are good: inversion from the mode."""
    from math import exp, lgamma

    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def matrix(counts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows go from each chunk to each shard: row sums are ``counts``, column sums are ``shards``."""
    rng, left, out = random.Random(seed), list(shards), []
    for n in counts:
        row, rest = [], sum(left)
        for at, room in enumerate(left):
            rest -= room
            row.append(hypergeometric(rng, room, rest, n - sum(row)) if at < len(left) - 1 else n - sum(row))
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shard(docs: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", chunk_bits: int = CHUNK_BITS, most_chunks: int = MOST_CHUNKS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row."""
    spark, text = docs.sparkSession, whole_text(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("at"))
    rows = materialize(slim, "sharding")  # from here on a row's chunk and place are fixed
    total = rows.count()
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.shiftright("at", chunk_bits)), F.lit(most_chunks)))
    chunks = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).orderBy("chunk").collect()
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    lines = (json.dumps({"chunk": c["chunk"], "ends": list(accumulate(row))}) for c, row in zip(chunks, matrix([c["n"] for c in chunks], sizes, seed), strict=True))
    write_bytes(spark, path := new_path(spark, "matrix"), "\n".join(lines).encode())
    dealt = spark.read.schema("chunk bigint, ends array<bigint>").json(path)

    first = W.partitionBy("chunk").orderBy(F.xxhash64("at", F.lit(seed)), "at")
    sent = rows.withColumn("k", F.row_number().over(first)).join(dealt.hint("merge"), "chunk")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("k"))))
    ranges = max(1, -(-total // (shards * range_rows)))
    key = F.xxhash64("at", F.lit(seed + 1))
    sent = sent.select("doc_id", "size", "text_crc32", "at", "shard", key.alias("key"), F.pmod(F.shiftright(key, 24), F.lit(ranges)).alias("range"))
    before = sent.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)))
    again = W.partitionBy("shard", "range").orderBy("key", "at")
    placed = sent.withColumn("k", F.row_number().over(again)).join(before.select("shard", "range", "base").hint("merge"), ["shard", "range"])
    slot = F.coalesce("base", F.lit(0)) + F.col("k") - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
