"""Secret scans through an incremental blob ledger.

Every historical version of a file is content-addressed: its blob is the SHA-256 of its text. A ledger in the shared
folder holds, for each pair of blob and rule version, what a scan found. A scan takes only pairs that the ledger has not
seen, and appends; findings are then joined back to all paths. No text is shuffled: where the ledger knows nothing yet,
texts are scanned where they lie, a blob once a task; else the list of unseen blobs, counted before they are shuffled,
is broadcast to the texts, and only a list too long for that makes texts meet their blobs by a shuffle, by path, not by
blob. Texts with very many copies cost one narrow row for each task. One writer at a time adds to a ledger.

The base rules are ``assign``, ``access`` and ``hex``; the method adds ``pem``, ``ghp``, ``jwt`` and ``slack``, whose
spans overlap none of the base. Offsets are code points, end exclusive.

Defined results: a null text is the empty blob, which has no findings; a null path is a path like any other; rows that
repeat are versions of the same path; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm._common import BROADCAST_ROWS, alone, exists, hold, new_path, tune, whole_text

#: A ledger keeps it with a digest of the patterns: blobs are scanned again whenever a rule changes.
RULES_VERSION = "1"

# The base rules, in the order in which kinds are listed, with the least length of what counts.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Names the folder of a ledger that outlives a query; unset, a query starts with an empty one.
LEDGER_SETTING = "spark.quill.ledger"
#: Blobs that a task remembers having scanned.
REMEMBERED = 1_000_000
#: A cheap test for texts that may hold a match of "hex", whose pattern meets every word.
LONG_HEX = re.compile(r"[0-9a-f]{32}")

#: All up to the key's END line, header lines included; of a key without one, header lines and what may be its body.
PEM = r"""
    -----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----
    (?: [^-]*+ (?: -(?!----BEGIN\x20|----END\x20[A-Z\x20]*PRIVATE\x20KEY-----) [^-]*+ )*+ -----END\x20[A-Z\x20]*PRIVATE\x20KEY-----
      | (?: \s*+ [A-Za-z0-9-]++ : [^\n]*+ \n )*+ [A-Za-z0-9+/=\s]*+ )
"""

# Further rules.
MORE = (
    ("pem", re.compile(PEM, re.VERBOSE), "-----BEGIN "),
    ("ghp", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), "eyJ"),
    ("slack", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
)
ORDER = {name: k for k, name in enumerate([*(b[0] for b in BASE), *(m[0] for m in MORE)])}


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans ``(kind, start, end)``, each sorted by start, then kind as listed."""
    base: list[tuple[str, int, int]] = []
    for kind, pattern, group, least in BASE:
        if kind == "access" and "AKIA" not in text or kind == "hex" and not LONG_HEX.search(text):
            continue
        base += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    more = [(kind, *m.span()) for kind, pattern, mark in MORE if mark in text for m in pattern.finditer(text) if all(m.end() <= a or m.start() >= b for _, a, b in base)]
    key = lambda s: (s[1], ORDER[s[0]])
    return sorted(base, key=key), sorted(more, key=key)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])))


def kept_as(version: str) -> str:
    """A rule version as a ledger keeps it."""
    rules = repr([(kind, p.pattern, p.flags, *rest) for kind, p, *rest in (*BASE, *MORE)])
    return f"{version}:{hashlib.sha256(rules.encode()).hexdigest()[:16]}"


FOUND = "blob binary, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_TYPES = {"string": pa.string(), "long": pa.int64()}


def _scan(version: str):
    """Findings beside each row's blob; null where the task has scanned the blob before."""
    names = [x.split() for x in FOUND.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for blob, text in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if blob in seen:
                    rows.append((None,) * len(names))
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(blob)
                base, more = scan(text)
                n = [sum(s[0] == kind for s in base) for kind in ("assign", "access", "hex")]
                rows.append((version, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more])))
            if rows:
                made = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], *(n for n, _ in names)])

    return run


def _scanned(versions: DataFrame, version: str) -> DataFrame:
    """``versions`` (some columns, blob, text) with findings in place of the text, held."""
    tune(versions.sparkSession)
    kept = versions.select(*versions.columns[:-1])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(FOUND).fields[1:]])
    return hold(versions.mapInArrow(_scan(kept_as(version)), schema))


class Ledger:
    """What was found in each pair of blob and rule version; ``path`` names its folder, an existing one is opened."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")
        if not exists(spark, self.path):
            spark.createDataFrame([], FOUND).write.parquet(self.path)

    def found(self, version: str) -> DataFrame:
        return self.spark.read.schema(FOUND).parquet(self.path).filter(F.col("rules") == kept_as(version))

    def add(self, versions: DataFrame, version: str = RULES_VERSION) -> DataFrame:
        """Scan the blobs of ``versions`` (path, blob, text) that are new under this rule version, and append; ``(path, blob)`` of all."""
        with alone(self.spark, self.path):
            known = self.found(version).select("blob")
            if known.isEmpty():
                paths = new = _scanned(versions, version)
            else:
                paths = hold(versions.select("path", "blob"))
                unseen = hold(paths.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti"))
                n = unseen.count()
                if n <= BROADCAST_ROWS:
                    texts = versions.join(F.broadcast(unseen.select("blob")), "blob", "left_semi").select("blob", "text")
                else:
                    one = unseen.select(F.col("blob").alias("__blob"), F.col("path").alias("__path"))
                    same = F.col("path").eqNullSafe(F.col("__path")) & (F.col("blob") == F.col("__blob"))
                    texts = versions.hint("merge").join(one.hint("merge"), same).select("blob", "text")
                new = _scanned(texts, version) if n else None
            if new is not None:
                some = new.filter(F.col("rules").isNotNull()).select("blob", *[x.split()[0] for x in FOUND.split(", ")[1:]])
                some.dropDuplicates(["blob"]).hint("rebalance").write.mode("append").parquet(self.path)
        return paths.select("path", "blob")


def scan_versions(docs: DataFrame, ledger: Ledger | None = None, path_col: str = "doc_id", text_col: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """The findings of every path's version: ``path``, the counts, ``base_sha256`` and ``spans``.

    The ledger is the one given, or that in the folder that the setting ``spark.quill.ledger`` names, or a new one.
    """
    spark, text = docs.sparkSession, whole_text(text_col)
    ledger = ledger or Ledger(spark, spark.conf.get(LEDGER_SETTING, None))
    versions = docs.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
    paths = ledger.add(versions, version)
    found = ledger.found(version).drop("rules")  # one row for each blob: joined by it without a sum, hot blobs split
    return paths.hint("merge").join(found.hint("merge"), "blob").drop("blob")
