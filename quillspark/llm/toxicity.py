"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a learned lexicon (words and word beginnings that toxic documents have far more
often than chance allows) and of a small fixed one, how near lexicon words stand to second-person words, rates of
capitals, of punctuation and of obfuscated words. Labels are read only from rows that are not held out; a row is held
out when the CRC-32 of its doc_id as text, modulo 4, is 2. Labels, language, source and doc_id are never features.

The fit takes at most ``MOST_LABELLED`` labelled rows, those with the smallest hashes of their doc_id; every document is
scored. The rows are dealt into ``FOLDS``: a row's features are computed with the lexicon of the other folds' rows, as a
new text's are with the lexicon of all rows, so that trees, calibration and scoring see features of one law. One fold
fits the calibration, the others the trees. A doc_id that stands in several documents lends its label to each.

Defined results: a null or empty text has all features zero and is scored like any other; null labels and labels of no
document are left out; without labels of both kinds every score is their mean, or 0 without any; repeated rows get the
same score; a null doc_id is not held out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm._common import boxed, hold, tune, unboxed, whole_text

MOST_LABELLED = 40_000
FALSE_WORDS = 0.01
FOLDS = 5
CUT = 0.3

# A small lexicon, and second-person words of four languages.
INSULTS = frozenset("idiot moron stupid loser pathetic worthless disgusting trash scum clown dumb fool jerk creep filth hate ugly".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros os".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

LETTERS = re.compile(r"[^\W\d_]+")
#: A mark or digit within a word; the letters before it are added where it is found.
MASKED = re.compile(r"[^\W\d_][0-9@$!|*_.-][^\s,;:]*[^\W\d_]")
MARKS = "*#$%&"
#: Lengths of the beginnings of words that are looked up as well as words.
STARTS = (4, 5)
NAMES = ("log_words", "hits", "hit_density", "hit_weight", "weight_density", "strongest", "distinct_hits", "insult_density", "you_density", "near_you", "near_you_share", "capitals", "shouted", "exclaims", "questions", "other_marks", "obfuscated", "obfuscated_hits", "stretched", "clustered")


def starts_of(word: str) -> tuple[str, ...]:
    """The beginnings of a word that the lexicon may hold, marked."""
    return tuple(word[:n] + "-" for n in STARTS)


class Features:
    """Computes the features of texts; it remembers what words are worth, as far as memory allows."""

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        self.lexicon, self.known, self.most = lexicon, {}, most

    def worth(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.most:
                self.known.clear()
            get = self.lexicon.get
            found = self.known[word] = max(get(word, 0.0), *(get(t, 0.0) for t in starts_of(word)))
        return found

    def of(self, text: str) -> list[float]:
        if not text:
            return [0.0] * len(NAMES)
        words = LETTERS.findall(text.lower())
        n, seen = len(words), set(words)
        per = 100 / max(n, 1)
        worth = {w: value for w in seen if (value := self.worth(w))}
        hits = [k for k, w in enumerate(words) if w in worth] if worth else []
        weight = sum(worth[words[k]] for k in hits)
        near = sum(not YOU.isdisjoint(words[max(0, k - 4) : k + 5]) for k in hits)
        clustered = first = 0  # most hits among 50 words
        for last, k in enumerate(hits):
            while k - hits[first] >= 50:
                first += 1
            clustered = max(clustered, last - first + 1)
        insults = sum(w in INSULTS for w in words) if not seen.isdisjoint(INSULTS) else 0
        you = sum(w in YOU for w in words) if not seen.isdisjoint(YOU) else 0
        odd = [self._whole(text, m) for m in MASKED.finditer(text)]
        unmasked = [w for x in odd for w in LETTERS.findall(x.lower().translate(LEET))]
        capitals, shouted, stretched = _letters(text)
        marks = sum(map(text.count, MARKS))
        return [
            math.log1p(n), len(hits), len(hits) * per, weight, weight * per, max(worth.values(), default=0.0), len(worth), insults * per,
            you * per, near, near / max(len(hits), 1), capitals / len(text), shouted * per, text.count("!") * per, text.count("?") * per, marks * per,
            len(odd) * per, sum(bool(self.worth(w)) or w in INSULTS for w in unmasked), stretched * per, clustered,
        ]

    @staticmethod
    def _whole(text: str, m: re.Match) -> str:
        start = m.start()
        while start and text[start - 1].isalpha():
            start -= 1
        return text[start : m.end()]


def _letters(text: str) -> tuple[int, int, int]:
    """Capitals, words of three and more capitals, and letters that stand three times in a row; of A to Z."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = (b >= 65) & (b <= 90)
    n = int(upper.sum())
    shouted = 0
    if n >= 3:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], upper, [False]]).astype(np.int8)))
        shouted = int((edges[1::2] - edges[::2] >= 3).sum())
    same = b[1:] == b[:-1]
    triple = same[1:] & same[:-1]
    stretched = int((((b[2:] | 32) >= 97) & ((b[2:] | 32) <= 122) & triple).sum()) if triple.any() else 0
    return n, shouted, stretched


# Trees


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    bias: float = 0.0
    cuts: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    steps: tuple = ()

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for which, limits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for depth in range(int(math.log2(len(leaves)))):
                at = node + (1 << depth) - 1
                node = node * 2 + (x[np.arange(len(x)), which[at]] > limits[at])
            out += leaves[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.prior)
        p = self.raw(x)
        xs, ys = self.steps
        return np.clip(np.interp(p, xs, ys) + 1e-6 * np.tanh(p / 10), 0, 1)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, bins: int = 32) -> Model:
    """Logistic gradient boosting with complete trees of ``depth`` over quantile bins."""
    prior = float(y.mean())
    model = Model(prior=prior, bias=math.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(c[c > c.min()] if (c > c.min()).any() else c, np.linspace(0, 1, bins))) for c in x.T]
    cuts = [np.unique(np.concatenate([[c.min()], k])) for c, k in zip(x.T, cuts, strict=True)]
    binned = np.stack([np.searchsorted(k, c, side="left") for c, k in zip(x.T, cuts, strict=True)], 1)  # bin b: value <= cuts[b]
    width = max(map(len, cuts)) + 1
    raw = np.full(len(y), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        which, limits = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            n = 1 << d
            best = np.full(n, 1e-9)
            for f in range(x.shape[1]):
                at = node * width + binned[:, f]
                gs = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                hs = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain = np.where((hs > 1) & (ha - hs > 1), gain, 0)[:, : len(cuts[f])]
                k = gain.argmax(1)
                better = gain[np.arange(n), k] > best
                best = np.where(better, gain[np.arange(n), k], best)
                at = np.arange(n) + n - 1
                which[at[better]], limits[at[better]] = f, cuts[f][k[better]]
            at = node + n - 1
            node = node * 2 + (x[np.arange(len(x)), which[at]] > limits[at])
        leaves = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
        raw += leaves[node]
        model.trees.append((which, limits, leaves))
    return model


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step fit of y on p by pooling adjacent violators: points to interpolate between.

    Each block's mean is drawn towards 1/2 by one row of both kinds together, so that no score is quite 0 or 1.
    """
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, lowest p, highest p
    for at, value in zip(p[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([value, 1, at, at])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    xs, ys = [], []
    for s, n, low, high in blocks:
        xs += [low, high]
        ys += [(s + 0.5 * 0.1) / (n + 0.1)] * 2
    return np.array(xs), np.maximum.accumulate(np.array(ys))


# The operator


TOXIC, ALL = [f"t{f}" for f in range(FOLDS)], [f"n{f}" for f in range(FOLDS)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each token by fold, of label 1 and in all, summed as memory allows."""

    def fresh():
        """By fold and whether rows are toxic: words, and beginnings of words."""
        return {(f, y): (Counter(), Counter()) for f in range(FOLDS) for y in (False, True)}

    def out(seen):
        for kind, mark in ((0, ""), (1, "-")):
            every = list(set().union(*(seen[k][kind] for k in seen)))
            get = lambda f, y: np.fromiter(map(seen[f, y][kind].__getitem__, every), np.int64, len(every))  # noqa: B023, E731
            toxic = [get(f, True) for f in range(FOLDS)]
            some = np.flatnonzero(sum(toxic))  # a token of no toxic document is never asked for
            both = [t + get(f, False) for f, t in enumerate(toxic)]
            yield pa.RecordBatch.from_arrays([pa.array([every[k] + mark for k in some.tolist()], pa.string()), *(pa.array(c[some]) for c in (*toxic, *both))], ["token", *TOXIC, *ALL])

    seen, rows = fresh(), 0
    for b in batches:
        for text, y, fold in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            words = set(LETTERS.findall(text.lower()))
            whole, starts = seen[fold, y]
            whole.update(words)
            starts.update({w[:n] for n in STARTS for w in words})
            rows += 1
        if sum(len(whole) for whole, _ in seen.values()) > 300_000:
            yield from out(seen)
            seen, rows = fresh(), 0
    if rows:
        yield from out(seen)


def lexicons(counts: DataFrame, toxic: list[int], rows: list[int]) -> list[dict[str, float]]:
    """For each fold the lexicon of all other folds' rows, and at last that of all rows.

    A lexicon has the tokens with more toxic documents than chance gives to tokens as many as were tried, by Chernoff's
    bound, and their log odds.
    """
    every_t, every_n = sum(F.col(c) for c in TOXIC), sum(F.col(c) for c in ALL)
    sides = []
    for f in range(FOLDS + 1):
        t, m = (every_t - F.col(TOXIC[f]), every_n - F.col(ALL[f])) if f < FOLDS else (every_t, every_n)
        n_toxic, n = sum(toxic) - (toxic[f] if f < FOLDS else 0), sum(rows) - (rows[f] if f < FOLDS else 0)
        if not 0 < n_toxic < n:
            sides.append((F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(False)))
            continue
        base, share = F.lit(n_toxic / n), F.greatest(t, F.lit(1)) / F.greatest(m, F.lit(1))  # tokens of the fold alone have none
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        rare = m * (share * F.log(share / base) + rest)
        odds = F.log((t + 0.5) / (m - t + 0.5)) - F.log(base / (1 - base))
        # Even as the last of all that were tried, a token has to be this rare, so the others need not be collected.
        some = (t >= 3) & (share > base) & (odds > 1.5) & (rare >= -math.log(FALSE_WORDS) - 1e-9)
        sides.append((t >= 3, odds, rare, some))
    tried = counts.agg(*[F.count(F.when(side[0], 1)).alias(f"c{f}") for f, side in enumerate(sides)]).first()
    told = F.array(*[F.when(some, F.struct(rare.alias("rare"), odds.alias("odds"))) for _, odds, rare, some in sides])
    found = counts.select("token", told.alias("told")).filter(F.exists("told", lambda x: x.isNotNull())).collect()
    out = []
    for f in range(FOLDS + 1):
        # Benjamini and Hochberg's rule: the longest list of which a share of FALSE_WORDS at most is expected to be chance.
        top = sorted(((-r["told"][f]["rare"], r["token"], r["told"][f]["odds"]) for r in found if r["told"][f] is not None), key=lambda x: x[:2])
        n = max((k for k, x in enumerate(top, 1) if -x[0] >= math.log(max(1, tried[f]) / (k * FALSE_WORDS))), default=0)
        out.append({token: odds for _, token, odds in top[:n]})
    return out


def _features(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [Features(lexicon, 60_000).of for lexicon in held.value]
        for b in batches:
            x = [of[fold](t) for t, fold in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bounded(joined: DataFrame, most: int) -> DataFrame:
    """``(text, y, fold)`` of at most so many labelled rows (__id, text, y, fold), held: their texts are read three times.

    An id may stand in many rows. Rows alike in id, text and label count once; beyond the bound those of the least hashes of
    the id and then of the text stay.
    """
    joined = hold(joined.withColumn("th", F.xxhash64("text")))
    key = ["__id", "th", "y", "fold"]
    kept = joined.select(*key).distinct().orderBy(F.xxhash64("__id"), *key).limit(most)
    if joined.count() > kept.count():
        joined = hold(joined.join(F.broadcast(kept), key, "left_semi").groupBy(*key).agg(F.first("text").alias("text")))
    return joined.select("text", "y", "fold")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> Model:
    spark = docs.sparkSession
    tune(spark)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    some = known.select(F.col(id_col).cast("long").alias("__id"), (F.col(label_col) != 0).alias("y")).orderBy(F.xxhash64("__id"), "__id", "y").limit(most)
    some = some.withColumn("fold", F.pmod(F.xxhash64(F.col("__id"), F.lit(3)), F.lit(FOLDS)).cast("int"))
    rows = _bounded(docs.select(F.col(id_col).cast("long").alias("__id"), whole_text(text_col).alias("text")).join(F.broadcast(some), "__id"), most)
    by_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(F.sum(F.col("y").cast("long")).alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    toxic, n = ([by_fold[f][k] if f in by_fold else 0 for f in range(FOLDS)] for k in ("t", "n"))
    if not 0 < sum(toxic[1:]) < sum(n[1:]):
        return Model(prior=sum(toxic) / sum(n) if sum(n) else 0.0)
    counts = rows.mapInArrow(_count, ", ".join(["token string", *(f"{c} long" for c in (*TOXIC, *ALL))]))
    counts = hold(counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in (*TOXIC, *ALL)]).filter(" + ".join(TOXIC) + " >= 3"), 4096)
    *others, whole = lexicons(counts, toxic, n)
    held = spark.sparkContext.broadcast(others)
    data = rows.mapInArrow(_features(held), "y boolean, fold int, x array<double>").collect()
    x, y, c = np.array([r["x"] for r in data]), np.array([r["y"] for r in data], float), np.array([r["fold"] for r in data]) == 0
    model = boost(x[~c], y[~c])
    model.lexicon = whole
    both = c if 0 < y[c].sum() < c.sum() else ~c
    model.steps = isotonic(model.raw(x[both]), y[both])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return scored_rows(slim, model).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def scored_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` as one column ``row``, and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        of = Features(m.lexicon).of
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array([of(t or "") for t in b.column(0).field(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x), pa.float64())], ["row", "score"])

    rows = boxed(docs)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT, **names) -> DataFrame:
    """The documents that score below ``cut``, with their own columns."""
    return unboxed(scored_rows(docs, fit(docs, labels, **names), names.get("text_col", "text")).filter(F.col("score") < cut))
