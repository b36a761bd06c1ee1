"""URL verdicts: fixed rules first, else logistic regression on hashed character n-grams of host and path.

The model is trained on a small labelled URL table, whose n-grams are counted by the same DataFrame expressions that
score the pages; the driver fits one weight a bucket. Scoring is a sum of weights within an expression: DataFrame
operations only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#``
or the end, with its leading slash. A rule ``host/path`` fits its host and all subdomains when the path starts with the
rule's from the slash on; the longest rule wins.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and takes the model's
verdict on them, which is the intercept's; null page_ids and repeated rows are rows like any other; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4)
#: Labelled rows that the fit takes at most: a table of URLs by hand is far below.
MOST_LABELLED = 20_000

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

# Words of hosts to be blocked (gambling, pills, adult, pirated, malware, loans, tracking, spam) and of ordinary ones, what hosts end in, and paths.
BLOCKED = """
casino bet bets gambling poker slots jackpot roulette lottery prize win winner pills meds pharmacy viagra steroid xxx porn adult cams escort nude warez crack
keygen torrent nulled malware phish trojan payday loans replica clicks ads track popup spam promo seo linkfarm bonus hack cheats
""".split()
ALLOWED = """
news weather library museum university school college academy blog garden docs wiki history recipes cooking travel maps science journal research health
hospital clinic music radio theatre sports football nature forest ocean river city council government books novels poetry letters archive art design
photo architecture energy climate farming bakery coffee market bank post railway airport hotel church charity chess cycling astronomy physics biology
""".split()
ENDS = ("com", "net", "org", "info", "io", "co.uk", "de", "eu", "tv", "biz")
BLOCKED_PATHS = ("/", "/win-now", "/bonus/free-spins", "/buy/cheap?aff=7", "/go.php", "/click/track/99", "/download/setup.exe", "/xxx/live", "/promo", "")
ALLOWED_PATHS = ("/", "/en/123", "/articles/2021/05/spring.html", "/wiki/Main_Page", "/about", "/de/4567.html", "/docs/guide/", "/fr/89/", "/events/calendar", "/index.html", "")


def _urls(words: list[str], paths: tuple[str, ...], n: int) -> list[str]:
    """n URLs by rule: one word or two, joined in several ways, each host with a path."""
    out = []
    for k in range(n):
        a, b, end = words[k % len(words)], words[(7 * k + 5) % len(words)], ENDS[(k // 3) % len(ENDS)]
        host = (f"{a}-{b}.{end}", f"www.{a}{b}.{end}", f"{a}.{b}.{end}", f"my{a}.{end}", f"{a}{k % 90 + 10}.{end}", f"the-{a}.{end}", f"m.{b}-{a}.{end}")[k % 7]
        out.append(f"http{'s' * (k % 2)}://{host}{paths[(k + k // 7) % len(paths)]}")
    return list(dict.fromkeys(out))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in table ``(url, label)`` of some hundred hosts; label 1 is to be blocked."""
    rows = [(u, 1) for u in _urls(BLOCKED, BLOCKED_PATHS, 420)] + [(u, 0) for u in _urls(ALLOWED, ALLOWED_PATHS, 420)]
    values = ", ".join(f"('{u}', {y})" for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``."""
    out = df.withColumn("__url", F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    out = out.withColumn("__rest", F.expr("CASE WHEN instr(__url, '://') > 0 THEN substring(__url, instr(__url, '://') + 3) ELSE '' END"))
    host = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(F.expr("substring(__rest, char_length(__host) + 1)"), r"^[^?#]*", 0)
    out = out.withColumn("__host", host).withColumn("path", path).withColumn("host", F.translate("__host", upper, upper.lower()))
    return out.drop("__url", "__rest", "__host")


def buckets_of(sizes=SIZES, n_buckets: int = BUCKETS):
    """The hashed n-grams of ``host`` and ``path`` (marked apart), as an array of bucket numbers."""
    grams = []
    for mark, name in (("h", "host"), ("p", "path")):
        framed = f"concat('^', {name}, '$')"
        for n in sizes:
            # sequence() would count down for short strings, so those give one gram: the whole
            grams.append(f"transform(sequence(1, greatest(1, char_length({name}) + 3 - {n})), i -> cast(pmod(xxhash64('{mark}', substring({framed}, i, {n})), {n_buckets}) AS int))")
    return F.expr(f"concat({', '.join(grams)})")


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", n_buckets: int = BUCKETS, sizes=SIZES, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights by bucket and intercept, by gradient descent over at most ``MOST_LABELLED`` labelled rows."""
    rows = parts(labelled.filter(F.col(label_col).isNotNull()), url_col).select(buckets_of(sizes, n_buckets).alias("b"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("b"), "y").limit(MOST_LABELLED).collect()
    weights, intercept = np.zeros(n_buckets), 0.0
    if not rows:
        return weights, intercept
    x = np.zeros((len(rows), n_buckets), np.float32)
    for k, r in enumerate(rows):
        np.add.at(x[k], r["b"], 1)
        x[k] /= len(r["b"])
    met = np.flatnonzero(x.any(0))  # other buckets keep their weight of zero
    x = np.ascontiguousarray(x[:, met])
    y, w = np.array([r["y"] for r in rows], np.float32), np.zeros(len(met), np.float32)
    rate = 40.0
    for _ in range(steps):  # in single precision: in double, the table would be converted at each step
        p = 1 / (1 + np.exp(-(x @ w + np.float32(intercept))))
        w -= np.float32(rate) * (x.T @ (p - y) / np.float32(len(y)) + np.float32(l2 / 100) * w)
        intercept -= 0.5 * float((p - y).mean())
    weights[met] = w
    return weights, float(intercept)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for each row; ``score`` is the model's probability to block."""
    spark = pages.sparkSession
    weights, intercept = fit(labelled if labelled is not None else labelled_urls(spark))
    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    total = F.aggregate(buckets_of(), F.lit(0.0), lambda acc, b: acc + F.get("__weights", b)) / F.size(buckets_of())
    scored = rows.withColumn("__weights", F.expr(f"from_json('[{','.join(format(w, '.6g') for w in weights)}]', 'array<double>')"))
    score = 1 / (1 + F.exp(-(total + F.lit(intercept))))
    out = scored.withColumns({"rule": rule, "score": score, "__fixed": verdict})
    return out.select("page_id", "host", "path", "rule", F.coalesce("__fixed", F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")
