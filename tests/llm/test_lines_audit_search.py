"""Line deduplication, the filter audit and lexical search against brute-force versions, on a small table with every awkward case."""

import collections
import itertools
import math
import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, row string, n_lines string, gone string, mask string, part string, term string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    common = [words(rng, 9) for _ in range(6)]
    texts = [None, "", "\n", " \t\x0b", "\n\n\n", "É" * 20, "é" * 19 + "É", "A" * 19, "x" * 4000, words(rng, 5000), "ß\x00a b\x00", "日本 日本 q"]
    for k in range(90):
        lines = [rng.choice(common) if rng.random() < 0.4 else words(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 9))]
        lines = [rng.choice([line, line.upper(), f"\t {line}\r", line + "\x0b"]) for line in lines]
        texts.append("\n".join(lines) + rng.choice(["", "\n", " #1", "$%", " ABC DEF"]))
    texts += [texts[20]] * 25 + [texts[30], texts[31], texts[31], "\n".join([common[0]] * 5), words(rng, 150) + " " + words(rng, 150)]
    out = [(k * 3, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    out += [out[15], out[15], (None, texts[16], "en"), (None, texts[16], "fr"), (None, common[0], "en"), (9, texts[20] + "\n" + common[0], "xx")]
    rng.shuffle(out)
    return [(d, t, lang, *"abcdef") for d, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def naive_lines(rows, min_documents=3, min_chars=20):
    holders = collections.defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOW)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text, *rest in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_documents or doc is not None and doc == max(d for d in holders[key(x)] if d is not None)]
        out.append((doc, text, *rest, "\n".join(kept) if len(kept) < len(lines) else text, len(lines), len(lines) - len(kept)))
    return collections.Counter(out)


def test_line_dedup(spark, docs, rows, empty):
    from quillspark.llm.line_dedup import deduplicated, without_repeated_lines

    made = deduplicated(docs)
    found = collections.Counter((*r["row"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in made.collect())
    assert found == naive_lines(rows) and sum(x[-1] for x in found) > 50
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)
    assert collections.Counter((*r["row"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in deduplicated(docs, 2, 5).collect()) == naive_lines(rows, 2, 5)
    kept = without_repeated_lines(docs)
    assert kept.columns == docs.columns
    want = collections.Counter()
    for x, n in naive_lines(rows).items():
        want[x[0], x[-3], *x[2:-3]] += n
    assert collections.Counter(tuple(r) for r in kept.collect()) == want
    assert deduplicated(empty).collect() == [] and without_repeated_lines(empty).collect() == []


def test_lines_that_are_all_dropped_leave_an_empty_text(spark):
    from quillspark.llm.line_dedup import without_repeated_lines

    line = "the same long line in all of them"
    df = spark.createDataFrame([(k, f"{line}\n{line}" if k < 4 else f"own\n {line.upper()}\t\n{line}") for k in range(5)], "doc_id long, text string")
    assert dict(tuple(r) for r in without_repeated_lines(df).collect()) == {0: "", 1: "", 2: "", 3: "", 4: f"own\n {line.upper()}\t\n{line}"}


def test_a_text_of_many_lines_is_put_together_in_linear_time(spark):
    """Two texts with the same 200,000 lines: every line goes from the lesser and stays in the greater."""
    from quillspark.llm.line_dedup import without_repeated_lines

    text = "\n".join(f"this is the line with the number {k}" for k in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nmine"), (3, text)], "doc_id long, text string")
    found = dict(tuple(r) for r in without_repeated_lines(df).collect())
    assert found == {1: "", 2: "mine", 3: text}


# 12


def naive_audit(rows, labels):
    text = lambda t: t or ""
    least = {}
    for doc, t, *_ in rows:
        least.setdefault(text(t), []).append(math.inf if doc is None else doc)
    failed = []
    for doc, t, lang, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text(t))
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text(t))) > 3 * len(text(t)), "D": bool(re.search("[#$%&*|]", text(t))), "E": min(least[text(t)]) < (math.inf if doc is None else doc)}
        marks = [x for x in labels if x[0] == doc and doc is not None]
        failed.append((lang or "", fails, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out, shapley = {}, collections.Counter()
    for part in {f[0] for f in failed}:
        mine = [f[1:] for f in failed if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                shapley[part, f] += len(gone)
                unique = sum(x[0][f] and sum(x[0].values()) == 1 for x in mine)
                out[part, order, step] = (len(left), len(gone), sum(x[0][f] for x in mine) - len(gone), unique, sum(x[1] for x in gone), sum(x[2] for x in gone))
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit(spark, docs, rows, empty):
    from quillspark.llm.filter_audit import audit

    rng = random.Random(6)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, *_ in rows if rng.random() < 0.6] + [(None, 1, 1), (10**9, 1, 1), (0, 0, 1), (0, 1, 0)]
    known = spark.createDataFrame([(*x, "z", "z") for x in labels], "doc_id long, quality int, toxic int, mask string, part string")
    found = audit(docs, known).collect()
    want = naive_audit(rows, labels)
    assert len(found) == len(want) == 600 * len({x[2] or "" for x in rows})
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == want
    bare = audit(docs, known.limit(0)).collect()
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in bare) and len(bare) == len(found)
    assert audit(empty, known).collect() == []


def test_matrices_agree_with_each_other():
    import numpy as np

    from quillspark.llm.filter_audit import ORDERS, matrices, same_filter

    m = matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    first = m["kept"] + m["removed"]
    assert np.array_equal(first[:, 0::5], np.ones((32, 120), int))  # nothing has gone before the first step
    for step in range(1, 5):
        assert np.array_equal(first[:, step::5], m["kept"][:, step - 1 :: 5])
    shapley = m["removed"] @ same_filter()
    own = [[shapley[mask, ORDERS.index(o) * 5] for o in ("ABCDE", "BACDE", "CABDE", "DABCE", "EABCD")] for mask in range(32)]
    assert [sum(x) for x in own] == [120 * (mask > 0) for mask in range(32)]  # each failing document is removed once an order


# 13


def naive_search(rows, items, k=20):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: [x.translate(LOW) for x in cut.findall(t or "")]
    tfs = [collections.Counter(split(t)) for _, t, *_ in rows]
    ns = [sum(x.values()) for x in tfs]
    n_docs, total = sum(n > 0 for n in ns), sum(ns)
    df = collections.Counter(t for x in tfs for t in x)
    out = collections.Counter()
    for item, text in sorted(set(items), key=repr):
        found = []
        for (doc, *_), tf, n in zip(rows, tfs, ns, strict=True):
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in split(text) if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(7)
    out = [(k, words(rng, rng.randint(1, 40))) for k in range(40)]
    return out + [(3, out[3][1]), (3, "a b a b a"), (None, "a É 日本"), (50, None), (51, ""), (52, "nowhereinthetexts"), (53, "AB ab Ab\x00aB"), (54, " ".join("abcdefgh" * 6))]


@pytest.mark.parametrize("segment_bytes,block_terms,broadcast", [(1 << 24, 20_000, 1 << 24), (600, 40, 1 << 24), (3000, 100, 0)])
def test_lexical_search(spark, docs, rows, items, empty, monkeypatch, segment_bytes, block_terms, broadcast):
    from quillspark.llm import lexical_search
    from quillspark.llm.lexical_search import Index, search

    monkeypatch.setattr(lexical_search, "BROADCAST_BYTES", broadcast)
    asked = spark.createDataFrame([(*x, "z", "z", "z") for x in items], "item_id long, text string, term string, doc_id string, block string")
    index = Index.of(docs, segment_bytes=segment_bytes)
    for k in (20, 3):
        found = search(index, asked, k, block_terms=block_terms)
        assert collections.Counter(tuple(r) for r in found.collect()) == naive_search(rows, items, k)
    assert search(Index.of(empty), asked).collect() == [] and search(index, asked.limit(0)).collect() == []


def test_bounds_hold_and_leave_few_to_rescore():
    """No impact is above its byte's bound or a step below it; of 50,000 documents few reach the kth lower bound."""
    import numpy as np

    from quillspark.llm.lexical_search import STEP, _Best, impacts

    tf, m = np.meshgrid(np.arange(1, 400), np.array([75, 76, 90, 100, 140, 1000, 10**6]))
    exact = impacts(tf.ravel(), m.ravel())
    bound = -(-exact // STEP)
    assert bound.min() >= 0 and bound.max() <= 255 and (bound * STEP >= exact).all() and (bound * STEP - (STEP - 1) <= exact).all()
    rng = np.random.default_rng(8)
    n = 50_000
    m = 75 + rng.integers(1, 200, n)
    docs = [np.sort(rng.choice(n, size, replace=False)).astype(np.int32) for size in (50, 500, 5_000, 20_000)]
    tfs = [rng.integers(1, 6, len(d)).astype(np.int32) for d in docs]
    bounds = [(-(-impacts(t, m[d]) // STEP)).astype(np.uint8) for d, t in zip(docs, tfs, strict=True)]
    scored = []
    best = _Best(20)
    import quillspark.llm.lexical_search as module

    plain = module.impacts
    try:
        module.impacts = lambda t, x: scored.append(len(t)) or plain(t, x)
        best.add(b"q", 1, docs, bounds, tfs, [7000, 4600, 2300, 900], (np.arange(n), np.zeros(n, np.uint8), m))
    finally:
        module.impacts = plain
    total = np.zeros(n, np.int64)
    for d, t, w in zip(docs, tfs, [7000, 4600, 2300, 900], strict=True):
        total[d] += w * plain(t, m[d])
    assert (-best.rows[b"q"][0]).tolist() == sorted(total.tolist(), reverse=True)[:20]
    assert sum(scored) < 400


def test_lengths_of_arrow_slices():
    import pyarrow as pa

    from quillspark.llm.lexical_search import lengths, terms

    texts = ["", "a b", "--", "É-É", "x" * 9, "", " q", "1\x002"]
    whole = pa.array([t.encode() for t in texts], pa.binary())
    for start in range(len(texts)):
        part = whole.slice(start)
        assert lengths(part).tolist() == [0, 2, 0, 2, 1, 0, 1, 2][start:]
        words_, where = terms(part)
        assert [(int(w), x) for w, x in zip(where, words_.to_pylist(), strict=True)] == [(k, x) for k, t in enumerate(texts[start:]) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
