"""Personal data: a character-level bidirectional LSTM with CRF transitions, beside fixed base patterns.

The base patterns find emails, IP addresses, card numbers and phone numbers. The tagger, trained in numpy from labelled
spans, adds spans of the same kinds that the patterns miss (numbers without a country prefix, emails with blanks around
the sign, and the like). It reads characters by class. A text is cut into overlapping windows around each place that
could belong to a span (an ``@`` or four digits close to each other; a span holds one of both by definition, so no
other place needs to be read); each window gives emission scores; where windows overlap the scores are averaged with
weights that fall towards a window's ends, and the whole stretch is decoded at once with the CRF's transitions.
An added span overlaps no base span and passes its kind's test (digits, parts, Luhn).

Offsets are code points, end exclusive. Defined results: a null or empty text has no spans; repeated rows and null
doc_ids are rows like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._common import read_bytes, shared_dir, tune, whole_text, write_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))

# Base spans

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    d = digits_of(s)
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` of the base patterns by start, then kind as listed."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > last and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
        at = text.find("@", max(last, at + 1))
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


# Characters by class

PUNCTUATION = " \n\t@.-+()_%/:,;#=&\"'[]<>$*!?|"
CLASSES = len(PUNCTUATION) + 6
OTHER, DIGITS, LOWER, UPPER, LETTER, PAD = (len(PUNCTUATION) + k for k in range(6))


def _class_table() -> np.ndarray:
    table = np.full(0x250, OTHER, np.uint8)
    for k in range(0x250):
        c = chr(k)
        table[k] = PUNCTUATION.index(c) if c in PUNCTUATION else DIGITS if "0" <= c <= "9" else LOWER if "a" <= c <= "z" else UPPER if "A" <= c <= "Z" else LETTER if c.isalpha() else OTHER
    return table


CLASS_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < len(CLASS_TABLE), CLASS_TABLE[np.minimum(code, len(CLASS_TABLE) - 1)], LETTER).astype(np.uint8)


# The tagger


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """A bidirectional LSTM over character classes; ``trans`` are the CRF's transition scores, ``first`` its start's.

    Weights of both ways stand together, so that each step is one multiplication for both: ``x`` (ways, classes, gates),
    ``h`` (ways, hidden, gates).
    """

    def __init__(self, hidden: int = 16, seed: int = 1):
        rng, labels = np.random.default_rng(seed), len(LABELS)
        self.hidden = hidden
        x = rng.normal(0, 0.3, (2, CLASSES, 4 * hidden))
        x[:, :, hidden : 2 * hidden] += 1  # remember at first
        h = rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden))
        self.p = {"x": x, "h": h, "out": rng.normal(0, 0.2, (2 * hidden, labels)), "bias": np.zeros(labels), "trans": np.zeros((labels, labels)), "first": np.zeros(labels)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, c: np.ndarray, keep: bool):
        """Hidden states (ways, places, windows, hidden), the way back in its own order; with what the gradient needs."""
        n, (rows, size), wh = self.hidden, c.shape, self.p["h"]
        ways = np.stack([c.T, c.T[::-1]])  # (ways, places, windows)
        h, m = np.zeros((2, rows, n), np.float32), np.zeros((2, rows, n), np.float32)
        out, held = np.empty((2, size, rows, n), np.float32), []
        for t in range(size):
            z = h @ wh
            z[0] += self.p["x"][0][ways[0, t]]
            z[1] += self.p["x"][1][ways[1, t]]
            gates = _sigmoid(z[:, :, : 3 * n])
            i, f, o = gates[:, :, :n], gates[:, :, n : 2 * n], gates[:, :, 2 * n :]
            g = np.tanh(z[:, :, 3 * n :])
            before = m
            m = f * m + i * g
            tm = np.tanh(m)
            if keep:
                held.append((h, before, gates, g, tm))
            h = o * tm
            out[:, t] = h
        return out, held, ways

    def emissions(self, c: np.ndarray, keep: bool = False):
        out, held, ways = self._lstm(c, keep)
        h = np.concatenate([out[0], out[1, ::-1]], 2)
        return h @ self.p["out"] + self.p["bias"], (h, held, ways)  # (places, windows, labels)

    def gradient(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's mean negative log likelihood of labels ``y``, and its gradient."""
        em, (h, held, ways) = self.emissions(c, True)
        loss, d_em, d_trans, d_first = crf_gradient(em, self.p["trans"], self.p["first"], y.T)
        n, size, rows = self.hidden, c.shape[1], len(c)
        labels = d_em.shape[2]
        grad = {"trans": d_trans, "first": d_first, "bias": d_em.sum((0, 1)), "out": h.reshape(-1, 2 * n).T @ d_em.reshape(-1, labels)}
        dh_all = (d_em @ self.p["out"].T).astype(np.float32)
        dh_ways = np.stack([dh_all[:, :, :n], dh_all[::-1, :, n:]])
        wt = self.p["h"].transpose(0, 2, 1)
        dz = np.empty((2, size, rows, 4 * n), np.float32)
        befores = np.empty((2, size, rows, n), np.float32)
        dh, dm = np.zeros((2, rows, n), np.float32), np.zeros((2, rows, n), np.float32)
        for t in range(size - 1, -1, -1):
            h_before, m_before, gates, g, tm = held[t]
            i, f, o = gates[:, :, :n], gates[:, :, n : 2 * n], gates[:, :, 2 * n :]
            dh = dh + dh_ways[:, t]
            dm = dm + dh * o * (1 - tm**2)
            z = dz[:, t]
            np.concatenate([dm * g, dm * m_before, dh * tm], 2, out=z[:, :, : 3 * n])
            z[:, :, : 3 * n] *= gates * (1 - gates)
            z[:, :, 3 * n :] = dm * i * (1 - g**2)
            befores[:, t] = h_before
            dh, dm = z @ wt, dm * f
        flat = dz.reshape(2, -1, 4 * n)
        grad["h"] = befores.reshape(2, -1, n).transpose(0, 2, 1) @ flat
        of_class = (ways.reshape(2, 1, -1) == np.arange(CLASSES).reshape(1, -1, 1)).astype(np.float32)
        grad["x"] = of_class @ flat
        return loss, grad

    def train(self, c: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam over random batches."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = rng.choice(len(c), min(batch, len(c)), replace=False)
            loss, grad = self.gradient(c[some], y[some])
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def crf_gradient(em: np.ndarray, trans: np.ndarray, first: np.ndarray, y: np.ndarray):
    """Of the mean negative log likelihood: itself, and gradients by emissions (places, windows, labels), transitions, start.

    Forward and backward sums are scaled place by place, so that they stay within range.
    """
    size, n, labels = em.shape
    top = em.max(2, keepdims=True)
    e, a = np.exp(em - top, dtype=np.float64), np.exp(trans, dtype=np.float64)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((size, n, 1))
    alpha[0] = e[0] * np.exp(first)
    for t in range(size):
        if t:
            alpha[t] = (alpha[t - 1] @ a) * e[t]
        scale[t] = alpha[t].sum(1, keepdims=True)
        alpha[t] /= scale[t]
    right = np.empty_like(e)
    for t in range(size - 1, 0, -1):
        right[t] = e[t] * beta[t] / scale[t]
        beta[t - 1] = right[t] @ a.T
    z = (np.log(scale) + top).sum((0, 2))
    d_em = alpha * beta
    d_trans = a * (alpha[:-1].reshape(-1, labels).T @ right[1:].reshape(-1, labels))
    d_first = d_em[0].sum(0)
    rows, places = np.arange(n), np.arange(size)
    score = first[y[0]] + em[places[:, None], rows, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
    d_em[places[:, None], rows, y] -= 1
    np.add.at(d_trans, (y[:-1], y[1:]), -1)
    np.add.at(d_first, y[0], -1)
    return float((z - score).mean()), d_em / n, d_trans / n, d_first / n


def viterbi(em: np.ndarray, trans: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The best labels of sequences ``em`` (places, sequences, labels) of their own lengths."""
    size, n, labels = em.shape
    back = np.zeros((size, n, labels), np.int8)
    score = em[0] + first
    final = score.copy()
    for t in range(1, size):
        total = score[:, :, None] + trans
        back[t] = total.argmax(1)
        score = total.max(1) + em[t]
        on = lengths > t
        final[on] = score[on]
    out = []
    for k in range(n):
        path = np.empty(lengths[k], np.int8)
        path[-1] = final[k].argmax()
        for t in range(lengths[k] - 1, 0, -1):
            path[t - 1] = back[t, k, path[t]]
        out.append(path)
    return out


# Labelled spans

WINDOW, STRIDE = 96, 48
TRIGGER = re.compile(r"@|[0-9](?:[^0-9]{0,3}[0-9]){3,}")


def labelled_spans(n: int = 3000, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made sentences with their spans: in forms that the base patterns find and others, among numbers that are none."""
    rng = random.Random(seed)
    letters = lambda a, b: "".join(rng.choice("etaoinshrdlucmfwypvbgkéüñ") for _ in range(rng.randint(a, b)))
    plain = lambda a, b: "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(a, b)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def email() -> str:
        user = plain(2, 8) + rng.choice(["", ".", "_", "+", "-"]) + rng.choice([plain(2, 8), number(2), plain(3, 5) + number(2)])
        at = rng.choice(["@"] * 5 + [" @ ", " @", "@ "])
        return user + at + plain(3, 9) + rng.choice([".", ".", ".", " . "]) + rng.choice(["com", "net", "org", "de", "co.uk", "example.com"])

    def ip() -> str:
        sep = rng.choice([".", ".", ".", ".", " . ", "[.]"])
        return sep.join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        d = [rng.randint(0, 9) for _ in range(15)]
        d = "".join(map(str, d))
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return rng.choice(["", " ", "-", ".", "  "]).join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        head = rng.choice(["+1 ", "+49 ", "+44-", "+33.", "00", "(", "", ""])
        if head == "(":
            return f"({number(3)}) {number(3)}-{number(4)}"
        sep = rng.choice(["-", " ", ".", "/"]) if not head else rng.choice(["-", " ", ".", ""])
        return head + sep.join([number(3), number(3), number(4)])

    def other() -> str:
        return rng.choice([f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}:{number(2)}", number(rng.randint(4, 9)), f"v{number(1)}.{number(2)}.{number(1)}", f"${number(3)},{number(3)}.{number(2)}", f"id={number(rng.randint(5, 20))}", f"#{number(5)}", f"{number(4)}/{number(4)}", f"{number(3)}.{number(5)}", "@" + plain(3, 9), f"{plain(3, 6)}@{plain(2, 5)}", number(16), plain(4, 8) + number(8), f"{number(2)}.{number(2)}.{number(4)}", "".join(rng.choice("0123456789abcdef") for _ in range(32))])

    kinds = {"email": email, "ip": ip, "card": card, "phone": phone}
    leads = ("mail", "write to", "call", "tel:", "phone", "from", "server", "host", "card", "contact:", "ip", "at", "to", "")
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(letters(1, 9) for _ in range(rng.randint(0, 5)))
            text += rng.choice([" ", ", ", "\n", ". ", ": ", " "]) + rng.choice(leads) + " "
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                value = kinds[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = other()
            text += value + rng.choice([" ", ", ", "\n", ". ", ".", ";", ")"])
        out.append((text + " ".join(letters(1, 9) for _ in range(rng.randint(0, 6))), spans))
    return out


def training_windows(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and labels around what triggers in labelled texts."""
    xs, ys = [], []
    for text, spans in examples:
        c, y = classes(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            y[a:b] = 2 + 2 * KINDS.index(kind)
            y[a] -= 1
        for start, _ in windows(stretches(text), len(text)):
            x, z = np.full(WINDOW, PAD, np.uint8), np.zeros(WINDOW, np.int64)
            part = c[start : start + WINDOW]
            x[: len(part)], z[: len(part)] = part, y[start : start + WINDOW]
            xs.append(x)
            ys.append(z)
    return np.array(xs), np.array(ys)


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of all places that could belong to a span."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def windows(some: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Starts of overlapping windows over each stretch, with the stretch's number."""
    return [(start, k) for k, (a, b) in enumerate(some) for start in range(a, max(a + 1, b - STRIDE), STRIDE)]


STEPS = 260
_TRAINED: dict[str, Tagger] = {}


def default_tagger(spark: SparkSession | None = None, steps: int = STEPS) -> Tagger:
    """The tagger of the made sentences; its weights are kept in the shared folder by a hash of what they are trained on."""
    x, y = training_windows(labelled_spans())
    tagger = Tagger()
    made_of = hashlib.sha256(x.tobytes() + y.tobytes() + repr((steps, {k: v.tolist() for k, v in tagger.p.items()})).encode()).hexdigest()[:24]
    if made_of not in _TRAINED:
        path = spark and f"{shared_dir(spark)}/quill-tagger-{made_of}.npz"
        kept = read_bytes(spark, path) if path else None
        if kept:
            with np.load(io.BytesIO(kept)) as weights:
                tagger.p = {k: weights[k] for k in tagger.p}
        else:
            tagger.train(x, y, steps)
            if path:
                np.savez(out := io.BytesIO(), **tagger.p)
                write_bytes(spark, path, out.getvalue())
        _TRAINED[made_of] = tagger
    return _TRAINED[made_of]


#: Places that are decoded at once.
DECODED = 200_000
WEIGHTS = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def tag(texts: list[str], tagger: Tagger, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans in each text, after global decoding of each stretch."""
    regions: list[tuple[int, int, int]] = []  # text, start, stop
    where: list[tuple[int, int]] = []  # region, start of a window
    coded: dict[int, np.ndarray] = {}
    for k, text in enumerate(texts):
        some = stretches(text)
        if some:
            coded[k] = classes(text)
            where += [(len(regions) + r, start) for start, r in windows(some, len(text))]
            regions += [(k, a, b) for a, b in some]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not regions:
        return out
    sums = [np.zeros((b - a, len(LABELS)), np.float32) for _, a, b in regions]
    weight = [np.zeros(b - a, np.float32) for _, a, b in regions]
    for at in range(0, len(where), batch):
        part = where[at : at + batch]
        x = np.full((len(part), WINDOW), PAD, np.uint8)
        for row, (r, start) in zip(x, part, strict=True):
            c = coded[regions[r][0]][start : min(start + WINDOW, regions[r][2])]
            row[: len(c)] = c
        em, _ = tagger.emissions(x)
        for k, (r, start) in enumerate(part):
            a, n = start - regions[r][1], min(WINDOW, regions[r][2] - start)
            sums[r][a : a + n] += em[:n, k] * WEIGHTS[:n, None]
            weight[r][a : a + n] += WEIGHTS[:n]
    for part in _decoded_together([len(x) for x in sums], batch):
        lengths = np.array([len(sums[r]) for r in part])
        em = np.zeros((lengths.max(), len(part), len(LABELS)), np.float32)
        for k, r in enumerate(part):
            em[: lengths[k], k] = sums[r] / weight[r][:, None]
        for r, path in zip(part, viterbi(em, tagger.p["trans"], tagger.p["first"], lengths), strict=True):
            k, a, _ = regions[r]
            kind = (path + 1) // 2
            starts = np.flatnonzero((path > 0) & ((path % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind)))
            for s in starts.tolist():
                e = s + 1
                while e < len(path) and path[e] == 2 * kind[s]:
                    e += 1
                out[k].append((KINDS[kind[s] - 1], a + s, a + e))
    return out


def _decoded_together(lengths: list[int], most: int) -> Iterator[list[int]]:
    """Stretches by length, as many at a time as fill ``DECODED`` places when padded to the longest; longer ones alone."""
    part: list[int] = []
    for r in sorted(range(len(lengths)), key=lengths.__getitem__):
        if part and (len(part) >= most or (len(part) + 1) * lengths[r] > DECODED):
            yield part
            part = []
        part.append(r)
    if part:
        yield part


def plausible(kind: str, s: str) -> bool:
    """Whether a tagged span passes its kind's test, blanks and brackets aside."""
    d = digits_of(s)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+( ?\. ?[A-Za-z0-9-]+)+", s))
    if kind == "ip":
        m = re.fullmatch(r"([0-9]{1,3})(?: ?\[?\.\]? ?([0-9]{1,3})){3}", s)
        return bool(m) and all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return bool(re.fullmatch(r"(00|\()?[0-9][0-9 ()./-]+[0-9]", s)) and 10 <= len(d) <= 15 and len(s) > len(d)


def find(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    out = []
    for text, tagged in zip(texts, tag(texts, tagger), strict=True):
        base = base_spans(text)
        more = [s for s in tagged if plausible(s[0], text[s[1] : s[2]]) and all(s[2] <= a or s[1] >= b for _, a, b in base)]
        out.append((base, more))
    return out


def personal_data(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for each row; the counts are of base spans."""
    spark = docs.sparkSession
    tune(spark, 256)
    held = spark.sparkContext.broadcast(tagger or default_tagger(spark))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for base, more in find(b.column(1).to_pylist(), held.value):
                for c, kind in zip(counts, KINDS, strict=True):
                    c.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined([*base, *more]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
