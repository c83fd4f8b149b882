"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions trained here from labelled spans.

Four kinds are found: email, ip, card, phone. The patterns give the base spans. The network is trained in numpy from spans of
generated records (written in ways that the patterns know and in ways that they do not) set into windows of the corpus; its
sample of corpus texts is bounded (MOST_TEXTS, the smallest ids by hash). It reads every text whole, in overlapping windows, all of
which are decoded; a place takes its tag from the window in whose middle it lies furthest, so that one tag sequence comes out for the
whole text, and spans are read from that. Spans of the network that touch a base span go, and so do those that cannot be of their kind.

The best tags of a window are found by Viterbi, but for windows where a bound shows that O throughout is the best path: there no
state's gain over O, with the best transitions into and out of it, is above zero at any place.

Null and empty texts hold nothing. Rows that repeat an id are read one by one; a null id is read and not sampled. A very long text is
read window by window in batches of bounded size. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, linear

KINDS = ("email", "ip", "card", "phone")
WINDOW, HIDDEN, MOST_TEXTS = 128, 12, 400
#: Windows that are read: their length, how far apart they start, how many at a time.
READ, STRIDE, AT_ONCE = 256, 192, 1024
STEPS, BATCH, RATE, SEED = 300, 64, 0.02, 23
#: Characters of a sampled text that training windows are cut from: the driver holds MOST_TEXTS times this at most.
SAMPLED = 100_000
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

# The contract's patterns, each anchored so that a failed start is not tried again inside its own run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


_CLASS = np.full(0x180, 6, np.int64)  # 6: other ASCII marks, 7: other letters and signs
for _c in range(0x180):
    _s = chr(_c)
    _CLASS[_c] = 1 if "0" <= _s <= "9" else 2 if "a" <= _s <= "z" else 3 if "A" <= _s <= "Z" else 4 if _s == " " else 5 if _s == "\n" else 8 + "@.-_%+(),:;/#".index(_s) if _s in "@.-_%+(),:;/#" else 6 if _c < 0x80 else 7
CLASSES = 22  # 0: beyond the text's end


def classes_of(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < len(_CLASS), _CLASS[np.minimum(c, len(_CLASS) - 1)], 7)


class Network:
    """Two LSTMs over one-hot character classes, a linear layer to tags, CRF transitions."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            self.p["h" + d] = rng.normal(0, 0.3, (hidden, 4 * hidden))
            self.p["x" + d][:, hidden : 2 * hidden] += 1  # forget gates start open
        self.p["o"] = rng.normal(0, 0.3, (2 * hidden, TAGS))
        self.p["c"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS, TAGS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps = x.shape
        h, c, out, tape = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32), np.empty((n, steps, self.h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p["x" + d][x[:, t]] + h @ self.p["h" + d]
            g = np.tanh(z * _HALF(self.h))
            i, f, o = (0.5 * g[:, k * self.h : (k + 1) * self.h] + 0.5 for k in (0, 1, 2))
            u = g[:, 3 * self.h :]
            was = (h, c)
            c = f * c + i * u
            y = np.tanh(c)
            h = o * y
            out[:, t] = h
            if keep:
                tape.append((t, i, f, o, u, *was, y))
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        f, tf = self._lstm(x, "f", keep)
        b, tb = self._lstm(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["o"] + self.p["c"], (both, tf, tb)

    def read(self, x: np.ndarray) -> np.ndarray:
        """Emissions of (windows, places), as (places, tags, windows): the same as `emissions`, in place and a window a column."""
        n, steps = x.shape
        h, at = self.h, np.ascontiguousarray(x.T)
        both = np.empty((steps, 2 * h, n), np.float32)
        for d, low in (("f", 0), ("b", h)):
            wx, wh = (np.ascontiguousarray((self.p[k + d] * _HALF(h)).T) for k in "xh")
            y, c = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z = np.take(wx, at[t], axis=1)
                z += wh @ y
                np.tanh(z, out=z)
                gates = z[: 3 * h]
                gates *= 0.5
                gates += 0.5
                c *= z[h : 2 * h]
                c += z[:h] * z[3 * h :]
                y = both[t, low : low + h]
                np.tanh(c, out=y)
                y *= z[2 * h : 3 * h]
        return np.matmul(self.p["o"].T[None], both) + self.p["c"][None, :, None]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window; an I follows its own B or I only."""
        e = self.read(x)
        trans = self.p["t"] + _FORBIDDEN
        # O throughout is the best path where this is below zero everywhere
        into = trans[:, 1:].max(0) - trans[0, 0]
        out = max(0.0, float((trans[1:, 0] - trans[0, 0]).max()))
        gain = e[:, 1:] - e[:, :1] + into[None, :, None]
        gain[0] -= np.minimum(into, 0)[:, None]  # the first place is reached by no transition
        busy = np.flatnonzero(gain.max((0, 1)) + out >= 0)
        tags = np.zeros(x.shape, np.int64)
        if len(busy):
            tags[busy] = self._viterbi(e[:, :, busy].transpose(2, 0, 1), trans)
        return tags

    @staticmethod
    def _viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
        score = e[:, 0] + _START
        back = []
        for t in range(1, e.shape[1]):
            s = score[:, :, None] + trans[None]
            k = s.argmax(1)
            back.append(k)
            score = np.take_along_axis(s, k[:, None, :], 1)[:, 0] + e[:, t]
        best = [score.argmax(1)]
        for k in reversed(back):
            best.append(np.take_along_axis(k, best[-1][:, None], 1)[:, 0])
        return np.stack(best[::-1], 1)

    def step(self, x: np.ndarray, y: np.ndarray, opt: dict) -> float:
        """A step on the CRF's negative log likelihood."""
        e, (both, tf, tb) = self.emissions(x, True)
        n, steps, _ = e.shape
        trans = self.p["t"].astype(np.float64)
        a, b = np.empty(e.shape), np.zeros(e.shape)
        lse = lambda z, ax: (m := z.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(z - m).sum(ax))
        a[:, 0] = e[:, 0]
        for t in range(1, steps):
            a[:, t] = lse(a[:, t - 1][:, :, None] + trans, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            b[:, t] = lse(trans[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = lse(a[:, -1], 1)
        de = np.exp(a + b - z[:, None, None])
        dt = sum(np.exp(a[:, t - 1][:, :, None] + trans + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(0) for t in range(1, steps))
        rows = np.arange(n)
        gold = sum(e[rows, t, y[:, t]] for t in range(steps)) + sum(trans[y[:, t - 1], y[:, t]] for t in range(1, steps))
        for t in range(steps):
            de[rows, t, y[:, t]] -= 1
            if t:
                np.add.at(dt, (y[:, t - 1], y[:, t]), -1)
        de = (de / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["t"], g["c"] = (dt / n).astype(np.float32), de.sum((0, 1))
        g["o"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS)
        dboth = de @ self.p["o"].T
        for d, tape, dh_all in (("f", tf, dboth[:, :, : self.h]), ("b", tb, dboth[:, :, self.h :])):
            dh, dc = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
            for t, i, f, o, u, h, c, v in reversed(tape):
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - v * v)
                dz = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * v * o * (1 - o), dc * i * (1 - u * u)], 1)
                np.add.at(g["x" + d], x[:, t], dz)
                g["h" + d] += h.T @ dz
                dh, dc = dz @ self.p["h" + d].T, dc * f
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        opt["n"] = opt.get("n", 0) + 1
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            m, s = opt.get(k, (0, 0))
            m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
            opt[k] = (m, s)
            self.p[k] = (self.p[k] - opt["rate"] * (m / (1 - 0.9 ** opt["n"])) / (np.sqrt(s / (1 - 0.99 ** opt["n"])) + 1e-8)).astype(np.float32)
        return float((z - gold).mean())


def _HALF(h: int) -> np.ndarray:
    """Gates are sigmoids, written as tanh of half the sum; the update is a tanh."""
    return np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])


_FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
_START = np.zeros(TAGS, np.float32)
for _k in range(len(KINDS)):
    _start, _inside = 1 + 2 * _k, 2 + 2 * _k
    _FORBIDDEN[[x for x in range(TAGS) if x not in (_start, _inside)], _inside] = -1e4


def _record(rng: np.random.Generator) -> tuple[int, str]:
    """A generated span: as the patterns know it, or written otherwise."""
    kind = int(rng.integers(4))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    other = rng.random() < 0.5
    if kind == 0:
        at = " @ " if other else "@"
        return kind, letters(rng.integers(3, 9)) + rng.choice([".", "_", ""]) + digits(rng.integers(0, 4)) + at + letters(rng.integers(3, 9)) + rng.choice(["", digits(1)]) + "." + rng.choice(["com", "org", "example.com", "net", "de"])
    if kind == 1:
        return kind, (" . " if other else ".").join(str(x) for x in rng.integers(1, 256, 4))
    if kind == 2:
        d = digits(15)
        last = next(str(c) for c in range(10) if _luhn(d + str(c)))
        s = d + last
        sep = rng.choice(["", " ", "-"]) if not other else "."
        return kind, sep.join(s[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return kind, f"({a}) {b}-{c}" if other else rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"+{rng.integers(1, 99)}-{a}-{b}-{c}"])


def training_windows(texts: list[str], n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts with generated records in them, and their tags; some have plain numbers, which are no one's data."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["the of and to in"]
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        t = texts[int(rng.integers(len(texts)))]
        a = int(rng.integers(max(1, len(t) - WINDOW)))
        t = t[a : a + WINDOW]
        tags = np.zeros(len(t), np.int64)
        for kind, s, e in base_spans(t):
            tags[s:e] = 2 + 2 * kind
            tags[s] -= 1
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(t) + 1))
            at = t.find(" ", at) if t.find(" ", at) >= 0 else at  # between words, where there are any
            if at < len(t) and tags[at]:
                continue
            if rng.random() < 0.3:
                kind, s = None, str(rng.choice([str(rng.integers(1, 10 ** int(rng.integers(1, 8)))), f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(0, 99)}.{rng.integers(0, 99)}", f"/{rng.integers(1, 999)}"]))
            else:
                kind, s = _record(rng)
            mark = np.zeros(len(s) + 2, np.int64)
            if kind is not None:
                mark[1:-1] = 2 + 2 * kind
                mark[1] -= 1
            t, tags = f"{t[:at]} {s} {t[at:].removeprefix(' ')}", np.concatenate([tags[:at], mark, tags[at:][t[at : at + 1] == " " :]])
        t, tags = t[:WINDOW], tags[:WINDOW]
        x[i, : len(t)], y[i, : len(t)] = classes_of(t), tags
    return x, y


def fit(texts: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    net, rng, opt = Network(seed), np.random.default_rng(seed), {"rate": RATE}
    x, y = training_windows(texts, 2048, seed)
    for k in range(steps):
        opt["rate"] = RATE * (1 - k / steps) + 1e-3
        rows = rng.integers(0, len(x), BATCH)
        net.step(x[rows], y[rows], opt)
    return net


def tags_of(texts: list[str], net: Network, most: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its tags) of every text, window by window: where two windows overlap, the place is the one's in whose middle
    it lies further."""
    edge = (READ - STRIDE) // 2
    done = [np.zeros(len(t), np.int64) for t in texts]
    due = [max(1, -(-(len(t) - READ) // STRIDE) + 1) if t else 0 for t in texts]
    x, where = [], []

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        if not x:
            return
        batch = np.zeros((len(x), READ), np.int64)  # all of one length: tags do not depend on what is read beside them
        for row, c in zip(batch, x, strict=True):
            row[: len(c)] = c
        for (n, at), tags in zip(where, net.decode(batch), strict=True):
            low = at + edge if at else 0  # windows before this one are further in up to here
            done[n][low : at + READ] = tags[low - at : len(done[n]) - at][: READ - (low - at)]
            due[n] -= 1
            if not due[n]:
                yield n, done[n]
                done[n] = np.empty(0, np.int64)
        x.clear(), where.clear()

    for n, t in enumerate(texts):
        if not t:
            yield n, done[n]
            continue
        c = classes_of(t)
        for k in range(due[n]):
            x.append(c[k * STRIDE : k * STRIDE + READ]), where.append((n, k * STRIDE))
            if len(x) >= most:
                yield from flush()
    yield from flush()


def _possible(kind: int, s: str) -> bool:
    digits = sum("0" <= c <= "9" for c in s)
    if kind == 0:
        left, at, right = s.partition("@")
        return bool(left.strip() and at and "." in right and right.strip(" ."))
    if kind == 1:
        parts = [p.strip() for p in s.split(".")]
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= digits <= 19 and _luhn("".join(c for c in s if "0" <= c <= "9"))
    return 9 <= digits <= 15 and not any(c.isalpha() for c in s)


def reconciled(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the network's others, by kind, then start."""
    n = len(text)
    if not tags.any():
        return base
    taken = np.zeros(n, bool)
    for _, s, e in base:
        taken[s:e] = True
    found, at = [], 0
    before = np.concatenate([[0], tags[:-1]])
    for s in np.flatnonzero((tags > 0) & (before != tags) & ((tags % 2 == 1) | (before == 0))).tolist():
        if s < at:
            continue
        kind = (int(tags[s]) - 1) // 2
        e = s + 1
        while e < n and tags[e] == 2 + 2 * kind:
            e += 1
        at = e
        while e > s and text[e - 1].isspace():
            e -= 1
        if not taken[s:e].any() and _possible(kind, text[s:e]):
            found.append((kind, s, e))
    return sorted([*base, *found])


def find(docs: DataFrame, most_texts: int = MOST_TEXTS) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive), a row for each row of docs."""
    spark = docs.sparkSession
    ids = linear.first_ids(docs.select("doc_id"), most_texts)
    some = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "doc_id long")), "doc_id")
    texts = [r[0] for r in some.filter("text IS NOT NULL").groupBy("doc_id").agg(F.min(F.substring("text", 1, SAMPLED)).alias("text")).orderBy("doc_id").select("text").collect()]
    sent = spark.sparkContext.broadcast(fit(texts).p)
    spans = "array<struct<kind: string, start: long, end: long>>"
    schema = common.with_fields(docs.select("doc_id"), f"base {spans}, spans {spans}")
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.p = sent.value
        shape = lambda xs: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in xs], kind_of)
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                part = b.slice(low, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                every = list(base)
                for n, tags in tags_of(texts, net):
                    every[n] = reconciled(texts[n], tags, base[n])
                yield pa.RecordBatch.from_arrays([part.column(0), shape(base), shape(every)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(common.frugal(run), schema)


def joined(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
