"""Personal data: validated patterns, and a character-level bidirectional LSTM with CRF transitions.

Patterns give the base spans. Their spans are the labels from which the model learns, in numpy, with what stands around them: windows of
``WINDOW`` characters round digits and @ signs, at most ``SAMPLE`` windows of the corpus by hash order. The model tags characters (outside,
or begin / inside of a kind). It looks at every stretch round a digit or @ sign of every text; as each kind must hold one, a
stretch without them has one admissible path, all outside, and is not computed. A stretch of any length is cut into overlapping
windows, the windows' tag scores are averaged where they overlap, and one Viterbi pass over the whole stretch reconciles them.
Spans of the model that touch no base span and are well-formed for their kind are added; base spans always stay.

Texts do not move: one pass gathers the sample (each task keeps ``SAMPLE`` windows at most), one finds the spans.
Defined cases: null and empty texts have no spans; texts are read whole; equal rows get equal results; if no text has a base
span, nothing is learned and nothing added.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The patterns. A look-behind only saves starts inside a run of digits, which cannot match anew.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Well-formed additions, by kind.
WELL_FORMED = {
    "email": re.compile(r"[^\s@,;:<>()\[\]\"]+@[^\s@,;:<>()\[\]\"]+\.[^\s@,;:<>()\[\]\".]{2,}"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]+(?:[ ./-]{1,2}[0-9]+)*"),
    "phone": re.compile(r"(?:00|\(|[0-9])[0-9() .\-/]*[0-9]"),
}


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    d = digits_of(s)
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in s.split(".")))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 if kind == "phone" else True


Span = tuple[int, int, int]  # start, place in KINDS, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        spans += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return sorted(spans)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- the model ---

TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 12, 16
WINDOW, STRIDE, AROUND = 64, 32, 20
SAMPLE, STEPS, BATCH = 3000, 240, 32
PAD, LETTER, OTHER = 95, 96, 97
CLASSES = 98


def classes(text: str) -> np.ndarray:
    """Class of each character: printable ASCII by itself, other letters, others."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 32, np.where(points >= 0xC0, LETTER, OTHER))


def tags_of(spans: list[Span], start: int, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for a, k, b in spans:
        lo, hi = max(a, start), min(b, start + size)
        if lo < hi:
            out[lo - start : hi - start] = 2 + 2 * k
            if a >= start:
                out[a - start] = 1 + 2 * k
    return out


class Weights(NamedTuple):
    embed: np.ndarray
    forward: np.ndarray  # input, state and bias to the four gates
    backward: np.ndarray
    out: np.ndarray
    step: np.ndarray  # CRF transitions; the last row starts a sequence


def start_weights() -> Weights:
    rng = np.random.default_rng(3)
    rows = EMBED + HIDDEN + 1
    lstm = lambda: rng.normal(size=(rows, 4 * HIDDEN)) / np.sqrt(rows)
    return Weights(rng.normal(size=(CLASSES, EMBED)) * 0.3, lstm(), lstm(), rng.normal(size=(2 * HIDDEN + 1, TAGS)) / 6, np.zeros((TAGS + 1, TAGS)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def lstm(x: np.ndarray, w: np.ndarray, keep: bool = False):
    """States of (batch, time, EMBED) inputs in order; with ``keep`` also what the gradient needs."""
    n, size, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    states, trace = np.empty((n, size, HIDDEN), x.dtype), []
    inputs = x @ w[:EMBED] + w[-1]
    for t in range(size):
        g = inputs[:, t] + h @ w[EMBED:-1]
        i, f, o = (_sigmoid(g[:, j * HIDDEN : (j + 1) * HIDDEN] + (j == 1)) for j in range(3))
        u = np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        tc = np.tanh(c)
        if keep:
            trace.append((i, f, o, u, before, tc, h))
        h = o * tc
        states[:, t] = h
    return (states, trace) if keep else states


def lstm_gradient(x: np.ndarray, w: np.ndarray, trace: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, size, _ = x.shape
    dw, dx = np.zeros_like(w), np.empty_like(x)
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for t in reversed(range(size)):
        i, f, o, u, before, tc, h = trace[t]
        dh = dh + d_states[:, t]
        dc = dc + dh * o * (1 - tc**2)
        dg = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)), 1)
        dw[:EMBED] += x[:, t].T @ dg
        dw[EMBED:-1] += h.T @ dg
        dw[-1] += dg.sum(0)
        dx[:, t] = dg @ w[:EMBED].T
        dh, dc = dg @ w[EMBED:-1].T, dc * f
    return dw, dx


def emissions(w: Weights, chars: np.ndarray) -> np.ndarray:
    """Tag scores of (batch, time) character classes."""
    x = w.embed[chars]
    both = np.concatenate((lstm(x, w.forward), lstm(x[:, ::-1], w.backward)[:, ::-1]), 2)
    return both @ w.out[:-1] + w.out[-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(scores: np.ndarray, tags: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, and its gradient by tag scores and transitions, of a batch."""
    n, size, _ = scores.shape
    inner = step[:-1]
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0] + step[-1]
    for t in range(1, size):
        alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + inner, 1) + scores[:, t]
    for t in reversed(range(size - 1)):
        beta[:, t] = _log_sum(inner + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _log_sum(alpha[:, -1], 1)
    d_scores = np.exp(alpha + beta - total[:, None, None])
    d_step = np.zeros_like(step)
    d_step[-1] = d_scores[:, 0].sum(0)
    for t in range(1, size):
        d_step[:-1] += np.exp(alpha[:, t - 1, :, None] + inner + (scores[:, t] + beta[:, t])[:, None, :] - total[:, None, None]).sum(0)
    rows = np.arange(n)[:, None]
    gold = scores[rows, np.arange(size), tags].sum() + step[-1][tags[:, 0]].sum() + inner[tags[:, :-1], tags[:, 1:]].sum()
    d_scores[rows, np.arange(size), tags] -= 1
    np.add.at(d_step, (tags[:, :-1], tags[:, 1:]), -1)
    np.add.at(d_step[-1], tags[:, 0], -1)
    return float(total.sum() - gold), d_scores, d_step


def train(chars: np.ndarray, tags: np.ndarray, steps: int = STEPS) -> Weights:
    """Adam over random batches of labelled windows."""
    rng, w = np.random.default_rng(33), start_weights()
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for s in range(1, steps + 1):
        pick = rng.integers(len(chars), size=BATCH)
        c, y = chars[pick], tags[pick]
        x = w.embed[c]
        f, trace_f = lstm(x, w.forward, True)
        b, trace_b = lstm(x[:, ::-1], w.backward, True)
        both = np.concatenate((f, b[:, ::-1]), 2)
        _, d_scores, d_step = crf_gradient(both @ w.out[:-1] + w.out[-1], y, w.step)
        d_both = d_scores @ w.out[:-1].T
        d_out = np.vstack((np.einsum("ntd,ntk->dk", both, d_scores), d_scores.sum((0, 1))))
        d_forward, dx_f = lstm_gradient(x, w.forward, trace_f, d_both[:, :, :HIDDEN])
        d_backward, dx_b = lstm_gradient(x[:, ::-1], w.backward, trace_b, d_both[:, ::-1, HIDDEN:])
        d_embed = np.zeros_like(w.embed)
        np.add.at(d_embed, c, dx_f + dx_b[:, ::-1])
        rate = 0.02 * min(1, 2 * (1 - s / (steps + 1)))
        for j, (p, g) in enumerate(zip(w, (d_embed, d_forward, d_backward, d_out, d_step), strict=True)):
            g = np.clip(g / BATCH, -5, 5)
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.99 * second[j] + 0.01 * g**2
            p -= rate * first[j] / (1 - 0.9**s) / (np.sqrt(second[j] / (1 - 0.99**s)) + 1e-8)
    return w


def viterbi(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of (batch, time) score sequences of one length."""
    n, size, _ = scores.shape
    best, back = scores[:, 0] + step[-1], np.zeros(scores.shape, np.int8)
    for t in range(1, size):
        ways = best[:, :, None] + step[:-1]
        back[:, t] = ways.argmax(1)
        best = ways.max(1) + scores[:, t]
    out = np.empty((n, size), np.int64)
    out[:, -1] = best.argmax(1)
    for t in reversed(range(1, size)):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged neighbourhoods of digits and @ signs, over whole words."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        done = out[-1][1] if out else 0
        if hi <= done:
            continue
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], hi
        else:
            out.append((lo, hi))
    return out


def _starts(size: int) -> list[int]:
    return [0] if size <= WINDOW else [*range(0, size - WINDOW, STRIDE), size - WINDOW]


def decoded(w: Weights, pieces: list[str]) -> list[np.ndarray]:
    """Tags of each stretch, its windows' scores averaged and one path taken over the whole."""
    windows, origin = [], []
    for i, p in enumerate(pieces):
        c = classes(p)
        for s in _starts(len(c)):
            part = c[s : s + WINDOW]
            windows.append(np.pad(part, (0, WINDOW - len(part)), constant_values=PAD))
            origin.append((i, s, len(part)))
    sums = [np.zeros((len(p), TAGS), np.float32) for p in pieces]
    seen = [np.zeros((len(p), 1), np.float32) for p in pieces]
    for at in range(0, len(windows), 512):
        e = emissions(w, np.stack(windows[at : at + 512]))
        for (i, s, size), scores in zip(origin[at : at + 512], e, strict=True):
            sums[i][s : s + size] += scores[:size]
            seen[i][s : s + size] += 1
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        by_size.setdefault(len(p), []).append(i)
    for places in by_size.values():
        for tags, i in zip(viterbi(np.stack([sums[i] / seen[i] for i in places]), w.step), places, strict=True):
            out[i] = tags
    return out


def spans_of(tags: np.ndarray) -> Iterator[Span]:
    start, kind = 0, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        k = (t - 1) // 2 if t else -1
        if kind >= 0 and (k != kind or t % 2):
            yield start, kind, i
            kind = -1
        if kind < 0 and k >= 0:
            start, kind = i, k


def additions(text: str, base: list[Span], found: Iterator[Span]) -> list[Span]:
    """Well-formed spans of the model that touch no base span."""
    out = []
    for a, k, b in found:
        s = text[a:b]
        ok = WELL_FORMED[KINDS[k]].fullmatch(s) and valid(KINDS[k], s) and not any(a < y and x < b for x, _, y in base)
        if ok and not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()) and (k != 3 or s != digits_of(s)):
            out.append((a, k, b))
    return out


def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task, the labelled windows of the smallest keys: key, chars, tags."""
    kept: list[tuple[int, bytes, bytes]] = []
    for batch in batches:
        for text in batch.column("text"):
            t = text.as_py() or ""
            if not TRIGGER.search(t):
                continue
            spans = base_spans(t)
            for lo, hi in stretches(t):
                for s in _starts(hi - lo):
                    part = t[lo + s : min(hi, lo + s + WINDOW)]
                    y = np.pad(tags_of(spans, lo + s, len(part)), (0, WINDOW - len(part))).astype(np.uint8)
                    key = -(xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass") + y.tobytes()) >> 1)  # one key, one window with its tags
                    if len(kept) == SAMPLE and key <= kept[0][0]:
                        continue
                    c = np.pad(classes(part), (0, WINDOW - len(part)), constant_values=PAD).astype(np.uint8)
                    (heapq.heappushpop if len(kept) == SAMPLE else heapq.heappush)(kept, (key, c.tobytes(), y.tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([-k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.binary()), pa.array([k[2] for k in kept], pa.binary())], names=["key", "chars", "tags"])


def learn(docs: DataFrame, steps: int = STEPS) -> Weights | None:
    """A model of the base spans of ``docs`` (text); None if there are none."""
    rows = docs.select("text").mapInArrow(sample_rows, "key long, chars binary, tags binary").dropDuplicates(["key"]).orderBy("key").limit(SAMPLE).collect()
    chars, tags = (np.array([np.frombuffer(r[c], np.uint8) for r in rows]) for c in ("chars", "tags"))
    return train(chars.astype(np.int64), tags.astype(np.int64), steps) if len(rows) and tags.any() else None


def span_rows(w: Weights | None):
    light = w and Weights(*(p.astype(np.float32) for p in w))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                yield one(whole.slice(at, 1000))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, more = [], []
        texts = [(t.as_py() or "") for t in batch.column("text")]
        places = []
        for i, t in enumerate(texts):
            hot = TRIGGER.search(t) is not None
            base.append(base_spans(t) if hot else [])
            more.append([])
            if hot and light:
                places += [(i, lo, hi) for lo, hi in stretches(t)]
        if places:
            for (i, lo, _), tags in zip(places, decoded(light, [texts[i][lo:hi] for i, lo, hi in places]), strict=True):
                if tags.any():
                    more[i] += additions(texts[i], base[i], ((a + lo, k, b + lo) for a, k, b in spans_of(tags)))
        text_of = [written(b) for b in base]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text_of]), pa.array([written(sorted(b + m)) for b, m in zip(base, more, strict=True)])],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )

    return rows


def find(docs: DataFrame, model: Weights | None = None) -> DataFrame:
    """Spans of ``docs`` (doc_id, text): doc_id, counts of base spans by kind, base_sha256, spans (base and added)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.mapInArrow(span_rows(model or learn(docs)), f"doc_id long, {counts}, base_sha256 string, spans string")
