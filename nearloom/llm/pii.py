"""Personal data in texts: fixed patterns, and spans that a character BiLSTM with CRF transitions adds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import release

KINDS = ("email", "ip", "card", "phone")
# Tag 0 is outside; 1 + kind begins a span and 5 + kind continues it.
TAGS = 1 + 2 * len(KINDS)
# Characters of a window and between the starts of two; a span of up to their difference lies whole in some window.
WINDOW, STRIDE = 160, 64
# Windows that are decoded together.
TOGETHER = 256
# Rows of the model's character table: ASCII, other letters, anything else, and no character.
LETTER, OTHER, NOTHING, ROWS = 128, 129, 130, 131
HIDDEN = 24
# Bounds of training: documents, windows of a document, windows in all, steps, windows and characters of a step.
SAMPLE, OF_DOCUMENT, WINDOWS, STEPS, BATCH, SPAN = 4000, 6, 12_000, 180, 64, 96

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin only where a run of digits does; starts within it would only be tried in vain.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Digits with at most two of the signs that added spans may have between them.
RUN = re.compile(r"[0-9](?:[ ()./-]{0,2}[0-9])*")
ADDED = {
    "email": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"), "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ./-]?[0-9])+"), "phone": re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])+"),
}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each ``@``: its local part reaches back as far as it can."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            done = end.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def matches(text: str) -> list[Span]:
    """``kind, start, end`` of all matches of the patterns, whatever their digits."""
    out = [(0, *span) for span in _emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def holds(kind: int, s: str) -> bool:
    """Whether the digits of a match fit its kind."""
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    digits = _digits(s)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Matches whose digits fit, by kind and start."""
    return [(k, a, b) for k, a, b in matches(text) if holds(k, text[a:b])]


def _valid(kind: int, text: str, a: int, b: int) -> bool:
    """Exact check of a span that the model adds: shape and digits, and no letter or digit on either side."""
    if not ADDED[KINDS[kind]].fullmatch(text, a, b) or not holds(kind, text[a:b]):
        return False
    if kind == 3 and not re.search(r"[ ().-]", text[a:b]):
        return False
    return not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())


def codes(text: str) -> np.ndarray:
    """Rows of the character table of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = points.astype(np.uint8)
    wide = np.flatnonzero(points > 127)
    out[wide] = [LETTER if text[i].isalpha() else OTHER for i in wide]
    return out


# ---- the model ----


@dataclass
class Tagger:
    """Gate inputs of every character, recurrent weights of both directions, and the CRF over their states."""

    inputs: np.ndarray  # direction, character, 4 * hidden: input, forget and output gates, then the candidate
    recurrent: np.ndarray  # direction, hidden, 4 * hidden
    output: np.ndarray  # 2 * hidden, tags
    bias: np.ndarray  # tags
    trans: np.ndarray  # tags, tags
    start: np.ndarray  # tags

    @staticmethod
    def fresh(seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) * 0.2).astype(np.float32)
        inputs = draw(2, ROWS, 4 * HIDDEN)
        inputs[:, :, HIDDEN : 2 * HIDDEN] += 1
        return Tagger(inputs, draw(2, HIDDEN, 4 * HIDDEN), draw(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), draw(TAGS, TAGS), np.zeros(TAGS, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.output, self.bias, self.trans, self.start]

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Tag scores of windows ``x`` (windows, characters), and what the gradient needs where asked."""
        n, length = x.shape
        states, kept = np.empty((2, length, n, HIDDEN), np.float32), []
        for way in (0, 1):
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            steps = []
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                z = self.inputs[way][x[:, t]] + h @ self.recurrent[way]
                gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                g = np.tanh(z[:, 3 * HIDDEN :])
                before, h_before = c, h
                c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * g
                squashed = np.tanh(c)
                h = gates[:, 2 * HIDDEN :] * squashed
                states[way, t] = h
                if keep:
                    steps.append((t, gates, g, before, h_before, squashed))
            kept.append(steps)
        both = np.concatenate([states[0], states[1]], axis=2)
        return both @ self.output + self.bias, [both, kept]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of windows and how far each beats the tag outside."""
        scores, _ = self.run(x)
        length, n = scores.shape[:2]
        best, back = self.start + scores[0], np.empty((length, n, TAGS), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + self.trans
            back[t] = ways.argmax(1)
            best = ways.max(1) + scores[t]
        tags = np.empty((length, n), np.int8)
        tags[-1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        lead = np.take_along_axis(scores, tags[:, :, None].astype(np.int64), 2)[:, :, 0] - scores[:, :, 0]
        return tags.T, lead.T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of tags ``y`` and its gradient, by the forward-backward sums and back through time."""
        scores, (both, kept) = self.run(x, keep=True)
        length, n = scores.shape[:2]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = self.start + scores[0]
        for t in range(1, length):
            alpha[t] = lse(alpha[t - 1][:, :, None] + self.trans, 1) + scores[t]
        for t in range(length - 2, -1, -1):
            beta[t] = lse(self.trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        d_scores = np.exp(alpha + beta - total[None, :, None])
        ways = alpha[:-1, :, :, None] + self.trans + (scores[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        d_trans = np.exp(ways).sum((0, 1))
        rows, places = np.arange(n), y.T
        gold = self.start[places[0]] + scores[0, rows, places[0]]
        for t in range(1, length):
            gold = gold + self.trans[places[t - 1], places[t]] + scores[t, rows, places[t]]
        np.subtract.at(d_trans, (places[:-1].ravel(), places[1:].ravel()), 1)
        d_scores[np.arange(length)[:, None], rows, places] -= 1
        d_scores /= n
        d_states = d_scores @ self.output.T
        d_inputs, d_recurrent = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        here = np.zeros((ROWS, x.size), np.float32)
        here[x.T.ravel(), np.arange(x.size)] = 1
        for way in (0, 1):
            d_h, d_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            d_zs, hs = np.empty((length, n, 4 * HIDDEN), np.float32), np.empty((length, n, HIDDEN), np.float32)
            for t, gates, g, before, h_before, squashed in reversed(kept[way]):
                d_h = d_h + d_states[t, :, way * HIDDEN : (way + 1) * HIDDEN]
                i, f, o = np.split(gates, 3, axis=1)
                d_c = d_c + d_h * o * (1 - squashed**2)
                d_gates = np.concatenate([d_c * g, d_c * before, d_h * squashed], axis=1) * gates * (1 - gates)
                d_zs[t] = np.concatenate([d_gates, d_c * i * (1 - g**2)], axis=1)
                hs[t] = h_before
                d_c, d_h = d_c * f, d_zs[t] @ self.recurrent[way].T
            d_recurrent[way] = hs.reshape(-1, HIDDEN).T @ d_zs.reshape(-1, 4 * HIDDEN)
            d_inputs[way] = here @ d_zs.reshape(-1, 4 * HIDDEN)
        d_output = both.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, TAGS)
        return float((total - gold).mean()), [
            d_inputs, d_recurrent, d_output, d_scores.sum((0, 1)), d_trans.astype(np.float32) / n, d_scores[0].sum(0),
        ]


def tags_of(spans: list[Span], low: int, length: int) -> np.ndarray:
    """Tags of the characters from ``low`` on."""
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if b > low and a < low + length:
            y[max(a - low, 0) : b - low] = 1 + len(KINDS) + kind
            if a >= low:
                y[a - low] = 1 + kind
    return y


def _shapes(text: str) -> list[Span]:
    """What the tagger is taught: matches by shape, since no tagger can see a check digit; kinds that come later win."""
    ok = lambda k, s: holds(k, s) if k != 2 else 13 <= len(_digits(s)) <= 19
    return [(k, a, b) for k, a, b in sorted(matches(text), key=lambda s: (s[0] in (0, 3), s)) if ok(k, text[a:b])]


def _varied(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A window with other digits, groupings and neighbours of its spans, so that it is shapes in a context that are learned."""
    out, made, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        s, before, after = text[a:b], "", ""
        if kind in (2, 3):
            digits = "".join(str(d) for d in rng.integers(0, 10, len(_digits(s))))
            if kind == 2:
                joint = ("", " ", "-", ".", "")[rng.integers(5)]
                s = joint.join(digits[k : k + 4] for k in range(0, len(digits), 4))
            else:
                digits = digits[:11].rjust(11, "1")
                s = (
                    f"+{digits[0]} ({digits[1:4]}) {digits[4:7]}-{digits[7:]}", f"({digits[1:4]}) {digits[4:7]}-{digits[7:]}",
                    f"{digits[1:4]}-{digits[4:7]}-{digits[7:]}", f"{digits[1:4]}.{digits[4:7]}.{digits[7:]}", f"+{digits[0]} {digits[1:4]} {digits[4:7]} {digits[7:]}",
                )[rng.integers(5)]
        near = rng.integers(6)
        group = "".join(str(d) for d in rng.integers(0, 10, rng.integers(1, 4)))
        if near == 0:
            before = group + " "
        elif near == 1:
            after = " " + group
        out += text[at:a] + before
        made.append((kind, len(out), len(out) + len(s)))
        out += s + after
        at = b
    return out + text[at:], made


def _cut(x: np.ndarray, low: int, length: int) -> np.ndarray:
    """Characters from ``low`` on, filled up with nothing on both sides."""
    out = np.full(length, NOTHING, np.uint8)
    part = x[max(low, 0) : max(low + length, 0)]
    out[max(-low, 0) : max(-low, 0) + len(part)] = part
    return out


def _training_pieces(text: str) -> list[str]:
    """Parts of a text around its matches and other digits, at most ``OF_DOCUMENT``."""
    centres = [(a + b) // 2 for _, a, b in _shapes(text)][: OF_DOCUMENT - 2]
    centres += [m.start() for m in re.finditer(r"[0-9]+", text)][:: max(1, text.count(" ") // 50)][:1]
    centres += [len(text) // 2]
    return [text[max(0, c - SPAN) : c + SPAN] for c in centres]


def train(pieces: list[str], seed: int = 0) -> Tagger:
    """A tagger of the spans of ``pieces``; Adam over ``STEPS`` batches of windows drawn in a fixed order."""
    rng, tagger = np.random.default_rng(seed), Tagger.fresh(seed)
    sure = [(p, spans) for p in pieces if (spans := _shapes(p))]
    rest = [(p, []) for p in pieces if not _shapes(p)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in tagger.parameters()]
    for step in range(1, STEPS + 1 if sure else 1):
        xs, ys = np.empty((BATCH, SPAN), np.int64), np.empty((BATCH, SPAN), np.int64)
        for k in range(BATCH):
            piece, spans = sure[rng.integers(len(sure))] if k % 4 or not rest else rest[rng.integers(len(rest))]
            piece, spans = _varied(piece, spans, rng) if k % 3 else (piece, spans)
            centre = spans[rng.integers(len(spans))][1] if spans else len(piece) // 2
            low = centre - int(rng.integers(0, SPAN))
            xs[k], ys[k] = _cut(codes(piece), low, SPAN), tags_of(spans, low, SPAN)
        _, grads = tagger.gradient(xs, ys)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        rate = 0.02 * min(1, 2.5 * (1 - step / (STEPS + 1)))
        for p, g, (m, v) in zip(tagger.parameters(), grads, moments):
            g = g * min(1, 5 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Tagger:
    """A tagger taught by the patterns' matches in at most ``sample`` documents, those with digits whose keys' hashes are least."""
    told = docs.filter(F.col(text).rlike("[0-9@]")).select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    chosen = told.select("key").filter("key is not null").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = sorted({p for t in b.column(0) for p in _training_pieces(t.as_py())})
            yield pa.RecordBatch.from_pydict({"piece": pa.array(pieces, pa.string())})

    rows = told.join(F.broadcast(chosen), "key").select("text").mapInArrow(run, "piece string").distinct()
    return train(sorted(r.piece for r in rows.orderBy(F.xxhash64("piece"), "piece").limit(WINDOWS).collect()))


# ---- spans of whole texts ----


def reconcile(spans: dict[Span, float]) -> list[Span]:
    """Spans without overlap of the largest total lead; of equals the ones found first."""
    order = sorted(spans, key=lambda s: (s[2], s[1], s[0]))
    ends = np.array([s[2] for s in order])
    best, took = np.zeros(len(order) + 1), []
    for k, s in enumerate(order):
        free = int(np.searchsorted(ends[:k], s[1], side="right"))
        took.append(free if best[free] + spans[s] > best[k] else -1)
        best[k + 1] = max(best[k], best[free] + spans[s])
    out, k = [], len(order)
    while k:
        if took[k - 1] >= 0:
            out.append(order[k - 1])
            k = took[k - 1]
        else:
            k -= 1
    return out[::-1]


def window_starts(text: str, base: list[Span]) -> list[int]:
    """Windows that meet an ``@``, or digits that could be a number or an address, outside the base spans.

    An added span overlaps no base one and has to pass ``_valid``, whose digits form such a run: the windows left out
    could add nothing.
    """
    parts, at = [], 0
    for _, a, b in sorted(base, key=lambda s: s[1]):
        parts += [text[at:a], "x" * (b - max(a, at))]
        at = max(at, b)
    left = "".join(parts) + text[at:]
    met = [(m.start(), m.end()) for m in RUN.finditer(left) if len(_digits(m.group())) >= 9 or m.group().count(".") >= 3]
    met += [(m.start(), m.end()) for m in re.finditer("@", left)]
    return sorted({k * STRIDE for a, b in met for k in range((a - WINDOW) // STRIDE + 1, (b - 1) // STRIDE + 1)})


def _read_tags(tags: np.ndarray, lead: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """Spans of a window that do not touch its edges, with their lead."""
    n = len(KINDS)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tags])) != 0)
    edges = edges[tags[edges] > 0]
    for a in edges:
        if tags[a] > n:
            continue
        kind, b = tags[a] - 1, a + 1
        while b < len(tags) and tags[b] == 1 + n + kind:
            b += 1
        if a > 0 and b < len(tags):
            yield int(kind), int(a), int(b), float(lead[a:b].sum())


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[Span]], together: int = TOGETHER) -> list[list[Span]]:
    """Spans of the tagger that pass the exact check and overlap no base span, for each text."""
    jobs = [(d, low) for d, (t, base) in enumerate(zip(texts, bases)) for low in window_starts(t, base)]
    found: list[dict[Span, float]] = [{} for _ in texts]
    cached = (-1, None)
    for at in range(0, len(jobs), together):
        mine = jobs[at : at + together]
        x = np.full((together, WINDOW), NOTHING, np.int64)
        for k, (d, low) in enumerate(mine):
            if cached[0] != d:
                cached = (d, codes(texts[d]))
            # One character of the window is kept free so that a span at an end of the text has an edge.
            x[k] = _cut(cached[1], low - 1, WINDOW)
        tags, lead = tagger.decode(x)
        for k in np.flatnonzero(tags[: len(mine)].any(1)):
            d, low = mine[k]
            for kind, a, b, weight in _read_tags(tags[k], lead[k]):
                a, b = a + low - 1, b + low - 1
                clear = all(b <= c or a >= e for _, c, e in bases[d])
                if weight > 0 and 0 <= a < b <= len(texts[d]) and clear and _valid(kind, texts[d], a, b):
                    found[d][kind, a, b] = max(weight, found[d].get((kind, a, b), 0))
    return [reconcile(f) if f else [] for f in found]


SPANS = "array<struct<kind:int,start:int,end:int>>"


def find(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, spans`` of every row: spans ``kind, start, end`` in code points, end exclusive, by kind and start.

    ``base`` are the leftmost matches of each kind's pattern whose digits fit. ``spans`` are those and what the tagger adds:
    overlapping windows of the whole text are decoded, their spans checked exactly and reconciled over the text by
    the largest total lead, without touching a base span. Null and empty texts have no spans, repeated rows have each
    their own, and other columns are not looked at. A task holds a batch of rows and ``TOGETHER`` windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans)]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added_spans(shared.value, texts, bases)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(rows, bases), item), pa.array([rows(x + y) for x, y in zip(bases, more)], item)], [key, "base", "spans"]
            )
            release()

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, base {SPANS}, spans {SPANS}")


def joined(spans: str) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
