"""Quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import release

# Bounds of the model: labelled documents to learn from, bins per feature, pairs.
SAMPLE = 20_000
BINS = 48
PAIRS = 6
FEATURES = (
    "words", "word_length", "distinct_words", "top_word", "repeated_neighbours", "repeated_lines", "line_words",
    "symbols", "symbol_words", "upper", "digits", "stops", "long_words", "non_ascii",
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` over the whole text; zeros for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    letters = sum(map(len, words))
    symbols = int(counts[_SYMBOL].sum())
    return [
        float(np.log1p(n)),
        letters / n,
        len(seen) / n,
        max(seen.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        symbols / letters,
        sum(c for w, c in seen.items() if not w.isalnum() and len(w) <= 3 and w.isascii() and not any(map(str.isalnum, w.decode()))) / n,
        int(counts[65:91].sum()) / letters,
        int(counts[48:58].sum()) / letters,
        sum(int(counts[ord(c)]) for c in ".!?") / n,
        sum(c for w, c in seen.items() if len(w) > 20) / n,
        int(counts[128:].sum()) / letters,
    ]


@dataclass
class AdditiveModel:
    """score = sigmoid(bias + sum of per-feature tables + sum of pair tables), all looked up by bin."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers of all rows and features."""
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.bias)
        for j, t in enumerate(self.tables):
            z += t[bins[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[bins[:, i], bins[:, j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -40, 40))) if len(x) else np.zeros(0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, penalty: float = 1.0) -> np.ndarray:
    """Leaf values, by bin, of a tree over the bins of one feature, grown by its best splits."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + penalty)
    spans = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in spans:
            at = np.arange(a + 1, b)
            if len(at):
                won = gain(a, at) + gain(at, b) - gain(a, b)
                i = int(np.argmax(won))
                if won[i] > best[0]:
                    best = (won[i], (a, b), int(at[i]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + penalty)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, penalty: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts each of two features once."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    rows, cols = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not rows.size:
        return 0.0, np.zeros_like(g)
    total_g, total_h = cg[-1, -1], ch[-1, -1]

    def leaf(c, total):
        a = c[rows, cols]
        b, d = c[rows, -1] - a, c[-1, cols] - a
        return a, b, d, total - a - b - d

    parts = list(zip(leaf(cg, total_g), leaf(ch, total_h)))
    gains = sum(x * x / (y + penalty) for x, y in parts) - total_g**2 / (total_h + penalty)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    a, b, c, d = (-x[i, j] / (y[i, j] + penalty) for x, y in parts)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = a, b, c, d
    return float(gains[i, j]), out


def train(x: np.ndarray, y: np.ndarray, bins: int = BINS, pairs: int = PAIRS, rounds: int = 150, rate: float = 0.1) -> AdditiveModel:
    """Cyclic boosting: every round gives each feature a shallow tree fitted to what is left; then pairs likewise."""
    if not len(x):
        return AdditiveModel(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    mean = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(mean / (1 - mean))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    at = model.bins(x)
    z = model.logits(at)

    def gradients():
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = gradients()
            step = rate * _shallow_tree(*(np.bincount(at[:, j], v, len(table)) for v in (g, h)))
            table += step
            z = z + step[at[:, j]]
    shape = lambda i, j: (len(model.tables[i]), len(model.tables[j]))

    def grid(i, j, v):
        a, b = shape(i, j)
        return np.bincount(at[:, i] * b + at[:, j], v, a * b).reshape(a, b)

    g, h = gradients()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(len(cuts)), 2)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:pairs]]
    model.pair_tables = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = gradients()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            z = z + step[at[:, i], at[:, j]]
    return model


def _feature_frame(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, *b.columns[1:]], names=["features", *keep])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(text).cast("string").alias(text), *keep).mapInArrow(run, f"features array<double>, {kinds}")


def fit(sample: DataFrame, text: str = "text", label: str = "label") -> AdditiveModel:
    """A model learned from ``sample`` (text, label 0/1), which is bounded by its maker.

    Features are made on the executors; their values, a row of numbers per document, are fitted on
    the driver. Without rows the score is one half.
    """
    found = _feature_frame(sample, text, label).toArrow()
    x = np.array(found.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = found.column(label).to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))
    return train(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` in [0, 1], higher if label 1 is likelier.

    Features are taken over the whole text; null and empty texts are texts without words. A
    column named ``score`` is replaced. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t.as_py()) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.array(shared.value.score(x))
        release()

    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col(text).cast("string")))
