"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import release, words_of
from nearloom.session import cut_lineage

# Bounds of the model: labelled documents to learn from, hashed terms, factors per term.
SAMPLE = 16_000
TERMS = 4096
FACTORS = 8
MIN_DOCS = 5
# A word counts as itself and as its beginnings of these lengths, which stand for its stem.
PREFIXES = (3, 4, 5, 6)
EDGE = b"\"'.,;:!?()[]{}<>|#$%&*@^~+-=_/\\`"
# Words whose terms a worker remembers at a time.
MEMO = 300_000


def term_hashes(word: bytes) -> set[int]:
    """Signed 64-bit hashes of the terms of a lower-case word without edge punctuation."""
    letters = word.decode()
    terms = {word, *(letters[:n].encode() + b"*" for n in PREFIXES if len(letters) > n)}
    return {h - (1 << 64) if (h := xxhash.xxh64_intdigest(t)) >> 63 else h for t in terms}


def _bare_words(text: str | None) -> set[bytes]:
    found = {w.strip(EDGE) for w in set(words_of(text))}
    found.discard(b"")
    return found


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the distinct known terms of a text."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid of ``n`` texts whose terms are given as (row, term number) pairs sorted by row."""
        return _logits(self.bias, self.weights, self.factors, rows, columns, n)[0]

    def scorer(self):
        """A function from a batch of texts to scores, with a bounded memory of words."""
        place = {int(t): i for i, t in enumerate(self.terms)}
        memo: dict[bytes, tuple[int, ...]] = {}

        def known(word: bytes) -> tuple[int, ...]:
            got = memo.get(word)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                got = memo[word] = tuple(place[h] for h in term_hashes(word) if h in place) if place else ()
            return got

        def score(texts: list[str | None]) -> np.ndarray:
            rows, columns = [], []
            for i, text in enumerate(texts):
                mine = sorted({t for w in _bare_words(text) for t in known(w)})
                rows += [i] * len(mine)
                columns += mine
            z = self.logits(np.array(rows, np.int64), np.array(columns, np.int64), len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        return score


def _logits(bias, weights, factors, rows, columns, n):
    linear = np.bincount(rows, weights[columns], n) if len(rows) else np.zeros(n)
    sums = np.zeros((n, factors.shape[1]))
    squares = np.zeros(n)
    if len(rows):
        v = factors[columns]
        np.add.at(sums, rows, v)
        squares = np.bincount(rows, (v * v).sum(1), n)
    return bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def train(
    terms: np.ndarray, rows: np.ndarray, columns: np.ndarray, y: np.ndarray, factors: int = FACTORS,
    epochs: int = 40, batch: int = 512, rate: float = 0.05, decay: float = 1e-4, seed: int = 42,
) -> FactorizationMachine:
    """Fit by mini-batch gradients with per-parameter step sizes; ``rows`` are sorted."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(scale=0.02, size=(len(terms), factors))
    mean = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(mean / (1 - mean)))
    gw, gv, gb = np.full(len(terms), 1e-3), np.full(v.shape, 1e-3), 1e-3
    starts = np.searchsorted(rows, np.arange(len(y) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            mine = order[i : i + batch]
            sizes = starts[mine + 1] - starts[mine]
            r = np.repeat(np.arange(len(mine)), sizes)
            at = np.repeat(starts[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(r))
            c = columns[at]
            z, sums = _logits(bias, w, v, r, c, len(mine))
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[mine]) / len(mine)
            used, slot = np.unique(c, return_inverse=True)
            dw = np.bincount(slot, error[r], len(used)) + decay * w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, slot, error[r][:, None] * (sums[r] - v[c]))
            dv += decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += error.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * error.sum() / np.sqrt(gb)
    return FactorizationMachine(terms, float(bias), w, v)


def fit(sample: DataFrame, text: str = "text", label: str = "label", terms: int = TERMS, seed: int = 42) -> FactorizationMachine:
    """A machine learned from ``sample`` (text, label 0/1), which is bounded by its maker.

    Terms seen in fewer than ``MIN_DOCS`` documents are dropped; of the others the ``terms`` most
    telling ones by the chi-square of their counts are kept. Counting runs on the executors; only these
    terms and, per document, the numbers of its kept terms reach the driver. With one class or no rows the
    score is constant.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [sorted({h for w in _bare_words(t.as_py()) for h in term_hashes(w)}) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), b.column(1)], names=["terms", "label"])

    docs = cut_lineage(
        sample.select(F.col(text).cast("string"), F.col(label).cast("int")).mapInArrow(hashed, "terms array<bigint>, label int")
        .withColumn("row", F.monotonically_increasing_id())
    )
    total, positive = docs.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    exploded = docs.select("row", "label", F.explode("terms").alias("term"))
    counts = exploded.groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("p")).filter(F.col("n") >= MIN_DOCS)
    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    share = F.lit(float(positive) / max(total, 1))
    telling = F.pow(p - n * share, 2) / n
    kept = counts.withColumn("telling", telling).orderBy(F.desc("telling"), "term").limit(terms).select("term")
    chosen = np.sort(kept.toArrow().column(0).to_numpy())
    labels = docs.select("row", "label").orderBy("row").toArrow()
    numbers, y = labels.column("row").to_numpy(), labels.column("label").to_numpy().astype(np.float64)
    names = docs.sparkSession.createDataFrame([(int(t), i) for i, t in enumerate(chosen)], "term bigint, number int")
    pairs = exploded.join(F.broadcast(names), "term").select("row", "number").toArrow()
    rows, columns = np.searchsorted(numbers, pairs.column("row").to_numpy()), pairs.column("number").to_numpy()
    order = np.lexsort((columns, rows))
    return train(chosen, rows[order], columns[order], y, seed=seed)


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` in [0, 1], higher if toxic is likelier.

    All words of the whole text are looked at. Null and empty texts get the score of a text
    without known terms. A column named ``score`` is replaced. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = shared.value.scorer()
        for texts in batches:
            yield pa.array(scorer(texts.to_pylist()))
        release()

    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col(text).cast("string")))
