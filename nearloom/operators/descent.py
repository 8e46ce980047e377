"""k-NN graph by neighbour descent: neighbours of neighbours are compared until the lists stop changing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearloom.functions import keyed, pairs
from nearloom.functions import vectors as V
from nearloom.operators import knn
from nearloom.session import bucket_count, cut_to_table, number_rows

CANDIDATES = "src bigint, dst bigint, dist double"
# Room for the rounding of a matrix product against the distances that decide.
SLACK = 1e-9
# Pairs of lists met at once, pairs found that a task holds, and pairs whose vectors lie side by side.
MET, HELD, STEP = 1 << 18, 1 << 20, 1 << 14


@dataclass
class Descent:
    """``neighbours``: ``src, rank, dst, dist``; ``rounds``: pairs compared and list entries changed in every round."""

    neighbours: DataFrame
    rounds: list[dict] = field(default_factory=list)


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if metric == "l2sq":
        return np.einsum("ij,ij->i", a - b, a - b)
    dots = np.einsum("ij,ij->i", a, b)
    return 1.0 - dots if metric == "cosine" else -dots


def _met(metric: str, x: np.ndarray, new: np.ndarray, limit: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that stand in one list, of which one is new, and that may enter the list of an end."""
    squares = np.einsum("ij,ij->i", x, x)
    left, right = [], []
    for low, high in zip(offsets[:-1], offsets[1:]):
        part, fresh, most = x[low:high], new[low:high].astype(bool), limit[low:high]
        dots = part @ part.T
        rough = squares[low:high, None] + squares[None, low:high] - 2 * dots if metric == "l2sq" else -dots
        rough = rough + (1.0 if metric == "cosine" else 0.0)
        slack = SLACK * (1 + np.abs(rough))
        near = (fresh[:, None] | fresh[None, :]) & ((rough <= most[:, None] + slack) | (rough <= most[None, :] + slack))
        i, j = np.nonzero(np.triu(near, 1))
        left.append(i + low)
        right.append(j + low)
    return np.concatenate(left), np.concatenate(right)


def _best_of(src: np.ndarray, dst: np.ndarray, dist: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once and at most ``keep`` pairs of a source, by distance, then id."""
    order = np.lexsort((dst, dist, src))
    src, dst, dist = src[order], dst[order], dist[order]
    # A pair met at several nodes has one distance, so its repeats are neighbours in this order.
    first = np.append(True, (np.diff(src) != 0) | (np.diff(dst) != 0)) if len(src) else np.zeros(0, bool)
    src, dst, dist = src[first], dst[first], dist[first]
    starts = np.flatnonzero(np.append(True, np.diff(src) != 0)) if len(src) else np.zeros(0, np.int64)
    place = np.arange(len(src)) - np.repeat(starts, np.diff(np.append(starts, len(src))))
    best = place < keep
    return src[best], dst[best], dist[best]


def _local_join(metric: str, keep: int):
    """Distances of the pairs of each row's ``items`` of which one is new, sent to the ends whose lists they may enter.

    A matrix product screens the pairs; the distances sent are those of the exact joins. Lists are met a few at a time, so that at most
    about ``MET`` pairs are held; a task sends each pair once and at most ``keep`` pairs of a source for every ``HELD`` pairs found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def reduced() -> tuple[np.ndarray, ...]:
            return _best_of(*(np.concatenate(c) for c in zip(*held)), keep)

        for b in batches:
            lists = b.column(0)
            lengths = lists.value_lengths().to_numpy()
            group = np.cumsum(lengths * lengths) // MET
            for rows in np.split(np.arange(len(lists)), np.flatnonzero(np.diff(group)) + 1) if len(lists) else []:
                items = lists.slice(rows[0], len(rows)).flatten()
                ids, new, limit = (items.field(c).to_numpy(zero_copy_only=False) for c in ("id", "new", "limit"))
                x = items.field("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(items), -1)
                i, j = _met(metric, x, new, limit, np.concatenate([[0], np.cumsum(lengths[rows])]))
                d = np.concatenate([np.zeros(0), *(_exact(metric, x[i[s : s + STEP]], x[j[s : s + STEP]]) for s in range(0, len(i), STEP))])
                src, dst = np.concatenate([ids[i], ids[j]]), np.concatenate([ids[j], ids[i]])
                dist, most = np.concatenate([d, d]), np.concatenate([limit[i], limit[j]])
                use = (dist <= most) & (src != dst)
                held.append(_best_of(src[use], dst[use], dist[use], keep))
                count += len(held[-1][0])
                if count >= HELD:
                    held = [reduced()]
                    count = len(held[0][0])
                    # Little was gained: these pairs go.
                    if count >= HELD // 2:
                        yield from pa.table(dict(zip(("src", "dst", "dist"), held[0]))).to_batches(max_chunksize=1 << 16)
                        held, count = [], 0
        if held:
            yield from pa.table(dict(zip(("src", "dst", "dist"), reduced()))).to_batches(max_chunksize=1 << 16)

    return run


def _first_lists(nodes: DataFrame, keep: int, metric: str, seed: int, count: int) -> DataFrame:
    """The ``keep`` nodes that follow each node in the order of keyed hashes."""
    keyed_ids = nodes.select(F.struct(keyed.hash60(seed, F.col("id")).alias("h"), "id").alias("k"))
    placed = cut_to_table(number_rows(keyed_ids, "k", "place").select(F.col("k.id").alias("id"), "place"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(min(keep, count - 1)))).alias("step")
    drawn = placed.select(F.col("id").alias("src"), "place", steps).select("src", F.pmod(F.col("place") + F.col("step"), F.lit(count)).alias("place"))
    # The planner takes the drawn rows to be as few as the nodes and would send all of them through the driver.
    drawn = drawn.join(placed.withColumnRenamed("id", "dst").hint("merge"), "place").select("src", "dst")
    ends = [nodes.select(F.col("id").alias(c), F.col("vec").alias(f"{c}_vec")) for c in ("src", "dst")]
    scored = drawn.join(ends[0], "src").join(ends[1], "dst")
    return scored.select("src", "dst", pairs.vector_distance(metric, "src_vec", "dst_vec").alias("dist"), F.lit(True).alias("new"))


def _around(lists: DataFrame, keep: int, seed: int, turn: int) -> DataFrame:
    """``z, id, new``: a node's list, at most ``keep`` of the nodes that list it (in hash order), and itself."""
    sampled = Window.partitionBy("dst").orderBy(keyed.hash60(seed, turn, F.col("src"), F.col("dst")), "src")
    back = lists.withColumn("place", F.row_number().over(sampled)).filter(F.col("place") <= keep)
    own = lists.select(F.col("src").alias("z")).distinct().select("z", F.col("z").alias("id"), F.lit(False).alias("new"))
    every = (
        lists.select(F.col("src").alias("z"), F.col("dst").alias("id"), "new")
        .unionByName(back.select(F.col("dst").alias("z"), F.col("src").alias("id"), "new")).unionByName(own)
    )
    return every.groupBy("z", "id").agg(F.max("new").alias("new"))


def descend(
    df: DataFrame, k: int, metric: str = "cosine", pool: int | None = None, max_rounds: int = 20, stop: float = 0.001,
    seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding",
) -> Descent:
    """Approximate k-NN graph whose work grows with rows x rounds instead of rows squared.

    Every node keeps its ``pool`` best neighbours so far (default: twice ``k``, 24 at least), from the nodes that follow it in a
    hash order. In a round, a node's list, a sample of the nodes that list it and the node itself meet, and each pair with
    an entry that is new since the last round is compared. It ends when fewer than ``stop`` of all entries changed, or after ``max_rounds``.
    Every choice is a hash of ids, so results do not depend on partitions. Rows without a vector take no part.

    A round moves each vector to the at most 2 ``pool`` + 1 places where it is listed; a popular node is a hot key only of a join
    against one row per key, which adaptive execution splits. Rounds are written to the checkpoint folder.
    """
    if metric not in V.VECTOR_METRICS:
        raise ValueError(f"unknown metric {metric}")
    if k < 1 or max_rounds < 0:
        raise ValueError("k must be > 0 and max_rounds >= 0")
    pool = pool or max(2 * k, 24)
    nodes = cut_to_table(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).filter("id is not null and vec is not null"))
    count = nodes.count()
    if count < 2:
        empty = df.sparkSession.createDataFrame([], CANDIDATES)
        return Descent(knn.top_k(empty, k, "src", ("dist", "dst")).select("src", "rank", "dst", "dist"))
    parts = bucket_count(df.sparkSession, count * pool)
    lists = cut_to_table(_first_lists(nodes, pool, metric, seed, count))
    rounds = []
    for turn in range(1, max_rounds + 1):
        around = cut_to_table(_around(lists, pool, seed, turn))
        sizes = around.groupBy("z").agg(F.count_if("new").alias("fresh"), F.count(F.lit(1)).alias("every"))
        compared = sizes.agg(F.coalesce(F.sum(F.expr("fresh * (fresh - 1) div 2 + fresh * (every - fresh)")), F.lit(0))).first()[0]
        full = F.when(F.count(F.lit(1)) >= min(pool, count - 1), F.max("dist")).otherwise(F.lit(float("inf")))
        limits = lists.groupBy(F.col("src").alias("id")).agg(full.alias("limit"))
        met = around.join(nodes.join(limits, "id"), "id").repartition(parts, "z")
        gathered = met.groupBy("z").agg(F.collect_list(F.struct("id", "new", "limit", "vec")).alias("items")).select("items")
        found = gathered.mapInArrow(_local_join(metric, pool), CANDIDATES)
        every = lists.select("src", "dst", "dist", F.lit(1).alias("old")).unionByName(found.withColumn("old", F.lit(0)))
        every = every.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.max("old").alias("old"))
        best = knn.top_k(every, pool, "src", ("dist", "dst"))
        lists = cut_to_table(best.select("src", "dst", "dist", (F.col("old") == 0).alias("new")))
        changed = lists.filter("new").count()
        rounds.append({"round": turn, "pairs": int(compared), "updates": changed})
        if changed <= stop * count * pool:
            break
    return Descent(knn.top_k(lists.drop("new"), k, "src", ("dist", "dst")).select("src", "rank", "dst", "dist"), rounds)
