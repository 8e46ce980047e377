"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearloom.llm.common import parts_for
from nearloom.llm.vectors import common_size, finite, matrix
from nearloom.session import cut_lineage

SAMPLE = 2048
# Index rows in one task of the scoring step, and rows of one bucket or probes of one bucket
# above which the bucket is split.
SHARD_ROWS = 16_384
BUCKET_ROWS = 4096
# Numbers in the largest array of differences.
BLOCK = 1 << 22


@dataclass(frozen=True)
class PStable:
    """Hashes floor((a.x + b) / width) with normal ``a``: ``tables`` tables of ``hashes`` hashes each.

    ``reach`` is the distance at which neighbours are expected; ``success`` is the probability
    that the buckets visited in one table hold a neighbour at that distance.
    """

    dim: int
    width: float
    reach: float
    tables: int
    hashes: int
    success: float
    seed: int = 42

    @cached_property
    def planes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.normal(size=(self.dim, self.tables * self.hashes))
        return a, rng.uniform(0, self.width, size=self.tables * self.hashes)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in units of the bucket width, by row, table and hash."""
        a, b = self.planes
        return ((x @ a + b) / self.width).reshape(len(x), self.tables, self.hashes)

    def code(self, table: int, cells: np.ndarray) -> np.ndarray:
        """A 64-bit number of the bucket with integer coordinates ``cells``. A collision only adds candidates."""
        out = np.full(cells.shape[:-1], table + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(cells.shape[-1]):
                out = (out ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of every row in every table."""
        cells = np.floor(self.places(x)).astype(np.int64)
        return np.stack([self.code(t, cells[:, t]) for t in range(self.tables)], axis=1)

    def probes(self, place: np.ndarray) -> np.ndarray:
        """Buckets to visit for one query, given its places, in order of estimated success.

        A neighbour at distance ``reach`` lies, along each hash, at a normal distance from the query.
        The product over hashes of the mass that falls on a cell is the success of a bucket;
        buckets are visited from the likeliest on until their sum reaches ``success``.
        """
        spread = self.reach / self.width
        far = math.ceil(4 * spread) + 1
        slack = (1 - self.success) / (4 * self.hashes)
        visited = []
        for t in range(self.tables):
            cells, chance = np.zeros((1, 0), np.int64), np.ones(1)
            for x in place[t]:
                own = np.arange(math.floor(x) - far, math.floor(x) + far + 1)
                edges = np.array([0.5 * math.erf((e - x) / spread / math.sqrt(2)) for e in np.append(own, own[-1] + 1)])
                mass = np.diff(edges)
                chance = (chance[:, None] * mass[None]).ravel()
                cells = np.concatenate([np.repeat(cells, len(own), 0), np.tile(own, len(cells))[:, None]], axis=1)
                # Buckets of the least success, slack in sum, are left out for good.
                order = np.argsort(-chance, kind="stable")
                keep = order[: int(np.searchsorted(np.cumsum(chance[order]), chance.sum() - slack)) + 1]
                cells, chance = cells[keep], chance[keep]
            stop = int(np.searchsorted(np.cumsum(chance), self.success)) + 1
            visited.append(self.code(t, cells[:stop]))
        return np.concatenate(visited)


def fit(
    vectors: DataFrame, rows: int, dim: int, key: str, vector: str, k: int,
    recall: float, tables: int, bucket_rows: int, sample: int, seed: int,
) -> PStable:
    """Width, reach and number of hashes from the ``sample`` rows of the smallest key hash (at most ``sample`` x ``dim`` numbers)."""
    found = vectors.orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow()
    x = matrix(found.column(0), dim)
    squares = (x * x).sum(1)
    dist = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * (x @ x.T), 0))
    np.fill_diagonal(dist, np.inf)
    near = np.sort(dist, axis=1)[:, min(k, len(x) - 1) - 1] if len(x) > 1 else np.ones(1)
    near = near[np.isfinite(near)]
    reach = float(np.median(near)) if len(near) and np.median(near) > 0 else float(np.sqrt(squares).mean()) or 1.0
    # Cells in use along one hash, from the entropy of a normal spread cut at this width.
    spread = float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean())) or reach
    in_use = max(1.5, spread / reach * math.sqrt(2 * math.pi * math.e))
    hashes = max(1, round(math.log(max(rows / bucket_rows, 1.5)) / math.log(in_use)))
    return PStable(dim, reach, reach, tables, hashes, 1 - (1 - recall) ** (1 / tables), seed)


def _score(index: pa.Table, probes: pa.Table, dim: int, k: int) -> pa.Table:
    """The k nearest of a shard's rows for each of its queries, among rows of buckets that the query visits."""
    code = index.column("code").to_numpy()
    order = np.argsort(code, kind="stable")
    code, ids = code[order], index.column("vec_id").to_numpy()[order]
    x = matrix(index.column("vector"), dim)[order]
    queries, q = probes.column("query_id").to_numpy(), matrix(probes.column("vector"), dim)
    visits = probes.column("codes").combine_chunks()
    wanted = visits.flatten().to_numpy()
    who = np.repeat(np.arange(len(queries)), np.diff(visits.offsets.to_numpy()))
    order = np.argsort(wanted, kind="stable")
    wanted, who = wanted[order], who[order]
    starts = np.flatnonzero(np.append(True, wanted[1:] != wanted[:-1])) if len(wanted) else np.empty(0, int)
    out_q, out_v, out_d = [], [], []
    for s, e in zip(starts, np.append(starts[1:], len(wanted))):
        low, high = np.searchsorted(code, wanted[s], "left"), np.searchsorted(code, wanted[s], "right")
        if low == high:
            continue
        step = max(1, BLOCK // ((high - low) * dim))
        for i in range(s, e, step):
            mine = who[i : min(i + step, e)]
            d = np.sqrt(((q[mine][:, None] - x[None, low:high]) ** 2).sum(-1))
            d[queries[mine][:, None] == ids[None, low:high]] = np.inf
            bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if high - low > k else np.full((len(mine), 1), np.inf)
            r, c = np.nonzero((d <= bound) & np.isfinite(d))
            out_q.append(mine[r])
            out_v.append(ids[low:high][c])
            out_d.append(d[r, c])
    if not any(map(len, out_q)):
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    a, v, d = np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_d)
    order = np.lexsort((v, d, a))
    a, v, d = a[order], v[order], d[order]
    # A row met in several tables has the same distance each time.
    fresh = np.append(True, (a[1:] != a[:-1]) | (v[1:] != v[:-1]) | (d[1:] != d[:-1]))
    a, v, d = a[fresh], v[fresh], d[fresh]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    top = rank < k
    return pa.table({"query_id": queries[a[top]], "vec_id": v[top], "score": d[top]})


def _search_cells(index: DataFrame, probes: DataFrame, dim: int, k: int) -> DataFrame:
    """Score index rows (shard, code, vec_id, vector) against probes (shard, query_id, vector, codes)."""
    return (
        index.groupBy("shard")
        .cogroup(probes.groupBy("shard"))
        .applyInArrow(lambda left, right: _score(left, right, dim, k), "query_id bigint, vec_id bigint, score double")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of every query; partitions are cut to k before the shuffle."""
    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def multiprobe_search(
    queries: DataFrame, base: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10,
    recall: float = 0.98, tables: int = 4, bucket_rows: int = 512, sample: int = SAMPLE, seed: int = 42,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``base`` that hashing finds for each query.

    ``score`` is the Euclidean distance in doubles; ties go to the smaller key; rows with the query's own
    key are no candidates. Every row is in every table; a query visits buckets until a
    neighbour is met in some table with probability ``recall``, as estimated at the distance of
    the k-th neighbour in a sample of ``sample`` rows. A query that has met fewer than k rows is
    compared with all rows, in blocks. ``bucket_rows`` sets the number of hashes, which grows with the
    logarithm of the table.

    Of rows with equal vectors the k + 1 smallest keys are kept: no other can be among the k
    nearest. A bucket with many rows or visited by many queries becomes a grid of cells. Tasks
    return k rows a query at most.

    Vectors that are null, empty, zero or hold null or non-finite numbers, vectors of another
    length than the most frequent one, and rows with a null key take no part. Repeated rows count
    once. Other columns are not looked at. Empty tables give no rows.
    """
    out = "query_id bigint, rank int, vec_id bigint, score double"
    spark = base.sparkSession

    def taking_part(df: DataFrame) -> DataFrame:
        return df.filter(finite(vector) & F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
        )

    rows = taking_part(base)
    dim, _ = common_size(rows, "vector")
    same = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id")
    rows = rows.filter(F.size("vector") == dim).distinct()
    rows = cut_lineage(rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy"))
    count = rows.count()
    asked = cut_lineage(
        taking_part(queries).filter(F.size("vector") == dim).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    )
    if not count:
        return spark.createDataFrame([], out)
    model = fit(rows, count, dim, "vec_id", "vector", k, recall, tables, bucket_rows, sample, seed)
    shards = parts_for(count * tables, SHARD_ROWS, spark.sparkContext.defaultParallelism)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = model.codes(matrix(b.column(1), dim))
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["vec_id", "vector", "codes"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = [model.probes(p) for p in model.places(matrix(b.column(1), dim))]
                codes = pa.array(lists, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), codes], names=["query_id", "codes"])

    index = rows.mapInArrow(hashed, "vec_id bigint, vector array<double>, codes array<bigint>")
    index = index.select("vec_id", "vector", F.explode("codes").alias("code"))
    visits = cut_lineage(
        asked.mapInArrow(visited, "query_id bigint, codes array<bigint>").select("query_id", F.explode("codes").alias("code"))
    )
    # Buckets to split, with the parts of their rows and of their queries.
    held = index.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS)
    sought = visits.groupBy("code").agg(F.count("*").alias("m")).filter(F.col("m") > BUCKET_ROWS)
    split = cut_lineage(
        held.join(sought, "code", "full").select(
            "code",
            F.coalesce(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1)).cast("int").alias("row_parts"),
            F.coalesce(F.ceil(F.col("m") / BUCKET_ROWS), F.lit(1)).cast("int").alias("query_parts"),
        )
    )
    parts = lambda c: F.coalesce(F.col(c), F.lit(1))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    one_of = lambda x, c: F.pmod(F.xxhash64(x), parts(c)).cast("int")
    shard = F.pmod(F.xxhash64("code", "row_part", "query_part"), F.lit(shards)).cast("int")
    cells = index.join(split, "code", "left").withColumn("row_part", one_of("vec_id", "row_parts")).withColumn(
        "query_part", all_of("query_parts")
    )
    cells = cells.select(shard.alias("shard"), "code", "vec_id", "vector")
    sent = visits.join(split, "code", "left").withColumn("query_part", one_of("query_id", "query_parts")).withColumn(
        "row_part", all_of("row_parts")
    )
    sent = sent.select("query_id", shard.alias("shard"), "code").distinct().groupBy("query_id", "shard").agg(
        F.collect_list("code").alias("codes")
    )
    sent = sent.join(asked, "query_id").select("shard", "query_id", "vector", "codes")
    found = cut_lineage(_best(_search_cells(cells, sent, dim, k), k))
    # Too few met: compare with every row.
    short = asked.join(found.groupBy("query_id").count().filter(F.col("count") >= min(k, max(count - 1, 0))), "query_id", "left_anti")
    whole = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("code"), "vec_id", "vector")
    to_all = short.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "vector", F.array(F.lit(0).cast("long")).alias("codes")
    )
    if not short.isEmpty():
        more = _best(_search_cells(whole, to_all, dim, k), k)
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
