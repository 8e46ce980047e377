"""Exact k nearest sign codes below a scan's work: parts of the code are keys, and the radius grows query by query.

A code is cut into parts of ``width`` bits. Two codes that differ in fewer than ``parts * (r + 1)`` bits differ in at
most ``r`` bits in one of the parts, so once a query has visited all values within ``r`` bits of each of its own parts,
nothing nearer than that is left unseen. A query is finished when its k-th distance lies below.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.functions import tiles
from nearloom.operators import knn
from nearloom.operators.lsh import keyed_topk
from nearloom.params import CodeParams
from nearloom.session import bucket_count, cut_to_table

WIDTHS = (4, 8, 16)
WORD_BITS = 64


@dataclass(frozen=True)
class HammingIndex:
    """``buckets``: ``bucket, id, code``, one row per code and part; ``sizes``: rows of every bucket; ``codes``: ``vec_id, code``."""

    buckets: DataFrame
    sizes: DataFrame
    codes: DataFrame
    params: CodeParams
    width: int
    rows: int

    @property
    def parts(self) -> int:
        return -(-self.params.bits // self.width)

    @property
    def score(self) -> tiles.HammingScore:
        return tiles.HammingScore(self.params.bits, self.params.residual_bits, self.params.shift)

    def unseen(self, radius: int) -> int:
        """Least distance of a code that no round up to ``radius`` has met."""
        return self.parts * (radius + 1) << (self.params.shift if self.params.residual_bits else 0)

    def last_radius(self) -> int:
        """Largest radius up to which all visits of a query are, on even buckets, at most one scan's work."""
        visits, radius = self.parts, 0
        while radius < self.width:
            visits += self.parts * comb(self.width, radius + 1)
            if visits > 1 << self.width:
                break
            radius += 1
        return radius


@dataclass
class Found:
    """``hits``: ``query_id, vec_id, dist, rank``; ``rounds``: ``radius, queries, candidates, finished``, the closing scan as radius -1."""

    hits: DataFrame
    rounds: list[dict] = field(default_factory=list)


def _own_value(params: CodeParams, width: int, part: int) -> Column:
    """The bits of a part of ``code`` as a number."""
    start = part * width
    bits = min(width, params.bits - start)
    return F.shiftrightunsigned(F.col("code")[start // WORD_BITS], start % WORD_BITS).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(params: CodeParams, width: int, radius: int) -> Column:
    """Buckets at exactly ``radius`` bits from the code, over all parts."""
    def of(part: int) -> Column:
        bits = min(width, params.bits - part * width)
        flips = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda x: F.bit_count(x) == radius)
        own = _own_value(params, width, part)
        return F.transform(flips, lambda x: own.bitwiseXOR(x.cast("bigint")) + F.lit(part << width))

    return F.concat(*(of(part) for part in range(-(-params.bits // width))))


def _codes(df: DataFrame, id_col: str, name: str) -> DataFrame:
    both = df.select(F.col(id_col).cast("bigint").alias(name), F.concat("primary", "residual").alias("code"))
    return both.filter(F.col("code").isNotNull() & F.col(name).isNotNull())


def build_index(codes: DataFrame, params: CodeParams, width: int | None = None, vec_id: str = "vec_id") -> HammingIndex:
    """Index of ``primary`` and ``residual`` words as made by ``encode``; rows without a code or an id are left out.

    Without ``width`` a part has about as many values as the table has rows. The table of buckets is sorted
    by bucket and id into files of even size, so a bucket that holds most rows is spread over many files.
    """
    kept = cut_to_table(_codes(codes, vec_id, "vec_id"))
    rows = kept.count()
    width = width or max([w for w in WIDTHS if 1 << w <= rows], default=WIDTHS[0])
    if width not in WIDTHS:
        raise ValueError(f"width must be one of {WIDTHS}")
    spread = kept.select(F.explode(_keys(params, width, 0)).alias("bucket"), F.col("vec_id").alias("id"), "code")
    parts = -(-params.bits // width)
    buckets = cut_to_table(spread.repartitionByRange(bucket_count(kept.sparkSession, rows * parts), "bucket", "id").sortWithinPartitions("bucket"))
    sizes = cut_to_table(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    return HammingIndex(buckets, sizes, kept, params, width, rows)


def search(queries: DataFrame, index: HammingIndex, k: int, query_id: str = "query_id", exclude_self: bool = False) -> Found:
    """The exact top k of every query by (combined distance, id), as :func:`nearloom.operators.knn.hamming_knn` gives.

    Every round sends the unfinished queries to the buckets one bit farther and only rows of visited buckets to
    tasks; a bucket with many rows or visitors becomes a grid of cells. Queries that are not finished when
    further rounds would visit more than a scan compares are scanned. Repeated codes and equal distances
    rank by id; queries without a code have no hits.
    """
    if k < 1:
        raise ValueError("k must be > 0")
    params, width, score = index.params, index.width, index.score
    dim = params.bits + params.residual_bits
    pending = cut_to_table(_codes(queries, query_id, "query_id"))
    waiting, best, finished, rounds = pending.count(), None, [], []
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    whole = Window.partitionBy("query_id")
    for radius in range(index.last_radius() + 1):
        if not waiting:
            break
        probes = cut_to_table(pending.select(F.explode(_keys(params, width, radius)).alias("bucket"), F.col("query_id").alias("id"), "code"))
        # At most parts x 2^width keys with a number each, whatever the tables hold.
        visits = F.broadcast(cut_to_table(probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("visits"))))
        candidates = index.sizes.join(visits, "bucket").agg(F.coalesce(F.sum(F.col("n") * F.col("visits")), F.lit(0))).first()[0]
        met = keyed_topk(
            probes, index.buckets.join(visits, "bucket", "left_semi"), ["bucket"], score, k, exclude_self, dim, most_rows=(waiting, index.rows)
        ).select("query_id", "vec_id", "dist")
        if best is not None:
            met = met.unionByName(best).distinct()
        ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        sure = (F.count(F.lit(1)).over(whole) == k) & (F.max("dist").over(whole) < index.unseen(radius))
        ranked = cut_to_table(ranked.withColumn("sure", sure))
        ready = ranked.filter("sure and rank = 1").select("query_id")
        finished.append(ranked.filter("sure").drop("sure"))
        best = ranked.filter("not sure").select("query_id", "vec_id", "dist")
        pending = cut_to_table(pending.join(ready, "query_id", "left_anti"))
        left = pending.count()
        rounds.append({"radius": radius, "queries": waiting, "candidates": candidates, "finished": waiting - left})
        waiting = left
    if waiting or not finished:
        finished.append(knn.topk_join(pending, index.codes, score, k, exclude_self, num_queries=waiting, num_base=index.rows, dim=dim))
        rounds.append({"radius": -1, "queries": waiting, "candidates": waiting * index.rows, "finished": waiting})
    columns = ["query_id", "vec_id", "dist", "rank"]
    return Found(reduce(DataFrame.unionByName, [f.select(*columns) for f in finished]), rounds)
