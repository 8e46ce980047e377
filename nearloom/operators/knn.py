"""k-NN joins: exact, by code, graph self-join, re-ranking and pair sampling.

All of them send (query, base) work to tasks as a grid of cells: queries are split in ``A``
parts by a hash of their id, base rows in ``B`` parts, and cell (a, b) scores part a against
part b with a running top k. Nothing but the k best rows of each query leaves a cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearloom.functions import codes as C
from nearloom.functions import keyed, pairs, tiles
from nearloom.functions import vectors as V
from nearloom.params import CodeParams
from nearloom.session import cut_lineage, number_rows

# Memory for the query part of a cell and its distance tile.
TASK_BYTES = 256 << 20
# Pairs scored by one task: bounds the work lost with an executor.
TASK_PAIRS = 1 << 36
# Fewer base rows than this per task are not worth another task.
MIN_BASE_ROWS = 4096


@dataclass(frozen=True)
class Grid:
    query_parts: int
    base_parts: int

    @property
    def cells(self) -> int:
        return self.query_parts * self.base_parts


def query_part_rows(dim: int, k: int, task_bytes: int = TASK_BYTES) -> int:
    """Queries one task can hold: halved until state and distance tile fit 80 % of the budget."""
    rows = 1 << 17
    tile = 8 * tiles.QUERY_CHUNK * tiles.BASE_CHUNK + 20 * tiles.BASE_CHUNK * dim
    while rows > tiles.QUERY_CHUNK and rows * (20 * dim + 26 * k) + tile > 0.8 * task_bytes:
        rows //= 2
    return rows


def plan_grid(num_queries: int, num_base: int, dim: int, k: int, parallelism: int) -> Grid:
    """Split queries to fit memory, then base rows until the cluster is busy."""
    a = max(1, math.ceil(num_queries / query_part_rows(dim, k)))
    busy = math.ceil(parallelism / a)
    b = max(1, min(busy, math.ceil(num_base / MIN_BASE_ROWS)))
    per_part = math.ceil(num_queries / a)
    b = max(b, math.ceil(per_part * num_base / TASK_PAIRS))
    return Grid(a, b)


def top_k(df: DataFrame, k: int, by: str = "query_id", order: tuple = ("dist", "vec_id")) -> DataFrame:
    """The k first rows of every group, with their ``rank``."""
    window = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _broadcast_limit(df: DataFrame) -> int:
    value = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    text = str(value).strip().lower()
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    for unit, factor in units.items():
        if text.endswith(unit):
            return int(text[: -len(unit)]) * factor
    return int(text)


def sides(queries: DataFrame, base: DataFrame, score) -> tuple[DataFrame, DataFrame]:
    """Both inputs as ``id, vec, code`` with null for the absent payload."""
    code_type = f"array<{score.code_type}>"
    empty_vec, empty_code = F.lit(None).cast("array<float>"), F.lit(None).cast(code_type)

    def shape(df: DataFrame, id_col: str) -> DataFrame:
        vec = F.col("vec").cast("array<float>") if "vec" in df.columns else empty_vec
        code = F.col("code").cast(code_type) if "code" in df.columns else empty_code
        return df.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"), code.alias("code"))

    return shape(queries, "query_id"), shape(base, "vec_id")


def _width(df: DataFrame) -> int:
    """Length of the first row's payload; all rows of a table share it."""
    row = df.select(F.size("vec" if "vec" in df.columns else "code").alias("n")).first()
    return max(1, row.n) if row is not None else 1


def topk_join(
    queries: DataFrame,
    base: DataFrame,
    score,
    k: int,
    exclude_self: bool = False,
    num_queries: int | None = None,
    num_base: int | None = None,
    dim: int | None = None,
    broadcast_bytes: int | None = None,
    grid: Grid | None = None,
) -> DataFrame:
    """Top k base rows of every query: ``query_id, vec_id, dist, rank``, ordered by (dist, id).

    ``queries`` is ``query_id`` with ``vec`` or ``code``, ``base`` is ``vec_id`` with ``vec`` or
    ``code``. Queries whose counted size fits the broadcast limit travel to the base partitions,
    so the base is never shuffled; beyond that both sides are hashed into the grid.
    """
    if k < 1:
        raise ValueError("k must be > 0")
    q, b = sides(queries, base, score)
    dim = dim or _width(queries)
    if num_queries is None:
        num_queries = queries.count()
    limit = _broadcast_limit(queries) if broadcast_bytes is None else broadcast_bytes
    if grid is None and num_queries * (4 * dim + 16) <= limit:
        return _held_join(q, b, score, k, exclude_self)
    if num_base is None:
        num_base = base.count()
    if grid is None:
        parallelism = queries.sparkSession.sparkContext.defaultParallelism
        grid = plan_grid(num_queries, num_base, dim, k, parallelism)
    return _grid_join(q, b, score, k, exclude_self, grid)


def _held_join(q: DataFrame, b: DataFrame, score, k: int, exclude_self: bool) -> DataFrame:
    spark = q.sparkSession
    table = q.toArrow()
    if table.num_rows == 0:
        return spark.createDataFrame([], tiles.RESULT_SCHEMA)
    sink = pa.BufferOutputStream()
    block = table.combine_chunks()
    with pa.ipc.new_stream(sink, block.schema) as writer:
        writer.write_table(block)
    held = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    partial = b.mapInArrow(tiles.held_topk(score, k, held, exclude_self), tiles.RESULT_SCHEMA)
    return _merge(partial, score, k)


def _merge(partial: DataFrame, score, k: int) -> DataFrame:
    """Top k of the cells' top k."""
    dist = F.col("dist").desc() if getattr(score, "farthest", False) else F.col("dist")
    return top_k(partial.drop("rank"), k, "query_id", (dist, "vec_id"))


def _grid_join(q: DataFrame, b: DataFrame, score, k: int, exclude_self: bool, grid: Grid) -> DataFrame:
    def parts(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own_q = F.pmod(F.xxhash64("id"), F.lit(grid.query_parts)).cast("int")
    own_b = F.pmod(F.xxhash64("id"), F.lit(grid.base_parts)).cast("int")
    q_rows = q.select("id", "vec", "code", own_q.alias("a"), parts(grid.base_parts).alias("b"), F.lit(0).alias("side"))
    b_rows = b.select("id", "vec", "code", own_b.alias("b"), parts(grid.query_parts).alias("a"), F.lit(1).alias("side"))
    cell = (F.col("a") * grid.base_parts + F.col("b")).alias("cell")
    columns = [cell, "side", "id", "vec", "code"]
    placed = (
        q_rows.select(*columns)
        .unionByName(b_rows.select(*columns))
        .repartitionById(grid.cells, F.col("cell"))
        .sortWithinPartitions("cell", "side")
    )
    partial = placed.mapInArrow(tiles.cell_topk(score, k, ["cell"], exclude_self), tiles.RESULT_SCHEMA)
    if grid.base_parts == 1:
        return partial
    return _merge(partial, score, k)


def _as_queries(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("vec"))


def _as_base(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))


def exact_knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "cosine",
    query_id: str = "query_id",
    vec_id: str = "vec_id",
    vec_col: str = "embedding",
    exclude_self: bool = False,
    farthest: bool = False,
    **sizes,
) -> DataFrame:
    """Exact k-NN join under ``cosine``, ``neg_dot`` or ``l2sq``; ``farthest`` inverts the order."""
    if metric not in V.VECTOR_METRICS:
        raise ValueError(f"unknown metric {metric}")
    score = tiles.VectorScore(metric=metric, farthest=farthest)
    return topk_join(
        _as_queries(queries, query_id, vec_col), _as_base(base, vec_id, vec_col), score, k, exclude_self, **sizes
    )


def knn_graph(df: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", **sizes) -> DataFrame:
    """Exact k-NN self-join as ``src, rank, dst, dist``; a node is never its own neighbour."""
    rows = exact_knn(df, df, k, metric, id_col, id_col, vec_col, exclude_self=True, **sizes)
    return rows.select(F.col("query_id").alias("src"), "rank", F.col("vec_id").alias("dst"), "dist")


def asymmetric_knn(
    queries: DataFrame,
    codes: DataFrame,
    params: CodeParams,
    k: int,
    query_id: str = "query_id",
    vec_id: str = "vec_id",
    vec_col: str = "embedding",
    code_col: str = "components",
    exclude_self: bool = False,
    **sizes,
) -> DataFrame:
    """Code k-NN join: query vectors against component codes by asymmetric distance."""
    score = tiles.VectorScore(
        metric="neg_dot", bits=params.bits, padded_dim=params.padded_dim, code_seed=params.seed
    )
    base = codes.filter(F.col(code_col).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.col(code_col).alias("code"))
    sizes.setdefault("dim", params.dim)
    return topk_join(_as_queries(queries, query_id, vec_col), base, score, k, exclude_self, **sizes)


def hamming_knn(
    queries: DataFrame,
    codes: DataFrame,
    params: CodeParams,
    k: int,
    query_id: str = "query_id",
    vec_id: str = "vec_id",
    exclude_self: bool = False,
    **sizes,
) -> DataFrame:
    """Code k-NN join of sign codes: ``dist`` is the combined Hamming distance.

    Both inputs hold ``primary`` and ``residual`` as made by ``encode``.
    """
    score = tiles.HammingScore(params.bits, params.residual_bits, params.shift)
    words = F.concat("primary", "residual")
    q = queries.select(F.col(query_id).alias("query_id"), words.alias("code"))
    b = codes.select(F.col(vec_id).alias("vec_id"), words.alias("code"))
    sizes.setdefault("dim", params.bits + params.residual_bits)
    return topk_join(q, b, score, k, exclude_self, **sizes)


def with_estimate(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The hits of :func:`hamming_knn` with ``estimate``, ``base + scale * distance`` of their query."""
    scalars = queries.select("query_id", "base", "scale")
    return hits.join(scalars, "query_id").select(
        "query_id", "vec_id", "rank", "dist", C.estimate("base", "scale", "dist").alias("estimate")
    )


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "cosine",
    query_id: str = "query_id",
    vec_id: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Exact distance of every distinct candidate, cut to the k best per query, as :func:`scored` gives them."""
    return top_k(scored(candidates, queries, base, metric, query_id, vec_id, vec_col), k)


def scored(
    candidates: DataFrame,
    queries: DataFrame,
    base: DataFrame,
    metric: str = "cosine",
    query_id: str = "query_id",
    vec_id: str = "vec_id",
    vec_col: str = "embedding",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Exact ``dist`` of every distinct candidate ``query_id, vec_id`` and the columns to ``keep``, which are the same wherever a pair repeats.

    Candidates whose stored vector, or whose query's vector, is missing or null disappear. A vector named by very many queries is a hot
    key of the gather join; the vector side has one row per key, so adaptive execution can split
    the candidates of a hot partition freely.
    """
    if metric not in V.VECTOR_METRICS:
        raise ValueError(f"unknown metric {metric}")
    named = candidates.select("query_id", "vec_id", *keep).distinct()
    vectors = base.select(F.col(vec_id).alias("vec_id"), F.col(vec_col).alias("_b")).filter("_b is not null")
    wanted = queries.select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("_q")).filter("_q is not null")
    gathered = named.join(vectors, "vec_id").join(wanted, "query_id")
    return gathered.select("query_id", "vec_id", *keep, pairs.vector_distance(metric, "_q", "_b").alias("dist"))


def neighbours_of(edges: DataFrame, nodes: DataFrame, id_col: str = "src") -> DataFrame:
    """Edges whose source is among ``nodes``."""
    return edges.join(nodes.select(F.col(id_col).alias("src")).distinct(), "src", "left_semi")


def edge_list(matrix: DataFrame, sentinel: int = 0xFFFFFFFF) -> DataFrame:
    """Wide rows ``src, neighbors, distances`` as ``src, dst, dist`` without missing slots and self edges."""
    slots = matrix.select("src", F.posexplode(F.arrays_zip("neighbors", "distances")).alias("slot", "edge"))
    edges = slots.select("src", F.col("edge.neighbors").cast("bigint").alias("dst"), F.col("edge.distances").alias("dist"))
    return edges.filter(F.col("dst").isNotNull() & (F.col("dst") != sentinel) & (F.col("dst") != F.col("src")))


def sample_pairs(
    df: DataFrame, num_pairs: int | None = None, per_vector: int = 20, seed: int = 42, id_col: str = "vec_id"
) -> DataFrame:
    """Random pairs ``pair_id, i, j`` of distinct ids; equal draws move j to the next id.

    Ids are numbered in ascending order and positions are drawn, so ids may be any longs. ``num_pairs``
    fixes the sample size; by default every vector contributes ``per_vector`` pairs. Null ids
    take no part and repeated ids count once.
    """
    ids = cut_lineage(number_rows(df.select(F.col(id_col).alias("id")), "id"))
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    if num_pairs is not None:
        numbered = df.sparkSession.range(num_pairs).select(F.col("id").alias("pair_id"))
    else:
        draws = ids.select("number", F.explode(F.sequence(F.lit(0), F.lit(per_vector - 1))).alias("draw"))
        numbered = draws.select((F.col("number") * per_vector + F.col("draw")).alias("pair_id"))
    drawn = numbered.select(
        "pair_id",
        n.alias("n"),
        F.pmod(keyed.hash60(seed, F.col("pair_id"), "i"), n).alias("i"),
        F.pmod(keyed.hash60(seed, F.col("pair_id"), "j"), n).alias("j"),
    )
    shifted = F.when(F.col("i") == F.col("j"), F.pmod(F.col("j") + 1, F.col("n"))).otherwise(F.col("j"))
    placed = drawn.filter(F.col("n") > 1).select("pair_id", "i", shifted.alias("j"))
    first = ids.select(F.col("number").alias("i"), F.col("id").alias("first"))
    second = ids.select(F.col("number").alias("j"), F.col("id").alias("second"))
    return placed.join(first, "i").join(second, "j").select("pair_id", F.col("first").alias("i"), F.col("second").alias("j"))


def closest_and_farthest(
    queries: DataFrame, base: DataFrame, metric: str = "cosine", query_id: str = "query_id", vec_id: str = "vec_id",
    vec_col: str = "embedding", exclude_self: bool = True, **sizes
) -> DataFrame:
    """``query_id, nearest, nearest_dist, farthest, farthest_dist``."""
    near = exact_knn(queries, base, 1, metric, query_id, vec_id, vec_col, exclude_self, **sizes)
    far = exact_knn(queries, base, 1, metric, query_id, vec_id, vec_col, exclude_self, farthest=True, **sizes)
    return near.select("query_id", F.col("vec_id").alias("nearest"), F.col("dist").alias("nearest_dist")).join(
        far.select("query_id", F.col("vec_id").alias("farthest"), F.col("dist").alias("farthest_dist")), "query_id"
    )


def duplicate_codes(codes: DataFrame, code_col: str = "components") -> DataFrame:
    """Codes held by several vectors: ``code, copies, pairs`` with c(c-1)/2 pairs, no pairwise join."""
    return (
        codes.groupBy(F.col(code_col).alias("code"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .withColumn("pairs", F.expr("copies * (copies - 1) div 2"))
    )
