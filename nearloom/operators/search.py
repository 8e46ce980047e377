"""Graph search for whole tables of queries: best-first beams advanced together, round by round."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearloom.functions import registry
from nearloom.operators import encode as enc
from nearloom.operators import graph, knn
from nearloom.operators.skew import HOT_ROWS, hot_keys, split_join
from nearloom.params import CodeParams, GraphParams, SearchParams
from nearloom.session import bucket_count, cut_lineage, cut_to_table, write_bucketed

# Entries carried to a query in one row.
ENTRY_ROWS = 1000


@dataclass(frozen=True)
class VectorIndex:
    """Vectors, their codes and the graph over them, as DataFrames.

    ``edges`` is ``src, dst, dist`` plus the target's code columns ``dst_*``.
    """

    vectors: DataFrame
    codes: DataFrame
    edges: DataFrame
    code_params: CodeParams
    graph_params: GraphParams
    metric: str = "asymmetric"


def encode_base(df: DataFrame, params: CodeParams, metric: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and the code columns the metric reads from the base side."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding")).filter("embedding is not null")
    if metric == "asymmetric":
        return enc.components(rows, params, keep=["vec_id"]).select("vec_id", "components")
    if metric in ("hamming", "estimate"):
        return enc.encode(rows, params, keep=["vec_id"])
    return rows


def encode_queries(
    queries: DataFrame, params: CodeParams, metric: str, avg_norm: DataFrame | float = 1.0,
    id_col: str = "query_id", vec_col: str = "embedding",
) -> DataFrame:
    """``query_id`` and the columns the metric reads from the query side."""
    rows = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("embedding")).filter("embedding is not null")
    if metric == "hamming":
        return enc.encode(rows, params, keep=["query_id"])
    if metric == "estimate":
        return enc.encode_query(rows, params, avg_norm).select("query_id", "primary", "residual", "base", "scale")
    return rows


def build_index(
    df: DataFrame,
    code_params: CodeParams,
    graph_params: GraphParams = GraphParams(),
    metric: str = "asymmetric",
    edges_from: str | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    **options,
) -> VectorIndex:
    """Encode a table and link it. Codes and edges are written once, edges bucketed by ``src``."""
    vectors = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding")).filter("embedding is not null")
    codes = cut_lineage(encode_base(vectors, code_params, metric))
    source = edges_from or (metric if metric in ("asymmetric", "hamming", "cosine") else "hamming")
    edges = graph.build_graph(vectors, code_params, graph_params, source, codes, **options)
    code_cols = list(registry.METRICS[metric].base_columns)
    full = graph.with_neighbour_codes(edges, codes, code_cols)
    # Edges are counted by their nodes: up to max_degree rows each.
    buckets = bucket_count(df.sparkSession, graph_params.max_degree * vectors.count())
    edge_table = write_bucketed(full, "src", buckets=buckets)
    return VectorIndex(vectors, codes, edge_table, code_params, graph_params, metric)


def beam_search(
    queries: DataFrame,
    edges: DataFrame,
    entries: DataFrame,
    metric: str,
    params: SearchParams,
    code_params: CodeParams | None = None,
    hot_rows: int = HOT_ROWS,
    num_queries: int | None = None,
) -> DataFrame:
    """Final beams ``query_id, node, dist, rank`` of all queries.

    ``queries`` holds the metric's query columns, ``edges`` its base columns as ``dst_*``,
    ``entries`` is ``node`` with the base columns. A round expands the best ``width`` open nodes
    of every beam; a query leaves the loop when its beam has no open node. A node dropped from a
    full beam can never return, because the worst kept distance only falls, so the beam itself
    serves as the visited set and the state stays at ``ef`` rows per query.

    A picked node takes its query's columns and the worst distance of a full beam to the edges. Targets are scored
    there, and only ids and distances that can enter the beam travel back.

    Beams are written as tables: a checkpoint hands on the planner's estimate of its size, a product over the joins of a
    round, whose digits would double with every round and fill the driver.
    """
    score = registry.distance(metric, code_params)
    buckets = bucket_count(queries.sparkSession, num_queries)
    query_side = write_bucketed(queries.select("query_id", *registry.as_query_columns(metric)), "query_id", buckets=buckets)
    code_columns = registry.as_base_columns(metric)
    code_names = [f"b_{c}" for c in registry.METRICS[metric].base_columns]
    hops = edges.select("src", F.col("dst").alias("node"), *registry.as_base_columns(metric, "dst_"))

    # Every query begins at every entry; entries come in arrays of bounded size.
    starts = cut_lineage(entries.dropDuplicates(["node"]).select("node", *code_columns))
    parts = max(1, -(-starts.count() // ENTRY_ROWS))
    part = F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")
    arrays = starts.groupBy(part).agg(F.collect_list(F.struct("node", *code_names)).alias("s"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    begun = query_side.withColumn("part", every).join(arrays, "part").withColumn("s", F.explode("s")).select(*query_side.columns, "s.*")
    first = begun.select("query_id", "node", score.alias("dist"), F.lit(False).alias("expanded"))
    state = cut_to_table(_keep_best(first.repartition(buckets, "query_id"), params))

    finished, rounds = [], 0
    while True:
        finished.append(state.filter(~F.col("open")))
        active = state.filter("open")
        open_rows = active.count()
        if open_rows == 0:
            break
        rounds += 1
        if rounds > params.max_iter:
            raise RuntimeError(f"beams are not finished after max_iter={params.max_iter} rounds")
        picked = active.filter("picked").select("query_id", F.col("node").alias("src"), "worst")
        picks = picked.join(query_side, "query_id")
        # With no more rows than a hot key has, no node can be hot; else most rounds still have none.
        hot = cut_to_table(hot_keys(picked, ["src"], hot_rows)) if open_rows > hot_rows else None
        met = picks.join(hops, "src") if hot is None or hot.isEmpty() else split_join(picks, hops, ["src"], hot_rows, hot)
        # A generated column, since the planner would score twice to filter by a plain one.
        near = met.select("query_id", "node", "worst", F.explode(F.array(score)).alias("dist"))
        near = near.filter(F.coalesce(F.col("dist") <= F.col("worst"), F.lit(True)))
        found = near.select("query_id", "node", "dist", F.lit(False).alias("expanded"))
        held = active.select("query_id", "node", "dist", (F.col("expanded") | F.col("picked")).alias("expanded"))
        # By query: what the beam holds or several picks found counts once.
        rows = found.unionByName(held).repartition(buckets, "query_id")
        new = rows.groupBy("query_id", "node").agg(F.min("dist").alias("dist"), F.max("expanded").alias("expanded"))
        state = cut_to_table(_keep_best(new, params))
    final = reduce(DataFrame.unionByName, finished)
    return knn.top_k(final.select("query_id", "node", "dist"), params.ef, "query_id", ("dist", "node"))


def _keep_best(rows: DataFrame, params: SearchParams) -> DataFrame:
    """The ``ef`` best nodes per query, the ``width`` nodes to expand next, whether any is left, and the worst distance of a full beam."""
    best = knn.top_k(rows, params.ef, "query_id", ("dist", "node")).drop("rank")
    turn = Window.partitionBy("query_id").orderBy("dist", "node").rowsBetween(Window.unboundedPreceding, 0)
    waiting = F.sum((~F.col("expanded")).cast("int"))
    return best.withColumns(
        {
            "picked": ~F.col("expanded") & (waiting.over(turn) <= params.width),
            "open": F.max(~F.col("expanded")).over(Window.partitionBy("query_id")),
            "worst": F.when(F.count(F.lit(1)).over(Window.partitionBy("query_id")) >= params.ef, F.max("dist").over(Window.partitionBy("query_id"))),
        }
    )


def index_entries(index: VectorIndex, count: int = 1, seed: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Entry nodes with their codes: the least id, hashed random ids, or the given ``node`` rows."""
    if nodes is None:
        nodes = graph.entry_points(index.codes, count, seed)
    return index.codes.withColumnRenamed("vec_id", "node").join(nodes.select("node").distinct(), "node", "left_semi")


def ann_search(
    queries: DataFrame,
    index: VectorIndex,
    params: SearchParams = SearchParams(),
    entries: DataFrame | None = None,
    rerank_metric: str = "cosine",
    query_id: str = "query_id",
    vec_col: str = "embedding",
    calibration: DataFrame | None = None,
) -> DataFrame:
    """Encode queries, search the graph, re-rank exactly if asked, cut to k.

    With ``calibration`` (one row ``alpha, beta``) and no re-ranking the code score becomes
    ``alpha * score + beta``.
    """
    beams = ann_beams(queries, index, params, entries, query_id, vec_col)
    return best_of_beams(beams, queries, index, params, rerank_metric, query_id, vec_col, calibration)


def ann_beams(
    queries: DataFrame, index: VectorIndex, params: SearchParams = SearchParams(), entries: DataFrame | None = None,
    query_id: str = "query_id", vec_col: str = "embedding",
) -> DataFrame:
    """Final beams of the encoded queries. They do not depend on how the beams are re-ranked."""
    avg_norm = enc.average_norm(index.vectors) if index.metric == "estimate" else 1.0
    coded = encode_queries(queries, index.code_params, index.metric, avg_norm, query_id, vec_col)
    if entries is None:
        entries = index_entries(index, params.num_entry_points, None if params.num_entry_points == 1 else index.code_params.seed)
    return beam_search(coded, index.edges, entries, index.metric, params, index.code_params, num_queries=queries.count())


def best_of_beams(
    beams: DataFrame, queries: DataFrame, index: VectorIndex, params: SearchParams = SearchParams(), rerank_metric: str = "cosine",
    query_id: str = "query_id", vec_col: str = "embedding", calibration: DataFrame | None = None,
) -> DataFrame:
    """The k best of final beams, re-ranked or calibrated as in :func:`ann_search`."""
    hits = beams.withColumnRenamed("node", "vec_id")
    if params.rerank:
        depth = hits.filter(F.col("rank") <= params.effective_rerank_k)
        return knn.rerank(depth, queries, index.vectors, params.k, rerank_metric, query_id, "vec_id", vec_col)
    best = hits.filter(F.col("rank") <= params.k).select("query_id", "vec_id", "dist", "rank")
    return calibrated(best, calibration) if calibration is not None else best


def calibrated(hits: DataFrame, calibration: DataFrame) -> DataFrame:
    """``alpha * score + beta`` in place of the code distance; order is kept for alpha > 0.

    The score is minus the distance, so that alpha is positive for a useful code.
    """
    alpha, beta = calibration.select("alpha").scalar(), calibration.select("beta").scalar()
    return hits.withColumn("dist", alpha * (-F.col("dist")) + beta)
