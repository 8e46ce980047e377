"""Neighbour graphs as edge tables ``src, dst, dist``: building, pruning, audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearloom.functions import keyed
from nearloom.operators import descent, knn, lsh
from nearloom.operators.skew import HOT_ROWS, hot_keys, salted_join
from nearloom.params import CodeParams, GraphParams
from nearloom.session import bucket_count, cut_lineage


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, unique on (src, dst) with its least distance."""
    ways = F.array(
        F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    both = edges.select(F.explode(ways).alias("e"), "dist").select("e.src", "e.dst", "dist")
    return both.groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def cap_degree(edges: DataFrame, max_degree: int = 64) -> DataFrame:
    """The ``max_degree`` nearest edges of every node by (dist, dst).

    The limit is applied before the shuffle as well, so a hub sends few rows from each task.
    """
    return knn.top_k(edges.select("src", "dst", "dist"), max_degree, "src", ("dist", "dst")).drop("rank")


def link(neighbours: DataFrame, params: GraphParams) -> DataFrame:
    """Graph from ranked neighbours ``src, dst, dist``: best links, both directions, capped."""
    best = cap_degree(neighbours, params.m_links)
    return cap_degree(reverse_edges(best), params.max_degree)


def build_graph(
    df: DataFrame,
    code_params: CodeParams,
    params: GraphParams = GraphParams(),
    edges_from: str = "asymmetric",
    codes: DataFrame | None = None,
    num_probes: int = 8,
    hashes_per_table: int = 1,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    **sizes,
) -> DataFrame:
    """Bulk graph build, independent of insertion order and partitioning.

    ``edges_from`` picks the candidate neighbours: ``asymmetric`` or ``hamming`` codes, true
    ``cosine`` (the hybrid build), or with work below quadratic ``lsh`` buckets or neighbour ``descent`` over
    true cosine distances.
    """
    k = params.m_links
    if edges_from == "cosine":
        found = knn.exact_knn(df, df, k, "cosine", id_col, id_col, vec_col, exclude_self=True, **sizes)
    elif edges_from == "asymmetric":
        found = knn.asymmetric_knn(df, codes, code_params, k, id_col, id_col, vec_col, exclude_self=True, **sizes)
    elif edges_from == "hamming":
        found = knn.hamming_knn(codes, codes, code_params, k, id_col, id_col, exclude_self=True, **sizes)
    elif edges_from == "lsh":
        found = lsh.multiprobe_knn(
            df, df, code_params, k, num_probes, hashes_per_table, "cosine", id_col, id_col, vec_col, exclude_self=True, **sizes
        )
    elif edges_from == "descent":
        found = descent.descend(df, k, "cosine", id_col=id_col, vec_col=vec_col, **sizes).neighbours
        return link(found, params)
    else:
        raise ValueError(f"unknown edge source {edges_from}")
    return link(found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "dist"), params)


def contains_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those ``src, dst`` pairs that are edges."""
    return pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")


def remove_edges(edges: DataFrame, deletions: DataFrame) -> DataFrame:
    """Edges without the listed ``src, dst`` pairs."""
    return edges.join(deletions.select("src", "dst"), ["src", "dst"], "left_anti")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _detoured(r1: pa.Array, alpha: pa.Array, own: pa.Array, own_ranks: pa.Array, onward: pa.Array, onward_ranks: pa.Array) -> pa.Array:
    """Per row, the own neighbours that the onward list also reaches with both ranks low enough."""
    rows = len(r1)
    row_own = np.repeat(np.arange(rows), np.diff(own.offsets.to_numpy()))
    row_on = np.repeat(np.arange(rows), np.diff(onward.offsets.to_numpy()))
    ids, place = np.unique(np.concatenate((own.flatten().to_numpy(), onward.flatten().to_numpy())), return_inverse=True)
    key_own = row_own * len(ids) + place[: len(row_own)]
    key_on = row_on * len(ids) + place[len(row_own) :]
    order = np.argsort(key_on)
    at = np.minimum(np.searchsorted(key_on, key_own, sorter=order), max(len(order) - 1, 0))
    if len(order):
        match = order[at]
        r2 = onward_ranks.flatten().to_numpy()[match]
        longest = np.maximum(r1.to_numpy()[row_own], r2) * alpha.to_numpy()[row_own]
        found = (key_on[match] == key_own) & (longest < own_ranks.flatten().to_numpy())
    else:
        found = np.zeros(len(row_own), dtype=bool)
    counts = np.bincount(row_own[found], minlength=rows)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.flatten().to_numpy()[found], pa.int64()))


def count_detours(ranked: DataFrame, alpha: float = 1.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ranked edges ``src, dst, rank, dist`` with ``detours``.

    A detour src -> z -> dst counts when both of its ranks, times ``alpha``, stay below the
    direct rank. Only detours that end in a neighbour of src matter, so each edge carries its
    source's neighbour list to z and meets z's list there: no pair leaves the lists of two
    nodes. The edges are written once, because four steps read them; a hub z is spread over tasks.
    """
    ranked = cut_lineage(ranked)
    lists = ranked.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("dst").cast("bigint").alias("dst")))).alias("l"))
    lists = lists.select("src", F.col("l.dst").alias("ids"), F.col("l.rank").alias("ranks"))
    first = ranked.select("src", F.col("dst").alias("z"), F.col("rank").alias("r1"))
    onward = lists.select(F.col("src").alias("z"), F.col("ids").alias("z_ids"), F.col("ranks").alias("z_ranks"))
    carried = first.join(lists, "src")
    if ranked.count() <= hot_rows:
        met = carried.join(onward, "z")
    else:
        met = salted_join(carried, onward, ["z"], "src", hot_keys(first, ["z"], hot_rows))
    shortcut = _detoured("r1", F.lit(float(alpha)), "ids", "ranks", "z_ids", "z_ranks")
    counts = (
        met.select("src", shortcut.alias("found")).select("src", F.explode("found").alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("detours"))
    )
    return ranked.join(counts, ["src", "dst"], "left").withColumn("detours", F.coalesce("detours", F.lit(0)))


def prune_detours(ranked: DataFrame, degree: int, alpha: float = 1.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ``degree`` edges of every node with the fewest detours, as ``src, dst, dist, rank, detours``."""
    counted = count_detours(ranked, alpha, hot_rows)
    window = Window.partitionBy("src").orderBy("detours", "rank")
    return (
        counted.withColumn("place", F.row_number().over(window))
        .filter(F.col("place") <= degree)
        .select("src", "dst", "dist", F.col("place").alias("rank"), "detours")
    )


def interleave_reverse(kept: DataFrame, degree: int) -> DataFrame:
    """Forward edges ``src, dst, dist, rank`` and their reverses alternating by rank, cut to ``degree``."""
    ways = F.array(
        F.struct("src", "dst", F.lit(0).alias("way")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("way")),
    )
    turned = kept.select(F.explode(ways).alias("e"), "dist", "rank").select("e.*", "dist", "rank")
    # A node can be the target of very many edges: every task sends its best ones only.
    by_source = Window.partitionBy("src", "way").orderBy("rank", "dst")
    both = turned.withColumn("slot", F.row_number().over(by_source)).filter(F.col("slot") <= degree)
    best = both.groupBy("src", "dst").agg(F.min(F.struct("slot", "way", "dist")).alias("b"))
    order = Window.partitionBy("src").orderBy("slot", "way", "dst")
    return (
        best.select("src", "dst", "b.dist", "b.slot", "b.way")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= degree)
        .select("src", "dst", "dist", "rank")
    )


def build_from_knn(
    neighbours: DataFrame, degree: int = 64, prune: bool = True, alpha: float = 1.1, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Graph from a k-NN table ``src, rank, dst, dist``: rank pruning, then interleaved reverse edges."""
    if not 1.0 <= alpha <= 3.0:
        raise ValueError("alpha must be in [1, 3]")
    if prune:
        kept = prune_detours(neighbours, degree, alpha, hot_rows)
    else:
        kept = neighbours.filter(F.col("rank") <= degree)
    return interleave_reverse(kept, degree)


def entry_points(nodes: DataFrame, count: int = 1, seed: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """Entry nodes ``node``: the least id, or ``count`` distinct ids in keyed-hash order."""
    ids = nodes.select(F.col(id_col).alias("node"))
    if seed is None and count == 1:
        return ids.agg(F.min("node").alias("node")).filter("node is not null")
    return ids.distinct().orderBy(keyed.hash60(seed if seed is not None else 42, F.col("node")), "node").limit(count)


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """All nodes reachable from the entries, ``node, depth``: breadth-first rounds of joins.

    A round joins the frontier (unique nodes) to the edges, so no key is hot; each round is
    written to the checkpoint folder.
    """
    seen = cut_lineage(entries.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        frontier = seen.filter(F.col("depth") == depth).select(F.col("node").alias("src"))
        fresh = (
            edges.select("src", "dst").join(frontier, "src", "left_semi")
            .select(F.col("dst").alias("node")).distinct()
            .join(seen, "node", "left_anti")
            .withColumn("depth", F.lit(depth + 1))
        )
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        depth += 1
        if depth % 8 == 0:
            # Few files again after the unions.
            seen = cut_lineage(seen.repartition(bucket_count(edges.sparkSession, seen.count()), "node"))
    return seen


def connectivity(edges: DataFrame, nodes: DataFrame, entries: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row ``num_nodes, reachable, reachable_pct``."""
    found = reachable(edges, entries).agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = nodes.agg(F.count(F.lit(1)).alias("num_nodes"))
    return totals.select(
        "num_nodes",
        found.alias("reachable"),
        F.when(F.col("num_nodes") > 0, F.lit(100.0) * found / F.col("num_nodes")).otherwise(0.0).alias("reachable_pct"),
    )


def neighbour_counts(edges: DataFrame, nodes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Out-degree of every node, ``node, degree``."""
    degrees = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(F.col(id_col).alias("node")).join(degrees, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(edges: DataFrame, nodes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row ``num_nodes, num_edges, avg_degree, max_degree, isolated``."""
    return neighbour_counts(edges, nodes, id_col).agg(
        F.count(F.lit(1)).alias("num_nodes"),
        F.coalesce(F.sum("degree"), F.lit(0)).alias("num_edges"),
        F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_degree"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.count_if(F.col("degree") == 0).alias("isolated"),
    )


def with_neighbour_codes(edges: DataFrame, codes: DataFrame, code_cols: list[str], id_col: str = "vec_id") -> DataFrame:
    """Edges carrying the code of their target, so that a search hop is one join.

    A hub is the target of many edges; codes have one row per key, so adaptive execution can
    split the edges of a hot partition freely.
    """
    named = codes.select(F.col(id_col).alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in code_cols])
    return edges.join(named, "dst")


def audit_knn(neighbours: DataFrame, nodes: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """One row of counts over a k-NN table ``src, dst, dist`` against k slots per node."""
    known = nodes.select(F.col(id_col).alias("dst"), F.lit(True).alias("known"))
    slots = nodes.agg((F.count(F.lit(1)) * k).alias("slots")).scalar()
    marked = neighbours.select("src", "dst", "dist").join(known, "dst", "left")
    return marked.agg(
        F.count_if(F.col("known") & (F.col("src") != F.col("dst"))).alias("valid"),
        F.count_if(F.col("known").isNull()).alias("out_of_range"),
        F.count_if(F.col("src") == F.col("dst")).alias("self_loops"),
        F.count(F.lit(1)).alias("present"),
        F.min("dist").alias("min_dist"),
        F.max("dist").alias("max_dist"),
    ).select("valid", (slots - F.col("present")).alias("missing"), "out_of_range", "self_loops", "min_dist", "max_dist")
