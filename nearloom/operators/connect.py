"""Components of neighbour graphs, and the cheapest exact edges that join them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.functions import keyed
from nearloom.operators import knn
from nearloom.session import cut_to_table

# Pivots at most, so that what is broadcast stays below PIVOTS x dimension floats; rows of a side of a grid cell.
PIVOTS, CELL = 4096, 8192
# Neighbours that every node is given once, for all rounds; distances that a task computes at once.
LISTED, TILE = 16, 1 << 20
SLACK = 1e-9


def _settled(parents: DataFrame) -> DataFrame:
    """``label, root``: parents followed to their end, twice as far each time; a root is its own parent."""
    parents = cut_to_table(parents)
    while True:
        up = parents.select(F.col("label").alias("root"), F.col("root").alias("above"))
        moved = parents.join(up, "root", "left").select("label", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
        moved = cut_to_table(moved)
        parents = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame, nodes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``node, component`` of the graph without directions; a component is named by its least node.

    Contraction: every component so far hooks itself to its least neighbour if that is smaller, hooks are
    followed to their ends, and edges inside a component go. Components with an edge at least halve each time, so rounds
    grow with the logarithm of the nodes, whatever the length of chains. Edges of nodes that are not listed, loops and nulls say nothing.
    """
    labels = cut_to_table(nodes.select(F.col(id_col).alias("node")).filter("node is not null").distinct().withColumn("component", F.col("node")))
    known = lambda c: labels.select(F.col("node").alias(c))
    links = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct()
    links = cut_to_table(links.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi"))
    while not links.isEmpty():
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _settled(ways.groupBy(F.col("a").alias("label")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        named = lambda c: parents.select(F.col("label").alias(c), F.col("root").alias(f"{c}_root"))
        labels = cut_to_table(labels.join(named("component"), "component", "left").select("node", F.coalesce("component_root", "component").alias("component")))
        moved = links.join(named("a"), "a").join(named("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        links = cut_to_table(moved.filter("a < b").distinct())
    return labels


@dataclass
class Connected:
    """``edges``: those given and one pair for each two components joined; ``added``: the latter, ``src < dst``; ``rounds``: what each did."""

    edges: DataFrame
    added: DataFrame
    rounds: list[dict] = field(default_factory=list)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Slices of so few rows that a matrix of them and ``width`` columns holds at most ``TILE`` numbers."""
    step = max(1, TILE // max(width, 1))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def _cost(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if metric == "l2sq":
        return np.einsum("ij,ij->i", a - b, a - b)
    return 1.0 - np.einsum("ij,ij->i", a, b)


def _least_cost(metric: str, gap: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Least cost of vectors at least ``gap`` apart whose squared norms sum to at most ``norms``."""
    return gap**2 if metric == "l2sq" else 1.0 - (norms - gap**2) / 2


def _bounds(metric: str, pivots):
    """The cheapest cost from a component's nodes to a pivot of another: a bound on its cheapest edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for b in batches:
            every, own = _matrix(b.column("vec")), b.column("component").to_numpy()
            for part in _slices(len(every), len(p["vec"])):
                comp, x = own[part], every[part]
                rough = _distances(x, p["vec"]) ** 2
                if metric == "cosine":
                    rough = 1.0 - (np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p["vec"], p["vec"])[None, :] - rough) / 2
                rough[comp[:, None] == p["component"][None, :]] = np.inf
                yield pa.RecordBatch.from_pydict({"component": comp, "bound": rough.min(1) + SLACK * 10})

    return run


def _visits(metric: str, pivots, blocks: int):
    """The cells that may hold a cheaper edge of a node's component: distance to the pivot less the cell's radius.

    A node that would visit more cells than there are ``blocks`` of all rows visits those instead, numbered -1, -2, ...; ``cells``
    tells how many it could not rule out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for b in batches:
            every, own, limit, ids = _matrix(b.column("vec")), b.column("component").to_numpy(), b.column("bound").to_numpy(), b.column("id").to_numpy()
            for part in _slices(len(every), len(p["vec"])):
                comp, x, bound = own[part], every[part], limit[part]
                gap = np.maximum(_distances(x, p["vec"]) - p["radius"][None, :] - SLACK * 10, 0)
                low = _least_cost(metric, gap, np.einsum("ij,ij->i", x, x)[:, None] + p["norm"][None, :])
                # A cell of the node's own component alone has no edge for it.
                use = (low <= bound[:, None]) & (p["only"][None, :] != comp[:, None])
                cells = use.sum(1)
                wide = cells > blocks
                row, cell = np.nonzero(use & ~wide[:, None])
                to = p["pivot"][cell]
                kept = np.ones(len(row), np.int64)
                across = np.repeat(np.flatnonzero(wide), blocks)
                places = np.tile(-1 - np.arange(blocks, dtype=np.int64), int(wide.sum()))
                # The first block carries the count.
                ruled = np.where(places == -1, cells[across], 0).astype(np.int64)
                columns = {
                    "id": ids[part][np.concatenate([row, across])], "place": np.concatenate([to, places]),
                    "of_pivot": np.concatenate([np.ones(len(row), bool), np.zeros(len(across), bool)]), "cells": np.concatenate([kept, ruled]),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _cheapest(metric: str):
    """The cheapest edge of every component between the two sides of a grid cell."""

    def part(a, b, ca, cb, ia, ib) -> tuple:
        rough = -(a @ b.T)
        if metric == "l2sq":
            rough = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] + 2 * rough
        rough[ca[:, None] == cb[None, :]] = np.inf
        best = rough.min(1)
        names, place = np.unique(ca, return_inverse=True)
        least = np.full(len(names), np.inf)
        np.minimum.at(least, place, best)
        near = np.isfinite(rough) & (rough <= least[place][:, None] + SLACK * (1 + np.abs(least[place][:, None])))
        i, j = np.nonzero(near)
        cost = np.concatenate([np.zeros(0), *(_cost(metric, a[i[s]], b[j[s]]) for s in _slices(len(i), a.shape[1]))])
        u, v = np.minimum(ia[i], ib[j]), np.maximum(ia[i], ib[j])
        order = np.lexsort((v, u, cost, ca[i]))
        first = order[np.append(True, np.diff(ca[i][order]) != 0)] if len(order) else order
        return ca[i][first], u[first], v[first], cost[first], cb[j][first]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"component": pa.int64(), "u": pa.int64(), "v": pa.int64(), "cost": pa.float64(), "other": pa.int64()}
        found = []
        if len(left) and len(right):
            # Rows of a component meet in as few tiles as there may be.
            left = left.sort_by("component")
            a, b = _matrix(left.column("vec")), _matrix(right.column("rvec"))
            ca, cb = left.column("component").to_numpy(), right.column("rcomponent").to_numpy()
            ia, ib = left.column("id").to_numpy(), right.column("rid").to_numpy()
            found = [part(a[s], b, ca[s], cb, ia[s], ib) for s in _slices(len(a), len(b))]
        out = [np.concatenate(c) for c in zip(*found)] if found else [[]] * len(kinds)
        return pa.table({c: pa.array(values, kinds[c]) for c, values in zip(kinds, out)})

    return run


def _search(asking: DataFrame, members: DataFrame, count: int, metric: str, radii: DataFrame) -> tuple[DataFrame, int]:
    """``component, u, v, cost, other``: the cheapest edge, within ``bound``, of the asking nodes of a component, and the cells not ruled out."""
    spark = members.sparkSession
    cells = members.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    # At most PIVOTS rows, whatever the table.
    named = members.select(F.col("id").alias("pivot"), F.col("component").alias("own"), "vec").join(radii, "pivot").join(cells, "pivot")
    rows = named.select("pivot", "own", "vec", "radius", "norm", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"), "n").orderBy("pivot").toArrow()
    held = {
        "pivot": rows.column("pivot").to_numpy(), "component": rows.column("own").to_numpy(), "vec": _matrix(rows.column("vec")),
        "radius": rows.column("radius").to_numpy(), "norm": rows.column("norm").to_numpy(),
        "only": rows.column("only").fill_null(-(2**63)).to_numpy(),
    }
    shared = spark.sparkContext.broadcast(held)
    bounds = asking.select("component", "vec").mapInArrow(_bounds(metric, shared), "component bigint, bound double")
    bounds = bounds.groupBy("component").agg(F.min("bound").alias("by_pivot"))
    asking = asking.join(bounds, "component").withColumn("bound", F.least("bound", "by_pivot")).drop("by_pivot")
    blocks = math.ceil(count / CELL)
    visits = asking.mapInArrow(_visits(metric, shared, blocks), "id bigint, place bigint, of_pivot boolean, cells bigint")
    visits = cut_to_table(visits)
    block = (-1 - F.pmod(F.xxhash64("id"), F.lit(blocks))).alias("place")
    # Every node stands in its cell and in a block; only what is asked for moves.
    every_place = members.select(F.col("pivot").alias("place"), F.lit(True).alias("of_pivot"), "id", "component", "vec").unionByName(
        members.select(block, F.lit(False).alias("of_pivot"), "id", "component", "vec")
    )
    at = ["place", "of_pivot"]
    asked = visits.groupBy(*at).agg(F.count(F.lit(1)).alias("asked"))
    sizes = every_place.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    split = cut_to_table(sizes.join(asked, at).select(*at, F.ceil(F.col("asked") / CELL).cast("int").alias("qn"), F.ceil(F.col("n") / CELL).cast("int").alias("bn")))
    part = lambda c, n: F.pmod(F.xxhash64(c, F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked_of = visits.drop("cells").join(members.select("id", "component", "vec"), "id")
    left = asked_of.join(split, at).select(*at, part("id", "qn").alias("a"), every("bn").alias("b"), "id", "component", "vec")
    right = every_place.join(split, at).select(*at, every("qn").alias("a"), part("id", "bn").alias("b"), "id", "component", "vec")
    # New names: both sides stem from the members.
    named = {"p": "place", "o": "of_pivot", "c": "a", "d": "b", "rid": "id", "rcomponent": "component", "rvec": "vec"}
    right = right.select(*[F.col(old).alias(new) for new, old in named.items()])
    kind = "component bigint, u bigint, v bigint, cost double, other bigint"
    found = left.groupBy(*at, "a", "b").cogroup(right.groupBy("p", "o", "c", "d")).applyInArrow(_cheapest(metric), kind)
    return cut_to_table(found.groupBy("component").agg(F.min(F.struct("cost", "u", "v", "other")).alias("e")).select("component", "e.*")), (
        visits.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
    )


def _nearest_foreign(
    members: DataFrame, listed: DataFrame, reach: DataFrame, giant: int, count: int, metric: str, radii: DataFrame
) -> tuple[DataFrame, DataFrame, int]:
    """``component, u, v, cost, other``: the cheapest edge of every component but ``giant``, the list entries still foreign, and the cells searched.

    A node's first foreign entry of ``listed`` is its nearest foreign node. A node without one is farther from every foreign node than
    the end of its list (``reach``); it is searched for only if this does not exceed what its component has found.
    """
    known = members.select("id", "component")
    ends = listed.join(known.select(F.col("id").alias("src"), "component"), "src").join(known.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst")
    ends = cut_to_table(ends.filter("component != other"))
    edge = F.min(F.struct(F.col("dist").alias("cost"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "other"))
    best = cut_to_table(ends.filter(F.col("component") != giant).groupBy("component").agg(edge.alias("e")).select("component", "e.*"))
    open_ends = members.filter(F.col("component") != giant).join(ends.select(F.col("src").alias("id")), "id", "left_anti")
    infinite = F.lit(float("inf"))
    asking = open_ends.join(reach, "id").join(best.select("component", F.col("cost").alias("bound")), "component", "left")
    asking = asking.withColumn("bound", F.coalesce("bound", infinite)).filter(F.col("reach") <= F.col("bound"))
    asking = cut_to_table(asking.select("id", "component", "vec", "bound"))
    visits = 0
    if not asking.isEmpty():
        searched, visits = _search(asking, members, count, metric, radii)
        both = best.unionByName(searched)
        best = cut_to_table(both.groupBy("component").agg(F.min(F.struct("cost", "u", "v", "other")).alias("e")).select("component", "e.*"))
    return best, ends.select("src", "dst", "dist"), visits


def connect(
    edges: DataFrame, df: DataFrame, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, seed: int = 42
) -> Connected:
    """Join the components of a graph by cheapest edges until one is left (Boruvka's rounds).

    In each round every component but the largest finds its cheapest edge to any other, exactly, by (cost, least id, largest id); the
    components so joined merge, at least halving in number. The edges added are those of the least spanning tree over components.

    Each node is given its ``LISTED`` nearest nodes once, and asks in a round only if none of these is foreign and its list ends before the
    best edge of its component so far. Its nearest foreign node is then found by cells: each node belongs to its nearest of about sqrt(rows) ``pivots``; a
    component's cost is bounded by its nearest foreign pivot, and its nodes visit only cells that may beat this by the triangle
    inequality. Where hardly a cell can be ruled out it is a comparison with all rows, in a grid of bounded cells. ``metric`` is ``l2sq`` or
    ``cosine`` (one minus the dot product, vectors of any length). Nodes without a vector stay as they are, and a round of
    ``rounds`` tells the components, the visits of a node to a cell and the share of visits ruled out.
    """
    if metric not in ("cosine", "l2sq"):
        raise ValueError(f"no bounds for metric {metric}")
    nodes = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).filter("id is not null and vec is not null")
    nodes = cut_to_table(nodes)
    count = nodes.count()
    labels = components(edges, nodes.select(F.col("id").alias("vec_id")))
    schema = "src bigint, dst bigint, dist double"
    added, rounds = df.sparkSession.createDataFrame([], schema), []
    if count:
        wanted = min(count, PIVOTS, pivots or max(1, math.isqrt(count)))
        chosen = cut_to_table(nodes.orderBy(keyed.hash60(seed, F.col("id")), "id").limit(wanted))
        as_query = nodes.select(F.col("id").alias("query_id"), F.col("vec").alias("embedding"))
        nearest = knn.exact_knn(as_query, chosen.select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding")), 1, "l2sq")
        nearest = nearest.select(F.col("query_id").alias("id"), F.col("vec_id").alias("pivot"), F.sqrt(F.greatest("dist", F.lit(0.0))).alias("away"))
        square = F.aggregate("vec", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
        placed = cut_to_table(nodes.join(nearest, "id").withColumn("square", square))
        radii = cut_to_table(placed.groupBy("pivot").agg(F.max("away").alias("radius"), F.max("square").alias("norm")))
        cells = radii.count()
        # Lists are exact and in the order of edges: by distance, then id.
        others = nodes.select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"))
        listed = cut_to_table(knn.knn_graph(others, LISTED, metric).select("src", "dst", "dist"))
        ends = listed.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("end"), F.count(F.lit(1)).alias("n"))
        reach = nodes.select("id").join(ends, "id", "left").select("id", F.when(F.col("n") >= LISTED, F.col("end")).otherwise(float("inf")).alias("reach"))
        reach = cut_to_table(reach)
    while count:
        sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        number, giant = sizes.agg(F.count(F.lit(1)), F.min(F.struct(-F.col("n"), F.col("component")))).first()
        held, giant = -giant[0], giant[1]
        if number < 2:
            break
        members = cut_to_table(placed.join(labels.withColumnRenamed("node", "id"), "id"))
        best, listed, visits = _nearest_foreign(members, listed, reach, giant, count, metric, radii)
        possible = (count - held) * cells
        rounds.append({"round": len(rounds) + 1, "components": number, "visits": visits, "ruled_out": 1 - visits / possible})
        fresh = cut_to_table(best.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("cost").alias("dist")).distinct())
        added = added.unionByName(fresh)
        # Two components that chose each other are led by the lesser; all other choices lead on to cheaper edges.
        back = best.select(F.col("component").alias("other"), F.col("other").alias("back"))
        lead = F.when((F.col("back") == F.col("component")) & (F.col("component") < F.col("other")), F.col("component")).otherwise(F.col("other"))
        parents = best.select("component", "other").join(back, "other", "left").select(F.col("component").alias("label"), lead.alias("root"))
        merged = _settled(parents.unionByName(df.sparkSession.createDataFrame([(giant, giant)], "label bigint, root bigint")))
        merged = merged.withColumnRenamed("label", "component")
        labels = cut_to_table(labels.join(merged, "component").select("node", F.col("root").alias("component")))
    added = cut_to_table(added.distinct())
    turned = added.unionByName(added.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    return Connected(edges.select("src", "dst", "dist").unionByName(turned), added, rounds)
