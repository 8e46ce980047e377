import itertools

import numpy as np
import pyarrow as pa
import pytest

from nearloom.operators import connect, descent, graph, knn
from nearloom.params import CodeParams, GraphParams
from nearloom.session import cut_to_table


def clustered(n, groups, dim=16, spread=0.05, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def recall(spark, df, found, k, metric="cosine"):
    truth = knn.knn_graph(df, k, metric).toPandas()
    return len(found.toPandas().merge(truth, on=["src", "dst"])) / len(truth)


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_below_quadratic_work(spark, frame, unit, kind):
    n, k = 2500, 8
    x = unit(n, 16) if kind == "isotropic" else clustered(n, 25)
    df = frame(x)
    found = descent.descend(df, k, pool=16)
    assert recall(spark, df, found.neighbours, k) >= 0.9
    updates = [r["updates"] for r in found.rounds]
    assert updates[-1] <= updates[0] / 10 and len(updates) < 20
    assert sum(r["pairs"] for r in found.rounds) < 0.7 * n * n


def test_partitions_do_not_matter(spark, frame, unit):
    df = frame(unit(300, 8))
    runs = [sorted(map(tuple, descent.descend(d, 5, max_rounds=2, stop=0.0).neighbours.collect())) for d in (df, df.repartition(7))]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("metric", ["l2sq", "neg_dot"])
def test_other_metrics(spark, frame, unit, metric):
    df = frame(unit(200, 8) * 2)
    assert recall(spark, df, descent.descend(df, 5, metric).neighbours, 5, metric) >= 0.9


def test_small_and_odd_tables(spark, frame, unit):
    assert descent.descend(frame(unit(1, 4)), 3).neighbours.count() == 0
    few = descent.descend(frame(unit(3, 4)), 5).neighbours
    assert few.count() == 6 and few.filter("src = dst").count() == 0
    copies = frame(np.ones((40, 4), np.float32))
    found = {(r.src, r["rank"]): r.dist for r in descent.descend(copies, 4).neighbours.collect()}
    assert len(found) == 160 and max(found.values()) == min(found.values())
    holes = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (4, [0.6, 0.8])], "vec_id bigint, embedding array<float>")
    assert {(r.src, r.dst) for r in descent.descend(holes, 2).neighbours.collect()} == {(1, 4), (4, 1)}
    with pytest.raises(ValueError):
        descent.descend(copies, 3, "hamming")


def plain_components(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_of_chains_and_islands(spark):
    chain = [(i, i + 1) for i in range(0, 120)]
    edges = [*chain, (130, 125), (125, 128), (140, 140), (141, 999)]
    nodes = spark.createDataFrame([(i,) for i in range(150)], "vec_id bigint")
    df = spark.createDataFrame([*edges, (None, 3)], "src bigint, dst bigint")
    got = {r.node: r.component for r in connect.components(df, nodes).collect()}
    want = plain_components(150, [e for e in edges if max(e) < 150])
    assert got == dict(enumerate(want))
    assert connect.components(df.limit(0), nodes.limit(0)).count() == 0


def least_tree(x, comps, cost):
    """Edges of the least spanning tree over components, by growing it from the first."""
    inside, out = {comps[0]}, set()
    while inside != set(comps):
        d, u, v = min((cost(i, j), min(i, j), max(i, j)) for i, j in itertools.product(range(len(x)), repeat=2) if comps[i] in inside and comps[j] not in inside)
        out.add((u, v))
        inside |= {comps[u], comps[v]}
    return out


@pytest.mark.parametrize("metric, cell", [("cosine", 2048), ("l2sq", 16)])
def test_cheapest_edges_join_all_islands(spark, frame, monkeypatch, metric, cell):
    monkeypatch.setattr(connect, "CELL", cell)
    x = clustered(150, 9, dim=6, seed=3) * (1 if metric == "cosine" else 3)
    df = frame(x)
    edges = knn.knn_graph(df, 1, metric).select("src", "dst", "dist")
    comps = plain_components(len(x), [(r.src, r.dst) for r in edges.collect()])
    y = x.astype(np.float64)
    cost = (lambda i, j: 1 - y[i] @ y[j]) if metric == "cosine" else (lambda i, j: ((y[i] - y[j]) ** 2).sum())
    found = connect.connect(edges, df, metric)
    assert {(r.src, r.dst) for r in found.added.collect()} == least_tree(x, comps, cost)
    assert connect.components(found.edges, df).select("component").distinct().count() == 1
    counts = [r["components"] for r in found.rounds]
    assert all(b <= (a + 1) // 2 + 1 for a, b in zip(counts, counts[1:]))
    assert found.rounds[-1]["ruled_out"] > 0.2


def test_repair_makes_a_bucket_graph_of_clusters_whole(spark, frame):
    x = clustered(1500, 30, spread=0.02)
    df = frame(x)
    params = GraphParams(m_links=8, max_degree=16, ef_construction=50)
    edges = graph.build_graph(df, CodeParams(16, bits=8), params, "lsh", num_probes=1)
    before = graph.connectivity(edges, df, graph.entry_points(df)).first().reachable_pct
    fixed = connect.connect(edges, df)
    after = graph.connectivity(graph.reverse_edges(fixed.edges), df, graph.entry_points(df)).first().reachable_pct
    assert before < 100 and after == 100


class Held:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("blocks", [2, 1000])
def test_nodes_that_rule_out_nothing_leave_in_small_batches(monkeypatch, blocks):
    monkeypatch.setattr(connect, "TILE", 1000)
    x = np.random.default_rng(4).normal(size=(300, 4)).astype(np.float32)
    pivots = {"pivot": np.arange(50), "component": np.arange(50), "vec": x[:50].astype(float), "radius": np.full(50, 9.0), "norm": np.full(50, 99.0), "only": np.full(50, -1)}
    rows = {"id": np.arange(300), "component": np.arange(300), "vec": list(x), "bound": np.full(300, np.inf)}
    out = list(connect._visits("l2sq", Held(pivots), blocks)(iter([pa.RecordBatch.from_pydict(rows)])))
    assert max(b.num_rows for b in out) <= 1000
    places = min(50, blocks)
    assert sum(b.num_rows for b in out) == 300 * places and sum(sum(b.column("cells").to_pylist()) for b in out) == 300 * 50


def test_isotropic_nodes_are_answered_by_their_lists(spark, frame, unit):
    df = frame(unit(120, 48))
    edges = knn.knn_graph(df, 1).select("src", "dst", "dist")
    found = connect.connect(edges, df)
    assert connect.components(found.edges, df).select("component").distinct().count() == 1
    assert found.rounds[0]["components"] > 2 and found.rounds[0]["ruled_out"] > 0.9


def test_lists_of_a_batch_meet_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(descent, "MET", 200)
    monkeypatch.setattr(descent, "HELD", 400)
    monkeypatch.setattr(descent, "STEP", 30)
    sizes, exact = [], descent._exact
    monkeypatch.setattr(descent, "_exact", lambda m, a, b: sizes.append(len(a)) or exact(m, a, b))
    rng = np.random.default_rng(6)
    x, lists = rng.normal(size=(60, 4)).astype(np.float32), [sorted(rng.choice(60, 9, replace=False).tolist()) for _ in range(80)]
    items = [[{"id": i, "new": True, "limit": float("inf"), "vec": x[i].tolist()} for i in l] for l in lists]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("new", pa.bool_()), ("limit", pa.float64()), ("vec", pa.list_(pa.float32()))]))
    out = list(descent._local_join("l2sq", 5)(iter([pa.RecordBatch.from_arrays([pa.array(items, kind)], ["items"])])))
    assert max(sizes) <= 30 and len(sizes) > 1
    y, got, want = x.astype(np.float64), {}, {}
    for a, b, d in {r for batch in out for r in zip(*(c.to_pylist() for c in batch.columns))}:
        got.setdefault(a, []).append((d, b))
    for l in lists:
        for a, b in itertools.permutations(l, 2):
            want.setdefault(a, set()).add((float(((y[a] - y[b]) ** 2).sum()), b))
    assert set(got) == set(want)
    for a in want:
        assert [b for _, b in sorted(got[a])[:5]] == [b for _, b in sorted(want[a])[:5]]


def test_drawn_rows_do_not_pass_through_the_driver(frame, unit):
    """Sixteen rows for every node are drawn, which the planner takes to be as few as the nodes."""
    nodes = cut_to_table(frame(unit(300, 8)).selectExpr("vec_id id", "embedding vec"))
    drawn = descent._first_lists(nodes, 16, "cosine", 42, 300)
    plan = drawn._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [place" in plan and "HashJoin [place" not in plan
    assert drawn.count() == 300 * 16
