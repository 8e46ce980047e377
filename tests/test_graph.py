import numpy as np
import pytest
from helpers import brute
from pyspark.sql import functions as F

from nearloom.functions.rotations import keyed_rotations
from nearloom.operators import encode, graph, knn, metrics, search
from nearloom.operators.skew import hot_keys, salted_join, split_join
from nearloom.params import CodeParams, GraphParams, SearchParams
from nearloom.plans import catalog
from nearloom.sources import index_store

EDGES = "src bigint, dst bigint, dist double"


def triples(df):
    return sorted((r.src, r.dst, r.dist) for r in df.collect())


def test_reverse_and_cap(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.4), (1, 3, 0.9), (4, 1, 0.1)], EDGES)
    both = graph.reverse_edges(e)
    assert triples(both) == [(1, 2, 0.4), (1, 3, 0.9), (1, 4, 0.1), (2, 1, 0.4), (3, 1, 0.9), (4, 1, 0.1)]
    assert triples(graph.cap_degree(both, 2).filter("src = 1")) == [(1, 2, 0.4), (1, 4, 0.1)]


def test_membership_removal_entries(spark, frame, unit):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.4)], EDGES)
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint")
    assert [tuple(r) for r in graph.contains_edges(e, pairs).collect()] == [(1, 2)]
    assert triples(graph.remove_edges(e, pairs)) == [(2, 3, 0.4)]
    df = frame(unit(20, 4))
    assert graph.entry_points(df).collect()[0].node == 0
    ids = [r.node for r in graph.entry_points(df, 4, 1).collect()]
    assert len(set(ids)) == 4 and ids == [r.node for r in graph.entry_points(df.repartition(5), 4, 1).collect()]
    assert graph.entry_points(df.limit(2), 4, 1).count() == 2


def detours(rows, alpha):
    rank = {(s, d): r for s, d, r in rows}
    out = {}
    for (s, d), r in rank.items():
        out[(s, d)] = sum(1 for (a, z), r1 in rank.items() if a == s and (z, d) in rank and max(r1, rank[(z, d)]) * alpha < r)
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 5])
@pytest.mark.parametrize("alpha", [1.0, 1.5])
def test_detours_equal_brute_force(frame, unit, hot_rows, alpha):
    x = unit(60, 6)
    ranked = knn.knn_graph(frame(x), 10)
    want = detours([(r.src, r.dst, r["rank"]) for r in ranked.collect()], alpha)
    got = {(r.src, r.dst): r.detours for r in graph.count_detours(ranked, alpha, hot_rows).collect()}
    assert got == want and max(want.values()) > 0


def test_rank_pruned_graph_shape(frame, unit):
    x = unit(80, 6)
    built = graph.build_from_knn(knn.knn_graph(frame(x), 16), 8, True, 1.1)
    stats = graph.degree_stats(built, frame(x)).first()
    assert stats.max_degree <= 8 and stats.isolated == 0 and stats.num_nodes == 80
    assert built.select("src", "dst").distinct().count() == built.count()
    plain = graph.build_from_knn(knn.knn_graph(frame(x), 16), 8, False)
    assert graph.degree_stats(plain, frame(x)).first().max_degree <= 8
    with pytest.raises(ValueError):
        graph.build_from_knn(plain, 8, True, 5.0)


def test_build_is_independent_of_partitions(frame, unit):
    x = unit(150, 16)
    params, g = CodeParams(16, bits=16), GraphParams(m_links=8, max_degree=12, ef_construction=50)
    seen = []
    for parts in (1, 5):
        df = frame(x).repartition(parts)
        codes = encode.components(df, params)
        seen.append(triples(graph.build_graph(df, params, g, "asymmetric", codes)))
    assert seen[0] == seen[1]
    degree = {}
    for s, _, _ in seen[0]:
        degree[s] = degree.get(s, 0) + 1
    assert max(degree.values()) <= 12 and len(degree) == 150
    with pytest.raises(ValueError):
        graph.build_graph(frame(x), params, g, "other")


def test_reachability(spark, frame, unit):
    chain = [(i, i + 1, 0.1) for i in range(20)] + [(30, 31, 0.1)]
    e = spark.createDataFrame(chain, EDGES)
    start = spark.createDataFrame([(0,)], "node bigint")
    got = {r.node: r.depth for r in graph.reachable(e, start).collect()}
    assert got == {i: i for i in range(21)}
    nodes = spark.createDataFrame([(i,) for i in range(40)], "vec_id bigint")
    row = graph.connectivity(e, nodes, start).first()
    assert (row.num_nodes, row.reachable, row.reachable_pct) == (40, 21, 52.5)


def test_code_graph_is_connected(frame, unit):
    x = unit(300, 32)
    params = CodeParams(32, bits=16)
    df = frame(x)
    edges = graph.build_graph(df, params, GraphParams(m_links=16, ef_construction=100), "asymmetric", encode.components(df, params))
    assert graph.connectivity(edges, df, graph.entry_points(df)).first().reachable_pct >= 99.0


def test_audit_knn(spark):
    e = spark.createDataFrame([(0, 1, 0.1), (1, 1, 0.0), (1, 9, 0.7)], EDGES)
    nodes = spark.createDataFrame([(0,), (1,)], "vec_id bigint")
    row = graph.audit_knn(e, nodes, 2).first()
    assert tuple(row) == (1, 1, 1, 1, 0.0, 0.7)


def best_first(scores, edges, start, ef):
    """One node at a time, as the definition says."""
    out = {}
    for q in range(len(scores)):
        beam, done = {start: scores[q][start]}, set()
        while True:
            open_nodes = [(d, n) for n, d in beam.items() if n not in done]
            if not open_nodes:
                break
            _, node = min(open_nodes)
            done.add(node)
            for nxt in edges.get(node, ()):
                if nxt not in done:
                    beam[nxt] = scores[q][nxt]
            beam = dict(sorted(beam.items(), key=lambda kv: (kv[1], kv[0]))[:ef])
        out[q] = [n for n, _ in sorted(beam.items(), key=lambda kv: (kv[1], kv[0]))]
    return out


@pytest.fixture(scope="module")
def small_index(frame, unit):
    x = unit(120, 16)
    df = frame(x)
    index = search.build_index(df, CodeParams(16, bits=16), GraphParams(m_links=6, max_degree=10, ef_construction=50))
    return x, df, index


def test_beam_search_equals_best_first(small_index):
    x, df, index = small_index
    rot = keyed_rotations(42, 16, 16)
    xs = x[:25].astype(np.float64)
    scores = -xs @ rot.decode(rot.components(x.astype(np.float64))[0]).T
    edges = {}
    for r in index.edges.collect():
        edges.setdefault(r.src, []).append(r.dst)
    queries = df.filter("vec_id < 25").withColumnRenamed("vec_id", "query_id")
    want = best_first(scores, edges, 0, 12)
    params = SearchParams(k=12, ef=12, rerank=False)
    got = search.ann_search(queries, index, params)
    lists = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        lists.setdefault(r.query_id, []).append(r.vec_id)
    assert lists == want
    coded = search.encode_queries(queries, index.code_params, index.metric)
    hot = search.beam_search(coded, index.edges, search.index_entries(index), "asymmetric", params, index.code_params, hot_rows=3)
    hot_lists = {}
    for r in sorted(hot.collect(), key=lambda r: (r.query_id, r["rank"])):
        hot_lists.setdefault(r.query_id, []).append(r.node)
    assert hot_lists == want


def test_wide_beam_finds_what_the_exact_join_finds(small_index):
    x, df, index = small_index
    queries = df.withColumnRenamed("vec_id", "query_id")
    truth = knn.exact_knn(queries, df, 5)
    recalls = []
    for ef in (8, 30, 120):
        found = search.ann_search(queries, index, SearchParams(k=5, ef=ef, width=8, rerank_k=200))
        recalls.append(metrics.recall_at_k(found, truth, 5).first().recall)
        audit = metrics.audit_results(found).first()
        assert (audit.unordered, audit.nans, audit.duplicates) == (0, 0, 0)
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_index_round_trip_and_modes(spark, small_index, tmp_path):
    x, df, index = small_index
    queries = df.withColumnRenamed("vec_id", "query_id").filter("query_id < 20")
    params = SearchParams(k=5, ef=16, width=4)
    want = sorted(map(tuple, search.ann_search(queries, index, params).collect()))
    index_store.save_index(index, f"{tmp_path}/index", buckets=3)
    loaded = index_store.load_index(spark, f"{tmp_path}/index")
    assert loaded.code_params == index.code_params and loaded.graph_params == index.graph_params
    assert sorted(map(tuple, search.ann_search(queries, loaded, params).collect())) == want
    for mode, code in (("hamming", CodeParams(16, 32)), ("estimate", CodeParams(16, 32, 16)), ("cosine", CodeParams(16, 8))):
        other = search.build_index(df, code, GraphParams(m_links=8, ef_construction=50), mode)
        own = search.ann_search(queries, other, SearchParams(k=1, ef=40, width=8, num_entry_points=4))
        assert metrics.identity_audit(own).first().self_first >= 16


def test_calibrated_search_keeps_order(spark, small_index):
    x, df, index = small_index
    queries = df.withColumnRenamed("vec_id", "query_id").filter("query_id < 5")
    params = SearchParams(k=5, ef=16, width=4, rerank=False)
    plain = {(r.query_id, r["rank"]): r for r in search.ann_search(queries, index, params).collect()}
    line = spark.createDataFrame([(0.5, 2.0)], "alpha double, beta double")
    for r in search.ann_search(queries, index, params, calibration=line).collect():
        base = plain[(r.query_id, r["rank"])]
        assert r.vec_id == base.vec_id and r.dist == pytest.approx(-0.5 * base.dist + 2.0)


def test_user_entry_points_and_fewer_vectors_than_ef(small_index, frame, unit, spark):
    x, df, index = small_index
    entries = search.index_entries(index, nodes=spark.createDataFrame([(7,), (7,), (9,)], "node bigint"))
    assert {r.node for r in entries.collect()} == {7, 9}
    tiny = frame(unit(6, 16, 3))
    small = search.build_index(tiny, CodeParams(16, 8), GraphParams(m_links=3, ef_construction=10))
    got = search.ann_search(tiny.withColumnRenamed("vec_id", "query_id"), small, SearchParams(k=4, ef=50, width=4), entries=None)
    assert got.count() == 24


def test_zero_vector_gives_no_nan(frame, unit):
    x = unit(60, 16)
    x[17] = 0
    df = frame(x)
    index = search.build_index(df, CodeParams(16, 16), GraphParams(m_links=6, ef_construction=50))
    found = search.ann_search(df.withColumnRenamed("vec_id", "query_id"), index, SearchParams(k=5, ef=20, width=4))
    assert metrics.audit_results(found).first().nans == 0


def test_skewed_joins_equal_plain_join(spark):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    right = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    hot = hot_keys(left, ["k"], 20)
    assert {r.k: r.pieces for r in hot.collect()}[1] >= 5
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, salted_join(left, right, ["k"], "v", hot, how).collect())) == want
    want = sorted(map(str, left.join(right, "k").collect()))
    assert sorted(map(str, split_join(left, right, ["k"], 20).collect())) == want


def test_duplicates_are_found(frame, unit, spark):
    x = unit(50, 16)
    both = np.concatenate((x, x))
    found = knn.exact_knn(frame(both, "query_id"), frame(both), 60)
    groups = spark.createDataFrame([(i, i % 50) for i in range(100)], "vec_id bigint, group_id bigint")
    rows = metrics.duplicates_found(found, groups, 60).collect()
    assert len(rows) == 100 and sum(r.found for r in rows) == 100
    assert as_expected(found, both)


def as_expected(found, both):
    want = brute(both, both, 2)
    return {r.query_id: r.vec_id for r in found.filter("rank = 1").collect()} == {i: w[0] for i, w in want.items()}


def test_only_what_can_enter_a_full_beam_travels(frame, unit, monkeypatch):
    df, ef, kept, states, farther = frame(unit(300, 16, seed=3)), 8, search._keep_best, [], []

    def spy(rows, params):
        if states:
            full = states[-1].groupBy("query_id").agg(F.count("*").alias("n"), F.max("dist").alias("worst")).filter(F.col("n") >= ef)
            farther.append(rows.join(full, "query_id").filter(F.col("dist") > F.col("worst")).count())
        states.append(kept(rows, params).checkpoint())
        return states[-1]

    monkeypatch.setattr(search, "_keep_best", spy)
    index = search.build_index(df, CodeParams(16, bits=16), GraphParams(m_links=6, max_degree=12, ef_construction=50), "cosine")
    search.ann_beams(df.withColumnRenamed("vec_id", "query_id").filter("query_id < 20"), index, SearchParams(k=4, ef=ef, width=2, rerank_k=ef))
    assert len(farther) > 2 and sum(farther) == 0


def test_sweep_searches_once_for_each_beam_size(spark, monkeypatch):
    sizes, searched = [], search.beam_search
    monkeypatch.setattr(search, "beam_search", lambda q, e, entries, metric, params, *a, **kw: sizes.append(params.ef) or searched(q, e, entries, metric, params, *a, **kw))
    found = catalog.graph_recall_sweep(spark, "/root/testdata/sf0.001").collect()
    assert sizes == catalog.GRAPH_SWEEP_EF and len(found) == 2 * len(sizes)


def test_estimates_do_not_grow_with_the_rounds(spark):
    """A walk along a chain, one node a round: the planner's number of bytes stays a number of few digits."""
    rows = [(i, [float(np.cos(0.1 * i)), float(np.sin(0.1 * i))]) for i in range(9)]
    nodes = spark.createDataFrame(rows, "node bigint, embedding array<float>")
    edges = spark.createDataFrame([(i, i + 1, rows[i + 1][1]) for i in range(8)], "src bigint, dst bigint, dst_embedding array<float>")
    queries = nodes.filter("node >= 6").withColumnRenamed("node", "query_id")
    found = search.beam_search(queries, edges, nodes.filter("node = 0"), "cosine", SearchParams(k=3, ef=3, rerank=False), hot_rows=1)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 256
    assert {r.query_id: r.node for r in found.collect() if r["rank"] == 1} == {6: 6, 7: 7, 8: 8}
