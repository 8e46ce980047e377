"""Results that must not be cut short or lose rows without a sign."""

import numpy as np
import pytest

from nearloom.operators import graph, knn, metrics, search
from nearloom.operators.skew import hot_keys, salted_join, split_join
from nearloom.params import SearchParams
from nearloom.session import bucket_count, number_rows


def ring(spark, n, edges):
    return spark.createDataFrame(edges, "src bigint, dst bigint, dist double")


def beam_tables(spark, frame, unit, n, links):
    x = unit(n, 8)
    base = frame(x)
    vectors = base.withColumnRenamed("vec_id", "node").withColumnRenamed("embedding", "embedding")
    to = base.selectExpr("vec_id as dst", "embedding as dst_embedding")
    edges = spark.createDataFrame(links, "src bigint, dst bigint").join(to, "dst").selectExpr("src", "dst", "0.0d as dist", "dst_embedding")
    queries = base.filter("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    return queries, edges, vectors


def test_all_entries_are_used(spark, frame, unit, monkeypatch):
    queries, edges, vectors = beam_tables(spark, frame, unit, 150, [])
    params = SearchParams(k=150, ef=200, rerank=False)
    monkeypatch.setattr(search, "ENTRY_ROWS", 40)
    got = search.beam_search(queries, edges, vectors, "cosine", params)
    assert got.groupBy("query_id").count().select("count").distinct().collect() == [(150,)]


def test_unfinished_beams_are_an_error(spark, frame, unit):
    chain = [(i, i + 1) for i in range(30)]
    queries, edges, vectors = beam_tables(spark, frame, unit, 31, chain)
    entries = vectors.filter("node = 0")
    with pytest.raises(RuntimeError, match="max_iter"):
        search.beam_search(queries, edges, entries, "cosine", SearchParams(k=5, ef=31, rerank=False, max_iter=2))
    whole = search.beam_search(queries, edges, entries, "cosine", SearchParams(k=5, ef=31, rerank=False))
    assert whole.count() == 3 * 31


def test_long_chains_are_walked_to_the_end(spark):
    edges = ring(spark, 25, [(i, i + 1, 0.0) for i in range(24)])
    start = spark.createDataFrame([(0,)], "node bigint")
    assert {r.node: r.depth for r in graph.reachable(edges, start).collect()} == {i: i for i in range(25)}


def test_null_vectors_are_not_ranked(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id bigint, embedding array<float>")
    named = spark.createDataFrame([(q, v) for q in (1, 2) for v in (1, 2, 3, 9)], "query_id bigint, vec_id bigint")
    got = knn.rerank(named, queries, vectors, 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(1, 1, 1), (1, 2, 3)]


def test_latency_of_null_groups_and_of_nothing(spark):
    rows = [(None, 3.0), (None, 1.0), ("a", 2.0), ("a", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r["mean"], r.p50, r.p99) for r in metrics.latency_stats(df, ["g"], "v").collect()}
    assert got == {None: (2, 2.0, 3.0, 3.0), "a": (1, 2.0, 2.0, 2.0)}
    whole = metrics.latency_stats(df, [], "v").collect()
    assert [tuple(r) for r in whole] == [(3, 2.0, 500000.0, 2.0, 3.0)]
    assert [tuple(r) for r in metrics.latency_stats(df.limit(0), [], "v").collect()] == [(0, 0.0, 0.0, 0.0, 0.0)]
    assert metrics.latency_stats(df.limit(0), ["g"], "v").count() == 0


def test_pairs_of_sparse_ids_join(spark):
    ids = list(range(-50, 1000, 10)) + [2**40]
    df = spark.createDataFrame([(i,) for i in ids + [ids[0], None]], "vec_id bigint")
    rows = knn.sample_pairs(df, per_vector=4).collect()
    assert len(rows) == 4 * len(ids) and {r.i for r in rows} | {r.j for r in rows} <= set(ids)
    assert all(r.i != r.j for r in rows) and len({r.pair_id for r in rows}) == len(rows)


def test_numbers_follow_the_order(spark):
    ids = np.random.default_rng(0).permutation(5000).tolist()
    df = spark.createDataFrame([(i * 3,) for i in ids], "x bigint").repartition(9)
    assert all(r.x == 3 * r.number for r in number_rows(df, "x").collect())
    assert number_rows(df.limit(0), "x").count() == 0


def test_every_hot_key_is_split(spark):
    left = spark.range(6000).selectExpr("id % 1500 as k", "id as x")
    hot = hot_keys(left, ["k"], 3)
    assert hot.count() == 1500
    right = spark.range(1500).selectExpr("id as k", "id * 2 as y")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, salted_join(left, right, ["k"], "x", hot).collect())) == want
    assert sorted(map(tuple, split_join(left, right, ["k"], 3).collect())) == want


def test_buckets_follow_the_rows(spark):
    assert bucket_count(spark, 10**9) == 10_000 and bucket_count(spark, 1) == 1
