import numpy as np
import pytest
from helpers import as_lists, brute
from pyspark.sql import functions as F

from nearloom.operators import encode, graph, search
from nearloom.params import CodeParams, GraphParams, SearchParams
from nearloom.streaming import ingest

CODE = CodeParams(16, bits=16)
GRAPH = GraphParams(m_links=6, max_degree=10, ef_construction=50)


@pytest.fixture(scope="module")
def arrivals(frame, unit, tmp_path_factory):
    """The same 90 vectors as three files, later ones arriving later."""
    path = str(tmp_path_factory.mktemp("in"))
    df = frame(unit(90, 16))
    for i in range(3):
        df.filter(F.floor(F.col("vec_id") / 30) == i).coalesce(1).write.mode("append").parquet(path)
    return path, df


def stream(spark, path, files=1):
    return spark.readStream.schema("vec_id bigint, embedding array<float>").option("maxFilesPerTrigger", files).parquet(path)


def test_stream_encoding_equals_batch(spark, arrivals, tmp_path):
    path, df = arrivals
    coded = ingest.encode_stream(stream(spark, path), CODE).select("vec_id", "components")
    q = coded.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/o").collect()))
    assert got == sorted(map(str, encode.components(df, CODE).select("vec_id", "components").collect()))


def test_growing_index(spark, arrivals, tmp_path):
    path, df = arrivals
    index = ingest.GrowingIndex(spark, f"{tmp_path}/i", CODE, GRAPH)
    index.start(stream(spark, path), f"{tmp_path}/c").awaitTermination()
    assert index.vectors().count() == 90 and index.codes().count() == 90
    edges = index.edges()
    stats = graph.degree_stats(edges, df).first()
    assert stats.max_degree <= 10 and stats.isolated == 0
    assert edges.select("src", "dst").distinct().count() == edges.count()
    assert graph.connectivity(edges, df, graph.entry_points(df)).first().reachable_pct >= 99.0
    # A batch that runs twice leaves the same index.
    before = sorted(map(tuple, edges.collect()))
    index.add(df.filter("vec_id >= 60"), 2)
    ids = [r.vec_id for r in index.vectors().collect()]
    assert len(ids) == len(set(ids)) == 90
    assert len(sorted(map(tuple, index.edges().collect()))) == len(before)


def test_one_batch_equals_bulk_build(spark, arrivals, tmp_path):
    path, df = arrivals
    index = ingest.GrowingIndex(spark, f"{tmp_path}/i", CODE, GRAPH)
    index.start(stream(spark, path, 10), f"{tmp_path}/c").awaitTermination()
    bulk = graph.build_graph(df, CODE, GRAPH, "asymmetric", encode.components(df, CODE))
    key = lambda e: sorted((r.src, r.dst, round(r.dist, 6)) for r in e.collect())
    assert key(index.edges()) == key(bulk)


def test_growth_through_buckets(spark, arrivals, tmp_path):
    path, df = arrivals
    index = ingest.GrowingIndex(spark, f"{tmp_path}/i", CodeParams(16, bits=4), GRAPH, num_probes=8, edges_from="lsh")
    index.start(stream(spark, path, 2), f"{tmp_path}/c").awaitTermination()
    assert graph.degree_stats(index.edges(), df).first().isolated == 0


def test_search_streams(spark, arrivals, tmp_path):
    path, df = arrivals
    base = search.build_index(df, CODE, GRAPH)
    params = SearchParams(k=3, ef=90, width=10, rerank_k=90)
    queries = stream(spark, path).withColumnRenamed("vec_id", "query_id")
    ingest.search_stream(queries, ingest.index_search(base, params), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/o")
    assert out.select("batch_id").distinct().count() == 3
    x = np.array([r.embedding for r in sorted(df.collect())])
    assert as_lists(out) == brute(x, x, 3)
    queries = stream(spark, path).withColumnRenamed("vec_id", "query_id")
    probe = ingest.bucket_search(df, CodeParams(16, bits=4), 1, 4)
    ingest.search_stream(queries, probe, f"{tmp_path}/p", f"{tmp_path}/d").awaitTermination()
    assert as_lists(spark.read.parquet(f"{tmp_path}/p")) == {i: [i] for i in range(90)}
