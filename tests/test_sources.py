import numpy as np
import pytest
from helpers import as_lists, brute

from nearloom.functions import vectors as V
from nearloom.operators import knn
from nearloom.sources import datasets, results, vecs


def write_vecs(path, x, dtype, tail=b""):
    with open(path, "wb") as f:
        for row in np.asarray(x, dtype=dtype):
            f.write(np.int32(len(row)).tobytes() + row.tobytes())
        f.write(tail)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, unit):
    path = tmp_path_factory.mktemp("set")
    base, queries = 3 * unit(50, 8), unit(7, 8, 1)
    write_vecs(path / "x_base.fvecs", base, "<f4", b"xyz")
    write_vecs(path / "x_query.fvecs", queries, "<f4")
    truth = brute(queries, base, 5, "l2sq")
    write_vecs(path / "x_groundtruth.ivecs", [truth[i] for i in range(7)], "<i4")
    return path, base, queries, truth


def test_fvecs_in_many_partitions(spark, folder):
    path, base, _, _ = folder
    vecs.register(spark)
    df = spark.read.format("fvecs").option("split_bytes", "200").load(f"{path}/x_base.fvecs")
    assert df.rdd.getNumPartitions() > 5
    rows = sorted(df.collect())
    assert [r.vec_id for r in rows] == list(range(50))
    assert np.array_equal(np.array([r.embedding for r in rows], dtype=np.float32), base)


def test_folder_of_files_counts_on(spark, tmp_path, unit):
    vecs.register(spark)
    x = unit(9, 4)
    write_vecs(tmp_path / "part-0", x[:4], "<f4")
    write_vecs(tmp_path / "part-1", x[4:], "<f4")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    rows = sorted(spark.read.format("fvecs").load(str(tmp_path)).collect())
    assert np.array_equal(np.array([r.embedding for r in rows], dtype=np.float32), x)


def test_strict_widths_and_empty_file(spark, tmp_path):
    vecs.register(spark)
    (tmp_path / "empty.fvecs").write_bytes(b"")
    assert spark.read.format("fvecs").load(f"{tmp_path}/empty.fvecs").count() == 0
    bad = np.array([2, 0, 0, 3, 0, 0], dtype="<i4")
    (tmp_path / "bad.fvecs").write_bytes(bad.tobytes())
    assert spark.read.format("fvecs").load(f"{tmp_path}/bad.fvecs").count() == 2
    with pytest.raises(Exception, match="different width"):
        spark.read.format("fvecs").option("strict", "true").load(f"{tmp_path}/bad.fvecs").collect()


def test_load_dataset(spark, folder, tmp_path, unit):
    path, base, queries, truth = folder
    data = datasets.load_vector_dataset(spark, str(path), "x")
    assert data.dim == 8 and as_lists(data.truth) == truth
    assert as_lists(knn.exact_knn(data.queries, data.base, 5, "l2sq")) == truth
    half = datasets.limit_base(data, 20, 5)
    assert half.base.count() == 20 and as_lists(half.truth) == brute(queries, base[:20], 5, "l2sq")
    normal = datasets.load_vector_dataset(spark, str(path), "x", normalize=True, truth_k=5)
    assert normal.base.selectExpr("size(embedding) as n").first().n == 8
    norms = [r.n for r in normal.base.select(V.norm("embedding").alias("n")).collect()]
    assert norms == pytest.approx([1.0] * 50, abs=1e-6)
    assert as_lists(normal.truth) == brute(queries, base / 3, 5)
    write_vecs(tmp_path / "y_base.fvecs", unit(3, 8), "<f4")
    write_vecs(tmp_path / "y_query.fvecs", unit(3, 9), "<f4")
    with pytest.raises(ValueError, match="Query dimension mismatch"):
        datasets.load_vector_dataset(spark, str(tmp_path), "y")


def test_random_dataset_depends_on_ids_alone(spark):
    a = datasets.random_unit_vectors(spark, 200, 6, 9)
    rows = {r.vec_id: r.embedding for r in a.collect()}
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    again = {r.vec_id: r.embedding for r in datasets.random_unit_vectors(spark, 50, 6, 9).collect()}
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert all(rows[i] == again[i] for i in range(50))
    x = np.array([rows[i] for i in range(200)])
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-6) and np.abs(x.mean(0)).max() < 0.1
    data = datasets.random_dataset(spark, 60, 5, 6, 4)
    base = np.array([r.embedding for r in sorted(data.base.collect())])
    queries = np.array([r.embedding for r in sorted(data.queries.collect())])
    assert as_lists(data.truth) == brute(queries, base, 4, "neg_dot")


def test_result_files(spark, tmp_path):
    a = spark.createDataFrame([("a", "c", 10, 0.5, 100.0, 1.0, 2.0, 3.0)], results.SCHEMAS["recall_qps"])
    b = spark.createDataFrame([("b", "c", 10, 0.7, 50.0, 4.0)], results.SCHEMAS["external_recall_qps"])
    results.write_results(a, "recall_qps", f"{tmp_path}/a")
    results.write_results(b, "external_recall_qps", f"{tmp_path}/b")
    merged = results.merge_results(
        [results.read_results(spark, "recall_qps", f"{tmp_path}/a"), results.read_results(spark, "external_recall_qps", f"{tmp_path}/b")]
    )
    rows = {r.system: r for r in merged.collect()}
    assert rows["a"].qps == 100.0 and rows["b"].qps == 50.0 and rows["b"].latency_p99_us is None
    assert set(results.SCHEMAS) >= {"thread_scaling", "topology_comparison", "correlation", "memory_breakdown", "gist_metrics"}
