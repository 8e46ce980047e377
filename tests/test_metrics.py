import numpy as np
import pytest
from pyspark.sql import functions as F

from nearloom.operators import metrics

HITS = "query_id bigint, rank int, vec_id bigint, dist double"


def test_recall_forms(spark):
    truth = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 11, 0.0), (2, 1, 10, 0.0), (2, 2, 10, 0.0), (3, 1, 5, 0.0)], HITS)
    got = spark.createDataFrame([(1, 1, 11, 0.0), (1, 2, 99, 0.0), (1, 3, 10, 0.0), (2, 1, 10, 0.0)], HITS)
    rows = {r.query_id: (r.hits, r.relevant, r.recall) for r in metrics.recall_per_query(got, truth, 2).collect()}
    assert rows == {1: (1, 2, 0.5), 2: (1, 1, 1.0), 3: (0, 1, 0.0)}
    assert metrics.recall_at_k(got, truth, 2).first().recall == 0.5
    strict = {r.query_id: r.recall for r in metrics.recall_per_query(got, truth, 2, strict_k=True).collect()}
    assert strict == {1: 0.5, 2: 0.5, 3: 0.0}
    tagged = got.withColumn("config", F.lit("a"))
    assert metrics.recall_by_config(tagged, truth, 2).first().recall == 0.5
    assert metrics.recall_at_k(got.limit(0), truth.limit(0), 2).first().recall == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 99, 100, 101, 5000])
def test_latency_stats_equal_sorted_positions(spark, n):
    rng = np.random.default_rng(n)
    big = np.round(rng.exponential(100, n), 1)
    rows = [("hot", float(v)) for v in big] + [("b", 5.0)] * 7 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in metrics.latency_stats(df, ["g"], "v").collect()}
    s = np.sort(big)
    r = got["hot"]
    assert set(got) == {"hot", "b"}
    assert r.n == n and r["mean"] == pytest.approx(big.mean()) and r.qps == pytest.approx(1e6 / big.mean())
    assert r.p50 == s[n // 2] and r.p99 == s[min(int(0.99 * n), n - 1)]
    assert (got["b"].p50, got["b"].p99) == (5.0, 5.0)


def test_order_statistics_of_the_whole_table(spark):
    df = spark.range(100_000).select(((F.col("id") * 7919) % 100_003).cast("double").alias("v"))
    got = metrics.order_statistics(df, [], "v", {"mid": (0.5, F.floor(F.col("n") / 2)), "top": (1.0, F.col("n") - 1)}).first()
    s = np.sort((np.arange(100_000) * 7919) % 100_003)
    assert (got.mid, got.top) == (s[50_000], s[-1])


def test_hot_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(metrics, "HOT_ROWS", 50)
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"), (F.col("id") % 501).cast("double").alias("v"))
    got = {r.g: (r.p50, r.p99) for r in metrics.latency_stats(df, ["g"], "v").collect()}
    for g, keep in (("x", lambda i: i % 3 == 0), ("y", lambda i: i % 3 != 0)):
        s = sorted(i % 501 for i in range(1000) if keep(i))
        assert got[g] == (s[len(s) // 2], s[min(int(0.99 * len(s)), len(s) - 1)])


def test_scalar_aggregates(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "x double, y double")
    row = df.agg(
        metrics.mean("x").alias("m"), metrics.stddev("x").alias("s"), metrics.pearson("x", "y").alias("r"),
        metrics.pearson("x", F.lit(1.0)).alias("flat"),
    ).first()
    assert (row.m, row.s, row.flat) == (2.0, 1.0, 0.0) and row.r == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    none = df.limit(0).agg(metrics.mean("x").alias("m"), metrics.stddev("x").alias("s"), metrics.pearson("x", "y").alias("r")).first()
    assert tuple(none) == (0.0, 0.0, 0.0)
    assert df.limit(1).agg(metrics.stddev("x").alias("s")).first().s == 0.0


def test_calibration_and_study(spark):
    rows = [(0.5 * s + 0.1, float(s), "a") for s in range(10)]
    df = spark.createDataFrame(rows, "truth double, score double, k string")
    line = metrics.calibrate(df).first()
    assert line.alpha == pytest.approx(0.5) and line.beta == pytest.approx(0.1)
    assert line.r_squared == pytest.approx(1.0) and line.num_samples == 10
    study = metrics.estimator_study(df, ["k"]).first()
    assert study.pearson_r == pytest.approx(1.0) and (study.min_score, study.max_score) == (0.0, 9.0)


def test_containment(spark):
    truth = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 11, 0.0)], HITS)
    code = spark.createDataFrame([(1, 1, 11, 0.0), (1, 2, 12, 0.0), (1, 3, 10, 0.0)], HITS)
    got = {r.depth: r.containment for r in metrics.topn_containment(code, truth, [1, 2, 3], 2).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0}


def test_audits(spark):
    df = spark.createDataFrame([(1, 1, 5, 0.2), (1, 2, 6, 0.1), (1, 3, 5, 0.3), (2, 1, 7, float("nan"))], HITS)
    row = metrics.audit_results(df).first()
    assert (row.num_rows, row.unordered, row.nans, row.duplicates) == (4, 1, 1, 1)
    sweep = spark.createDataFrame([("s", 10, 0.5), ("s", 20, 0.495), ("s", 40, 0.4)], "system string, ef int, recall double")
    assert [r.dropped for r in metrics.monotone_audit(sweep, ["system"]).orderBy("ef").collect()] == [False, False, True]
    codes = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4]), (3, [1, 2, 3, 4])], "vec_id bigint, code array<int>")
    other = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 9]), (3, [9, 9, 9, 4])], "vec_id bigint, code array<int>")
    from nearloom.functions.codes import component_hamming

    assert tuple(metrics.code_audit(codes, other, component_hamming("stored_code", "fresh_code")).first()) == (3, 1, 1, 1)


def test_pareto_front_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [("s" if i % 3 else "t", float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 40, (300, 2)))]
    df = spark.createDataFrame(rows, "system string, recall double, qps double")
    got = sorted((r.system, r.recall, r.qps) for r in metrics.pareto_front(df.repartition(5)).collect())
    want = sorted({p for p in rows if not any(
        o[0] == p[0] and o[1] >= p[1] and o[2] >= p[2] and (o[1] > p[1] or o[2] > p[2]) for o in rows)})
    assert got == want


def test_memory_and_speedup(spark):
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    rows = metrics.memory_footprint({"vectors": (vec, 4 * F.size("embedding")), "none": (vec.limit(0), F.lit(4))}, "a")
    assert {r.component: r.bytes for r in rows.collect()} == {"vectors": 16, "none": 0}
    other = metrics.memory_footprint({"vectors": (vec, F.lit(2))}, "b")
    assert metrics.compression_ratio(rows.unionByName(other), "a", "b").first().ratio == 4.0
    runs = spark.createDataFrame([(1, 100.0), (4, 30.0)], "threads int, build_time_s double")
    got = {r.threads: (r.speedup, r.efficiency) for r in metrics.speedup(runs).collect()}
    assert got[1] == (1.0, 1.0) and got[4] == (pytest.approx(100 / 30), pytest.approx(100 / 120))
