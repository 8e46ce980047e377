"""Result tables of benchmark runs: fixed schemas, CSV sinks and merging of several systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

# Column names and types of the result files.
SCHEMAS = {
    "recall_qps": "system string, config string, ef_search int, recall_10 double, qps_1t double, "
    "latency_mean_us double, latency_p50_us double, latency_p99_us double",
    "external_recall_qps": "system string, config string, ef_search int, recall_10 double, qps double, latency_mean_us double",
    "thread_scaling": "threads int, build_time_s double, throughput_vps double, speedup double, connectivity_pct double",
    "topology_comparison": "edge_selection string, construction string, connectivity_pct double, graph_recall_10 double",
    "correlation": "dataset string, dim int, K int, num_pairs int, pearson_r double",
    "memory_breakdown": "system string, component string, bytes bigint, MB double",
    "gist_metrics": "metric string, value double",
    "resolution_ceiling": "K int, BruteForce_Recall double, Graph_Recall double, Rerank_Recall double",
}


def write_results(df: DataFrame, kind: str, path: str, mode: str = "overwrite") -> None:
    """Write rows as CSV with a header, cast to the schema of their kind."""
    columns = [part.split() for part in SCHEMAS[kind].split(",")]
    df.selectExpr(*[f"cast(`{name}` as {dtype}) as `{name}`" for name, dtype in columns]).write.mode(mode).option(
        "header", True
    ).csv(path)


def read_results(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(SCHEMAS[kind]).csv(path)


def merge_results(frames: list[DataFrame]) -> DataFrame:
    """One table from systems with different columns; ``qps_1t`` becomes ``qps``."""
    renamed = [df.withColumnRenamed("qps_1t", "qps") for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
