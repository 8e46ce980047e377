"""A vector index on shared storage: Parquet tables for vectors, codes and edges, plus parameters.

Edges are bucketed by ``src`` so that every hop of a search reads them where they lie.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from nearloom.operators.search import VectorIndex
from nearloom.params import CodeParams, GraphParams
from nearloom.session import bucket_count


def _bucketed(spark: SparkSession, schema: str, path: str, buckets: int) -> DataFrame:
    name = f"nearloom_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (src) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def save_index(index: VectorIndex, path: str, buckets: int | None = None) -> None:
    """Write a new index directory; fails if it holds data."""
    spark = index.vectors.sparkSession
    buckets = buckets or bucket_count(spark, index.graph_params.max_degree * index.vectors.count())
    index.vectors.write.parquet(f"{path}/vectors")
    index.codes.write.parquet(f"{path}/codes")
    name = f"nearloom_{uuid.uuid4().hex}"
    index.edges.repartition(buckets, "src").write.format("parquet").bucketBy(buckets, "src").option(
        "path", f"{path}/edges"
    ).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    params = {
        "code": asdict(index.code_params),
        "graph": asdict(index.graph_params),
        "metric": index.metric,
        "buckets": buckets,
    }
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.parquet(f"{path}/params")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    params = json.loads(spark.read.parquet(f"{path}/params").first().params)
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/edges").schema.fields
    )
    return VectorIndex(
        spark.read.parquet(f"{path}/vectors"),
        spark.read.parquet(f"{path}/codes"),
        _bucketed(spark, schema, f"{path}/edges", params["buckets"]),
        CodeParams(**params["code"]),
        GraphParams(**params["graph"]),
        params["metric"],
    )
