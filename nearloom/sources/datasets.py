"""Data sets of base vectors, queries and ground truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.functions import keyed
from nearloom.functions import vectors as V
from nearloom.operators import knn
from nearloom.sources import vecs


@dataclass(frozen=True)
class VectorDataset:
    """``base`` is ``vec_id, embedding``, ``queries`` ``query_id, embedding``, ``truth`` ``query_id, rank, vec_id``."""

    base: DataFrame
    queries: DataFrame
    truth: DataFrame
    dim: int


def load_embeddings(spark: SparkSession, path: str, columns: tuple[str, ...] = ("vec_id", "embedding")) -> DataFrame:
    """An embedding table, only the named columns read."""
    return spark.read.parquet(path).select(*columns)


def long_truth(wide: DataFrame) -> DataFrame:
    """``query_id, neighbors`` as ``query_id, rank, vec_id`` with ranks from 1."""
    return wide.select("query_id", F.posexplode("neighbors").alias("pos", "vec_id")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "vec_id"
    )


def _dim(df: DataFrame, what: str) -> int:
    row = df.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if row.lo is None or row.lo != row.hi:
        raise ValueError(f"{what} vectors must exist and share one dimension")
    return row.lo


def _normalized(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", V.normalize("embedding").cast("array<float>"))


def load_vector_dataset(spark: SparkSession, directory: str, prefix: str, normalize: bool = False, truth_k: int = 100) -> VectorDataset:
    """``<prefix>_base.fvecs``, ``_query.fvecs`` and ``_groundtruth.ivecs`` of a directory.

    Normalizing changes distances, so the ground truth is then computed from the vectors.
    """
    vecs.register(spark)
    base = spark.read.format("fvecs").load(f"{directory}/{prefix}_base.fvecs")
    queries = spark.read.format("fvecs").load(f"{directory}/{prefix}_query.fvecs").withColumnRenamed("vec_id", "query_id")
    dim = _dim(base, "base")
    if _dim(queries, "query") != dim:
        raise ValueError("Query dimension mismatch")
    if normalize:
        base, queries = _normalized(base), _normalized(queries)
        truth = knn.exact_knn(queries, base, truth_k, "neg_dot", dim=dim).select("query_id", "rank", "vec_id")
    else:
        truth = long_truth(spark.read.format("ivecs").load(f"{directory}/{prefix}_groundtruth.ivecs"))
    return VectorDataset(base, queries, truth, dim)


def limit_base(dataset: VectorDataset, n: int, truth_k: int = 100, metric: str = "l2sq") -> VectorDataset:
    """The first ``n`` base vectors, with the ground truth of what is left."""
    base = dataset.base.filter(F.col("vec_id") < n)
    truth = knn.exact_knn(dataset.queries, base, truth_k, metric, dim=dataset.dim).select("query_id", "rank", "vec_id")
    return VectorDataset(base, dataset.queries, truth, dataset.dim)


def random_unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42, id_col: str = "vec_id") -> DataFrame:
    """Gaussian coordinates on the unit sphere; a row depends on (seed, id) alone."""
    coordinates = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: keyed.gaussian(F.lit(seed), F.col("id"), i)
    )
    rows = spark.range(n).select(F.col("id").alias(id_col), coordinates.alias("raw"))
    return rows.select(id_col, V.normalize("raw").cast("array<float>").alias("embedding"))


def random_dataset(spark: SparkSession, n: int, num_queries: int, dim: int, k: int, seed: int = 42) -> VectorDataset:
    """Random base and queries with brute-force ground truth."""
    base = random_unit_vectors(spark, n, dim, seed)
    queries = random_unit_vectors(spark, num_queries, dim, seed + 1, "query_id")
    truth = knn.exact_knn(queries, base, k, "neg_dot", num_queries=num_queries, num_base=n, dim=dim)
    return VectorDataset(base, queries, truth.select("query_id", "rank", "vec_id"), dim)
