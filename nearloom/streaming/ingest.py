"""Streams of vectors and queries.

Encoding is stateless and runs inside the stream. Search and index growth run per micro-batch
with the batch operators; every batch writes to a folder named by its id, so a repeated batch
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearloom.operators import encode, graph, knn, lsh
from nearloom.operators.search import VectorIndex, ann_search, encode_base
from nearloom.params import CodeParams, GraphParams, SearchParams

BATCH = "batch_id"


def encode_stream(stream: DataFrame, params: CodeParams, vec_col: str = "embedding") -> DataFrame:
    """Components of arriving vectors: the batch encoder on a stream, append mode, no state."""
    return encode.components(stream, params, vec_col)


def search_stream(
    stream: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger
):
    """Answer arriving queries; ``search`` maps a batch of queries to results.

    Results of batch n are in ``out/batch_id=n``.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def index_search(index: VectorIndex, params: SearchParams) -> Callable[[DataFrame], DataFrame]:
    """Graph search of a static index, for :func:`search_stream`."""
    return lambda batch: ann_search(batch, index, params)


def bucket_search(base: DataFrame, params: CodeParams, k: int, num_probes: int = 8) -> Callable[[DataFrame], DataFrame]:
    """LSH bucket join against a static table, for :func:`search_stream`."""
    return lambda batch: lsh.multiprobe_knn(batch, base, params, k, num_probes)


@dataclass(frozen=True)
class GrowingIndex:
    """An index folder that grows batch by batch.

    ``vectors`` and ``codes`` hold the rows of every batch; ``edges`` holds, per batch, the
    complete adjacency of all nodes that batch touched. The current edges of a node are those of
    the last batch that touched it.
    """

    spark: SparkSession
    path: str
    code_params: CodeParams
    graph_params: GraphParams = GraphParams()
    num_probes: int = 8
    edges_from: str = "asymmetric"

    def _read(self, part: str, schema: str, before: int | None) -> DataFrame:
        full = T._parse_datatype_string(f"{schema}, {BATCH} bigint")
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(f"{self.path}/{part}")
        return rows if before is None else rows.filter(F.col(BATCH) < before)

    def vectors(self, before: int | None = None) -> DataFrame:
        return self._read("vectors", "vec_id bigint, embedding array<float>", before).drop(BATCH)

    def codes(self, before: int | None = None) -> DataFrame:
        return self._read("codes", "vec_id bigint, components array<int>", before).drop(BATCH)

    def edges(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Current edges ``src, dst, dist``, of the nodes ``of`` (``src``) only if given."""
        rows = self._read("edges", "src bigint, dst bigint, dist double", before)
        if of is not None:
            rows = rows.join(of, "src", "left_semi")
        last = F.max(BATCH).over(Window.partitionBy("src"))
        return rows.withColumn("_last", last).filter(F.col(BATCH) == F.col("_last")).select("src", "dst", "dist")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Encode new vectors, link them to old and new ones, and rewrite the touched adjacencies."""

        def write(df: DataFrame, part: str) -> DataFrame:
            target = f"{self.path}/{part}/{BATCH}={batch_id}"
            df.write.mode("overwrite").parquet(target)
            return self.spark.read.schema(df.schema).parquet(target)

        new = write(batch.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), "vectors")
        codes = write(encode_base(new, self.code_params, "asymmetric"), "codes")
        k, p = self.graph_params.m_links, self.code_params
        if self.edges_from == "asymmetric":
            everything = self.codes(before=batch_id).unionByName(codes)
            found = knn.asymmetric_knn(new, everything, p, k, "vec_id", "vec_id", exclude_self=True)
        else:
            everything = self.vectors(before=batch_id).unionByName(new)
            found = lsh.multiprobe_knn(
                new, everything, p, k, self.num_probes, query_id="vec_id", vec_id="vec_id", exclude_self=True
            )
        forward = found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "dist")
        added = graph.reverse_edges(forward)
        touched = added.select("src").distinct()
        merged = self.edges(before=batch_id, of=touched).unionByName(added)
        unique = merged.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        write(graph.cap_degree(unique, self.graph_params.max_degree), "edges")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Grow the index from a stream of ``vec_id, embedding``."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})
        ).start()
