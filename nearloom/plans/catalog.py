"""Registered queries: name -> function of (session, table folder) giving a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearloom.functions import codes as C
from nearloom.functions import pairs
from nearloom.functions import vectors as V
from nearloom.operators import connect, descent, encode, graph, hamming_index, ivf, knn, lsh, metrics, search
from nearloom.params import CodeParams, GraphParams, SearchParams
from nearloom.session import cut_lineage, ensure_checkpoint_dir
from nearloom.sources import datasets, index_store, results
from nearloom.streaming import ingest

DIM = 64
K = 10
COMPONENT_CODE = CodeParams(DIM, bits=16)
SIGN_CODE = CodeParams(DIM, bits=32)
PART_BITS = 8
RESIDUAL_CODE = CodeParams(DIM, bits=32, residual_bits=16, shift=2)
LSH_CODE = CodeParams(DIM, bits=8)
GRAPH_SWEEP_EF = [10, 32]
PROBE_SWEEP = [1, 2, 4, 8, 16]
CODE_SWEEP = [16, 32, 64]
PAIR_HASH_CODE = CodeParams(DIM, bits=8, seed=7)
GRAPH = GraphParams(m_links=12, max_degree=24, ef_construction=100)
BEAM = SearchParams(k=K, ef=32, width=8, rerank=False)
RERANKED = SearchParams(k=K, ef=32, width=8, rerank=True, rerank_k=32)
KNN_K = 16
DETOUR_DEGREE = 8
DESCENT_POOL = 16
DESCENT_ROUNDS = 3
DEPTHS = [10, 20, 50, 100, 200]
SWEEP_EF = [10, 20, 40, 80]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def registered(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# ---- inputs ---------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


def as_queries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("vec_id", "query_id")


def scaled_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of different lengths: every embedding times (1 + label)."""
    factor = (F.col("label") + 1).cast("float")
    return table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x * factor).alias("embedding")
    )


def line_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Five measures of every order line as a vector."""
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    vec = F.array(*[F.col(c).cast("float") for c in measures]).alias("vec")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", vec)
    return lines


def hits(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("query_id", "vec_id", "rank", F.round("dist", digits).alias("dist"))


def edges_out(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("src", "dst", F.round("dist", digits).alias("dist"))


def component_codes(e: DataFrame, params: CodeParams = COMPONENT_CODE) -> DataFrame:
    return encode.components(e, params, keep=["vec_id"]).select("vec_id", "components")


def sizes(e: DataFrame) -> dict:
    """Row counts read from the file footers, so that derived inputs are not run to be counted."""
    n = e.count()
    return {"num_queries": n, "num_base": n, "dim": DIM}


def code_ranks(spark: SparkSession, folder: str, k: int) -> DataFrame:
    e = embeddings(spark, folder)
    return knn.asymmetric_knn(as_queries(e), component_codes(e), COMPONENT_CODE, k, **sizes(e))


def truth(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    e = embeddings(spark, folder)
    return knn.exact_knn(as_queries(e), e, k, "cosine", dim=DIM)


def neighbours(spark: SparkSession, folder: str, k: int = KNN_K) -> DataFrame:
    return knn.knn_graph(embeddings(spark, folder), k, "cosine", dim=DIM)


# ---- vector arithmetic ----------------------------------------------------------------------


@registered
def normalize_vectors(spark, folder):
    lines = line_vectors(spark, folder).withColumn("n", V.normalize("vec"))
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", *[F.round(F.col("n")[i], 6).alias(f"n{i}") for i in range(5)])


@registered
def norm_audit(spark, folder):
    lengths = embeddings(spark, folder).select(V.norm("embedding").alias("norm"))
    return lengths.agg(
        F.round(F.min("norm"), 5).alias("min_norm"),
        F.round(F.max("norm"), 5).alias("max_norm"),
        F.count_if(F.abs(F.col("norm") - 1.0) > 1e-4).alias("off_unit"),
    )


@registered
def avg_norm(spark, folder):
    return encode.average_norm(scaled_embeddings(spark, folder)).select(F.round("avg_norm", 5).alias("avg_norm"))


@registered
def validate_vectors(spark, folder):
    return encode.validate_vectors(embeddings(spark, folder), DIM)


@registered
def pair_distances(spark, folder):
    """All vector distances on a keyed sample of pairs."""
    e = scaled_embeddings(spark, folder)
    sampled = knn.sample_pairs(e)
    left = e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    right = e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    joined = sampled.join(left, "i").join(right, "j")
    return joined.select(
        "pair_id", "i", "j",
        F.round(V.dot("a", "b"), 4).alias("dot"),
        F.round(V.neg_dot("a", "b"), 4).alias("neg_dot"),
        F.round(V.cosine("a", "b"), 4).alias("cosine"),
        F.round(V.l2sq("a", "b"), 4).alias("l2sq"),
    )


# ---- encoding -------------------------------------------------------------------------------


@registered
def fht_transform(spark, folder):
    out = encode.fht(line_vectors(spark, folder), "vec", "t", ["l_orderkey", "l_partkey", "l_linenumber"])
    return out.select("l_orderkey", "l_partkey", "l_linenumber", *[F.round(F.col("t")[i], 2).alias(f"t{i}") for i in range(8)])


@registered
def rotate(spark, folder):
    r = encode.rotate(embeddings(spark, folder), LSH_CODE, keep=["vec_id"])
    one = r.select("vec_id", F.posexplode("rotated").alias("rotation", "y"))
    return one.select("vec_id", "rotation", F.posexplode("y").alias("axis", "v")).select(
        "vec_id", "rotation", "axis", F.round("v", 3).alias("value")
    )


@registered
def learned_rotation(spark, folder):
    """Components where the first diagonal of rotation 0 is a weight learned from the table."""
    e = embeddings(spark, folder)
    weights = (
        e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i")
        .agg((F.lit(1.0) + F.avg(F.col("x").cast("double"))).alias("weight"))
        .select(F.lit(0).alias("rotation"), F.lit(0).alias("layer"), "i", "weight")
    )
    table_ = encode.learned_weights(weights, LSH_CODE)
    coded = encode.components(e, LSH_CODE, weights=table_, keep=["vec_id"])
    return coded.select("vec_id", F.posexplode("components").alias("rotation", "component"))


@registered
def cp_components(spark, folder):
    coded = encode.components(embeddings(spark, folder), COMPONENT_CODE, keep=["vec_id"])
    both = F.arrays_zip("components", "magnitudes")
    rows = coded.select("vec_id", F.posexplode(both).alias("rotation", "c"))
    scale = 255.0 / 512.0
    quantized = C.quantize_magnitude(F.col("c.magnitudes"), scale)
    return rows.select(
        "vec_id", "rotation", F.col("c.components").alias("component"),
        C.component_axis(F.col("c.components")).alias("axis"),
        C.component_sign(F.col("c.components")).alias("sign"),
        F.round("c.magnitudes", 3).alias("magnitude"),
        quantized.alias("quantized"),
        F.round(C.dequantize_magnitude(quantized, 1.0 / scale), 3).alias("restored"),
    )


@registered
def sign_codes(spark, folder):
    coded = encode.encode(embeddings(spark, folder), SIGN_CODE, keep=["vec_id"])
    return coded.select("vec_id", F.col("primary")[0].alias("word"), C.bit_get("primary", 5).alias("bit5"))


@registered
def residual_codes(spark, folder):
    coded = encode.encode(embeddings(spark, folder), RESIDUAL_CODE, keep=["vec_id"])
    return coded.select("vec_id", F.col("primary")[0].alias("primary_word"), F.col("residual")[0].alias("residual_word"))


@registered
def query_scale(spark, folder):
    e = scaled_embeddings(spark, folder)
    coded = encode.encode_query(e, RESIDUAL_CODE, encode.average_norm(e))
    return coded.select("vec_id", F.round("query_norm", 4).alias("query_norm"), "base", F.round("scale", 5).alias("scale"))


@registered
def bit_operations(spark, folder):
    coded = encode.encode(embeddings(spark, folder), SIGN_CODE, keep=["vec_id"])
    flipped = coded.withColumns(
        {"on": C.bit_set("primary", 3, True), "off": C.bit_set("primary", 3, False), "none": C.clear_bits("primary")}
    )
    return flipped.select(
        "vec_id", F.col("on")[0].alias("on_word"), F.col("off")[0].alias("off_word"), F.col("none")[0].alias("cleared"),
        C.codes_equal("on", "off").alias("same"), C.hamming("on", "off").alias("distance"),
        C.codes_equal("primary", F.when(C.bit_get("primary", 3) == 1, F.col("on")).otherwise(F.col("off"))).alias("unchanged"),
    )


@registered
def rotation_stats(spark, folder):
    stats = metrics.rotation_stats(encode.rotate(embeddings(spark, folder), LSH_CODE, keep=["vec_id"]))
    return stats.select("rotation", F.round("max_abs", 3).alias("max_abs"), F.round("mean_value", 5).alias("mean_value"), F.round("mean_peak", 4).alias("mean_peak"))


# ---- code distances -------------------------------------------------------------------------


def coded_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled pairs with their inner product and code distances."""
    e = embeddings(spark, folder)
    sampled = knn.sample_pairs(e)
    coded = encode.encode(encode.components(e, COMPONENT_CODE), RESIDUAL_CODE)
    left = coded.select(
        F.col("vec_id").alias("i"), F.col("embedding").alias("a"),
        F.col("components").alias("ca"), F.col("primary").alias("pa"), F.col("residual").alias("ra"),
    )
    right = coded.select(
        F.col("vec_id").alias("j"), F.col("embedding").alias("b"), F.col("components").alias("cb"),
        F.col("magnitudes").alias("mb"), F.col("primary").alias("pb"), F.col("residual").alias("rb"),
    )
    joined = sampled.join(left, "i").join(right, "j")
    return joined.withColumns(
        {
            "truth": -pairs.vector_distance("neg_dot", "a", "b"),
            "asymmetric": pairs.asymmetric_distance(COMPONENT_CODE, "i", "a", "cb"),
            "component_hamming": C.component_hamming("ca", "cb"),
            "hamming": C.hamming("pa", "pb"),
            "combined": C.combined_hamming("pa", "pb", "ra", "rb", RESIDUAL_CODE.shift),
        }
    )


@registered
def code_distances(spark, folder):
    rotated = encode.rotate(embeddings(spark, folder), COMPONENT_CODE, keep=["vec_id"]).withColumnRenamed("vec_id", "i")
    return coded_pairs(spark, folder).join(rotated, "i").select(
        "pair_id", "i", "j", F.round("asymmetric", 3).alias("asym_distance"),
        F.round(C.weighted_score("rotated", "cb", "mb"), 2).alias("weighted"),
        "component_hamming", "hamming", "combined", C.estimate(F.lit(5.0), F.lit(0.5), "combined").alias("estimate"),
    )


@registered
def estimator_correlation(spark, folder):
    rows = coded_pairs(spark, folder)
    long = F.explode(
        F.array(
            F.struct(F.lit("asymmetric").alias("estimator"), (-F.col("asymmetric")).alias("score")),
            F.struct(F.lit("hamming").alias("estimator"), (-F.col("hamming")).cast("double").alias("score")),
            F.struct(F.lit("combined").alias("estimator"), (-F.col("combined")).cast("double").alias("score")),
        )
    ).alias("s")
    study = metrics.estimator_study(rows.select("truth", long).select("truth", "s.*"), ["estimator"])
    return study.select(
        "estimator", "num_pairs", F.round("pearson_r", 6).alias("pearson_r"), F.round("r_squared", 6).alias("r_squared"),
        F.round("min_truth", 5).alias("min_truth"), F.round("max_truth", 5).alias("max_truth"),
        F.round("min_score", 3).alias("min_score"), F.round("max_score", 3).alias("max_score"),
    )


def calibration_line(spark: SparkSession, folder: str) -> DataFrame:
    scored = coded_pairs(spark, folder).select("truth", (-F.col("asymmetric")).alias("score"))
    return metrics.calibrate(scored)


@registered
def calibration(spark, folder):
    return calibration_line(spark, folder).select(
        F.round("alpha", 9).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("r_squared", 6).alias("r_squared"), "num_samples"
    )


@registered
def sample_pairs(spark, folder):
    return knn.sample_pairs(embeddings(spark, folder))


@registered
def pairs_sparse_ids(spark, folder):
    """Pairs over ids with gaps, and whether both ends are vectors."""
    ids = embeddings(spark, folder).select((F.col("vec_id") * 10 + 3).alias("vec_id"))
    known = lambda c: ids.select(F.col("vec_id").alias(c))
    drawn = knn.sample_pairs(ids, per_vector=5)
    return drawn.join(known("i"), "i").join(known("j"), "j").select("pair_id", "i", "j")


# ---- k-NN joins -----------------------------------------------------------------------------


@registered
def exact_knn_cosine(spark, folder):
    return hits(truth(spark, folder))


@registered
def exact_knn_l2(spark, folder):
    e = scaled_embeddings(spark, folder)
    return hits(knn.exact_knn(as_queries(e), e, K, "l2sq", **sizes(embeddings(spark, folder))), 4)


@registered
def exact_knn_ip(spark, folder):
    e = scaled_embeddings(spark, folder)
    return hits(knn.exact_knn(as_queries(e), e, K, "neg_dot", **sizes(embeddings(spark, folder))), 4)


@registered
def closest_farthest(spark, folder):
    e = embeddings(spark, folder)
    out = knn.closest_and_farthest(as_queries(e), e, "cosine", dim=DIM)
    return out.select(
        "query_id", "nearest", F.round("nearest_dist", 6).alias("nearest_dist"), "farthest", F.round("farthest_dist", 6).alias("farthest_dist")
    )


@registered
def asymmetric_knn(spark, folder):
    return hits(code_ranks(spark, folder, K), 3)


@registered
def hamming_knn(spark, folder):
    e = embeddings(spark, folder)
    c = encode.encode(e, SIGN_CODE, keep=["vec_id"])
    return knn.hamming_knn(as_queries(c), c, SIGN_CODE, K, **sizes(e)).select(
        "query_id", "vec_id", "rank", F.col("dist").cast("int").alias("hamming")
    )


def part_search(spark: SparkSession, folder: str) -> hamming_index.Found:
    c = encode.encode(embeddings(spark, folder), SIGN_CODE, keep=["vec_id"])
    return hamming_index.search(as_queries(c), hamming_index.build_index(c, SIGN_CODE, PART_BITS), K)


@registered
def hamming_index_knn(spark, folder):
    """The same by an index over parts of the code."""
    return part_search(spark, folder).hits.select("query_id", "vec_id", "rank", F.col("dist").cast("int").alias("hamming"))


@registered
def hamming_index_work(spark, folder):
    """Queries and codes compared in every round of the index, the closing scan as radius -1."""
    rounds = part_search(spark, folder).rounds
    return spark.createDataFrame(rounds, "radius int, queries bigint, candidates bigint, finished bigint")


@registered
def combined_hamming_knn(spark, folder):
    """Residual codes: integer distance and its scaled estimate."""
    e = embeddings(spark, folder)
    coded = encode.encode_query(e, RESIDUAL_CODE, encode.average_norm(e))
    c = coded.select("vec_id", "primary", "residual")
    q = as_queries(coded).select("query_id", "base", "scale")
    found = knn.hamming_knn(as_queries(c), c, RESIDUAL_CODE, K, **sizes(e))
    return knn.with_estimate(found, q).select(
        "query_id", "vec_id", "rank", F.col("dist").cast("int").alias("combined"), F.round("estimate", 5).alias("estimate")
    )


@registered
def rerank_topk(spark, folder):
    e = embeddings(spark, folder)
    return hits(knn.rerank(code_ranks(spark, folder, 50), as_queries(e), e, K, "cosine"))


@registered
def rerank_missing_vectors(spark, folder):
    """Candidates and queries without a vector are not ranked."""
    e = embeddings(spark, folder)
    without = lambda n: e.withColumn("embedding", F.when(F.col("vec_id") % n != 0, F.col("embedding")))
    return hits(knn.rerank(code_ranks(spark, folder, 50), as_queries(without(11)), without(7), K, "cosine"))


@registered
def lsh_multiprobe_join(spark, folder):
    e = embeddings(spark, folder)
    return hits(lsh.multiprobe_knn(as_queries(e), e, LSH_CODE, K, num_probes=4))


@registered
def lsh_pair_hash_join(spark, folder):
    """Two hashes per table: smaller buckets, combined probing costs."""
    e = embeddings(spark, folder)
    return hits(lsh.multiprobe_knn(as_queries(e), e, PAIR_HASH_CODE, K, num_probes=12, hashes_per_table=2))


@registered
def lsh_code_rerank_join(spark, folder):
    """Bucket rows carry codes instead of vectors; the best by code are re-ranked exactly."""
    e = embeddings(spark, folder)
    return hits(lsh.multiprobe_knn(as_queries(e), e, LSH_CODE, K, num_probes=4, rerank_k=40))


@registered
def lsh_bucket_sizes(spark, folder):
    return lsh.bucket_sizes(embeddings(spark, folder), LSH_CODE)


@registered
def duplicate_codes(spark, folder):
    """Vectors that share a two-rotation code."""
    codes = component_codes(embeddings(spark, folder), CodeParams(DIM, bits=2))
    return knn.duplicate_codes(codes).select(
        F.col("code")[0].alias("first"), F.col("code")[1].alias("second"), "copies", "pairs"
    )


@registered
def ivf_knn(spark, folder):
    e = embeddings(spark, folder)
    model = ivf.train(e, nlist=16, iterations=5)
    return hits(ivf.ivf_knn(as_queries(e), e, model, K, nprobe=4))


@registered
def ivf_pq_knn(spark, folder):
    e = embeddings(spark, folder)
    model = ivf.train(e, nlist=8, subspaces=4, bits=4, iterations=3)
    return hits(ivf.ivf_knn(as_queries(e), e, model, K, nprobe=4))


def label_model(spark: SparkSession, folder: str) -> ivf.IvfModel:
    """Cells and product codewords that need no training: means per label, read from the table."""
    e = table(spark, folder, "embeddings")

    def means(rows: DataFrame, vec_col: str) -> np.ndarray:
        one = rows.select("label", F.posexplode(vec_col).alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        lists = one.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("l"))
        return ivf.given_centroids(lists.select(F.col("label").alias("cell"), F.col("l.m").alias("centroid")))

    cells = means(e, "embedding")
    assigned = ivf.assign(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), ivf.IvfModel(cells), 1)
    residuals = assigned.select(F.col("id").alias("vec_id"), "residual").join(e.select("vec_id", "label"), "vec_id")
    words = means(residuals, "residual")
    books = np.stack([words[:, s : s + 16] for s in range(0, DIM, 16)])
    return ivf.IvfModel(cells, books)


@registered
def ivf_label_cells(spark, folder):
    e = embeddings(spark, folder)
    model = ivf.IvfModel(label_model(spark, folder).centroids)
    return hits(ivf.ivf_knn(as_queries(e), e, model, K, nprobe=3))


@registered
def ivf_label_product_codes(spark, folder):
    e = embeddings(spark, folder)
    return hits(ivf.ivf_knn(as_queries(e), e, label_model(spark, folder), K, nprobe=3, lookup=False))


# ---- graphs ---------------------------------------------------------------------------------


@registered
def knn_graph(spark, folder):
    return neighbours(spark, folder).select("src", "rank", "dst", F.round("dist", 6).alias("dist"))


@registered
def reverse_edges(spark, folder):
    return edges_out(graph.reverse_edges(neighbours(spark, folder)))


@registered
def degree_capped_edges(spark, folder):
    return edges_out(graph.cap_degree(graph.reverse_edges(neighbours(spark, folder)), 20))


@registered
def detour_pruned_edges(spark, folder):
    kept = graph.prune_detours(neighbours(spark, folder), DETOUR_DEGREE, 1.1)
    return kept.select("src", "dst", "rank", "detours", F.round("dist", 6).alias("dist"))


@registered
def rank_pruned_graph(spark, folder):
    built = graph.build_from_knn(neighbours(spark, folder), DETOUR_DEGREE, True, 1.1)
    return built.select("src", "dst", "rank", F.round("dist", 6).alias("dist"))


def code_graph(spark: SparkSession, folder: str) -> DataFrame:
    e = embeddings(spark, folder)
    return graph.build_graph(e, COMPONENT_CODE, GRAPH, "asymmetric", component_codes(e), **sizes(e))


@registered
def graph_build_codes(spark, folder):
    return edges_out(code_graph(spark, folder), 3)


@registered
def graph_build_hamming(spark, folder):
    e = embeddings(spark, folder)
    codes = encode.encode(e, SIGN_CODE, keep=["vec_id"])
    return edges_out(graph.build_graph(e, SIGN_CODE, GRAPH, "hamming", codes, **sizes(e)))


@registered
def graph_build_hybrid(spark, folder):
    return edges_out(graph.build_graph(embeddings(spark, folder), COMPONENT_CODE, GRAPH, "cosine", dim=DIM))


@registered
def graph_build_lsh(spark, folder):
    return edges_out(graph.build_graph(embeddings(spark, folder), LSH_CODE, GRAPH, "lsh", num_probes=4))


@registered
def descent_graph(spark, folder):
    """Neighbour lists after a fixed number of rounds."""
    found = descent.descend(embeddings(spark, folder), K, pool=DESCENT_POOL, max_rounds=DESCENT_ROUNDS, stop=0.0)
    return found.neighbours.select("src", "rank", "dst", F.round("dist", 6).alias("dist"))


@registered
def descent_work(spark, folder):
    """Pairs compared and entries changed in every round."""
    found = descent.descend(embeddings(spark, folder), K, pool=DESCENT_POOL, max_rounds=DESCENT_ROUNDS, stop=0.0)
    return spark.createDataFrame([(r["round"], r["pairs"], r["updates"]) for r in found.rounds], "round int, pairs bigint, updates bigint")


@registered
def graph_build_descent(spark, folder):
    e = embeddings(spark, folder)
    return edges_out(graph.build_graph(e, COMPONENT_CODE, GRAPH, "descent", pool=DESCENT_POOL, max_rounds=DESCENT_ROUNDS, stop=0.0))


@registered
def edge_list(spark, folder):
    """A wide k-NN matrix with a missing and a self slot per row, as edges."""
    lists = neighbours(spark, folder).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("l"))
    wide = lists.select(
        "src",
        F.concat(F.col("l.dst"), F.array(F.lit(0xFFFFFFFF), "src")).alias("neighbors"),
        F.concat(F.col("l.dist"), F.array(F.lit(0.0), F.lit(0.0))).alias("distances"),
    )
    return edges_out(knn.edge_list(wide))


@registered
def edge_membership(spark, folder):
    """Which reversed edges are edges themselves."""
    edges = cut_lineage(neighbours(spark, folder))
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.contains_edges(edges, turned)


@registered
def edge_removal(spark, folder):
    """The k-NN graph without its mutual edges."""
    edges = cut_lineage(neighbours(spark, folder))
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges_out(graph.remove_edges(edges, turned))


@registered
def hub_neighbours(spark, folder):
    """Edges of the nodes that clearly more than k others point to."""
    edges = cut_lineage(neighbours(spark, folder))
    hubs = edges.groupBy("dst").count().filter(F.col("count") > KNN_K + 4).select(F.col("dst").alias("src"))
    return edges_out(knn.neighbours_of(edges, hubs))


@registered
def neighbour_codes(spark, folder):
    e = embeddings(spark, folder)
    joined = graph.with_neighbour_codes(neighbours(spark, folder), component_codes(e), ["components"])
    return joined.select("src", "dst", "rank", F.array_join("dst_components", ",").alias("code"))


@registered
def graph_stats(spark, folder):
    stats = graph.degree_stats(code_graph(spark, folder), embeddings(spark, folder))
    return stats.withColumn("avg_degree", F.round("avg_degree", 6))


@registered
def graph_reachability(spark, folder):
    e = embeddings(spark, folder)
    edges = cut_lineage(neighbours(spark, folder, 3).select("src", "dst"))
    return graph.reachable(edges, graph.entry_points(e))


@registered
def graph_connectivity(spark, folder):
    e = embeddings(spark, folder)
    edges = cut_lineage(neighbours(spark, folder, 3).select("src", "dst"))
    found = graph.connectivity(edges, e, graph.entry_points(e))
    return found.withColumn("reachable_pct", F.round("reachable_pct", 6))


def island_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest neighbour of every node: a graph of many islands."""
    return cut_lineage(neighbours(spark, folder, 1).select("src", "dst", "dist"))


@registered
def graph_components(spark, folder):
    return connect.components(island_edges(spark, folder), embeddings(spark, folder))


@registered
def connecting_edges(spark, folder):
    """The cheapest edges that join the islands."""
    return edges_out(connect.connect(island_edges(spark, folder), embeddings(spark, folder)).added)


@registered
def repaired_connectivity(spark, folder):
    e = embeddings(spark, folder)
    edges = cut_lineage(graph.reverse_edges(connect.connect(island_edges(spark, folder), e).edges))
    found = graph.connectivity(edges, e, graph.entry_points(e))
    return found.withColumn("reachable_pct", F.round("reachable_pct", 6))


@registered
def entry_points(spark, folder):
    return graph.entry_points(embeddings(spark, folder), 4, seed=42)


@registered
def knn_audit(spark, folder):
    out = graph.audit_knn(neighbours(spark, folder), embeddings(spark, folder), KNN_K)
    return out.withColumns({"min_dist": F.round("min_dist", 6), "max_dist": F.round("max_dist", 6)})


# ---- search ---------------------------------------------------------------------------------


def code_index(spark: SparkSession, folder: str) -> search.VectorIndex:
    e = embeddings(spark, folder)
    return search.build_index(e, COMPONENT_CODE, GRAPH, "asymmetric", **sizes(e))


@registered
def beam_search(spark, folder):
    return hits(search.ann_search(as_queries(embeddings(spark, folder)), code_index(spark, folder), BEAM), 3)


@registered
def ann_search(spark, folder):
    return hits(search.ann_search(as_queries(embeddings(spark, folder)), code_index(spark, folder), RERANKED))


@registered
def calibrated_search(spark, folder):
    e = embeddings(spark, folder)
    line = calibration_line(spark, folder)
    return hits(search.ann_search(as_queries(e), code_index(spark, folder), BEAM, calibration=line), 5)


@registered
def stored_index_search(spark, folder):
    """Build, write to shared storage, load, search."""
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    index_store.save_index(code_index(spark, folder), path)
    loaded = index_store.load_index(spark, path)
    return hits(search.ann_search(as_queries(embeddings(spark, folder)), loaded, RERANKED))


@registered
def ann_search_sign_codes(spark, folder):
    """Sign codes with scaled Hamming estimates, four hashed entry points, exact re-ranking."""
    e = embeddings(spark, folder)
    index = search.build_index(e, SIGN_CODE, GRAPH, "estimate", **sizes(e))
    params = SearchParams(k=K, ef=32, width=8, num_entry_points=4, rerank=True, rerank_k=32)
    return hits(search.ann_search(as_queries(e), index, params))


@registered
def ann_search_exact_graph(spark, folder):
    """The hybrid index: true distances in the graph and in the search."""
    e = embeddings(spark, folder)
    index = search.build_index(e, COMPONENT_CODE, GRAPH, "cosine", dim=DIM)
    return hits(search.ann_search(as_queries(e), index, BEAM))


# ---- metrics and audits ---------------------------------------------------------------------


@registered
def recall_at_k(spark, folder):
    found = metrics.recall_at_k(code_ranks(spark, folder, K), truth(spark, folder), K)
    return found.select(F.round("recall", 6).alias("recall"))


@registered
def topn_containment(spark, folder):
    out = metrics.topn_containment(code_ranks(spark, folder, max(DEPTHS)), truth(spark, folder), DEPTHS, K)
    return out.select("depth", F.round("containment", 6).alias("containment"))


def sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Recall after re-ranking the first ef code neighbours, one code join for all ef."""
    e = embeddings(spark, folder)
    ranked = cut_lineage(code_ranks(spark, folder, max(SWEEP_EF)))
    ef = F.explode(F.array(*[F.lit(n) for n in SWEEP_EF])).alias("ef")
    # The place goes along with its candidate, so that nothing is joined to it again and rows stay with their query.
    scored = knn.scored(ranked.withColumnRenamed("rank", "place"), as_queries(e), e, "cosine", keep=("place",))
    tagged = scored.select("*", ef).filter(F.col("place") <= F.col("ef"))
    order = Window.partitionBy("ef", "query_id").orderBy("dist", "vec_id")
    best = tagged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K)
    shares = metrics.recall_by_config(best.withColumnRenamed("ef", "config"), truth(spark, folder), K)
    return shares.select(F.col("config").alias("ef"), "recall")


@registered
def recall_sweep(spark, folder):
    return sweep(spark, folder).select("ef", F.round("recall", 6).alias("recall"))


@registered
def recall_monotone_audit(spark, folder):
    tagged = sweep(spark, folder).withColumn("system", F.lit("component_codes"))
    out = metrics.monotone_audit(tagged, ["system"])
    return out.select("system", "ef", F.round("recall", 6).alias("recall"), F.round("previous", 6).alias("previous"), "dropped")


def recall_of(tagged: DataFrame, spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name, recall`` of results with a whole number ``name`` as their configuration."""
    shares = metrics.recall_by_config(tagged.withColumnRenamed(name, "config"), truth(spark, folder), K)
    return shares.select(F.col("config").alias(name), F.round("recall", 6).alias("recall"))


@registered
def graph_recall_sweep(spark, folder):
    """Recall of graph search itself by beam size, without and with exact re-ranking."""
    e, index, runs = embeddings(spark, folder), code_index(spark, folder), None
    for ef in GRAPH_SWEEP_EF:
        # Both read the same beams.
        beams = cut_lineage(search.ann_beams(as_queries(e), index, SearchParams(k=K, ef=ef, width=8, rerank_k=ef)))
        for exact in (0, 1):
            params = SearchParams(k=K, ef=ef, width=8, rerank=bool(exact), rerank_k=ef)
            found = search.best_of_beams(beams, as_queries(e), index, params).withColumn("setting", F.lit(2 * ef + exact))
            runs = found if runs is None else runs.unionByName(found)
    shares = recall_of(runs, spark, folder, "setting")
    return shares.select(F.floor(F.col("setting") / 2).cast("int").alias("ef"), (F.col("setting") % 2).alias("reranked"), "recall")


@registered
def multiprobe_recall_sweep(spark, folder):
    """Recall of the bucket join by the number of buckets a query visits in each table."""
    e = embeddings(spark, folder)
    return recall_of(lsh.multiprobe_sweep(as_queries(e), e, LSH_CODE, K, PROBE_SWEEP), spark, folder, "num_probes")


@registered
def code_length_sweep(spark, folder):
    """Recall of the code join by the number of rotations."""
    e, runs = embeddings(spark, folder), None
    for bits in CODE_SWEEP:
        params = CodeParams(DIM, bits=bits)
        found = knn.asymmetric_knn(as_queries(e), component_codes(e, params), params, K).withColumn("bits", F.lit(bits))
        runs = found if runs is None else runs.unionByName(found)
    return recall_of(runs, spark, folder, "bits")


@registered
def latency_stats(spark, folder):
    out = metrics.latency_stats(table(spark, folder, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("qps", 4).alias("qps"), "p50", "p99")


@registered
def latency_overall(spark, folder):
    """One group without a key, and a null key beside others."""
    events = table(spark, folder, "events")
    digits = lambda df: df.select("scope", "n", F.round("mean", 6).alias("mean"), F.round("qps", 4).alias("qps"), "p50", "p99")
    whole = metrics.latency_stats(events, [], "value").withColumn("scope", F.lit("all"))
    none = metrics.latency_stats(events.filter("value < -1e18"), [], "value").withColumn("scope", F.lit("none"))
    keyed = events.withColumn("scope", F.when(F.col("event_type") > "m", F.col("event_type")))
    return digits(whole).unionByName(digits(none)).unionByName(digits(metrics.latency_stats(keyed, ["scope"], "value")))


@registered
def value_moments(spark, folder):
    e = table(spark, folder, "events")
    return e.groupBy("event_type").agg(
        F.round(metrics.mean("value"), 6).alias("mean"), F.round(metrics.stddev("value"), 6).alias("stddev"),
        F.round(metrics.mean(F.when(F.col("value") < 0, F.col("value"))), 6).alias("mean_of_none"),
        F.round(metrics.stddev(F.when(F.col("value") < 0, F.col("value"))), 6).alias("stddev_of_none"),
    )


@registered
def price_correlation(spark, folder):
    """Correlation and R squared at volume, and 0 where a side does not vary."""
    lines = table(spark, folder, "lineitem").withColumn("constant", F.lit(1.0))
    return lines.groupBy("l_returnflag").agg(
        F.round(metrics.pearson("l_quantity", "l_extendedprice"), 6).alias("pearson_r"),
        F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r_squared"),
        metrics.pearson("l_quantity", "constant").alias("flat_r"),
    )


@registered
def result_audit(spark, folder):
    return metrics.audit_results(truth(spark, folder))


@registered
def identity_audit(spark, folder):
    """Own id first in the exact and the code join, and the self score equal to the magnitudes."""
    e = embeddings(spark, folder)
    exact = metrics.identity_audit(truth(spark, folder)).withColumn("check", F.lit("exact"))
    coded = metrics.identity_audit(code_ranks(spark, folder, K)).withColumn("check", F.lit("code"))
    own = encode.rotate(encode.components(e, COMPONENT_CODE), COMPONENT_CODE)
    total = F.aggregate("magnitudes", F.lit(0.0), lambda acc, m: acc + m)
    score = -C.asymmetric_distance("rotated", "components")
    sums = own.select(F.abs(score - total).alias("gap"), total.alias("total")).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("gap") <= 0.01 * F.col("total")).alias("self_first")
    ).withColumn("check", F.lit("self_score"))
    columns = ["check", "queries", "self_first"]
    return exact.select(columns).unionByName(coded.select(columns)).unionByName(sums.select(columns))


@registered
def code_audit(spark, folder):
    """Stored codes of the scaled vectors against fresh codes: a positive factor keeps the code."""
    stored = component_codes(scaled_embeddings(spark, folder)).withColumnRenamed("components", "code")
    fresh = component_codes(embeddings(spark, folder)).withColumnRenamed("components", "code")
    return metrics.code_audit(stored, fresh, C.component_hamming("stored_code", "fresh_code"))


@registered
def neighbour_discrimination(spark, folder):
    """Does the code put the true nearest before the true farthest vector?"""
    e = embeddings(spark, folder)
    ends = knn.closest_and_farthest(as_queries(e), e, "cosine", dim=DIM)
    codes = component_codes(e)
    near = codes.select(F.col("vec_id").alias("nearest"), F.col("components").alias("cn"))
    far = codes.select(F.col("vec_id").alias("farthest"), F.col("components").alias("cf"))
    q = encode.rotate(as_queries(e), COMPONENT_CODE, keep=["query_id"])
    joined = ends.join(near, "nearest").join(far, "farthest").join(q, "query_id")
    d_near, d_far = C.asymmetric_distance("rotated", "cn"), C.asymmetric_distance("rotated", "cf")
    return joined.agg(F.count(F.lit(1)).alias("queries"), F.count_if(d_near < d_far).alias("told_apart"))


@registered
def duplicates_retrieval(spark, folder):
    """A table of which every row has a copy: is the copy found?"""
    e = embeddings(spark, folder)
    n = e.agg(F.max("vec_id") + 1).scalar()
    copy = e.select((F.col("vec_id") + n).alias("vec_id"), "embedding")
    both = e.unionByName(copy)
    groups = e.select("vec_id", F.col("vec_id").alias("group_id")).unionByName(
        copy.select("vec_id", (F.col("vec_id") - n).alias("group_id"))
    )
    count = 2 * e.count()
    found = knn.exact_knn(as_queries(both), both, 60, "cosine", num_queries=count, num_base=count, dim=DIM)
    return metrics.duplicates_found(found, groups, 60)


def footprint(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of the columns that each index holds: codes and links, or vectors and links."""
    e = embeddings(spark, folder)
    codes = encode.encode(e, SIGN_CODE, keep=["vec_id"])
    edges = neighbours(spark, folder).select("src", "dst")
    held = {"codes": codes.select("vec_id", "primary"), "edges": edges, "vectors": e}
    parts = {name: (df, metrics.stored_bytes(df)) for name, df in held.items()}
    ours = metrics.memory_footprint(parts, "codes_and_graph")
    plain = metrics.memory_footprint({name: parts[name] for name in ("vectors", "edges")}, "float_graph")
    return ours.unionByName(plain)


@registered
def memory_footprint(spark, folder):
    return footprint(spark, folder).withColumn("mb", F.round("mb", 6))


@registered
def compression_ratio(spark, folder):
    index_only = footprint(spark, folder).filter("not (system = 'codes_and_graph' and component = 'vectors')")
    return metrics.compression_ratio(index_only, "float_graph", "codes_and_graph").select(F.round("ratio", 6).alias("ratio"))


@registered
def pareto_front(spark, folder):
    """Lines no other line of the same return flag beats in both quantity and price."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("system"), F.col("l_quantity").alias("recall"), F.col("l_extendedprice").alias("qps")
    )
    return metrics.pareto_front(rows)


@registered
def speedup(spark, folder):
    """Mean value per hour of day against hour 0, as run times against a one-thread run."""
    e = table(spark, folder, "events").groupBy((F.hour("ts") + 1).alias("threads")).agg(F.avg("value").alias("build_time_s"))
    out = metrics.speedup(e)
    return out.select("threads", F.round("build_time_s", 5).alias("build_time_s"), F.round("speedup", 5).alias("speedup"), F.round("efficiency", 5).alias("efficiency"))


@registered
def merged_results(spark, folder):
    """Result files of two systems with different columns, written, read and merged to one table."""
    stats = metrics.latency_stats(table(spark, folder, "events"), ["event_type"], "value")
    full = stats.select(
        F.lit("ours").alias("system"), F.col("event_type").alias("config"), F.col("n").cast("int").alias("ef_search"),
        F.round(F.col("p50") / F.col("p99"), 6).alias("recall_10"), F.round("qps", 4).alias("qps_1t"),
        F.round("mean", 6).alias("latency_mean_us"), F.col("p50").alias("latency_p50_us"), F.col("p99").alias("latency_p99_us"),
    )
    short = table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("config")).agg(
        F.lit("external").alias("system"), F.count(F.lit(1)).cast("int").alias("ef_search"), F.lit(1.0).alias("recall_10"),
        F.round(F.lit(1e6) / F.avg("o_totalprice"), 4).alias("qps"), F.round(F.avg("o_totalprice"), 3).alias("latency_mean_us"),
    )
    out = work_folder(spark, "results")
    results.write_results(full, "recall_qps", f"{out}/ours")
    results.write_results(short, "external_recall_qps", f"{out}/external")
    return results.merge_results(
        [results.read_results(spark, "recall_qps", f"{out}/ours"), results.read_results(spark, "external_recall_qps", f"{out}/external")]
    )


# ---- vector files ---------------------------------------------------------------------------


def export_vecs(df: DataFrame, id_col: str, list_col: str, path: str, element: str) -> None:
    """Write a table as a folder of record files in id order, one file per task."""
    pafs.FileSystem.from_uri(path)[0].create_dir(pafs.FileSystem.from_uri(path)[1])

    def run(batches):
        rows = []
        for batch in batches:
            values = np.array(batch.column(list_col).to_pylist(), dtype=element)
            width = np.full((len(values), 1), values.shape[1], dtype="<i4")
            rows.append(np.concatenate((width, values.view("<i4")), axis=1))
        if rows:
            fs, inner = pafs.FileSystem.from_uri(path)
            with fs.open_output_stream(f"{inner}/part-{TaskContext.get().partitionId():05d}") as f:
                for block in rows:
                    f.write(np.ascontiguousarray(block).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    ordered = df.select(id_col, list_col).repartitionByRange(4, id_col).sortWithinPartitions(id_col)
    ordered.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def vecs_dataset(spark: SparkSession, folder: str) -> datasets.VectorDataset:
    """The embeddings and their true neighbours as a data set of fvecs and ivecs files."""
    out = work_folder(spark, "vecs")
    e = embeddings(spark, folder)
    wide = truth(spark, folder).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("l"))
    export_vecs(e, "vec_id", "embedding", f"{out}/set_base.fvecs", "<f4")
    export_vecs(as_queries(e), "query_id", "embedding", f"{out}/set_query.fvecs", "<f4")
    export_vecs(wide.select("query_id", F.col("l.vec_id").alias("n")), "query_id", "n", f"{out}/set_groundtruth.ivecs", "<i4")
    return datasets.load_vector_dataset(spark, out, "set")


@registered
def fvecs_scan(spark, folder):
    base = vecs_dataset(spark, folder).base
    digest = F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint")), ",").cast("binary"))
    return base.select("vec_id", F.size("embedding").alias("dim"), F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"), digest.alias("digest"))


@registered
def ivecs_truth(spark, folder):
    return vecs_dataset(spark, folder).truth


@registered
def limited_base_truth(spark, folder):
    """The limit option: the first half of the base, with the ground truth of that half."""
    e = embeddings(spark, folder)
    full = datasets.VectorDataset(e, as_queries(e), truth(spark, folder), DIM)
    return datasets.limit_base(full, e.count() // 2, K, "cosine").truth


# ---- streams --------------------------------------------------------------------------------


def vector_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = embeddings(spark, folder).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/embeddings.parquet*")


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@registered
def stream_encode(spark, folder):
    out = work_folder(spark, "stream-encode")
    coded = ingest.encode_stream(vector_stream(spark, folder), COMPONENT_CODE).select("vec_id", "components")
    query = (
        coded.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(coded.schema).parquet(f"{out}/data").select(
        "vec_id", F.posexplode("components").alias("rotation", "component")
    )


@registered
def stream_search(spark, folder):
    out = work_folder(spark, "stream-search")
    answer = ingest.bucket_search(embeddings(spark, folder), LSH_CODE, K, num_probes=4)
    stream = vector_stream(spark, folder).withColumnRenamed("vec_id", "query_id")
    ingest.search_stream(stream, answer, f"{out}/data", f"{out}/state").awaitTermination()
    return hits(spark.read.parquet(f"{out}/data"))


@registered
def stream_index_growth(spark, folder):
    out = work_folder(spark, "stream-index")
    index = ingest.GrowingIndex(spark, f"{out}/index", COMPONENT_CODE, GRAPH)
    index.start(vector_stream(spark, folder), f"{out}/state").awaitTermination()
    return edges_out(index.edges(), 3)
