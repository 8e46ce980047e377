"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.llm import ann, bpe, conversations, langid, licenses, mixing, phrases, pii, quality, simhash, suffix_lm, toxicity, vector_dedup
from nearloom.llm.common import fold, table
from nearloom.llm.labelled import labelled_sample


def op1_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter(F.col("vec_id") % 100 == 0)
    return ann.multiprobe_search(queries, vectors, k=10)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_copies(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    first = F.array_min(F.transform("pieces", lambda p: p["position"]))
    return mixing.plan_mix(docs).select(
        "doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("first_position")
    )


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes of all rows."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    dictionaries = langid.fit(docs, ~held_out)
    return langid.identify(docs, dictionaries).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", 5, 0, toxicity.SAMPLE)
    scored = toxicity.score(docs, toxicity.fit(sample))
    return _with_prediction(scored, 0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", 5, 0, quality.SAMPLE)
    scored = quality.score(docs, quality.fit(sample))
    return _with_prediction(scored, 0.3)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs)).select(
        "doc_id", *(pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.joined("base").cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damaged(rows)).summary.withColumnRenamed("conv", "found")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    # Conversations that lost all rows.
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = {c: F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)) for c in longs}
    none |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return every.select("conv_id", *(expression.alias(c) for c, expression in none.items()))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def _with_prediction(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


REGISTRY = {
    f.__name__: f
    for f in (
        op1_multiprobe_search, op2_embedding_near_dedup, op3_simhash_near_dedup, op4_curriculum_mix, op5_byte_bpe,
        op6_language_id, op7_toxicity, op8_quality, op9_license_scan, op10_suffix_tree_scores, op11_personal_data,
        op12_conversation_repair, op13_phrase_collocations,
    )
}
