"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from nearloom.llm.common import root_parts, word_count
from nearloom.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
# Weight of a source at the start and at the end of training, relative to its mean, by its place
# in WEIGHTS: heavy sources fade out, light ones fade in.
RAMPS = ((1.25, 0.75), (1.0, 1.0), (0.5, 1.5))


def _source_key(source: str) -> Column:
    """A text that names a source and is not null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def source_targets(
    sized: DataFrame, source: str, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``source_key, place, weight, source_size, target`` of every source of ``sized`` (source, size).

    Sources weigh ``weights`` in turn, by code point, null last. The total of all sizes is shared by
    weight; a share beyond ``max_repeats`` times the source's size stops there and the excess is
    shared among the others, until no share is above its bound. Each round of that is one
    sum over the sources, of which only two numbers reach the driver.
    """
    spark = sized.sparkSession
    totals = sized.groupBy(F.col(source).cast("string").alias("name")).agg(F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("name").asc_nulls_last())
    # The index counts per partition: the sort stays a range shuffle and no task sees all sources.
    numbered = ordered.rdd.zipWithIndex().map(lambda x: Row(name=x[0][0], source_size=x[0][1], place=x[1]))
    places = spark.createDataFrame(numbered, "name string, source_size bigint, place bigint")
    share = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        share = F.when(F.pmod("place", F.lit(len(weights))) == i, float(w)).otherwise(share)
    places = cut_lineage(
        places.select(
            F.coalesce(F.concat(F.lit("s"), "name"), F.lit("n")).alias("source_key"),
            "place", share.alias("weight"), "source_size",
        )
    )
    bound = F.col("source_size") * max_repeats
    total, free = places.agg(F.sum("source_size"), F.sum("weight")).first()
    level, held = (total / free if free else 0.0), -1
    while free:
        full = bound <= F.lit(level) * F.col("weight")
        row = places.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, bound)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if row[0] == held or not row[2]:
            break
        held, level = row[0], (total - row[1]) / row[2]
    target = F.least(bound.cast("double"), F.lit(float(level)) * F.col("weight"))
    return places.withColumn("target", target)


def _position(share: Column, first: Column, last: Column) -> Column:
    """The time in [0, 1] by which a weight that goes linearly from ``first`` to ``last``, of mean 1, has used ``share`` of its sum."""
    return F.lit(2.0) * share / (first + F.sqrt(first * first + F.lit(2.0) * (last - first) * share))


def plan_mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    ramps: Sequence[tuple[float, float]] = RAMPS,
    max_repeats: int = MAX_REPEATS,
    prefix: str = "",
) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it.

    Adds ``size`` (words), ``source_size``, ``target``, ``taken`` (words, repeats counted) and
    ``pieces``, an array of ``(copy, words, position)``. A source's documents stand in the order of
    the md5 of their key and are read again from the start up to ``max_repeats`` times; the words
    before a document are its place in the source's demand. The integral of the source's weight
    over training time, scaled to its target, is the demand met by a time; inverting it gives the
    position in [0, 1] at which the document is due. The last document of a source is taken up to
    the target, so takings differ from targets by less than a word.

    Running sums are made in two steps: sources are cut by the hash into about sqrt(rows) buckets,
    whose sums are accumulated per source, then rows are accumulated per bucket; a source that
    holds a third of all rows is spread over all buckets. Null texts have size 0; rows of size 0 are
    in no piece; null sources are a source; a row with a null key is placed by the hash of its text. Repeated rows are
    documents of their own; rows of one key are ordered by size, then by a hash of their text. Names of the added columns start with
    ``prefix``; columns named like them are replaced. An empty table gives no rows.
    """
    added = ("size", "source_size", "target", "taken", "pieces")
    docs = docs.drop(*[prefix + c for c in added])
    # The row travels whole in one column, so that none of its names can meet those used here.
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(F.col(text)).alias("_size"), _source_key(source).alias("_source"),
        F.col(source).cast("string").alias("_name"), F.xxhash64(F.col(text).cast("string")).alias("_content"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.col(text).cast("string"), F.lit("")).cast("binary")).alias("_hash"),
    )
    sized = cut_lineage(keyed.select("_name", "_source", "_hash", F.col("_size").alias("size")))
    rows = sized.count()
    buckets = root_parts(rows)
    bucket = F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int")
    sources = source_targets(sized.select("_name", "size"), "_name", weights, max_repeats)
    start, end = F.lit(float(ramps[-1][0])), F.lit(float(ramps[-1][1]))
    for i, (first, last) in enumerate(ramps[:-1]):
        mine = F.pmod("place", F.lit(len(ramps))) == i
        start, end = F.when(mine, float(first)).otherwise(start), F.when(mine, float(last)).otherwise(end)
    sources = sources.select(
        F.col("source_key").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        (start * 2 / (start + end)).alias("_first"), (end * 2 / (start + end)).alias("_last"),
    )
    sums = sized.withColumn("_bucket", bucket).groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = F.expr("coalesce(sum(_sum) over (partition by _source order by _bucket rows between unbounded preceding and 1 preceding), 0)")
    # Written once, so that the expressions below stay small.
    offsets = cut_lineage(sums.withColumn("_offset", before).drop("_sum").join(sources, "_source"))
    inside = F.expr(
        "coalesce(sum(_size) over (partition by _source, _bucket order by _hash, _size, _content rows between unbounded preceding and 1 preceding), 0)"
    )
    placed = keyed.withColumn("_bucket", bucket).withColumn("_before", inside).join(offsets, ["_source", "_bucket"])
    demand = F.round("_target").cast("long")
    at = F.col("_offset") + F.col("_before")
    copies = F.array(
        *[
            F.struct(
                F.lit(c).alias("copy"),
                F.least(demand - F.col("_source_size") * c - at, F.col("_size")).alias("words"),
                _position(
                    (F.col("_source_size") * c + at) / F.greatest(demand, F.lit(1)), F.col("_first"), F.col("_last")
                ).alias("position"),
            )
            for c in range(max_repeats)
        ]
    )
    pieces = F.filter(copies, lambda p: p["words"] > 0)
    words = [F.greatest(F.lit(0).cast("long"), F.least(demand - F.col("_source_size") * c - at, F.col("_size"))) for c in range(max_repeats)]
    made = {"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"), "taken": sum(words[1:], words[0]), "pieces": pieces}
    return placed.select("row.*", *[made[c].alias(prefix + c) for c in added])


def training_order(plan: DataFrame, columns: Sequence[str], key: str = "doc_id", share: float = 0.5, prefix: str = "") -> DataFrame:
    """The documents of a planned mix in training order, a row for each copy, with the given columns.

    A copy of which the mix takes at least ``share`` of the words goes in whole, any other stays
    out. Rows are range-sorted by position, ties by the hash of the key.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    due = plan.select(row, F.col(prefix + "size").alias("of"), F.xxhash64(key).alias("hash"), F.explode(prefix + "pieces").alias("piece"))
    due = due.filter(F.col("piece")["words"] >= F.lit(float(share)) * F.col("of"))
    return due.orderBy(F.col("piece")["position"], "hash", F.col("piece")["copy"]).select("row.*")
