"""Retrieval and estimator metrics as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.operators.skew import HOT_ROWS, hot_keys, salted_join
from nearloom.session import cut_lineage

# Relative rank error of percentile_approx is 1 / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000


def recall_per_query(results: DataFrame, truth: DataFrame, k: int, strict_k: bool = False) -> DataFrame:
    """``query_id, hits, relevant, recall`` from the first k of both sides.

    The divisor is the number of distinct true ids of the first k, or k itself with ``strict_k``.
    Queries without results count as 0.
    """
    wanted = truth.filter(F.col("rank") <= k).select("query_id", "vec_id").distinct()
    got = results.filter(F.col("rank") <= k).select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1))
    counts = wanted.join(got, ["query_id", "vec_id"], "left").groupBy("query_id").agg(
        F.count("hit").alias("hits"), F.count(F.lit(1)).alias("relevant")
    )
    return counts.withColumn("recall", F.col("hits") / (F.lit(k) if strict_k else F.col("relevant")))


def recall_at_k(results: DataFrame, truth: DataFrame, k: int, strict_k: bool = False) -> DataFrame:
    """One row ``recall``: the mean over all queries of the ground truth."""
    return recall_per_query(results, truth, k, strict_k).agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


def recall_by_config(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``config, recall`` over tagged results ``config, query_id, vec_id, rank``.

    The divisor comes from the ground truth alone, so queries a configuration missed count as 0.
    """
    # Written once: three steps read it.
    wanted = cut_lineage(truth.filter(F.col("rank") <= k).select("query_id", "vec_id").distinct())
    relevant = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    num_queries = relevant.agg(F.count(F.lit(1)).alias("n")).scalar()
    got = results.filter(F.col("rank") <= k).select("config", "query_id", "vec_id").distinct()
    marked = got.join(wanted.withColumn("hit", F.lit(1.0)), ["query_id", "vec_id"], "left").join(relevant, "query_id")
    hits = marked.groupBy("config").agg(
        F.sum(F.coalesce("hit", F.lit(0.0)) / F.col("relevant")).alias("total")
    )
    return hits.select("config", (F.col("total") / num_queries).alias("recall"))


def order_statistics(df: DataFrame, group_cols: list[str], value_col: str, positions: dict[str, tuple[float, Column]]) -> DataFrame:
    """Exact order statistics per group: ``name -> (quantile, 0-based index from column "n")``.

    A group may be far too large to sort in one task. A sketch brackets every wanted position, one
    pass counts the rows below the bracket, and only the rows inside it, some 1/1000 of the
    group, are ranked, equal values already merged into one row with a count. Null group keys are
    groups; callers join them by a key that is not null, such as a struct. A position that the
    bracket misses is an error.
    """
    if not group_cols:
        whole = df.withColumn("_all", F.lit(0))
        return order_statistics(whole, ["_all"], value_col, positions).drop("_all")
    values = df.select(*group_cols, F.col(value_col).cast("double").alias("v")).filter("v is not null")
    slack = 4.0 / SKETCH_ACCURACY
    brackets = []
    for name, (p, _) in positions.items():
        low, high = max(0.0, p - slack), min(1.0, p + slack)
        sketch = F.percentile_approx("v", F.array(F.lit(low), F.lit(high)), F.lit(SKETCH_ACCURACY))
        brackets.append(sketch.alias(f"b_{name}"))
    sketched = values.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), *brackets)
    ranges = sketched.select(
        *group_cols,
        "n",
        *[
            F.struct(
                F.when(index <= 0, F.lit(float("-inf"))).otherwise(F.col(f"b_{name}")[0]).alias("low"),
                F.when(index >= F.col("n") - 1, F.lit(float("inf"))).otherwise(F.col(f"b_{name}")[1]).alias("high"),
                index.cast("bigint").alias("index"),
            ).alias(name)
            for name, (_, index) in positions.items()
        ],
    )
    hot = (
        sketched.filter(F.col("n") > HOT_ROWS)
        .select(*group_cols, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("pieces"))
    )
    bounded = salted_join(values, ranges, group_cols, "v", hot)
    below = bounded.groupBy(*group_cols).agg(
        *[F.count_if(F.col("v") < F.col(f"{name}.low")).alias(f"below_{name}") for name in positions]
    )
    slot = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("r")) for name in positions]))
    inside = (
        bounded.withColumn("slot", slot)
        .filter((F.col("v") >= F.col("slot.r.low")) & (F.col("v") <= F.col("slot.r.high")))
        .groupBy(*group_cols, "slot.name", "v")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("slot.r.index").alias("index"))
    )
    running = Window.partitionBy(*group_cols, "name").orderBy("v")
    end = F.sum("copies").over(running)
    ranked = inside.withColumn("end", end).join(below, group_cols)
    offset = F.coalesce(*[F.when(F.col("name") == name, F.col(f"below_{name}")) for name in positions])
    hit = ranked.withColumn("from", offset + F.col("end") - F.col("copies")).filter(
        (F.col("index") >= F.col("from")) & (F.col("index") < F.col("from") + F.col("copies"))
    )
    found = hit.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in positions]
    )
    missed = F.raise_error(F.lit("the sketch missed a position"))
    return ranges.select(*group_cols).join(found, group_cols, "left").select(
        *group_cols, *[F.coalesce(name, missed.cast("double")).alias(name) for name in positions]
    )


def latency_stats(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """``n, mean, qps, p50, p99`` per group, values in microseconds.

    p50 is the value at index n/2 of the sorted values, p99 at min(floor(0.99 n), n - 1). Null
    values are left out. A null group key is a group; without group columns a table without values
    has zeros.
    """
    # A struct is never null itself, so that null keys meet in the joins below.
    keyed = df.select(F.struct(F.lit(0).alias("_"), *group_cols).alias("_g"), F.col(value_col).cast("double").alias("_v")).filter("_v is not null")
    n = F.col("n")
    positions = {
        "p50": (0.5, F.floor(n / 2)),
        "p99": (0.99, F.least(F.floor(F.lit(0.99) * n), n - 1)),
    }
    means = keyed.groupBy("_g").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    if not group_cols:
        one = df.sparkSession.range(1).select(F.struct(F.lit(0).alias("_")).alias("_g"))
        means = one.join(means, "_g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = order_statistics(keyed, ["_g"], "_v", positions)
    joined = means.join(order, "_g", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        *[F.col("_g")[c].alias(c) for c in group_cols],
        "n",
        zero(F.col("mean")).alias("mean"),
        zero(F.try_divide(F.lit(1e6), F.col("mean"))).alias("qps"),
        zero(F.col("p50")).alias("p50"),
        zero(F.col("p99")).alias("p99"),
    )


def mean(col) -> Column:
    """Average, 0 for no values."""
    return F.coalesce(F.avg(col), F.lit(0.0))


def stddev(col) -> Column:
    """Sample standard deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(col), F.lit(0.0))


def pearson(x, y) -> Column:
    """Pearson correlation, 0 for no values or where one side does not vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.try_divide(F.covar_pop(x, y), spread)
    return F.when(F.coalesce(spread * F.count(x) * F.count(x), F.lit(0.0)) <= 1e-10, F.lit(0.0)).otherwise(r)


def estimator_study(pairs: DataFrame, group_cols: list[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Per group: pairs, Pearson r, R squared and the ranges of both sides."""
    return pairs.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("num_pairs"),
        pearson(score, truth).alias("pearson_r"),
        F.regr_r2(F.col(truth), F.col(score)).alias("r_squared"),
        F.min(truth).alias("min_truth"),
        F.max(truth).alias("max_truth"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )


def calibrate(pairs: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """One row ``alpha, beta, r_squared, num_samples`` of the line truth = alpha * score + beta."""
    return pairs.agg(
        F.regr_slope(F.col(truth), F.col(score)).alias("alpha"),
        F.regr_intercept(F.col(truth), F.col(score)).alias("beta"),
        F.regr_r2(F.col(truth), F.col(score)).alias("r_squared"),
        F.regr_count(F.col(truth), F.col(score)).alias("num_samples"),
    )


def topn_containment(code_ranked: DataFrame, truth: DataFrame, depths: list[int], k: int = 10) -> DataFrame:
    """``depth, containment``: share of the true top k inside the code's top ``depth``.

    One join at the greatest depth; all depths come from one aggregation.
    """
    wanted = truth.filter(F.col("rank") <= k).select("query_id", "vec_id")
    placed = code_ranked.filter(F.col("rank") <= max(depths)).select("query_id", "vec_id", F.col("rank").alias("place"))
    joined = wanted.join(placed, ["query_id", "vec_id"], "left")
    shares = joined.agg(
        *[F.avg(F.when(F.col("place") <= d, 1.0).otherwise(0.0)).alias(f"d{d}") for d in depths]
    )
    pairs = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"d{d}").alias("containment")) for d in depths])
    return shares.select(F.explode(pairs).alias("r")).select("r.depth", "r.containment")


def monotone_audit(sweep: DataFrame, group_cols: list[str], by: str = "ef", value: str = "recall", tolerance: float = 0.01) -> DataFrame:
    """Sweep rows with ``previous`` and whether recall fell by more than the tolerance.

    A sweep has one row per parameter setting.
    """
    window = Window.partitionBy(*group_cols).orderBy(by)
    return sweep.withColumn("previous", F.lag(value).over(window)).withColumn(
        "dropped", F.coalesce(F.col(value) < F.col("previous") - F.lit(tolerance), F.lit(False))
    )


def audit_results(results: DataFrame) -> DataFrame:
    """One row of counts over search results: out-of-order, NaN and duplicate rows."""
    window = Window.partitionBy("query_id").orderBy("rank")
    marked = results.withColumn("unordered", F.coalesce(F.col("dist") < F.lag("dist").over(window), F.lit(False)))
    rows = marked.groupBy("query_id", "vec_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.col("unordered")).alias("unordered"),
        F.count_if(F.isnan("dist")).alias("nans"),
    )
    return rows.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("num_rows"),
        F.coalesce(F.sum("unordered"), F.lit(0)).alias("unordered"),
        F.coalesce(F.sum("nans"), F.lit(0)).alias("nans"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    )


def identity_audit(results: DataFrame) -> DataFrame:
    """One row ``queries, self_first``: queries that are stored vectors and whose own id comes first."""
    return results.filter(F.col("rank") == 1).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("query_id") == F.col("vec_id")).alias("self_first")
    )


def code_audit(stored: DataFrame, fresh: DataFrame, difference: Column) -> DataFrame:
    """Counts of exact, close (at most 2 differing rotations) and other stored codes.

    ``difference`` reads ``stored_code`` and ``fresh_code``.
    """
    pairs = stored.select("vec_id", F.col("code").alias("stored_code")).join(
        fresh.select("vec_id", F.col("code").alias("fresh_code")), "vec_id"
    )
    return pairs.select(difference.alias("d")).agg(
        F.count(F.lit(1)).alias("num_codes"),
        F.count_if(F.col("d") == 0).alias("exact"),
        F.count_if((F.col("d") > 0) & (F.col("d") <= 2)).alias("close"),
        F.count_if(F.col("d") > 2).alias("mismatch"),
    )


def duplicates_found(results: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``query_id, copies, found``: copies of the query inside its top k.

    ``groups`` maps ``vec_id`` to a duplicate ``group_id``; queries are vectors of the table too.
    A group of very many copies is never paired with itself: only result rows look up their group.
    """
    of_hit = groups.select("vec_id", F.col("group_id").alias("hit_group"))
    of_query = groups.select(F.col("vec_id").alias("query_id"), "group_id")
    sizes = groups.groupBy("group_id").agg((F.count(F.lit(1)) - 1).alias("copies"))
    hot = hot_keys(groups, ["group_id"])
    kept = results.filter((F.col("rank") <= k) & (F.col("query_id") != F.col("vec_id"))).select("query_id", "vec_id")
    hits = kept.join(of_hit, "vec_id")
    counted = (
        hits.join(of_query, "query_id").filter(F.col("hit_group") == F.col("group_id"))
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    )
    return (
        salted_join(of_query, sizes.filter("copies > 0"), ["group_id"], "query_id", hot).join(counted, "query_id", "left")
        .select("query_id", "copies", F.coalesce("found", F.lit(0)).alias("found"))
    )


def stored_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values as its columns hold them: fixed widths by type, the elements of arrays, the bytes of texts."""
    widths = {"bigint": 8, "double": 8, "int": 4, "float": 4, "smallint": 2, "tinyint": 1, "boolean": 1, "date": 4, "timestamp": 8}
    total = F.lit(0).cast("bigint")
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            size = F.octet_length(f.name)
        elif kind.startswith("array<") and kind[6:-1] in widths:
            size = F.size(f.name) * widths[kind[6:-1]]
        elif kind in widths:
            size = F.when(F.col(f.name).isNotNull(), widths[kind])
        else:
            raise ValueError(f"no width for {kind}")
        total = total + F.coalesce(F.greatest(size, F.lit(0)), F.lit(0))
    return total


def memory_footprint(parts: dict[str, tuple[DataFrame, Column]], system: str) -> DataFrame:
    """``system, component, bytes, mb``: the summed row sizes of every component table."""
    rows = None
    for name, (table, size) in parts.items():
        one = table.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes")).select(
            F.lit(system).alias("system"), F.lit(name).alias("component"), "bytes"
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("mb", F.col("bytes") / F.lit(1048576.0))


def compression_ratio(footprint: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """One row ``ratio``: bytes of one system over bytes of another."""
    return footprint.agg(
        (
            F.sum(F.when(F.col("system") == numerator, F.col("bytes")))
            / F.sum(F.when(F.col("system") == denominator, F.col("bytes")))
        ).alias("ratio")
    )


def speedup(runs: DataFrame, by: str = "threads", value: str = "build_time_s") -> DataFrame:
    """Runs with ``speedup`` and ``efficiency`` against the row with the least ``by``."""
    base = runs.agg(F.min_by(value, by).alias("t")).scalar()
    least = runs.agg(F.min(by).alias("n")).scalar()
    gain = base / F.col(value)
    return runs.withColumn("speedup", gain).withColumn("efficiency", gain * least / F.col(by))


def pareto_front(rows: DataFrame, system: str = "system", recall: str = "recall", qps: str = "qps") -> DataFrame:
    """Rows no other row of the system beats in both recall and speed.

    Rows are range-sorted by system and falling speed. The best recall before a row is the best of the
    partitions before it, from one row per system and partition, and of the rows before it
    within its partition: no task sees more of a system than a partition.
    """
    best = rows.groupBy(system, F.col(qps)).agg(F.max(recall).alias(recall))
    ordered = best.sort(system, F.col(qps).desc()).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(ordered).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(system, "_part").agg(F.max(recall).alias("_best"))
    earlier = Window.partitionBy(system).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(system).alias("_system"), F.col("_part").alias("_p"), F.max("_best").over(earlier).alias("_before"))
    inside = Window.partitionBy("_part", system).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("_inside", F.max(recall).over(inside)).join(
        parts, F.col(system).eqNullSafe(F.col("_system")) & (F.col("_part") == F.col("_p"))
    )
    top = F.greatest("_inside", "_before")
    return seen.filter(top.isNull() | (F.col(recall) > top)).select(*best.columns)


def rotation_stats(rotated: DataFrame, col: str = "rotated") -> DataFrame:
    """Per rotation: ``max_abs, mean_value, mean_peak`` over all rotated vectors."""
    per_row = rotated.select(F.posexplode(col).alias("rotation", "y")).select(
        "rotation",
        F.array_max(F.transform("y", lambda x: F.abs(x))).alias("peak"),
        F.aggregate("y", F.lit(0.0), lambda acc, x: acc + x).alias("total"),
        F.size("y").alias("n"),
    )
    return per_row.groupBy("rotation").agg(
        F.max("peak").alias("max_abs"),
        (F.sum("total") / F.sum("n")).alias("mean_value"),
        F.avg("peak").alias("mean_peak"),
    )
