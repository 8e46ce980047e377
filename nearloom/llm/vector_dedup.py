"""Near copies among embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import parts_for
from nearloom.llm.components import connected_components
from nearloom.llm.vectors import common_size, finite, matrix
from nearloom.session import cut_lineage, cut_to_table

BITS = 60
# Rows of a sorted run in one task.
RUN_ROWS = 32_768
# Rows of a block of an order, and the fewest rows of an order that are worth a part of their own.
BLOCK_ROWS, PART_ROWS = 256, 2048
# Windows to choose from, and what moving a row costs in comparisons.
WINDOWS, ROW_COST = (256, 512, 1024, 2048), 1024
# Orders that the choice is measured in, bits of a key that are counted at once, and steps of a factor e in a histogram of chances.
TRIALS, LEVELS, FINE = 4, 16, 64


def _agree(offset: np.ndarray, threshold: float) -> np.ndarray:
    """Chance that a row of this offset from the mean shares a hash bit with a partner at the threshold."""
    apart = np.sqrt(max(0.0, 2 - 2 * threshold))
    angle = 2 * np.arcsin(np.minimum(1, apart / np.maximum(2 * np.linalg.norm(offset, axis=1), 1e-12)))
    return 1 - np.minimum(angle / np.pi, 0.95)


def _trial_keys(offset: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """The orders that the choice is measured in."""
    for p in range(TRIALS):
        planes = np.random.default_rng([seed, 7, p]).normal(size=(offset.shape[1], BITS))
        yield ((offset @ planes) > 0) @ np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1))


def _passes(met: np.ndarray, weight: np.ndarray, miss: float) -> int:
    """Passes after which rows that meet a partner with chance ``met`` in one miss it with a mean probability of at most ``miss``."""
    met = np.clip(met, 1e-9, 1 - 1e-12)
    low, high = 1, 1
    missed = lambda n: float(np.average(np.exp(n * np.log1p(-met)), weights=weight))
    while missed(high) > miss:
        low, high = high, high * 2
    while low < high:
        half = (low + high) // 2
        low, high = (low, half) if missed(half) <= miss else (half + 1, high)
    return high


def _cheapest(chances: dict[int, tuple[np.ndarray, np.ndarray]], miss: float) -> tuple[int, int]:
    """The window whose passes compare the fewest rows, and their number."""
    plans = [(window, _passes(met, weight, miss)) for window, (met, weight) in sorted(chances.items())]
    return min(plans, key=lambda plan: plan[1] * (plan[0] + ROW_COST))


def plan_passes(
    sample: np.ndarray, mean: np.ndarray, rows: int, threshold: float, miss: float, seed: int = 42, windows: tuple[int, ...] = WINDOWS
) -> tuple[int, int]:
    """Window and number of passes after which pairs at the threshold are missed with a mean probability of at most ``miss``.

    Two offsets from the mean at an angle share a hash bit with probability 1 - angle / pi. The angle of a pair at the threshold
    follows from the length of its offsets, which is short where vectors share a direction; the bits that a row must share
    to stand within a window of its partner are counted in the order of the ``sample`` for a few passes, so that dense regions count as
    what they are. Of the windows the one whose passes compare the fewest rows is taken. Operators count all rows instead (:func:`measured_plan`).
    """
    offset = sample / np.linalg.norm(sample, axis=1, keepdims=True) - mean
    agree = _agree(offset, threshold)
    # A sample row stands for so many rows.
    scale = rows / len(sample)
    # Rows of the sample that share the first bits with each row, for every number of bits.
    shared = [
        np.stack([(lambda u: u[1][u[0]])(np.unique(keys >> (BITS - n), return_inverse=True, return_counts=True)[1:]) for n in range(BITS + 1)])
        for keys in _trial_keys(offset, seed)
    ]
    chances = {}
    for window in windows:
        bits = []
        for near in shared:
            few = near * scale <= window
            # Beyond the sample's resolution each bit halves what is left.
            deep = np.argmax(near == 1, axis=0) + max(0.0, math.log2(max(scale / window, 1e-9)))
            bits.append(np.where(few.any(0), np.argmax(few, axis=0), deep))
        met = np.mean([agree**b for b in bits], axis=0)
        chances[window] = met, np.ones(len(met))
    return _cheapest(chances, miss)


def measured_plan(
    classes: DataFrame, mean: np.ndarray, rows: int, threshold: float, miss: float, seed: int = 42, windows: tuple[int, ...] = WINDOWS
) -> tuple[int, int]:
    """The choice of :func:`plan_passes` from all rows of ``classes`` (id, vector).

    The rows that share leading bits are counted by groups, ``LEVELS`` bits at a time, and only rows of groups with more than
    the smallest window go on to the next bits. Rows of one key count as at most that window, since they link and windows go on through them. What reaches the driver is a histogram of the chances to meet a partner.
    """
    dim = len(mean)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), dim)
                offset = x / np.linalg.norm(x, axis=1, keepdims=True) - mean
                agree = pa.array(_agree(offset, threshold))
                for p, keys in enumerate(_trial_keys(offset, seed)):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), p, np.int32)), pa.array(keys), agree], names=["id", "trial", "key", "agree"])

    keys = cut_lineage(classes.select("id", "vector").mapInArrow(keyed, "id bigint, trial int, key bigint, agree double"))
    crowded = lambda w: F.count_if(F.col("size") > w)
    least = min(windows)
    going = keys.groupBy("trial", "key").agg(F.least(F.count(F.lit(1)), F.lit(least)).alias("n"))
    going = cut_lineage(going)
    # No bits: all rows share them.
    total = going.groupBy("trial").agg(F.sum("n").alias("size"))
    found = total.join(going, "trial").select("trial", "key", *[(F.col("size") > w).cast("long").alias(f"bits_{w}") for w in windows])
    depths = found
    for low in range(1, BITS + 1, LEVELS):
        last = min(low + LEVELS - 1, BITS)
        levels = F.explode(F.sequence(F.lit(low), F.lit(last))).alias("level")
        prefixes = going.select("trial", "key", "n", levels).withColumn("prefix", F.expr(f"shiftright(key, {BITS} - level)"))
        sizes = cut_lineage(prefixes.groupBy("trial", "level", "prefix").agg(F.sum("n").alias("size")).filter(F.col("size") > least))
        if sizes.isEmpty():
            break
        found = prefixes.join(sizes, ["trial", "level", "prefix"]).groupBy("trial", "key").agg(
            *[crowded(w).alias(f"bits_{w}") for w in windows], F.max("level").alias("last"), F.first("n").alias("n")
        )
        found = cut_lineage(found)
        depths = depths.unionByName(found.select("trial", "key", *[f"bits_{w}" for w in windows]))
        going = found.filter(F.col("last") == last).select("trial", "key", "n")
    depths = depths.groupBy("trial", "key").agg(*[F.sum(f"bits_{w}").alias(f"bits_{w}") for w in windows])
    chance = keys.join(depths, ["trial", "key"]).groupBy("id").agg(
        *[F.avg(F.pow("agree", F.col(f"bits_{w}"))).alias(str(w)) for w in windows]
    )
    each = chance.select(F.explode(F.create_map(*[c for w in windows for c in (F.lit(w), F.col(str(w)))])).alias("window", "met"))
    # Rounded down, so that no pass too few is made.
    step = F.floor(F.log(F.greatest("met", F.lit(1e-9))) * FINE).cast("int").alias("step")
    counted = each.select("window", step).groupBy("window", "step").agg(F.count(F.lit(1)).alias("n")).orderBy("window", "step").collect()
    chances = {}
    for w in windows:
        bins = [(r["step"], r["n"]) for r in counted if r["window"] == w] or [(0, 1)]
        chances[w] = np.exp(np.array([b for b, _ in bins]) / FINE), np.array([n for _, n in bins])
    return _cheapest(chances, miss)


def _mean(units: DataFrame, dim: int) -> np.ndarray:
    """The mean of all unit vectors; a task sends one sum."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), dim)
                total += (x / np.linalg.norm(x, axis=1, keepdims=True)).sum(0)
                n += len(x)
        yield pa.RecordBatch.from_pydict({"at": np.arange(dim, dtype=np.int32), "part": total, "n": np.full(dim, n, np.int64)})

    sums = units.select("vector").mapInArrow(partial, "at int, part double, n bigint").groupBy("at").agg(
        F.sum("part").alias("part"), F.sum("n").alias("n")
    )
    rows = sums.collect()
    out = np.zeros(dim)
    for r in rows:
        out[r["at"]] = r["part"] / max(r["n"], 1)
    return out


def _linked_in_run(
    x: np.ndarray, first: int, end: int, own: np.ndarray, place: np.ndarray, step: np.ndarray, threshold: float, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of ``own``, row of ``x``) with cosine of at least the threshold, and rows of ``own`` to go on in a later run.

    ``x`` holds the places of an order from ``first`` to ``end`` and the window after it. A row at ``place`` is compared with
    windows of the rows after it, from number ``step`` on, while the last one held a link: a dense
    group is compared whole, however large it is. Windows that begin at ``end`` or later belong to later
    runs; those rows come back with the number of their next window.
    """
    unit, mine = x / np.linalg.norm(x, axis=1)[:, None], own / np.linalg.norm(own, axis=1)[:, None]
    norms, own_norms = np.linalg.norm(x, axis=1), np.linalg.norm(own, axis=1)
    left, right, moved, moved_step = ([np.empty(0, int)] for _ in range(4))
    rows, step = np.arange(len(own)), step.copy()
    while len(rows):
        later = place[rows] + step[rows] * window + 1 >= end
        moved.append(rows[later])
        moved_step.append(step[rows[later]])
        rows = rows[~later]
        rows = rows[np.lexsort((step[rows], place[rows] // window))]
        block = np.stack([place[rows] // window, step[rows]])
        cuts = np.flatnonzero((block[:, 1:] != block[:, :-1]).any(0)) + 1
        going = [np.empty(0, int)]
        for group in np.split(rows, cuts) if len(rows) else []:
            k = step[group[0]]
            start = place[group].min() + k * window + 1 - first
            stop = min(place[group].max() + (k + 1) * window + 1 - first, len(x))
            gap = first + np.arange(start, stop)[None] - place[group][:, None]
            hit = (mine[group] @ unit[start:stop].T >= threshold - 1e-9) & (gap > k * window) & (gap <= (k + 1) * window)
            r, c = np.nonzero(hit)
            a, b = group[r], start + c
            sure = np.einsum("ij,ij->i", own[a], x[b]) / (own_norms[a] * norms[b]) >= threshold
            left.append(a[sure])
            right.append(b[sure])
            going.append(np.unique(a[sure]))
        rows = np.concatenate(going)
        step[rows] += 1
    return tuple(np.concatenate(p) for p in (left, right, moved, moved_step))


def _blocks(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of every ``BLOCK_ROWS`` rows."""
    starts = np.arange(0, len(unit), BLOCK_ROWS)
    centre = np.add.reduceat(unit, starts) / np.diff(np.append(starts, len(unit)))[:, None]
    away = np.linalg.norm(unit - np.repeat(centre, BLOCK_ROWS, axis=0)[: len(unit)], axis=1)
    return centre, np.maximum.reduceat(away, starts)


def _all_links(x: np.ndarray, place: np.ndarray, y: np.ndarray, place_y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (row of ``x``, later row of ``y`` in the order) with cosine of at least the threshold, block by block.

    Blocks too far apart for a link, by the triangle inequality, are left out. A product in single precision screens the others, with
    room for its rounding, and doubles decide as in the windows.
    """
    norms, norms_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    unit, unit_y = x / norms[:, None], y / norms_y[:, None]
    (centre, radius), (centre_y, radius_y) = _blocks(unit), _blocks(unit_y)
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    rough, rough_y = unit.astype(np.float32), unit_y.astype(np.float32)
    least = np.float32(threshold - 1e-9 - 4 * (x.shape[1] + 4) * np.finfo(np.float32).eps)
    column_block = np.arange(len(y)) // BLOCK_ROWS
    # Of an order that begins later only these blocks hold later rows.
    last_y = np.maximum.reduceat(place_y, np.arange(0, len(y), BLOCK_ROWS))
    for b, start in enumerate(range(0, len(x), BLOCK_ROWS)):
        own = slice(start, start + BLOCK_ROWS)
        # Not "farther than": distances that are no numbers rule out nothing.
        near = ~(np.linalg.norm(centre_y - centre[b], axis=1) > radius[b] + radius_y + reach) & (last_y > place[own].min())
        columns = np.flatnonzero(near[column_block])
        if not len(columns):
            continue
        r, c = np.nonzero(rough[own] @ (rough_y if len(columns) == len(y) else rough_y[columns]).T >= least)
        a, c = r + start, columns[c]
        later = place_y[c] > place[a]
        a, c = a[later], c[later]
        for at in range(0, len(a), RUN_ROWS):
            i, j = a[at : at + RUN_ROWS], c[at : at + RUN_ROWS]
            sure = np.einsum("ij,ij->i", x[i], y[j]) / (norms[i] * norms_y[j]) >= threshold
            yield i[sure], j[sure]


def exact_links(placed: DataFrame, rows: int, dim: int, threshold: float) -> DataFrame:
    """All linked pairs ``a, b, n_a, n_b`` of one order (place, id, n, vector), whatever lies between them.

    The order is cut into parts, and each pair of parts is a cell: a task holds the earlier part and the later one streams past it. A row
    goes to one cell for every part. Cells of one step of the order are a job, as many steps at once as there are cores to fill.
    """
    spark = placed.sparkSession
    cores = spark.sparkContext.defaultParallelism
    each = min(RUN_ROWS, max(PART_ROWS, math.ceil(rows / math.ceil(math.sqrt(2 * cores)))))
    parts = max(1, math.ceil(rows / each))
    # Steps at once, so that a job has a few cells for each core and copies few rows.
    at_once = math.ceil(4 * cores / parts)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, own = None, [], None
        for batch in batches:
            # Rows arrive by cell, the earlier part first.
            cells, sides = (batch.column(c).to_numpy() for c in ("cell", "side"))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                if high == low:
                    continue
                some = batch.slice(low, high - low)
                if cells[low] != cell:
                    cell, held, own = cells[low], [], None
                if sides[low] == 0:
                    held.append(some)
                    continue
                if own is None:
                    t, held = pa.Table.from_batches(held), []
                    own = matrix(t.column("vector"), dim), *(t.column(c).to_numpy() for c in ("place", "id", "n"))
                x, place, ids, n = own
                place_y, others, n_others = (some.column(c).to_numpy() for c in ("place", "id", "n"))
                for i, j in _all_links(x, place, matrix(some.column("vector"), dim), place_y, threshold):
                    swap = ids[i] > others[j]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.where(swap, others[j], ids[i])), pa.array(np.where(swap, ids[i], others[j])),
                            pa.array(np.where(swap, n_others[j], n[i])), pa.array(np.where(swap, n[i], n_others[j])),
                        ],
                        names=["a", "b", "n_a", "n_b"],
                    )

    part, columns, links = F.floor(F.col("place") / F.lit(each)).cast("int"), ["place", "id", "n", "vector"], None
    for low in range(0, parts, at_once):
        steps = F.sequence(F.lit(low), F.lit(min(low + at_once, parts) - 1))
        # The earlier part of a cell, and the later one that many steps behind it.
        early = placed.select(part.alias("first"), F.explode(steps).alias("step"), F.lit(0).alias("side"), *columns).filter(F.col("first") + F.col("step") < parts)
        late = placed.select(part.alias("part"), F.explode(steps).alias("step"), F.lit(1).alias("side"), *columns)
        late = late.filter(F.col("part") >= F.col("step")).select((F.col("part") - F.col("step")).alias("first"), "step", "side", *columns)
        cells = early.unionByName(late).withColumn("cell", (F.col("step") - F.lit(low)) * F.lit(parts) + F.col("first"))
        count = min(at_once, parts - low) * parts
        # Parts of an order follow each other in a cell, so that its blocks stay close.
        sent = cells.select("cell", "side", *columns).repartitionById(count, F.col("cell")).sortWithinPartitions("cell", "side", "place")
        found = cut_to_table(sent.mapInArrow(met, "a bigint, b bigint, n_a bigint, n_b bigint"))
        links = found if links is None else links.unionByName(found)
    return links


def projection_links(
    classes: DataFrame, rows: int, dim: int, threshold: float, window: int | None = None, miss: float = 1e-3, seed: int = 42, kind: str = "double"
) -> DataFrame:
    """Linked pairs ``a < b`` of ``classes`` (id, n, vector), with the sizes ``n_a`` and ``n_b`` of both.

    In each pass vectors are sorted by the signs of ``BITS`` random projections of their offset
    from the mean, the first projection weighing most, and compared along the order. The order is cut into runs
    of ``RUN_ROWS``, each with the window of rows that follows it; rows whose windows go on holding
    links go on in the next run, a round for each. Thus cuts part no pair, whatever the cluster. Window and passes are
    chosen from all rows; where so many passes would be dearer than to compare every pair, as in a narrow cone, one pass is made.
    Rows that lie apart in the order of every pass meet in the exact comparison that follows (:func:`exact_links`), so no link is lost.
    A pair is verified in doubles; pairs of all passes and of the comparison are united.
    """
    mean = _mean(classes, dim)
    spark = classes.sparkSession
    window, passes = measured_plan(classes, mean, rows, threshold, miss, seed, (window,) if window else WINDOWS)
    if passes * (window + ROW_COST) >= rows:
        window, passes = max(window, WINDOWS[0]), 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1))
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2), dim)
            offset = x / np.linalg.norm(x, axis=1, keepdims=True) - mean
            drawn = np.random.default_rng(seed)
            for p in range(passes):
                order = ((offset @ drawn.normal(size=(dim, BITS))) > 0) @ weights
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, np.int32)), pa.array(order), *b.columns], names=["pass", "order", "id", "n", "vector"]
                )

    each = max(RUN_ROWS, window)
    runs_a_pass = math.ceil(rows / each)
    found = "a bigint, b bigint, n_a bigint, n_b bigint, place bigint, step bigint"

    def linked(run: pa.Table, visitors: pa.Table) -> pa.Table:
        none = pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n_a", "n_b", "place", "step")})
        if not run.num_rows or not visitors.num_rows:
            return none
        run, visitors = run.sort_by("place"), visitors.sort_by("place")
        numbers = lambda t, c: t.column(c).to_numpy()
        first = int(numbers(run, "run")[0]) % runs_a_pass * each
        own, x = matrix(visitors.column("vector"), dim), matrix(run.column("vector"), dim)
        i, j, moved, step = _linked_in_run(
            x, first, first + each, own, numbers(visitors, "place"), numbers(visitors, "step"), threshold, window
        )
        ids, others = numbers(visitors, "id")[i], numbers(run, "id")[j]
        n, n_others = numbers(visitors, "n")[i], numbers(run, "n")[j]
        swap = ids > others
        pairs = {
            "a": np.where(swap, others, ids), "b": np.where(swap, ids, others),
            "n_a": np.where(swap, n_others, n), "n_b": np.where(swap, n, n_others),
            "place": np.full(len(i), -1), "step": np.full(len(i), -1),
        }
        # A row that goes on: its id, pass and place.
        at = numbers(visitors, "pass")[moved].astype(np.int64)
        goes = {
            "a": numbers(visitors, "id")[moved], "b": at, "n_a": at, "n_b": at,
            "place": numbers(visitors, "place")[moved], "step": step,
        }
        return pa.table({c: np.concatenate([pairs[c], goes[c]]).astype(np.int64) for c in pairs})

    ordered = cut_lineage(
        classes.select("id", "n", F.col("vector").cast(f"array<{kind}>").alias("vector"))
        .mapInArrow(keyed, f"pass int, order bigint, id bigint, n bigint, vector array<{kind}>")
        .repartitionByRange(parts_for(rows * passes, RUN_ROWS), "pass", "order", "id")
        .sortWithinPartitions("pass", "order", "id")
        .drop("order")
    )
    # Places in the order of each pass, which holds all rows, from the sizes of the partitions.
    numbered = ordered.withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    sizes = sorted(map(tuple, numbered.groupBy(part.alias("part")).count().collect()))
    starts = np.cumsum([0, *[n for _, n in sizes]])
    offsets = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts)], "part bigint, start bigint")
    placed = numbered.withColumn("part", part).join(offsets, "part").select(
        "pass", "id", "n", "vector",
        F.pmod(F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(max(rows, 1))).alias("place"),
    )
    placed = cut_lineage(placed)
    run_of = lambda place: F.floor(place / F.lit(each)).cast("long")
    # A run number that tells passes apart.
    number = lambda run: F.col("pass") * F.lit(runs_a_pass) + run
    own, after = run_of(F.col("place")), F.col("place") % F.lit(each) < F.lit(window)
    table = placed.select(number(own).alias("run"), "place", "id", "n", "vector").unionByName(
        placed.filter((own > 0) & after).select((number(own) - 1).alias("run"), "place", "id", "n", "vector")
    )
    going, pairs = placed.withColumn("step", F.lit(0).cast("long")), None
    while True:
        begins = F.col("place") + F.col("step") * F.lit(window) + 1
        visitors = going.filter(begins < F.lit(rows)).select(number(run_of(begins)).alias("run"), *[F.col(c).alias(c) for c in ("pass", "place", "id", "n", "vector", "step")])
        met = cut_lineage(table.groupBy("run").cogroup(visitors.groupBy("run")).applyInArrow(linked, found))
        held = met.filter("place < 0").select("a", "b", "n_a", "n_b")
        pairs = held if pairs is None else pairs.unionByName(held)
        more = met.filter(F.col("place") + F.col("step") * F.lit(window) + 1 < F.lit(rows)).filter("place >= 0")
        if more.isEmpty():
            break
        going = more.select(F.col("b").cast("int").alias("pass"), "place", "step").join(placed, ["pass", "place"])
    order = cut_to_table(placed.filter(F.col("pass") == 0).select("place", "id", "n", "vector"))
    exact = exact_links(order, rows, dim, threshold)
    return pairs.unionByName(exact).groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


def near_copies(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
    window: int | None = None, miss: float = 1e-3, seed: int = 42,
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Vectors link at a cosine of at least ``threshold``. n_links counts the other rows a row links
    with directly, component_id is the smallest key reachable by links, itself included, and kept marks
    the row that is its own component. Rows with equal vectors form one class, named by its
    smallest key, and only classes are compared, so copies never meet in pairs.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and vectors of another
    length than the most frequent one, link with nothing. Rows with a null key link with nothing and
    are not kept. Repeated rows count as rows of one class. Other columns are not looked at. An
    empty table gives no rows.
    """
    rows = vectors.select(F.col(key), F.when(finite(vector), F.col(vector).cast("array<double>")).alias("vector"))
    usable = rows.filter(F.col("vector").isNotNull() & F.col(key).isNotNull())
    dim, _ = common_size(usable, "vector")
    usable = usable.filter(F.size("vector") == dim)
    classes = cut_lineage(usable.groupBy("vector").agg(F.min(key).alias("id"), F.count("*").alias("n")))
    # Floats travel as floats; distances are in doubles either way.
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    links = cut_lineage(projection_links(classes, classes.count(), max(dim, 1), threshold, window, miss, seed, kind))
    ends = links.select(F.col("a").alias("id"), F.col("n_b").alias("others")).unionByName(
        links.select(F.col("b").alias("id"), F.col("n_a").alias("others"))
    )
    degrees = ends.groupBy("id").agg(F.sum("others").alias("others"))
    found = connected_components(links).select(F.col("node").alias("id"), "component")
    named = (
        classes.join(degrees, "id", "left")
        .join(found, "id", "left")
        .select("vector", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    named = named.withColumn("_hash", F.xxhash64("vector")).withColumnRenamed("vector", "_vector")
    rows = rows.withColumn("_hash", F.when(F.col(key).isNotNull() & F.col("vector").isNotNull(), F.xxhash64("vector")))
    joined = rows.join(named, (rows["_hash"] == named["_hash"]) & (rows["vector"] == named["_vector"]), "left")
    component = F.coalesce("component_id", key)
    return joined.select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"),
    )
