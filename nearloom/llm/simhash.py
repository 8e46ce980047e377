"""SimHash fingerprints and near copies by a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearloom.llm.common import release, words_of
from nearloom.llm.components import connected_components
from nearloom.session import cut_lineage

SEED = 42
BITS = 64
# Bits by which a node pair is extended in one round of the trie join.
STRIDE = 4
# Fingerprints of a node that a task may hold, and pairs of fingerprints compared without going on.
NODE_ROWS = 2048
SMALL = 16
# Shingles hashed at a time, which bounds the memory a very long text takes.
CHUNK = 1 << 18


def simhash(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles.

    A bit is set if more than half of the shingle hashes have it. A text with fewer than ``width``
    words is one shingle, a text without words (null included) has the fingerprint zero.
    """
    words = words_of(text)
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    counts = np.zeros(BITS, np.int64)
    shingles = len(words) - width + 1
    for low in range(0, shingles, CHUNK):
        high = min(low + CHUNK, shingles)
        spans = zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > shingles).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key, fingerprint`` of every row; the fingerprint is a long with the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(t.as_py(), width) for t in batch.column(1)]
            found = pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "fingerprint"])
        release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, fingerprint bigint")


def hex_digits(fingerprint: str | Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _ways(budget: Column, max_bits: int) -> Column:
    """All ways to differ within the next bits of a pair that may still differ in ``budget`` bits."""
    ways = [F.array(*[F.lit(m).cast("long") for m in range(1 << STRIDE) if m.bit_count() <= b]) for b in range(max_bits + 1)]
    choice = ways[max_bits]
    for b in range(max_bits):
        choice = F.when(budget == b, ways[b]).otherwise(choice)
    return choice


def _nodes(prints: DataFrame, depth: int) -> DataFrame:
    """Trie nodes of a depth: prefix and number of fingerprints."""
    return prints.groupBy(F.shiftrightunsigned("fp", BITS - depth).alias("node")).agg(F.count("*").alias("n"))


def walk_pair(a: np.ndarray, b: np.ndarray, depth: int, used: int, max_bits: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between the fingerprints of two nodes of a depth, given sorted, whose prefixes differ in ``used`` bits.

    Both subtries are walked together, a bit a round: of the four pairs of children those are kept
    that are not empty and within the budget. Pairs of nodes with few fingerprints are decided at
    once. With ``same`` the node is paired with itself and each pair is met once.
    """
    one = np.uint64(1)
    al, ah, bl, bh = (np.array([v]) for v in (0, len(a), 0, len(b)))
    diff = np.array([used])
    left, right = [], []
    for bit in range(BITS - depth - 1, -2, -1):
        small = (ah - al) * (bh - bl) <= SMALL if bit >= 0 else np.ones(len(al), bool)
        size = ((ah - al) * (bh - bl))[small]
        of = np.repeat(np.flatnonzero(small), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        wide = (bh - bl)[of]
        i, j = al[of] + at // wide, bl[of] + at % wide
        near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
        if same:
            near &= i < j
        left.append(a[i[near]])
        right.append(b[j[near]])
        al, ah, bl, bh, diff = (v[~small] for v in (al, ah, bl, bh, diff))
        if not len(al):
            break
        at_bit = np.uint64(bit)
        split = lambda x, low: np.searchsorted(x, ((x[low] >> at_bit) | one) << at_bit)
        am, bm = split(a, al), split(b, bl)
        own = same & (al == bl) & (ah == bh)
        al, ah, bl, bh, diff = (
            np.concatenate(v)
            for v in (
                (al, am, al, am[~own]), (am, ah, am, ah[~own]), (bl, bm, bm, bl[~own]), (bm, bh, bh, bm[~own]),
                (diff, diff, diff + 1, diff[~own] + 1),
            )
        )
        keep = (al < ah) & (bl < bh) & (diff <= max_bits)
        al, ah, bl, bh, diff = (v[keep] for v in (al, ah, bl, bh, diff))
    return np.concatenate(left), np.concatenate(right)


def trie_join(prints: DataFrame, max_bits: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """All pairs ``a, b`` of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits, each once.

    The binary trie of the fingerprints is walked from its root by node pairs. While one of the
    two nodes holds more than ``node_rows`` fingerprints, a round extends the first by its children
    four bits below, the second by every child whose bits differ from them within what is left
    of the error budget, and keeps pairs whose nodes exist. Pairs of nodes small enough meet in a
    task, which goes on walking to the leaves. A node takes part in a bounded number of pairs, so
    tasks stay small however fingerprints are spread. ``max_bits`` may be 0 to 4.
    """
    if not 0 <= max_bits <= STRIDE:
        raise ValueError(f"max_bits must be in [0, {STRIDE}]")
    spark = prints.sparkSession
    prints = prints.select("fp")
    zero = F.lit(0).cast("long")
    total = prints.count()
    pairs = spark.range(1).select(zero.alias("a"), zero.alias("b"), F.lit(0).alias("diff"), (F.lit(total) > node_rows).alias("large"))
    below = F.lit((1 << STRIDE) - 1)
    found = None
    for depth in range(0, BITS + 1, STRIDE):
        links = _meet(prints, pairs.filter(~F.col("large")), depth, max_bits)
        found = links if found is None else found.unionByName(links)
        pairs = pairs.filter("large").drop("large")
        if depth == BITS or pairs.isEmpty():
            break
        nodes = _nodes(prints, depth + STRIDE)
        first = nodes.select(
            (F.shiftrightunsigned("node", STRIDE) if depth else zero).alias("a"), F.col("node").alias("a_next"), F.col("n").alias("a_n")
        )
        second = nodes.select(F.col("node").alias("b_next"), F.col("n").alias("b_n"))
        mine, other = F.col("a_next").bitwiseAND(below), F.col("b_next").bitwiseAND(below)
        pairs = cut_lineage(
            pairs.join(first, "a")
            .withColumn("way", F.explode(_ways(F.lit(max_bits) - F.col("diff"), max_bits)))
            .withColumn("b_next", F.shiftleft("b", STRIDE).bitwiseOR(mine.bitwiseXOR(F.col("way"))))
            # A node paired with itself yields every pair of its children once.
            .filter((F.col("a") != F.col("b")) | (mine <= other))
            .join(second, "b_next")
            .select(
                F.col("a_next").alias("a"), F.col("b_next").alias("b"), (F.col("diff") + F.bit_count("way")).cast("int").alias("diff"),
                # At the leaves every node holds one fingerprint.
                (F.greatest("a_n", "b_n") > node_rows).alias("large"),
            )
        )
    return found


def _meet(prints: DataFrame, pairs: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """Links within node pairs of a depth: the fingerprints of both nodes come together in a task."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b, used = (k.as_py() for k in key)
        values = rows.column("fp").to_numpy().view(np.uint64)
        second = rows.column("second").to_numpy(zero_copy_only=False)
        x = np.sort(values[~second])
        y = x if a == b else np.sort(values[second])
        i, j = walk_pair(x, y, depth, used, max_bits, a == b) if len(x) and len(y) else (x[:0], x[:0])
        return pa.table({"a": i.view(np.int64), "b": j.view(np.int64)})

    sides = pairs.select("a", "b", "diff", F.lit(False).alias("second"), F.col("a").alias("node")).unionByName(
        pairs.filter("a != b").select("a", "b", "diff", F.lit(True).alias("second"), F.col("b").alias("node"))
    )
    node = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    together = sides.join(prints.withColumn("node", node), "node")
    return together.groupBy("a", "b", "diff").applyInArrow(run, "a bigint, b bigint")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 2, width: int = 3
) -> DataFrame:
    """``key, fingerprint, component_id`` of every row.

    Documents link if their fingerprints differ in at most ``max_bits`` bits; component_id is the
    smallest key reachable by links, the row's own included. Equal fingerprints become one
    node, so copies never meet in pairs. Null and empty texts have the fingerprint zero and link
    like any other. Rows with a null key take their component from the others; a component of
    such rows alone is null. Repeated rows share a component. ``key`` is a long; other columns are
    not looked at. An empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs, key, text, width))
    prints = cut_lineage(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("first")))
    links = trie_join(prints, max_bits)
    ends = prints.select(F.col("fp").alias("a"), F.col("first").alias("x"))
    others = prints.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    linked = links.join(ends, "a").join(others, "b").select("x", "y")
    found = connected_components(linked, "x", "y")
    place = prints.join(found, prints["first"] == found["node"], "left").select(
        F.col("fp").alias("fingerprint"), F.coalesce("component", "first").alias("component_id")
    )
    return rows.join(place, "fingerprint").select(key, "fingerprint", "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 2) -> DataFrame:
    """The documents whose key is the smallest of their component, with all their columns.

    Of rows that share this key the one whose text has the least hash stays. Rows with a null key cannot be named and go.
    """
    kept = near_copies(docs, key, text, max_bits).filter(F.col(key) == F.col("component_id")).select(key).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    order = F.struct(F.sha2(F.col(text).cast("binary"), 256).alias("text"), F.xxhash64(*plain).alias("row"))
    # Combined in tasks before the shuffle, so that a key with very many rows is no hot one.
    return docs.join(kept, key, "left_semi").groupBy(F.col(key).alias("key")).agg(F.min_by(row, order).alias("row")).select("row.*")
