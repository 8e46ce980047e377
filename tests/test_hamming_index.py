import numpy as np
import pytest
from helpers import as_lists

from nearloom.operators import hamming_index
from nearloom.params import CodeParams

ONE = CodeParams(64, bits=32)
BOTH = CodeParams(64, bits=40, residual_bits=16, shift=2)
SCHEMA = "vec_id bigint, primary array<bigint>, residual array<bigint>"


def words(rng, n, bits):
    return [int(x) for x in rng.integers(0, 1 << bits, n)]


def table(spark, params, primary, residual, ids=None):
    ids = range(len(primary)) if ids is None else ids
    rows = [(i, [p] if p is not None else None, [r] if params.residual_bits else []) for i, p, r in zip(ids, primary, residual)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(params, q, b, k, exclude_self=False):
    out = {}
    for i, (p, r) in enumerate(zip(*q)):
        if p is None:
            continue
        scored = []
        for j, (x, y) in enumerate(zip(*b)):
            if x is None or (exclude_self and i == j):
                continue
            d = (p ^ x).bit_count()
            scored.append(((d << params.shift) + (r ^ y).bit_count() if params.residual_bits else d, j))
        out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def near_words(rng, centres, n, bits, flips):
    out = []
    for _ in range(n):
        w = centres[rng.integers(len(centres))]
        for b in rng.integers(0, bits, flips):
            w ^= 1 << int(b)
        out.append(w)
    return out


@pytest.mark.parametrize("params", [ONE, BOTH])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_equals_brute_force(spark, params, exclude_self):
    rng = np.random.default_rng(3)
    primary = near_words(rng, words(rng, 12, params.bits), 300, params.bits, 3) + words(rng, 60, params.bits)
    residual = words(rng, 360, 16)
    codes = table(spark, params, primary, residual)
    index = hamming_index.build_index(codes, params, width=8)
    found = hamming_index.search(codes.withColumnRenamed("vec_id", "query_id"), index, 5, exclude_self=exclude_self)
    assert as_lists(found.hits) == plain(params, (primary, residual), (primary, residual), 5, exclude_self)
    assert sum(r["finished"] for r in found.rounds) == 360
    # Queries of clusters end early; those far from everything are scanned.
    assert found.rounds[0]["queries"] == 360 and found.rounds[-1]["radius"] == -1 and found.rounds[-1]["queries"] < 120


def test_clustered_codes_need_a_small_share_of_a_scan(spark):
    rng = np.random.default_rng(5)
    primary = near_words(rng, words(rng, 150, 32), 3000, 32, 2)
    codes = table(spark, ONE, primary, [0] * len(primary))
    found = hamming_index.search(codes.withColumnRenamed("vec_id", "query_id"), hamming_index.build_index(codes, ONE, width=8), 5)
    assert as_lists(found.hits) == plain(ONE, (primary, [0] * 3000), (primary, [0] * 3000), 5)
    assert sum(r["candidates"] for r in found.rounds) < 0.25 * 3000**2


def test_copies_and_shared_parts(spark, monkeypatch):
    """A third of the rows are one code, another third share three of its four parts; cells are small."""
    rng = np.random.default_rng(7)
    same = 0x12345678
    primary = [same] * 200 + [(same & 0xFFFFFF00) | int(x) for x in rng.integers(0, 256, 200)] + words(rng, 200, 32)
    zeros = [0] * 600
    codes = table(spark, ONE, primary, zeros)
    real = hamming_index.keyed_topk
    monkeypatch.setattr(hamming_index, "keyed_topk", lambda *a, **kw: real(*a, **{**kw, "cell_query_rows": 50, "cell_base_rows": 40}))
    found = hamming_index.search(codes.withColumnRenamed("vec_id", "query_id"), hamming_index.build_index(codes, ONE, width=8), 7)
    assert as_lists(found.hits) == plain(ONE, (primary, zeros), (primary, zeros), 7)


def test_last_part_may_be_short_and_codes_may_span_words(spark):
    params = CodeParams(64, bits=76)
    rng = np.random.default_rng(9)
    low, high = (rng.integers(-(1 << 63), 1 << 63, 200) for _ in range(2))
    high &= (1 << 12) - 1
    rows = [(i, [int(a), int(b)], []) for i, (a, b) in enumerate(zip(low, high))]
    rows += [(200 + i, [int(a) ^ (1 << (i % 60)), int(b)], []) for i, (a, b) in enumerate(zip(low, high))]
    codes = spark.createDataFrame(rows, SCHEMA)
    found = hamming_index.search(codes.withColumnRenamed("vec_id", "query_id"), hamming_index.build_index(codes, params, width=16), 2)
    got = as_lists(found.hits)
    values = [((a & (1 << 64) - 1) | b << 64) for _, (a, b), _ in rows]
    assert got == plain(params, (values, [0] * 400), (values, [0] * 400), 2)


def test_missing_codes_empty_tables_and_few_rows(spark):
    primary = [5, None, 7]
    codes = table(spark, ONE, primary, [0] * 3)
    queries = codes.withColumnRenamed("vec_id", "query_id")
    assert as_lists(hamming_index.search(queries, hamming_index.build_index(codes, ONE), 10).hits) == {0: [0, 2], 2: [2, 0]}
    empty = codes.limit(0)
    assert hamming_index.search(queries, hamming_index.build_index(empty, ONE), 3).hits.count() == 0
    assert hamming_index.search(queries.limit(0), hamming_index.build_index(codes, ONE), 3).hits.count() == 0
    with pytest.raises(ValueError):
        hamming_index.search(queries, hamming_index.build_index(codes, ONE), 0)
