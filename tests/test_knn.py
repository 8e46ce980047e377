import numpy as np
import pytest
from helpers import as_lists, brute
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearloom.functions import tiles
from nearloom.functions.rotations import keyed_rotations
from nearloom.operators import encode, knn, lsh
from nearloom.operators.knn import Grid, plan_grid, query_part_rows
from nearloom.params import CodeParams


@pytest.mark.parametrize("metric", ["cosine", "neg_dot", "l2sq"])
@pytest.mark.parametrize("grid", [None, Grid(1, 1), Grid(2, 3), Grid(3, 1)])
def test_exact_knn_equals_brute_force(frame, unit, metric, grid):
    x = unit(120, 20) * np.linspace(0.5, 3, 120, dtype=np.float32)[:, None]
    q = unit(30, 20, 1)
    got = knn.exact_knn(frame(q, "query_id"), frame(x), 7, metric, grid=grid)
    assert as_lists(got) == brute(q, x, 7, metric)


@pytest.mark.parametrize("grid", [None, Grid(2, 2)])
def test_a_third_of_all_rows_are_copies(frame, unit, grid):
    x = unit(90, 16)
    x[::3] = x[0]
    want = brute(x, x, 8, exclude_self=True)
    got = knn.exact_knn(frame(x, "query_id"), frame(x), 8, exclude_self=True, grid=grid)
    assert as_lists(got) == want


def test_farthest_missing_and_short(frame, unit):
    x = unit(5, 8)
    far = knn.exact_knn(frame(x, "query_id"), frame(x), 2, farthest=True)
    assert as_lists(far) == brute(x, x, 2, farthest=True)
    assert min(r.dist for r in far.collect()) > 0
    assert all(len(v) == 4 for v in as_lists(knn.exact_knn(frame(x, "query_id"), frame(x), 9, exclude_self=True)).values())
    nothing = frame(x, "query_id").filter("query_id < 0")
    assert knn.exact_knn(nothing, frame(x), 2).count() == 0
    ends = knn.closest_and_farthest(frame(x, "query_id"), frame(x))
    near, far = brute(x, x, 1, exclude_self=True), brute(x, x, 1, exclude_self=True, farthest=True)
    assert {r.query_id: (r.nearest, r.farthest) for r in ends.collect()} == {i: (near[i][0], far[i][0]) for i in range(5)}


def test_result_does_not_depend_on_partitions(frame, unit):
    x = unit(200, 12)
    x[50:100] = x[7]
    answers = []
    for parts in (1, 3, 8):
        base = frame(x).repartition(parts)
        rows = knn.exact_knn(frame(x, "query_id"), base, 5).orderBy("query_id", "rank").collect()
        answers.append([tuple(r) for r in rows])
    rows = knn.exact_knn(frame(x, "query_id"), frame(x), 5, grid=Grid(3, 4)).orderBy("query_id", "rank").collect()
    answers.append([tuple(r) for r in rows])
    assert all(a == answers[0] for a in answers)


@given(st.integers(0, 10**6), st.integers(1, 9), st.sampled_from(["cosine", "l2sq"]), st.booleans())
@settings(max_examples=40, deadline=None)
def test_running_top_k_over_chunks(seed, k, metric, exclude_self):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, size=(60, 4)).astype(np.float64)
    ids = rng.permutation(60)
    score = tiles.VectorScore(metric)
    top = tiles.RunningTopK(np.arange(10), k)
    q = score._pack(x[:10])
    for s in range(0, 60, 13):
        part = slice(s, s + 13)
        tiles.score_chunk(top, q, score._pack(x[part]), ids[part], score, exclude_self)
    want = brute(x[:10], x, k, metric, exclude_self, b_ids=ids)
    assert {i: [int(v) for v in row if v != tiles.NO_ID] for i, row in enumerate(top.ids)} == want


@given(st.integers(0, 10**6), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_running_top_k_of_integer_scores(seed, k):
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, size=(60, 6)).astype(np.float32)
    ids = rng.permutation(60)
    score = tiles.HammingScore(6)
    sign = 1 - 2 * bits
    top = tiles.RunningTopK(np.arange(10), k)
    for s in range(0, 60, 17):
        tiles.score_chunk(top, {"x32": sign[:10]}, {"x32": sign[s : s + 17]}, ids[s : s + 17], score, False)
    d = (bits[:10, None, :] != bits[None]).sum(2)
    for i in range(10):
        want = sorted(zip(d[i], ids))[:k]
        assert list(zip(top.dist[i], top.ids[i])) == [(float(a), b) for a, b in want]


def test_surplus_copies_keeps_smallest_ids():
    x = np.array([[1.0, 2], [3, 4], [1, 2], [1, 2], [3, 4]])
    mask = tiles.surplus_copies(x, np.array([9, 1, 4, 2, 7]), 2)
    assert mask.tolist() == [False, True, True, True, True]
    assert tiles.surplus_copies(x[:2], np.array([1, 2]), 1) is None


@pytest.mark.parametrize("grid", [None, Grid(2, 2)])
def test_code_joins(frame, unit, grid):
    x = unit(80, 24)
    params = CodeParams(24, bits=16)
    rot = keyed_rotations(params.seed, 16, 32)
    padded = np.pad(x.astype(np.float64), ((0, 0), (0, 8)))
    codes, _ = rot.components(padded)
    d = -padded @ rot.decode(codes).T
    coded = encode.components(frame(x), params)
    got = knn.asymmetric_knn(frame(x, "query_id"), coded, params, 6, grid=grid)
    assert as_lists(got) == {i: [j for _, j in sorted((round(v, 9), j) for j, v in enumerate(row))[:6]] for i, row in enumerate(d)}

    params = CodeParams(24, bits=70, residual_bits=10, shift=3)
    primary = keyed_rotations(42, 70, 32).components(padded)[0] & 1
    residual = keyed_rotations(42 + 70, 10, 32).components(padded)[0] & 1
    h = 8 * (primary[:, None] != primary[None]).sum(2) + (residual[:, None] != residual[None]).sum(2)
    signs = encode.encode(frame(x), params).drop("embedding")
    got = knn.hamming_knn(signs.withColumnRenamed("vec_id", "query_id"), signs, params, 6, exclude_self=True, grid=grid)
    want = {i: [j for _, j in sorted((v, j) for j, v in enumerate(row) if j != i)[:6]] for i, row in enumerate(h)}
    assert as_lists(got) == want
    assert {r.query_id: r.dist for r in got.filter("rank = 1").collect()} == {i: float(h[i][w[0]]) for i, w in want.items()}


def test_rerank_drops_unknown_candidates(spark, frame, unit):
    x = unit(10, 8)
    cands = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (0, 999), (3, 4)], "query_id bigint, vec_id bigint")
    got = knn.rerank(cands, frame(x, "query_id"), frame(x), 5, "l2sq")
    d = ((x[0].astype(float) - x[[1, 2]].astype(float)) ** 2).sum(1)
    assert as_lists(got) == {0: [1, 2] if d[0] < d[1] else [2, 1], 3: [4]}
    with pytest.raises(ValueError):
        knn.rerank(cands, frame(x, "query_id"), frame(x), 5, "other")


def test_grid_planning():
    assert plan_grid(100, 1000, 64, 10, 8).cells == 1
    assert plan_grid(10_000, 10_000_000, 64, 10, 100) == Grid(1, 100)
    big = plan_grid(10**9, 10**9, 128, 10, 1000)
    assert big.query_parts * query_part_rows(128, 10) >= 10**9
    assert 10**18 / big.cells <= 2**37
    assert query_part_rows(960, 100) < query_part_rows(64, 10)


def test_edge_list_and_neighbours(spark):
    wide = spark.createDataFrame([(1, [2, 1, 4294967295], [0.1, 0.0, 9.9]), (2, [1], [0.1])], "src bigint, neighbors array<bigint>, distances array<double>")
    edges = knn.edge_list(wide)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 0.1), (2, 1, 0.1)]
    assert knn.neighbours_of(edges, spark.createDataFrame([(2,)], "src bigint")).count() == 1


def test_sample_pairs(spark, frame, unit):
    df = frame(unit(7, 4))
    rows = knn.sample_pairs(df, num_pairs=500, seed=3).collect()
    assert len(rows) == 500 and all(0 <= r.i < 7 and 0 <= r.j < 7 and r.i != r.j for r in rows)
    assert {r.i for r in rows} == set(range(7))
    again = knn.sample_pairs(df.repartition(5), num_pairs=500, seed=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert knn.sample_pairs(df, per_vector=3).count() == 21
    assert knn.sample_pairs(frame(unit(1, 4)), num_pairs=5).count() == 0


@pytest.mark.parametrize("hashes", [1, 2])
def test_multiprobe_scores_exactly_the_probed_buckets(frame, unit, hashes):
    x = unit(150, 16)
    x[::3] = x[0]  # one bucket per table holds a third of the rows
    params = CodeParams(16, bits=4, seed=5)
    q, b = frame(x, "query_id"), frame(x)
    base = {}
    for r in lsh.base_buckets(b, params, hashes).collect():
        base.setdefault((r.table, r.bucket), set()).add(r.id)
    probes = lsh.query_probes(q, params, 3, hashes).collect()
    cands = {}
    for r in probes:
        cands.setdefault(r.id, set()).update(base.get((r.table, r.bucket), ()))
    first = [r for r in probes if r.probe == 0]
    assert all(r.id in base[(r.table, r.bucket)] and r.cost == 0 for r in first)
    want = {}
    for i, c in cands.items():
        order = brute(x[[i]], x[sorted(c)], 5, exclude_self=True, q_ids=[i], b_ids=sorted(c))
        if order[i]:
            want[i] = order[i]
    plain = lsh.multiprobe_knn(q, b, params, 5, 3, hashes, exclude_self=True)
    assert as_lists(plain) == want
    split = lsh.multiprobe_knn(
        q, b, params, 5, 3, hashes, exclude_self=True, cell_query_rows=7, cell_base_rows=11, most_rows=None
    )
    assert as_lists(split) == want


def test_duplicate_codes(spark):
    df = spark.createDataFrame([(i, [1, 2] if i < 4 else [i, 0]) for i in range(8)], "vec_id bigint, components array<int>")
    assert [(r.copies, r.pairs) for r in knn.duplicate_codes(df).collect()] == [(4, 6)]


def test_scored_candidates_keep_their_place(spark, frame, unit):
    x = unit(12, 8)
    # A repeated pair counts once.
    cands = spark.createDataFrame([(0, 3, 1), (0, 5, 2), (0, 5, 2), (1, 99, 1)], "query_id long, vec_id long, place int")
    got = knn.scored(cands, frame(x, "query_id"), frame(x), "l2sq", keep=("place",))
    assert got.columns == ["query_id", "vec_id", "place", "dist"]
    assert sorted((r.query_id, r.vec_id, r.place) for r in got.collect()) == [(0, 3, 1), (0, 5, 2)]


def test_running_top_k_sorts_few_rows(monkeypatch):
    """Once k rows are held, what a chunk adds waits and is merged with that of others."""
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(40, 8)), rng.normal(size=(6400, 8))
    score, merged, real = tiles.VectorScore("l2sq"), [], np.lexsort
    top, features = tiles.RunningTopK(np.arange(40), 20), score._pack(q)
    with monkeypatch.context() as m:
        m.setattr(tiles.np, "lexsort", lambda keys, axis=-1: merged.append(len(keys)) or real(keys, axis=axis))
        for s in range(0, 6400, 64):
            tiles.score_chunk(top, features, score._pack(x[s : s + 64]), np.arange(s, s + 64), score, False)
        sorts = sum(n == 3 for n in merged)
    assert sorts < 25
    assert {i: row.tolist() for i, row in enumerate(top.ids)} == brute(q, x, 20, "l2sq")


def test_set_places_are_found():
    rng = np.random.default_rng(6)
    for shape in ((1, 1), (3, 5), (7, 8), (16, 40)):
        for share in (0.0, 0.1, 1.0):
            mask = rng.random(shape) < share
            for m in (mask, np.asfortranarray(mask)):
                assert [v.tolist() for v in tiles._where(m)] == [v.tolist() for v in np.nonzero(mask)]


@pytest.mark.parametrize("hashes, exclude_self", [(1, False), (2, True)])
@pytest.mark.parametrize("grid", [None, (1, 1), (3, 4), (2, 16)])
def test_sweep_of_probes_equals_single_runs(frame, unit, hashes, exclude_self, grid):
    x = unit(150, 8)
    x[::5] = x[1]
    params, b, q = CodeParams(8, bits=4, seed=3), frame(x), frame(x, "query_id")
    swept = lsh.multiprobe_sweep(q, b, params, 6, [4, 1, 2], hashes, exclude_self=exclude_self, grid=grid).collect()
    for n in (1, 2, 4):
        plain = lsh.multiprobe_knn(q, b, params, 6, n, hashes, exclude_self=exclude_self).collect()
        key = lambda r: (r.query_id, r["rank"], r.vec_id, r.dist)
        assert sorted(key(r) for r in swept if r.num_probes == n) == sorted(map(key, plain))


def test_sweep_sends_a_query_once_to_a_table(spark, frame, unit, monkeypatch):
    """Not once to each of its buckets."""
    real = tiles.probed_topk
    count = spark.sparkContext.accumulator(0)

    def counted(*args):
        run = real(*args)

        def counting(batches):
            def seen():
                for batch in batches:
                    count.add(batch.num_rows)
                    yield batch

            yield from run(seen())

        return counting

    monkeypatch.setattr(tiles, "probed_topk", counted)
    x = unit(100, 16)
    lsh.multiprobe_sweep(frame(x, "query_id"), frame(x), CodeParams(16, bits=4), 5, [1, 2, 4, 8], grid=(2, 1)).collect()
    # Four tables: queries once, base rows to both parts.
    assert count.value == 4 * 100 + 4 * 2 * 100


def test_sweep_grid_sends_few_copies():
    rows = 65_536
    for n in (1_000, 60_000, 600_000, 6_000_000, 600_000_000):
        parts, groups = lsh._sweep_grid(n, 8, 16, 128, rows, 8)
        assert n * min(16, groups) / groups <= parts * rows
        assert parts + min(16, groups) <= 1 + -(-n // rows)


def test_a_key_of_many_pairs_is_split(frame, unit, monkeypatch):
    """Few enough rows for one cell, but more pairs than a task shall take."""
    x = unit(80, 8)
    keyed = lambda name: frame(x, name).select(F.col(name).alias("id"), F.col("embedding").alias("vec"), (F.col(name) % 4 == 0).cast("int").alias("key"))
    q, b, seen, real = keyed("query_id"), keyed("vec_id"), [], lsh._cells_topk
    score = tiles.VectorScore("l2sq")
    want = lsh.keyed_topk(q, b, ["key"], score, 5).collect()

    def noted(queries, base, keys, split, *rest):
        seen.append({r.key: (r.qn, r.bn) for r in split.collect()})
        return real(queries, base, keys, split, *rest)

    monkeypatch.setattr(lsh, "_cells_topk", noted)
    got = lsh.keyed_topk(q, b, ["key"], score, 5, most_rows=(80, 80), cell_pairs=1000).collect()
    assert seen == [{0: (4, 1)}]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
