import numpy as np
import pytest

from nearloom.llm import ann, vector_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, n string, vector string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def odd(dim):
    return [(901, None), (902, [0.0] * dim), (903, [1.0, None] + [0.0] * (dim - 2)), (904, [float("nan")] * dim),
            (905, [float("inf")] + [0.0] * (dim - 1)), (906, []), (907, [1.0] * (dim - 1)), (None, [1.0] * dim)]


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[rng.integers(0, 5, n - n // 2)] + rng.normal(scale=0.05, size=(n - n // 2, dim))
    x[n - 40 :] = x[3]
    return x.astype(np.float32)


def nearest(x, ids, i, k):
    d = np.sqrt(((x.astype(np.float64) - x[i].astype(np.float64)) ** 2).sum(1))
    d[ids == ids[i]] = np.inf
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]


def test_search_finds_neighbours_ties_and_copies(spark):
    x = clustered(1500, 16)
    ids = np.random.default_rng(1).permutation(1500) * 3
    base = frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)] + odd(16))
    queries = base.filter("vec_id % 50 = 0")
    rows = ann.multiprobe_search(queries, base, k=10).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = [i for i in range(1500) if ids[i] % 50 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    hits = 0
    for i in asked:
        want = nearest(x, ids, i, 10)
        mine = got[int(ids[i])]
        assert len(mine) == 10 and mine == sorted(mine, key=lambda p: (p[1], p[0]))
        for j, d in mine:
            assert d == np.sqrt(((x[ids == j][0].astype(np.float64) - x[i].astype(np.float64)) ** 2).sum())
        hits += len({j for j, _ in mine} & {j for j, _ in want})
    assert hits / (10 * len(asked)) >= 0.9
    # Copies at equal distance come by the smaller id.
    copies = sorted(int(i) for i in ids[np.append(3, np.arange(1460, 1500))])
    query = next((i for i in copies if i % 50 == 0), None)
    if query is not None:
        assert [j for j, _ in got[query]] == [i for i in copies if i != query][:10]


def test_search_splits_hot_buckets_and_agrees(spark, monkeypatch):
    x = clustered(800, 8, seed=3)
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    queries = base.filter("vec_id % 20 = 0")
    want = sorted(map(tuple, ann.multiprobe_search(queries, base, k=5).collect()))
    monkeypatch.setattr(ann, "BUCKET_ROWS", 7)
    assert sorted(map(tuple, ann.multiprobe_search(queries, base, k=5).collect())) == want


def test_few_rows_are_all_returned(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 900.0]), (2, [-500.0, 1.0]), (2, [-500.0, 1.0])]
    base = frame(spark, rows)
    got = ann.multiprobe_search(base.filter("vec_id = 0"), base).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]


def test_search_of_nothing(spark):
    none, some = frame(spark, []), frame(spark, [(1, [1.0, 2.0])])
    columns = ["query_id", "rank", "vec_id", "score"]
    for q, b in ((none, none), (none, some), (some, none), (some, some), (some, frame(spark, odd(2)))):
        found = ann.multiprobe_search(q, b)
        assert found.columns == columns and found.count() == 0


def links(x, threshold):
    u = x.astype(np.float64)
    norm = np.linalg.norm(u, axis=1)
    s = (u @ u.T) / norm[:, None] / norm[None]
    np.fill_diagonal(s, -1)
    return s >= threshold


def components(ids, linked):
    place = {int(i): int(i) for i in ids}
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            least = min([place[int(ids[i])], *[place[int(ids[j])] for j in np.flatnonzero(linked[i])]])
            if least < place[int(ids[i])]:
                place[int(ids[i])], changed = least, True
    return place


@pytest.mark.parametrize("window", [4, 256])
def test_near_copies_equal_brute_force(spark, window):
    x = clustered(700, 16, seed=5)
    ids = np.random.default_rng(2).permutation(700)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = frame(spark, rows + odd(16))
    got = {r.vec_id: r for r in vector_dedup.near_copies(df, threshold=0.95, window=window, miss=1e-6).collect()}
    linked = links(x, 0.95)
    place = components(ids, linked)
    for k, i in enumerate(ids):
        r = got[int(i)]
        assert (r.n_links, r.component_id, r.kept) == (int(linked[k].sum()), place[int(i)], place[int(i)] == int(i))
    for i, _ in odd(16)[:-1]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert len(got) == 708


def test_repeated_rows_and_nothing(spark):
    df = frame(spark, [(4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 1.0])])
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_copies(df).collect())
    assert got == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (9, 0, 9, True)]
    assert vector_dedup.near_copies(frame(spark, [])).count() == 0


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hard_rows(kind, n, seed=0):
    """Vectors with partners at a cosine of about 0.955 for some."""
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        x = _unit(rng.normal(size=(60, 64))[rng.integers(0, 60, n)] + 0.35 * rng.normal(size=(n, 64)))
    else:
        shared = 2.9 * 8 * _unit(rng.normal(size=(1, 64))) if kind == "shared direction" else 0
        x = _unit(rng.normal(size=(n, 64)) + shared)
    p = x[rng.integers(0, n, n // 30)]
    z = rng.normal(size=p.shape)
    z = _unit(z - (z * p).sum(1, keepdims=True) * p)
    return np.concatenate([x, _unit(0.955 * p + np.sqrt(1 - 0.955**2) * z)])


def _linked(x, step=1000):
    for i in range(0, len(x), step):
        a, b = np.nonzero(x[i : i + step] @ x.T >= 0.95)
        keep = a + i < b
        yield np.stack([a[keep] + i, b[keep]], axis=1)


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "shared direction"])
def test_passes_meet_links_of_hard_data(kind):
    x = _hard_rows(kind, 30_000)
    links = np.concatenate(list(_linked(x)))
    mean = x.mean(0)
    window, passes = vector_dedup.plan_passes(x[:4096], mean, len(x), 0.95, 1e-3)
    met = np.zeros(len(links), bool)
    for p in range(passes):
        keys = ((x - mean) @ np.random.default_rng(p).normal(size=(64, 60)) > 0) @ np.left_shift(np.int64(1), np.arange(59, -1, -1))
        place = np.argsort(np.argsort(keys, kind="stable"))
        met |= np.abs(place[links[:, 0]] - place[links[:, 1]]) <= window
    assert len(links) >= 1000 and met.mean() >= 0.99


def test_shared_direction_equals_brute_force(spark):
    x = _hard_rows("shared direction", 3000, seed=1).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    y = _unit(x.astype(np.float64))
    degree = np.zeros(len(x), int)
    for pair in _linked(y):
        np.add.at(degree, pair.ravel(), 1)
    got = np.array([r.n_links for r in sorted(vector_dedup.near_copies(df).collect(), key=lambda r: r.vec_id)])
    assert (got <= degree).all() and got.sum() >= 0.99 * degree.sum()


def test_passes_grow_slowly():
    x = _unit(np.random.default_rng(3).normal(size=(4096, 64)))
    costs = [w * p for w, p in (vector_dedup.plan_passes(x, x.mean(0), n, 0.95, 1e-3) for n in (10**4, 10**9))]
    assert costs[0] < costs[1] < 100 * costs[0]

def _equals_brute_force(spark, x, **settings):
    got = {r.vec_id: r for r in vector_dedup.near_copies(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]).repartition(40), **settings).collect()}
    linked = links(x, 0.95)
    place = components(range(len(x)), linked)
    assert linked.any()
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id) == (int(linked[i].sum()), place[i])


def test_runs_part_no_pair_of_a_small_table(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(100, 64))
    x = np.concatenate([x, x + rng.normal(scale=0.3, size=x.shape)]).astype(np.float32)
    _equals_brute_force(spark, x)


def test_group_larger_than_a_run_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "RUN_ROWS", 50)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(1, 16)) + rng.normal(scale=0.05, size=(300, 16))).astype(np.float32)
    _equals_brute_force(spark, x, window=20)


def test_passes_come_from_all_rows(spark):
    """A dense group too small to show in a sample of a few rows decides the number of passes."""
    rng = np.random.default_rng(9)
    x = np.concatenate([_unit(rng.normal(size=(600, 16))), _unit(rng.normal(size=(1, 16)) + 0.3 * rng.normal(size=(60, 16)))])
    classes = frame(spark, [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]).selectExpr("vec_id id", "cast(embedding as array<double>) vector")
    x, mean = _unit(x.astype(np.float32).astype(float)), x.mean(0)
    for windows in ((8,), (4,), (4, 64)):
        window, passes = vector_dedup.measured_plan(classes, mean, len(x), 0.95, 1e-3, windows=windows)
        want = vector_dedup.plan_passes(x, mean, len(x), 0.95, 1e-3, windows=windows)
        assert window == want[0] and want[1] <= passes <= 1.05 * want[1] + 1
        assert len(windows) > 1 or passes > vector_dedup.plan_passes(x[:500], mean, len(x), 0.95, 1e-3, windows=windows)[1]


def test_links_that_no_pass_meets_are_found(spark):
    """One pass of narrow windows meets few of the pairs; the comparison that follows finds all of them."""
    x = _hard_rows("isotropic", 3000, seed=2).astype(np.float32)
    _equals_brute_force(spark, x, window=8, miss=0.9)


def test_blocks_that_are_left_out_hold_no_link():
    x = np.concatenate([clustered(900, 8, seed=4), clustered(700, 8, seed=6)]).astype(np.float64)
    x = x[np.argsort(x[:, 0])]
    found = {(int(i), int(j) + 500) for a, b in vector_dedup._all_links(x[:800], np.arange(800), x[500:], np.arange(500, len(x)), 0.95) for i, j in zip(a, b)}
    assert found == {(i, j) for i, j in zip(*np.nonzero(links(x, 0.95))) if i < 800 and j >= 500 and i < j}
