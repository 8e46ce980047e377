import numpy as np
import pytest
from pyspark.sql import functions as F

from nearloom.functions.vectors import VECTOR_METRICS
from nearloom.operators import ivf


def blobs(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(6, dim))[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)


def hits(df):
    return {(r.query_id, r["rank"]): (r.vec_id, round(r.dist, 9)) for r in df.collect()}


def plain_codes(x, q, model, k, nprobe, metric):
    """Every pair scored by the decoded code of the base row."""
    c, books = model.centroids, model.codebooks
    near = lambda v: np.argsort(0.5 * (c**2).sum(1) - v @ c.T, kind="stable")
    width, out = books.shape[2], {}
    decoded = []
    for v in x.astype(np.float64):
        cell = near(v)[0]
        r = (v - c[cell]).astype(np.float32).astype(np.float64)
        code = [np.argmin(((b - r[j * width : (j + 1) * width]) ** 2).sum(1)) for j, b in enumerate(books)]
        decoded.append((cell, c[cell] + np.concatenate([b[w] for b, w in zip(books, code)])))
    for i, v in enumerate(q.astype(np.float64)):
        probed, scored = set(near(v)[:nprobe]), []
        for j, (cell, y) in enumerate(decoded):
            if cell in probed:
                d = ((v - y) ** 2).sum() if metric == "l2sq" else (metric == "cosine") - (v * y).sum()
                scored.append((round(d, 9), j))
        for rank, (d, j) in enumerate(sorted(scored)[:k], 1):
            out[i, rank] = (j, d)
    return out


@pytest.mark.parametrize("metric", sorted(VECTOR_METRICS))
@pytest.mark.parametrize("rows", [300, 3000])
def test_lookup_tables_equal_decoded_codes(frame, metric, rows):
    x, q = blobs(rows, 16), blobs(40, 16, 1)
    model = ivf.train(frame(x), nlist=4, subspaces=4, bits=3, iterations=3)
    got = hits(ivf.ivf_knn(frame(q, "query_id"), frame(x), model, 6, nprobe=2, metric=metric))
    want = plain_codes(x, q, model, 6, 2, metric)
    assert got.keys() == want.keys()
    # Rows of one code tie; a sum of other order may differ in the last digits.
    assert all(abs(got[key][1] - want[key][1]) < 1e-7 for key in want)
    assert sum(got[key][0] == want[key][0] for key in want) > 0.98 * len(want)


def test_a_hot_cell_is_split(frame, monkeypatch):
    x = blobs(400, 16)
    x[::3] = x[0]
    model = ivf.train(frame(x), nlist=3, subspaces=2, bits=4, iterations=2)
    args = frame(blobs(50, 16, 1), "query_id"), frame(x), model, 5, 2
    want = hits(ivf.ivf_knn(*args))
    real = ivf.keyed_topk
    monkeypatch.setattr(ivf, "keyed_topk", lambda *a, **kw: real(*a, **{**kw, "cell_query_rows": 20, "cell_base_rows": 30}))
    assert hits(ivf.ivf_knn(*args)) == want


def test_training_is_the_same_for_any_partitioning(frame):
    x = blobs(500, 16)
    one, many = frame(x).repartition(1), frame(x).repartition(7, F.rand(3))
    a, b = (ivf.train(df, nlist=8, subspaces=4, bits=4, iterations=4) for df in (one, many))
    assert (a.centroids == b.centroids).all() and (a.codebooks == b.codebooks).all()


def test_rounds_lower_the_error_and_ends_equal_plain_means(frame):
    x = blobs(500, 16)
    error = []
    for rounds in (0, 1, 8):
        c = ivf.train(frame(x), nlist=6, iterations=rounds).centroids
        error.append(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    assert error[0] > error[1] >= error[2]
    before = ivf.train(frame(x), nlist=6, iterations=2).centroids
    own = ((x[:, None] - before[None]) ** 2).sum(2).argmin(1)
    after = ivf.train(frame(x), nlist=6, iterations=3).centroids
    means = np.array([x[own == i].mean(0) if (own == i).any() else before[i] for i in range(6)])
    assert np.abs(after - means).max() < 1e-6


def test_codes_travel_as_bytes(frame):
    x = blobs(600, 16)
    model = ivf.train(frame(x), nlist=2, subspaces=4, bits=8, iterations=1)
    assigned = ivf.assign(frame(x).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), model, 1)
    codes = ivf.product_codes(assigned, model)
    assert dict(codes.dtypes)["code"] == "array<tinyint>"
    wide = {r.id: r.code for r in ivf.quantize(assigned, model).select("id", "code").collect()}
    assert {r.id: [c & 0xFF for c in r.code] for r in codes.collect()} == wide
    assert max(max(c) for c in wide.values()) > 127
    assert hits(ivf.ivf_knn(frame(x[:20], "query_id"), frame(x), model, 3, 2)).keys() == {(i, r) for i in range(20) for r in (1, 2, 3)}


def test_missing_vectors_few_rows_and_refusals(spark, frame, monkeypatch):
    x = blobs(5, 16)
    base = frame(x).unionByName(spark.sql("SELECT 9L AS vec_id, CAST(NULL AS array<float>) AS embedding"))
    model = ivf.train(base, nlist=8, subspaces=4, bits=4, iterations=2)
    assert model.centroids.shape == (5, 16) and model.codebooks.shape == (4, 16, 4)
    got = ivf.ivf_knn(base.withColumnRenamed("vec_id", "query_id"), base, model, 10, nprobe=8)
    assert {r.vec_id for r in got.collect()} == {r.query_id for r in got.collect()} == set(range(5))
    assert ivf.ivf_knn(base.limit(0).withColumnRenamed("vec_id", "query_id"), base, model, 3).count() == 0
    with pytest.raises(ValueError):
        ivf.train(base.limit(0), nlist=2)
    with pytest.raises(ValueError):
        ivf.train(base, nlist=2, subspaces=3)
    monkeypatch.setattr(ivf, "MAX_MODEL_BYTES", 100)
    with pytest.raises(ValueError):
        ivf.IvfModel(np.zeros((4, 16)))
