import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearloom.functions import codes as C
from nearloom.functions import keyed, pairs
from nearloom.functions import vectors as V
from nearloom.functions.rotations import (
    RotationSet, keyed_rotations, rotate, sign_weights, unrotate, walsh_hadamard,
)
from nearloom.operators import encode
from nearloom.params import CodeParams, GraphParams, SearchParams, next_power_of_two


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fht_golden():
    assert walsh_hadamard(np.array([[1.0, 2, 3, 4]])).tolist() == [[10, -2, -4, 0]]
    x = np.arange(1.0, 9)[None, :]
    assert np.allclose(walsh_hadamard(walsh_hadamard(x)), 8 * x)
    with pytest.raises(ValueError):
        walsh_hadamard(np.zeros((1, 6)))


@given(st.sampled_from([8, 16, 32, 64, 128, 256]), st.integers(0, 10**6))
@settings(max_examples=30, deadline=None)
def test_fht_scales_norm(n, seed):
    x = np.random.default_rng(seed).normal(size=(3, n))
    assert np.allclose(np.linalg.norm(walsh_hadamard(x), axis=1), np.sqrt(n) * np.linalg.norm(x, axis=1))
    h = np.array([[1 - 2 * (bin(i & j).count("1") % 2) for i in range(n)] for j in range(n)])
    assert np.allclose(walsh_hadamard(x), x @ h)


def test_rotation_transpose_and_dense_form_agree():
    w = sign_weights(42, 3, 64)
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose((rotate(x, w[0]) * y).sum(1), (x * unrotate(y, w[0])).sum(1))
    assert np.allclose(RotationSet(w).apply(x, 1), rotate(x, w[1]))


def test_large_dimension_uses_butterfly_with_same_codes():
    w = sign_weights(1, 2, 512)
    rot = RotationSet(w)
    assert rot._matrices is None
    x = np.random.default_rng(0).normal(size=(4, 512))
    codes, mags = rot.components(x)
    y = np.stack([rotate(x, w[r]) for r in range(2)], axis=1)
    assert (codes >> 1 == np.abs(y).argmax(2)).all()
    assert np.allclose(mags, np.abs(y).max(2))
    assert np.allclose((rot.decode(codes) * x).sum(1), mags.sum(1))


def test_argmax_ties_take_first_axis_and_zero_vector():
    ones = RotationSet(np.ones((1, 3, 4)))
    codes, mags = ones.components(np.array([[0.0, 0, 0, 0], [1.0, 0, 0, 0]]))
    assert codes[0, 0] == 0 and mags[0, 0] == 0.0
    y = rotate(np.array([[1.0, 0, 0, 0]]), np.ones((3, 4)))
    assert codes[1, 0] >> 1 == np.abs(y[0]).argmax()


def test_decoded_code_gives_asymmetric_score():
    rot = keyed_rotations(42, 16, 64)
    x = np.random.default_rng(0).normal(size=(20, 64))
    codes, mags = rot.components(x)
    y = np.stack([rot.apply(x, r) for r in range(16)], axis=1)
    want = np.array([[sum((1 - 2 * (c & 1)) * y[q, r, c >> 1] for r, c in enumerate(codes[b])) for b in range(20)] for q in range(20)])
    assert np.allclose(x @ rot.decode(codes).T, want)
    assert np.allclose(np.diag(want), mags.sum(1))


def test_signs_equal_in_column_and_numpy(spark):
    grid = spark.range(64).select(F.col("id").cast("int").alias("i"), keyed.sign(42, 3, 1, F.col("id")).alias("s"))
    got = [r.s for r in grid.orderBy("i").collect()]
    assert got == sign_weights(42, 5, 64)[3, 1].astype(int).tolist()


def test_vector_columns(spark):
    row = one(
        spark,
        V.norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n"),
        V.normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u"),
        V.normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"),
        V.l2sq(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))).alias("l2"),
        V.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))).alias("d"),
        V.pad(F.array(*[F.lit(1.0).cast("float")] * 5), 5).alias("p"),
    )
    assert row.n == 5.0 and row.l2 == 25.0 and row.d == 16.0
    assert row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0]
    assert row.p == [1.0] * 5 + [0.0] * 3


def test_unit_vectors_rank_alike_under_all_metrics(spark, unit, frame):
    x = unit(30, 16)
    df = frame(x).select("vec_id", "embedding", F.lit(1).alias("k"))
    q = F.array(*[F.lit(float(v)) for v in x[0]])
    ranked = [
        [r.vec_id for r in df.orderBy(F.round(fn("embedding", q), 9), "vec_id").collect()]
        for fn in (V.neg_dot, V.cosine, V.l2sq)
    ]
    assert ranked[0] == ranked[1] == ranked[2]


def words(*values):
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def test_code_distance_golden(spark):
    none = F.array().cast("array<bigint>")
    row = one(
        spark,
        C.hamming(words(0), words(0b1111111111)).alias("h"),
        C.estimate(F.lit(5.0), F.lit(0.5), C.hamming(words(0), words(0b1111111111))).alias("e"),
        C.combined_hamming(words(0), words(1), words(0), words(0), 2).alias("p1"),
        C.combined_hamming(words(0), words(0), words(0), words(1), 2).alias("r1"),
        C.combined_hamming(words(0), words(7), words(0), words(31), 2).alias("m"),
        C.combined_hamming(words(0), words(7), none, none, 0).alias("plain"),
        *[C.hamming(words(1), words(((1 << n) - 1) << 1)).alias(f"b{n}") for n in range(16)],
    )
    assert (row.h, row.e, row.p1, row.r1, row.m, row.plain) == (10, 10.0, 4, 1, 17, 3)
    assert [row[f"b{n}"] for n in range(16)] == [n + 1 for n in range(16)]


def test_component_and_magnitude_coding(spark):
    row = one(
        spark,
        C.encode_component(F.lit(5), F.lit(-0.1)).alias("neg"),
        C.encode_component(F.lit(5), F.lit(0.1)).alias("pos"),
        C.component_axis(F.lit(11)).alias("axis"),
        C.component_sign(F.lit(11)).alias("sign"),
        C.quantize_magnitude(F.lit(0.5)).alias("q"),
        C.quantize_magnitude(F.lit(9.0)).alias("high"),
        C.quantize_magnitude(F.lit(-1.0)).alias("low"),
        C.dequantize_magnitude(F.lit(255)).alias("one"),
        C.component_hamming(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3))).alias("ch"),
    )
    assert (row.neg, row.pos, row.axis, row.sign) == (11, 10, 5, -1)
    assert (row.q, row.high, row.low) == (127, 255, 0) and row.one == pytest.approx(1.0) and row.ch == 1
    assert C.primary_weight(2) == 0.8 and C.residual_weight(2) == 0.2


def test_words_across_64_bits(spark, unit, frame):
    x = unit(4, 16)
    params = CodeParams(16, bits=96, residual_bits=3)
    rows = encode.encode(encode.components(frame(x), params), params)
    got = rows.select(
        "components", "primary", "residual", C.bit_get("primary", 95).alias("b95"), C.bit_get("primary", 63).alias("b63"),
        C.bit_get(C.bit_set("primary", 63, True), 63).alias("set"), C.bit_get(C.bit_set("primary", 70, False), 70).alias("unset"),
    ).collect()
    for r in got:
        bits = [c & 1 for c in r.components]
        packed = [sum(b << i for i, b in enumerate(bits[s : s + 64])) for s in (0, 64)]
        assert [w % (1 << 64) for w in r.primary] == packed
        assert (r.b95, r.b63, r.set, r.unset) == (bits[95], bits[63], 1, 0)
        assert len(r.residual) == 1


def test_arrow_pair_distances_equal_columns(spark, unit, frame):
    x = unit(40, 24)
    params = CodeParams(24, bits=8)
    coded = encode.rotate(encode.components(frame(x), params), params)
    q = coded.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"), "rotated")
    b = coded.select(F.col("vec_id").alias("j"), F.col("embedding").alias("b"), "components")
    both = q.join(b, (F.col("i") + F.col("j")) % 7 == 0)
    out = both.select(
        *[(pairs.vector_distance(m, "a", "b") - V.VECTOR_METRICS[m]("a", "b")).alias(m) for m in V.VECTOR_METRICS],
        (pairs.asymmetric_distance(params, "i", "a", "components") - C.asymmetric_distance("rotated", "components")).alias("asym"),
        pairs.vector_distance("cosine", F.lit(None).cast("array<float>"), "b").alias("none"),
    ).toPandas()
    assert len(out) > 100 and out.none.isna().all()
    assert out.drop(columns="none").abs().max().max() < 1e-9


def test_encode_skips_missing_vectors_and_refuses_ragged_ones(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id bigint, embedding array<float>")
    assert encode.components(df, CodeParams(2, bits=2)).count() == 1
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "vec_id bigint, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="same length"):
        encode.components(ragged, CodeParams(2, bits=2)).collect()
    with pytest.raises(ValueError, match="dimension mismatch"):
        encode.require_dim(ragged, 2)


def test_average_norm_and_query_scale(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert encode.average_norm(empty).first().avg_norm == 1.0
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 1.0]), (3, [])], "vec_id bigint, embedding array<float>")
    mean = encode.average_norm(df)
    assert mean.first().avg_norm == 3.0
    kept = df.filter("vec_id < 3")
    plain = encode.encode_query(kept, CodeParams(2, bits=4), mean).filter("vec_id = 1").first()
    assert plain.scale == pytest.approx(2 * 5 * 3 / 4) and plain.base == 0.0 and plain.query_norm == 5.0
    with_rest = encode.encode_query(kept, CodeParams(2, bits=4, residual_bits=2, shift=3), 1.0).filter("vec_id = 1").first()
    assert with_rest.scale == pytest.approx(2 * 5 / (4 * 8 + 2))


def test_learned_weights_are_checked(spark):
    params = CodeParams(4, bits=2)
    one_row = spark.createDataFrame([(1, 2, 3, 0.5)], "rotation int, layer int, i int, weight double")
    assert encode.learned_weights(one_row, params)[1, 2, 3] == 0.5
    outside = spark.createDataFrame([(2, 0, 0, 0.5)], "rotation int, layer int, i int, weight double")
    with pytest.raises(ValueError):
        encode.learned_weights(outside, params)


def test_params():
    assert [next_power_of_two(n) for n in (1, 2, 3, 64, 65)] == [1, 2, 4, 64, 128]
    assert CodeParams(3, 32).effective_bits == 32 and CodeParams(3, 32, 16, 2).effective_bits == 144
    assert SearchParams(k=5, ef=20, rerank_k=200).effective_rerank_k == 20
    for bad in (
        lambda: CodeParams(0), lambda: CodeParams(4, bits=257), lambda: GraphParams(m_links=65),
        lambda: GraphParams(m_links=32, ef_construction=10), lambda: GraphParams(alpha=0.5), lambda: GraphParams(k_entry=101),
        lambda: SearchParams(k=10, ef=5), lambda: SearchParams(k=300, ef=400, rerank_k=200), lambda: SearchParams(k=0),
    ):
        with pytest.raises(ValueError):
            bad()
