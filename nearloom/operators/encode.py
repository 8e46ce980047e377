"""Encoding operators: every one is a narrow batch function followed by Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearloom.functions import codes as C
from nearloom.functions import vectors as V
from nearloom.functions.arrow import list_matrix, matrix_list
from nearloom.functions.rotations import (
    LAYERS,
    RotationSet,
    keyed_rotations,
    pad_rows,
    sign_weights,
    walsh_hadamard,
)
from nearloom.params import CodeParams, next_power_of_two

# Rows rotated at once: bounds the memory of one batch.
ROW_CHUNK = 2048


def _with_arrays(df: DataFrame, vec_col: str, new: list[tuple[str, str]], compute, keep: list[str] | None = None) -> DataFrame:
    """Append array columns computed from the vector column, batch by batch.

    Rows without a vector are dropped; the columns ``keep``, by default all, pass through
    untouched. What nobody reads should not be kept: it would travel back from the workers.
    """
    keep = df.columns if keep is None else keep
    kept = df.filter(F.col(vec_col).isNotNull()).select(*keep, *([] if vec_col in keep else [vec_col]))
    schema = ", ".join(f"`{name}` {kept.schema[name].dataType.simpleString()}" for name in keep)
    schema += "".join(f", `{name}` {kind}" for name, kind in new)
    names = keep + [name for name, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROW_CHUNK):
                part = batch.slice(s, ROW_CHUNK)
                arrays = compute(list_matrix(part.column(vec_col)))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in keep] + arrays, names=names)

    return kept.mapInArrow(run, schema)


def fht(df: DataFrame, vec_col: str = "embedding", out: str = "transformed", keep: list[str] | None = None) -> DataFrame:
    """Unnormalized Walsh-Hadamard transform of the zero-padded vector."""

    def compute(x: np.ndarray):
        return [matrix_list(walsh_hadamard(pad_rows(x, next_power_of_two(x.shape[1]))), pa.float64())]

    return _with_arrays(df, vec_col, [(out, "array<double>")], compute, keep)


def _rotations(params: CodeParams, residual: bool, weights: np.ndarray | None):
    """A factory of the rotation set, called inside the task."""
    seed = params.seed + params.bits if residual else params.seed
    count = params.residual_bits if residual else params.bits
    padded = params.padded_dim
    if weights is not None:
        return lambda: RotationSet(weights)
    return lambda: keyed_rotations(seed, count, padded)


def learned_weights(overrides: DataFrame, params: CodeParams) -> np.ndarray:
    """Rotation diagonals with user rows ``rotation, layer, i, weight`` replacing the keyed signs.

    The table is a model parameter: rows outside the code's shape are refused, so it holds at
    most ``bits * 3 * padded_dim`` rows and can be shipped to every task.
    """
    bound = params.bits * LAYERS * params.padded_dim
    rows = overrides.select("rotation", "layer", "i", F.col("weight").cast("double")).take(bound + 1)
    if len(rows) > bound:
        raise ValueError("more weights than the rotations have")
    table = sign_weights(params.seed, params.bits, params.padded_dim).copy()
    for rotation, layer, i, weight in rows:
        if not (0 <= rotation < params.bits and 0 <= layer < LAYERS and 0 <= i < params.padded_dim):
            raise ValueError(f"weight outside the code's shape: {(rotation, layer, i)}")
        table[rotation, layer, i] = weight
    return table


def rotate(
    df: DataFrame,
    params: CodeParams,
    vec_col: str = "embedding",
    out: str = "rotated",
    weights: np.ndarray | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """All rotated copies of the vector, ``array<array<double>>`` of bits x padded_dim."""
    factory, padded, bits = _rotations(params, False, weights), params.padded_dim, params.bits

    def compute(x: np.ndarray):
        rotations = factory()
        x = pad_rows(x, padded)
        stacked = np.stack([rotations.apply(x, r) for r in range(bits)], axis=1)
        inner = matrix_list(stacked.reshape(-1, padded), pa.float64())
        offsets = np.arange(0, (len(x) + 1) * bits, bits, dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), inner)]

    return _with_arrays(df, vec_col, [(out, "array<array<double>>")], compute, keep)


def components(
    df: DataFrame,
    params: CodeParams,
    vec_col: str = "embedding",
    residual: bool = False,
    weights: np.ndarray | None = None,
    names: tuple[str, str] = ("components", "magnitudes"),
    keep: list[str] | None = None,
) -> DataFrame:
    """Cross-polytope component and magnitude of every rotation."""
    factory, padded = _rotations(params, residual, weights), params.padded_dim

    def compute(x: np.ndarray):
        codes, mags = factory().components(pad_rows(x, padded))
        return [matrix_list(codes, pa.int32()), matrix_list(mags, pa.float64())]

    return _with_arrays(df, vec_col, [(names[0], "array<int>"), (names[1], "array<double>")], compute, keep)


def encode(
    df: DataFrame,
    params: CodeParams,
    vec_col: str = "embedding",
    weights: np.ndarray | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Sign code of the table: ``primary`` and ``residual`` words, from one pass over the vectors."""
    primary = _rotations(params, False, weights)
    residual = _rotations(params, True, None) if params.residual_bits else None
    padded = params.padded_dim

    def compute(x: np.ndarray):
        x = pad_rows(x, padded)
        arrays = [matrix_list(primary().components(x)[0], pa.int32())]
        if residual is not None:
            arrays.append(matrix_list(residual().components(x)[0], pa.int32()))
        return arrays

    new = [("_primary", "array<int>")]
    if params.residual_bits:
        new.append(("_residual", "array<int>"))
    coded = _with_arrays(df, vec_col, new, compute, keep)
    return coded.withColumns(
        {
            "primary": C.sign_words("_primary", params.bits),
            "residual": C.sign_words("_residual", params.residual_bits)
            if params.residual_bits
            else F.array().cast("array<bigint>"),
        }
    ).drop("_primary", "_residual")


def average_norm(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row ``avg_norm``: the mean length, empty vectors skipped, 1.0 for an empty table."""
    kept = df.filter(F.size(vec_col) > 0)
    return kept.agg(F.coalesce(F.avg(V.norm(vec_col)), F.lit(1.0)).alias("avg_norm"))


def encode_query(
    df: DataFrame,
    params: CodeParams,
    avg_norm: DataFrame | float = 1.0,
    vec_col: str = "embedding",
    weights: np.ndarray | None = None,
) -> DataFrame:
    """Sign code plus ``query_norm``, ``base`` and ``scale``.

    ``avg_norm`` is a number or the one-row result of :func:`average_norm`, used as a scalar subquery.
    """
    mean: Column = avg_norm.scalar() if isinstance(avg_norm, DataFrame) else F.lit(float(avg_norm))
    return encode(df, params, vec_col, weights).withColumns(
        {
            "query_norm": V.norm(vec_col),
            "base": F.lit(0.0),
            "scale": C.query_scale(vec_col, mean, params.effective_bits),
        }
    )


def validate_vectors(df: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """One row of counts: rows, missing vectors and vectors of another length than ``dim``."""
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_if(F.col(vec_col).isNull()).alias("null_vectors"),
        F.count_if(F.size(vec_col) != dim).alias("wrong_dim"),
    )


def require_dim(df: DataFrame, dim: int, vec_col: str = "embedding") -> None:
    """Fail if a vector is missing or has another length than ``dim``."""
    row = validate_vectors(df, dim, vec_col).first()
    if row.null_vectors or row.wrong_dim:
        raise ValueError(f"dimension mismatch: {row.wrong_dim} vectors are not {dim}-d, {row.null_vectors} are null")
