"""Distances of joined rows as Arrow batch functions, for joins that score very many pairs.

They equal the Column builders of ``vectors`` and ``codes`` and cost a fraction per element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearloom.functions.arrow import list_matrix
from nearloom.functions.rotations import keyed_rotations, pad_rows
from nearloom.params import CodeParams


def _aligned(valid: np.ndarray, values: np.ndarray) -> pa.Array:
    """Values at the valid rows, null elsewhere."""
    out = np.zeros(len(valid))
    out[valid] = values
    return pa.array(out, mask=~valid)


def vector_distance(metric: str, a, b) -> Column:
    """``neg_dot``, ``cosine`` or ``l2sq`` of two vector columns; null where a vector is missing."""

    @F.arrow_udf(T.DoubleType())
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        valid = (x.is_valid().to_numpy(False)) & (y.is_valid().to_numpy(False))
        keep = pa.array(valid)
        left, right = list_matrix(x.filter(keep)), list_matrix(y.filter(keep))
        if metric == "l2sq":
            diff = left - right
            return _aligned(valid, np.einsum("ij,ij->i", diff, diff))
        values = -np.einsum("ij,ij->i", left, right)
        return _aligned(valid, values + 1.0 if metric == "cosine" else values)

    return distance(a, b)


def asymmetric_distance(params: CodeParams, key, vec, components) -> Column:
    """Asymmetric distance of a query vector to a component code.

    ``key`` identifies the query: rows of one query share its rotated copies, so the row carries
    the vector and not the ``bits x padded_dim`` rotated values.
    """
    bits, padded, seed = params.bits, params.padded_dim, params.seed

    @F.arrow_udf(T.DoubleType())
    def distance(k: pa.Array, x: pa.Array, c: pa.Array) -> pa.Array:
        valid = (x.is_valid().to_numpy(False)) & (c.is_valid().to_numpy(False))
        if not valid.any():
            return _aligned(valid, np.empty(0))
        keep = pa.array(valid)
        _, first, row = np.unique(k.filter(keep).to_numpy(False), return_index=True, return_inverse=True)
        vectors = pad_rows(list_matrix(x.filter(keep).take(pa.array(first))), padded)
        codes = list_matrix(c.filter(keep), np.int64)
        rotations = keyed_rotations(seed, bits, padded)
        total = np.zeros(len(codes))
        for r in range(bits):
            turned = rotations.apply(vectors, r)
            total += turned[row, codes[:, r] >> 1] * (1.0 - 2.0 * (codes[:, r] & 1))
        return _aligned(valid, -total)

    return distance(key, vec, components)
