"""Numpy helpers of the batch encoder: sign tables, Walsh-Hadamard transform, rotations."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

LAYERS = 3
# A rotation of up to this many dimensions is applied as one matrix product.
DENSE_LIMIT = 256
# |x| within this relative gap of the maximum counts as a tie; the first axis wins.
TIE_GAP = 1e-9


@lru_cache(maxsize=32)
def sign_weights(seed: int, rotations: int, padded_dim: int) -> np.ndarray:
    """Diagonals ``[rotation, layer, i]`` of the keyed-hash rotations."""
    out = np.empty((rotations, LAYERS, padded_dim))
    for r in range(rotations):
        for layer in range(LAYERS):
            for i in range(padded_dim):
                digit = hashlib.md5(f"{seed}:{r}:{layer}:{i}".encode()).hexdigest()[0]
                out[r, layer, i] = 1.0 if digit < "8" else -1.0
    out.setflags(write=False)
    return out


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalized transform of every row; the row length is a power of two."""
    n = x.shape[-1]
    if n & (n - 1):
        raise ValueError("length must be a power of two")
    out = np.array(x, dtype=np.float64)
    rows = out.reshape(-1, n)
    half = 1
    while half < n:
        pairs = rows.reshape(rows.shape[0], n // (2 * half), 2, half)
        low, high = pairs[:, :, 0, :], pairs[:, :, 1, :]
        rows = np.stack((low + high, low - high), axis=2).reshape(-1, n)
        half *= 2
    return rows.reshape(out.shape)


def rotate(x: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Apply H D3 H D2 H D1 to every row."""
    for d in diagonals:
        x = walsh_hadamard(x * d)
    return x


def unrotate(x: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Apply the transpose, D1 H D2 H D3 H, to every row."""
    for d in diagonals[::-1]:
        x = walsh_hadamard(x) * d
    return x


def pad_rows(x: np.ndarray, padded_dim: int) -> np.ndarray:
    if x.shape[1] == padded_dim:
        return x
    return np.pad(x, ((0, 0), (0, padded_dim - x.shape[1])))


class RotationSet:
    """All rotations of one code, applied to batches of padded rows."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.padded_dim = weights.shape[2]
        self._matrices = None
        if self.padded_dim <= DENSE_LIMIT:
            eye = np.eye(self.padded_dim)
            self._matrices = np.stack([rotate(eye, d) for d in weights])

    def __len__(self) -> int:
        return self.weights.shape[0]

    def apply(self, x: np.ndarray, r: int) -> np.ndarray:
        return x @ self._matrices[r] if self._matrices is not None else rotate(x, self.weights[r])

    def components(self, x: np.ndarray):
        """Component and magnitude of every row and rotation."""
        n = x.shape[0]
        codes = np.empty((n, len(self)), dtype=np.int32)
        mags = np.empty((n, len(self)))
        rows = np.arange(n)
        for r in range(len(self)):
            y = self.apply(x, r)
            size = np.abs(y)
            peak = size.max(axis=1)
            axis = (size >= peak[:, None] * (1.0 - TIE_GAP)).argmax(axis=1)
            codes[:, r] = (axis << 1) | (y[rows, axis] < 0)
            mags[:, r] = size[rows, axis]
        return codes, mags

    def decode(self, codes: np.ndarray, factors: np.ndarray | None = None) -> np.ndarray:
        """The vector whose inner product with x is the code's asymmetric score of x.

        The score sum_r s_r (R_r x)[axis_r] is linear in x, so it equals <sum_r s_r R_r^T e_axis_r, x>.
        """
        n = codes.shape[0]
        total = np.zeros((n, self.padded_dim))
        rows = np.arange(n)
        for r in range(len(self)):
            axis, s = codes[:, r] >> 1, 1.0 - 2.0 * (codes[:, r] & 1)
            if factors is not None:
                s = s * factors[:, r]
            if self._matrices is not None:
                total += self._matrices[r][:, axis].T * s[:, None]
            else:
                spike = np.zeros((n, self.padded_dim))
                spike[rows, axis] = s
                total += unrotate(spike, self.weights[r])
        return total


@lru_cache(maxsize=8)
def keyed_rotations(seed: int, rotations: int, padded_dim: int) -> RotationSet:
    """Rotation sets are rebuilt from their seed in every worker, so no table is shipped."""
    return RotationSet(sign_weights(seed, rotations, padded_dim))
