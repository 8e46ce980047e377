"""Validated, immutable parameters of the encoders, graphs and searches."""

from __future__ import annotations

from dataclasses import dataclass


def next_power_of_two(n: int) -> int:
    """Smallest power of two that is at least ``n``."""
    if n < 1:
        raise ValueError("dim must be > 0")
    return 1 << (n - 1).bit_length()


def _check(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in [{low}, {high}], got {value}")


@dataclass(frozen=True)
class CodeParams:
    """How vectors become codes.

    ``bits`` rotations make the primary code and ``residual_bits`` further ones the residual
    code; ``shift`` weights a primary bit 2**shift times a residual bit.
    """

    dim: int
    bits: int = 32
    residual_bits: int = 0
    shift: int = 2
    seed: int = 42

    def __post_init__(self):
        if self.dim < 1:
            raise ValueError("dim must be > 0")
        _check("bits", self.bits, 1, 256)
        _check("residual_bits", self.residual_bits, 0, 256)
        _check("shift", self.shift, 0, 8)

    @property
    def padded_dim(self) -> int:
        return next_power_of_two(self.dim)

    @property
    def mode(self) -> str:
        return "residual" if self.residual_bits else "sign"

    @property
    def effective_bits(self) -> int:
        """Largest combined Hamming distance: the divisor of the query scale."""
        if self.residual_bits == 0:
            return self.bits
        return self.bits * (1 << self.shift) + self.residual_bits


@dataclass(frozen=True)
class GraphParams:
    """Links made per node, node capacity and pruning of a neighbour graph."""

    m_links: int = 32
    max_degree: int = 64
    ef_construction: int = 200
    k_entry: int = 4
    alpha: float = 1.1
    keep_pruned: bool = True

    def __post_init__(self):
        _check("m_links", self.m_links, 1, 64)
        _check("max_degree", self.max_degree, 1, 64)
        _check("ef_construction", self.ef_construction, self.m_links, 10000)
        _check("k_entry", self.k_entry, 1, 100)
        _check("alpha", self.alpha, 1.0, 3.0)


@dataclass(frozen=True)
class SearchParams:
    """Size of the beam, of the result and of the exact re-ranking.

    ``width`` is the number of beam nodes each query expands per round; 1 is strict best-first.
    """

    k: int = 10
    ef: int = 100
    num_entry_points: int = 1
    rerank: bool = True
    rerank_k: int = 200
    width: int = 1
    max_iter: int = 10000

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be > 0")
        if self.ef < self.k:
            raise ValueError("ef must be >= k")
        if self.rerank and self.rerank_k < self.k:
            raise ValueError("rerank_k must be >= k")
        _check("num_entry_points", self.num_entry_points, 1, 100)
        _check("width", self.width, 1, self.ef)

    @property
    def effective_rerank_k(self) -> int:
        """A beam of ``ef`` holds no more than ``ef`` candidates."""
        return min(self.rerank_k, self.ef)
