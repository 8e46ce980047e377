"""Metric registry: one name, a Column distance for joined rows and a tile score for k-NN joins.

A Column distance reads ``query_id``, query columns ``q_*`` and base columns ``b_*``; smaller is
closer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearloom.functions import codes as C
from nearloom.functions import pairs, tiles
from nearloom.functions import vectors as V
from nearloom.params import CodeParams


@dataclass(frozen=True)
class Metric:
    """``query_columns`` and ``base_columns`` name what the distance reads from either side."""

    name: str
    query_columns: tuple[str, ...]
    base_columns: tuple[str, ...]
    column: Callable[[CodeParams | None], Column]
    tile: Callable[[CodeParams | None], object]


def _vector_metric(name: str) -> Metric:
    return Metric(
        name,
        ("embedding",),
        ("embedding",),
        lambda params: pairs.vector_distance(name, "q_embedding", "b_embedding"),
        lambda params: tiles.VectorScore(metric=name),
    )


METRICS: dict[str, Metric] = {name: _vector_metric(name) for name in V.VECTOR_METRICS}


def register(metric: Metric) -> None:
    """Add a metric, or replace one of the same name."""
    METRICS[metric.name] = metric


register(
    Metric(
        "asymmetric",
        ("embedding",),
        ("components",),
        lambda p: pairs.asymmetric_distance(p, "query_id", "q_embedding", "b_components"),
        lambda p: tiles.VectorScore("neg_dot", p.bits, p.padded_dim, p.seed),
    )
)
register(
    Metric(
        "hamming",
        ("primary", "residual"),
        ("primary", "residual"),
        lambda p: C.combined_hamming(
            "q_primary", "b_primary", "q_residual", "b_residual", p.shift if p.residual_bits else 0
        ).cast("double"),
        lambda p: tiles.HammingScore(p.bits, p.residual_bits, p.shift),
    )
)
register(
    Metric(
        "estimate",
        ("primary", "residual", "base", "scale"),
        ("primary", "residual"),
        lambda p: C.estimate(
            "q_base",
            "q_scale",
            C.combined_hamming("q_primary", "b_primary", "q_residual", "b_residual", p.shift if p.residual_bits else 0),
        ),
        lambda p: tiles.HammingScore(p.bits, p.residual_bits, p.shift),
    )
)


def distance(name: str, params: CodeParams | None = None) -> Column:
    """Distance column of a registered metric."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}")
    return METRICS[name].column(params)


def as_query_columns(name: str) -> list[Column]:
    return [F.col(c).alias(f"q_{c}") for c in METRICS[name].query_columns]


def as_base_columns(name: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}").alias(f"b_{c}") for c in METRICS[name].base_columns]
