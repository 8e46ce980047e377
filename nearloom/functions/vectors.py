"""Vector arithmetic as Column builders over array columns. All arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearloom.params import next_power_of_two


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product of two arrays."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    """Euclidean length."""
    return F.sqrt(
        F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def normalize(v) -> Column:
    """Divide by the length; a vector no longer than 1e-10 stays unchanged."""
    v = _col(v)
    # A one-element array binds the length, which would else be computed again per element.
    divisor = F.transform(F.array(norm(v)), lambda n: F.when(n > 1e-10, n).otherwise(1.0))
    return F.element_at(F.transform(divisor, lambda d: F.transform(v, lambda x: x.cast("double") / d)), 1)


def l2sq(a, b) -> Column:
    """Squared Euclidean distance."""
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d * d)


def neg_dot(a, b) -> Column:
    """Inner product turned into a distance."""
    return -dot(a, b)


def cosine(a, b) -> Column:
    """Cosine distance of unit vectors, 1 - dot."""
    return F.lit(1.0) - dot(a, b)


def pad(v, dim: int) -> Column:
    """Zero-pad to the next power of two of ``dim``."""
    v = _col(v)
    missing = next_power_of_two(dim) - dim
    if missing == 0:
        return v
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), missing))


def rounded(v, digits: int = 6) -> Column:
    """Round every element; ``+ 0.0`` turns a negative zero into zero."""
    return F.transform(_col(v), lambda x: F.round(x.cast("double"), digits) + F.lit(0.0))


# metric name -> distance between two vector columns
VECTOR_METRICS = {"neg_dot": neg_dot, "cosine": cosine, "l2sq": l2sq}
