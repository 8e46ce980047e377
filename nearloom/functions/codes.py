"""Code arithmetic as Column builders: components, sign words, Hamming and asymmetric scores.

A component is ``(axis << 1) | negative``. Sign codes are ``array<bigint>`` of 64-bit words,
bit ``r % 64`` of word ``r // 64`` belonging to rotation ``r``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearloom.functions.vectors import norm

WORD_BITS = 64


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_component(axis, value) -> Column:
    """``(axis << 1) | (value < 0)``."""
    return F.shiftleft(_col(axis), 1).bitwiseOR((_col(value) < 0).cast("int"))


def component_axis(c) -> Column:
    return F.shiftright(_col(c), 1)


def component_sign(c) -> Column:
    """+1 or -1."""
    return F.lit(1) - F.lit(2) * _col(c).bitwiseAND(F.lit(1))


def quantize_magnitude(mag, scale: float = 255.0) -> Column:
    """Scale, clamp to 0..255 and truncate."""
    scaled = _col(mag).cast("double") * F.lit(float(scale))
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int")


def dequantize_magnitude(q, scale: float = 1.0 / 255.0) -> Column:
    return _col(q).cast("double") * F.lit(float(scale))


def sign_words(components, bits: int) -> Column:
    """Pack the sign bits of ``bits`` components into 64-bit words."""
    components = _col(components)

    def word(w: int) -> Column:
        rotations = range(w * WORD_BITS, min(bits, (w + 1) * WORD_BITS))
        parts = [
            F.shiftleft(components[r].bitwiseAND(F.lit(1)).cast("bigint"), r % WORD_BITS)
            for r in rotations
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    if bits == 0:
        return F.array().cast("array<bigint>")
    return F.array(*[word(w) for w in range(-(-bits // WORD_BITS))])


def bit_get(words, bit: int) -> Column:
    """Value 0 or 1 of one bit."""
    return F.shiftrightunsigned(_col(words)[bit // WORD_BITS], bit % WORD_BITS).bitwiseAND(F.lit(1)).cast("int")


def bit_set(words, bit: int, value: bool) -> Column:
    """Words with one bit set or cleared."""
    word, mask = bit // WORD_BITS, 1 << (bit % WORD_BITS)
    signed = mask - (1 << 64) if mask >= 1 << 63 else mask

    def change(x, i):
        changed = x.bitwiseOR(F.lit(signed)) if value else x.bitwiseAND(F.lit(~signed))
        return F.when(i == word, changed).otherwise(x)

    return F.transform(_col(words), change)


def clear_bits(words) -> Column:
    return F.transform(_col(words), lambda x: F.lit(0).cast("bigint"))


def codes_equal(a, b) -> Column:
    return _col(a) == _col(b)


def hamming(a, b) -> Column:
    """Number of differing bits of two word arrays."""
    counts = F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)


def combined_hamming(primary_a, primary_b, residual_a, residual_b, shift: int) -> Column:
    """``(primary << shift) + residual``; empty residuals add nothing."""
    return F.shiftleft(hamming(primary_a, primary_b), shift) + hamming(residual_a, residual_b)


def estimate(base, scale, combined) -> Column:
    """``base + scale * combined``."""
    return _col(base) + _col(scale) * _col(combined)


def primary_weight(shift: int) -> float:
    return (1 << shift) / ((1 << shift) + 1)


def residual_weight(shift: int) -> float:
    return 1 / ((1 << shift) + 1)


def query_scale(vec, avg_norm, effective_bits: int) -> Column:
    """``2 * |q| * avg_norm / effective_bits``."""
    return F.lit(2.0) * norm(vec) * _col(avg_norm) / F.lit(float(effective_bits))


def component_hamming(a, b) -> Column:
    """Number of rotations whose components differ."""
    return F.size(F.filter(F.zip_with(_col(a), _col(b), lambda x, y: x != y), lambda d: d))


def _signed_values(rotated, components) -> Column:
    """Per rotation, the query's value at the stored axis with the stored sign."""
    return F.zip_with(
        _col(rotated), _col(components), lambda x, c: component_sign(c) * F.get(x, component_axis(c))
    )


def asymmetric_distance(rotated, components) -> Column:
    """Minus the sum over rotations of the query's signed value at the stored axis."""
    return -F.aggregate(_signed_values(rotated, components), F.lit(0.0), lambda acc, x: acc + x)


def weighted_score(rotated, components, magnitudes) -> Column:
    """Sum of sign * query value * stored magnitude; larger is closer."""
    products = F.zip_with(_signed_values(rotated, components), _col(magnitudes), lambda x, m: x * m)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
