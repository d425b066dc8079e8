"""Deterministic noise: every draw is a function of the seed and the row's keys.

``randn(seed)`` depends on how rows fall into partitions; a released value must not change when a task is retried or
the partition count differs, so the uniforms come from a hash of the keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MECHANISMS = ("laplace", "gaussian")
_DIGITS = 13  # hex digits per uniform = 52 bits


def uniform(seed: int | str, keys: Sequence[str | Column], lane: int = 0) -> Column:
    """Uniform in (0, 1) from the sha256 of seed and keys; lanes give independent draws for one row.

    Each part goes in as ``length:text,`` and NULL as ``-,``, so no two lists of keys spell the same text.
    """
    digest = F.sha2(F.concat(*[_text(k) for k in (F.lit(str(seed)), *keys)]), 256)
    part = F.substring(digest, 1 + _DIGITS * lane, _DIGITS)
    return (F.conv(part, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** (4 * _DIGITS)))


def _text(key: str | Column) -> Column:
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(",")), F.lit("-,"))


def gaussian(scale: Column, seed: int | str, keys: Sequence[str | Column]) -> Column:
    """N(0, scale^2) by the Box-Muller transform."""
    u, v = uniform(seed, keys, 0), uniform(seed, keys, 1)
    return scale * F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def laplace(scale: Column, seed: int | str, keys: Sequence[str | Column]) -> Column:
    """Lap(0, scale) by inverting its distribution function."""
    centred = uniform(seed, keys, 0) - F.lit(0.5)
    return -scale * F.signum(centred) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def noise_scale(mechanism: str | Column, epsilon, delta=1e-5, sensitivity=1.0) -> Column:
    """Scale of the noise: ``s/eps`` (laplace) or ``sqrt(2 ln(1.25/delta)) s/eps`` (gaussian).

    Every argument may be a column, so budget and sensitivity can differ per row.
    """
    if isinstance(mechanism, str) and mechanism not in MECHANISMS:
        raise ValueError(f"no such noise mechanism: {mechanism}")
    kind = F.lit(mechanism) if isinstance(mechanism, str) else mechanism
    eps, dlt, sens = _num(epsilon), _num(delta), _num(sensitivity)
    return (
        F.when(kind == "laplace", sens / eps)
        .when(kind == "gaussian", F.sqrt(F.lit(2.0) * F.ln(F.lit(1.25) / dlt)) * sens / eps)
        .otherwise(F.raise_error(F.concat(F.lit("no such noise mechanism: "), kind)).cast("double"))
    )


def draw(mechanism: str | Column, scale: Column, seed: int | str, keys: Sequence[str | Column]) -> Column:
    """Noise of the named mechanism."""
    kind = F.lit(mechanism) if isinstance(mechanism, str) else mechanism
    return F.when(kind == "laplace", laplace(scale, seed, keys)).otherwise(gaussian(scale, seed, keys))


def _num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


# Upper bound of the budget (exclusive) and the text reported for it; the last applies from 10 upwards.
PRIVACY_BANDS = [
    (0.1, "Extremely Strong (epsilon < 0.1)"),
    (0.5, "Very Strong (0.1 <= epsilon < 0.5)"),
    (1.0, "Strong (0.5 <= epsilon < 1.0) [RECOMMENDED]"),
    (5.0, "Moderate (1.0 <= epsilon < 5.0)"),
    (10.0, "Weak (5.0 <= epsilon < 10.0)"),
]
WEAKEST_BAND = "Very Weak (epsilon >= 10.0)"


def privacy_level(epsilon: Column) -> Column:
    """Readable strength of a per-round budget."""
    level = F.lit(WEAKEST_BAND)
    for bound, text in reversed(PRIVACY_BANDS):
        level = F.when(epsilon < bound, text).otherwise(level)
    return level
