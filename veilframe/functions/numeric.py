"""Small numeric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 256  # vectors up to this length become one expression per element


def fixed(col: Column | str, digits: int = 9) -> Column:
    """Round half up at ``digits`` decimals with plain double arithmetic, so every SQL engine gives the same bits."""
    scale = F.lit(float(10**digits))
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * scale + F.lit(0.5)) / scale


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def dot(weights: Column, x: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(
        F.zip_with(weights, x, lambda w, v: w * v.cast("double")), F.lit(0.0), lambda acc, p: acc + p
    )


def literal_array(values: list[float]) -> Column:
    """Array literal of doubles, built as one SQL expression."""
    return F.expr(f"array({', '.join(_double(v) for v in values)})") if values else F.array().cast("array<double>")


def linear(weights: list[float], features: list[str], bias: float) -> Column:
    """``w.x + b`` over wide columns with the model as literals; long models stay arrays to keep the plan flat."""
    if len(weights) != len(features):
        raise ValueError(f"model has {len(weights)} weights for {len(features)} features")
    if len(weights) > UNROLL:
        return dot(literal_array(weights), F.array(*features)) + F.lit(float(bias))
    terms = [_double(bias)] + [f"{_double(w)} * `{f}`" for w, f in zip(weights, features, strict=True)]
    return F.expr(" + ".join(terms))


def _double(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError(f"parameter is {value}")
    return f"({float(value)!r}D)"
