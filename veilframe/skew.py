"""Keyed joins and running aggregates that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.storage import materialize, materialize_counted, materialize_measured, measure

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, max_keys: int = BROADCAST_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, at most ``max_keys`` of them, with their row count ``n``; None if there are none.

    Partially aggregated counts over the key columns only. At most N/hot_rows keys qualify; when that is still more
    than ``max_keys`` the threshold rises until the list can be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= hot_rows:
        return None
    hot, n = materialize_counted(counts.where(F.col("n") > hot_rows), "hot")
    while n > max_keys:
        hot_rows *= 4
        hot = hot.where(F.col("n") > hot_rows)
        n = hot.count()
    return hot


def attach(
    df: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    written: bool = True,
    null_safe: bool = False,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``side`` (unique per key) to ``df``; how = inner, left, left_semi or left_anti.

    ``side`` is written once (unless it holds secrets or is a written table already: ``written=False``), counted and measured. Up to
    ``max_rows`` rows and ``max_bytes`` it is broadcast and ``df`` is not shuffled. A larger side is joined by shuffle for ordinary keys, while
    the rows of hot keys meet a broadcast of just their side rows, as long as these stay below ``max_bytes``.
    ``null_safe`` lets NULL keys meet, for sides that were grouped from the rows themselves.
    """
    keys = list(keys)
    if null_safe:
        marked = df.withColumns(_null_safe(keys))
        side = side.withColumns(_null_safe(keys)).drop(*keys)
        return attach(marked, side, list(_null_safe(keys)), how, max_rows, hot_rows, written, max_bytes=max_bytes).drop(*_null_safe(keys))
    side, n, size = materialize_measured(side, "side") if written else (side, *measure(side))
    if n <= max_rows and size <= max_bytes:
        return df.join(F.broadcast(side), keys, how)
    if df.isStreaming:
        return df.join(side, keys, how)
    hot = hot_keys(df, keys, hot_rows, max_rows)
    if hot is None:
        return df.join(side, keys, how)
    hot = hot.select(*keys)
    hot_side = side.join(F.broadcast(hot), keys, "left_semi")
    if measure(hot_side)[1] > max_bytes:
        return df.join(side, keys, how)
    hot_part = df.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(hot_side), keys, how)
    rest = df.join(F.broadcast(hot), keys, "left_anti").join(side, keys, how)
    return rest.unionByName(hot_part)


def _null_safe(keys: Sequence[str]) -> dict[str, Column]:
    """Stand-ins that are never NULL: a struct with the key as its field."""
    return {f"_ns_{k}": F.struct(F.col(k).alias("key")) for k in keys}


# how -> (aggregate over rows, combination of a carried and a local value)
_RUNNING = {
    "max": (F.max, lambda carry, local: F.greatest(carry, local)),
    "sum": (F.sum, lambda carry, local: F.coalesce(carry + local, carry, local)),
    "count": (F.count, lambda carry, local: F.coalesce(carry, F.lit(0)) + local),
}


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    outputs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running max / sum / count per key in the order of one integer column.

    Ordinary keys use one window per key. A key with more than ``hot_rows`` rows is cut into equal-depth blocks of the
    order column: each block is a window of its own, started from the combined aggregate of the blocks before it.
    """
    by = list(by)
    last = 0 if inclusive else -1
    hot = hot_keys(df, by, hot_rows)
    if hot is None:
        frame = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, last)
        return df.select("*", *[_RUNNING[how][0](expr).over(frame).alias(c) for c, (how, expr) in outputs.items()])

    top = hot.agg(F.max("n")).first()[0]
    blocks = -(-top // hot_rows) + 1
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = materialize(
        df.join(F.broadcast(hot.select(*by)), by, "left_semi").groupBy(*by).agg(
            F.percentile_approx(order, cuts, 20 * blocks).alias("_cuts")
        ),
        "cuts",
    )
    block = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0)).alias("_block")
    partial = {c: f"_p{i}" for i, c in enumerate(outputs)}
    carry_cols = {c: f"_c{i}" for i, c in enumerate(outputs)}
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        df.join(F.broadcast(bounds), by)
        .withColumn("_block", block)
        .groupBy(*by, "_block")
        .agg(*[_RUNNING[how][0](expr).alias(partial[c]) for c, (how, expr) in outputs.items()])
        .select(
            *by,
            "_block",
            *[
                (F.max if how == "max" else F.sum)(partial[c]).over(before).alias(carry_cols[c])
                for c, (how, _) in outputs.items()
            ],
        )
    )
    frame = W.partitionBy(*by, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, last)
    local = df.join(F.broadcast(bounds), by, "left").withColumn("_block", block).drop("_cuts")
    local = local.select("*", *[_RUNNING[h][0](e).over(frame).alias(partial[c]) for c, (h, e) in outputs.items()])
    return attach(local, carry, [*by, "_block"], "left").select(
        *df.columns,
        *[_RUNNING[how][1](F.col(carry_cols[c]), F.col(partial[c])).alias(c) for c, (how, _) in outputs.items()],
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
