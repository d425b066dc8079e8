"""Combining client updates into a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.skew import attach, union_all
from veilframe.storage import materialize, materialize_counted

ELEMENT = ("round", "param", "idx")
MEDIAN_ROWS = 100_000
SKETCH_K = 200
GRID = 256  # quantiles that are read from a sketch at a time


def collect_updates(updates: DataFrame, round: int | None = None) -> DataFrame:
    """Usable updates, of one round if given: present and non-NaN values from clients with a positive row count."""
    usable = updates.where("value IS NOT NULL AND NOT isnan(value) AND num_samples > 0")
    return usable if round is None else usable.where(F.col("round") == round)


def element_counts(updates: DataFrame, by: Sequence[str] = ELEMENT) -> DataFrame:
    """Clients and total weight behind every element."""
    return updates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clients"), F.sum("num_samples").alias("total_samples")
    )


def fedavg(updates: DataFrame, by: Sequence[str] = ELEMENT) -> DataFrame:
    """Row-count-weighted mean per element; NULL when the total weight is zero."""
    weighted = F.sum(F.col("num_samples") * F.col("value"))
    return updates.groupBy(*by).agg(F.try_divide(weighted, F.sum("num_samples")).alias("value"))


def median_sketch(updates: DataFrame, by: Sequence[str] = ELEMENT, k: int = SKETCH_K) -> DataFrame:
    """A mergeable quantile sketch per element, ``(by.., n, sketch)``; works on streams too."""
    usable = collect_updates(updates)
    return usable.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merge_sketches(parts: DataFrame, by: Sequence[str] = ELEMENT, k: int = SKETCH_K) -> DataFrame:
    """Sketches of the union of written partials."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_median(sketches: DataFrame) -> DataFrame:
    """``value``: the median of each sketch, by rank within about 1.7 % of the count at the default size."""
    return sketches.withColumn("value", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).drop("sketch")


def median_update(updates: DataFrame, by: Sequence[str] = ELEMENT, max_group_rows: int = MEDIAN_ROWS, k: int = SKETCH_K) -> DataFrame:
    """Exact unweighted median per element; the mean of the middle two when the count is even.

    Groups of up to ``max_group_rows`` use the built-in median. For larger ones a sketch of the values brackets a middle rank; the next pass
    counts what lies below, at and between the bracket's ends and sketches what is between, until the rank is at an end or at most
    ``max_group_rows`` values are between. So no task ever holds more than that of a group, and every pass but the last moves one sketch
    per group and task.
    """
    by = list(by)
    updates = collect_updates(updates)
    sizes, n_groups = materialize_counted(updates.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "sizes")
    if not n_groups or sizes.agg(F.max("n")).first()[0] <= max_group_rows:
        return updates.groupBy(*by).agg(F.median("value").alias("value"))
    small = attach(updates.select(*by, "value"), sizes.where(F.col("n") <= max_group_rows), by).groupBy(*by).agg(F.median("value").alias("value"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    ranks = sizes.where(F.col("n") > max_group_rows).select(*by, F.explode(middle).alias("r"))
    rows = attach(updates.select(*by, "value"), sizes.where(F.col("n") > max_group_rows).select(*by), by)

    v, lo, hi, r = (F.col(c) for c in ("value", "lo", "hi", "r"))
    between = (v > lo) & (v < hi)
    edges = {"lo": float("-inf"), "hi": float("inf"), "above": float("-inf"), "under": float("inf")}  # the value is in (above, under)
    open_ = ranks.withColumns({c: F.lit(x) for c, x in edges.items()})
    found, short = [], []
    while not open_.isEmpty():
        seen = attach(rows, open_, by).groupBy(*by, "r", *edges).agg(
            F.count(F.when(v < lo, 1)).alias("below"),
            F.count(F.when(v == lo, 1)).alias("at_lo"),
            F.count(F.when(between, 1)).alias("between"),
            F.count(F.when((v == hi) & (hi > lo), 1)).alias("at_hi"),
            F.kll_sketch_agg_double(F.when(between, v), F.lit(k)).alias("sketch"),
        )
        start, end = F.col("below") + F.col("at_lo"), F.col("below") + F.col("at_lo") + F.col("between")
        now = materialize(seen.withColumns({"start": start, "end": end}), "brackets")
        start, end = F.col("start"), F.col("end")
        low, at_lo, at_hi = r < F.col("below"), (r >= F.col("below")) & (r < start), (r >= end) & (r < end + F.col("at_hi"))
        inside = (r >= start) & (r < end)
        found.append(now.where(at_lo | at_hi).select(*by, "r", F.when(at_lo, lo).otherwise(hi).alias("value")))
        short.append(now.where(inside & (F.col("between") <= max_group_rows)).select(*by, "r", "lo", "hi", "start"))
        left = now.where(~at_lo & ~at_hi & ~(inside & (F.col("between") <= max_group_rows)))
        share, slack = (r - start) / F.col("between"), F.lit(8.0 / k)  # several times the sketch's rank error
        grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        steps = (F.greatest(F.floor((share - slack) * GRID), F.lit(0)), F.least(F.ceil((share + slack) * GRID), F.lit(GRID)))
        ends = [F.get(grid, at.cast("int")) for at in steps]
        missed = [F.when(low, F.col("above")).otherwise(hi), F.when(low, lo).otherwise(F.col("under"))]
        open_ = materialize(
            left.select(
                *by,
                "r",
                *[F.when(inside, new).otherwise(other).alias(c) for c, new, other in zip(("lo", "hi"), ends, missed, strict=True)],
                F.when(inside, lo).otherwise(F.col("above")).alias("above"),
                F.when(inside, hi).otherwise(F.col("under")).alias("under"),
            ),
            "open",
        )
    held = attach(rows, materialize(union_all(short), "short"), by).where(between)
    arrays = held.groupBy(*by, "r", "start").agg(F.sort_array(F.collect_list("value")).alias("x"))
    picked = arrays.select(*by, "r", F.get("x", (r - F.col("start")).cast("int")).alias("value"))
    large = union_all([*found, picked]).groupBy(*by).agg(F.avg("value").alias("value"))
    return small.unionByName(large)


def combine(updates: DataFrame, previous: DataFrame, how: str = "fedavg", by: Sequence[str] = ELEMENT) -> DataFrame:
    """New model; elements without any usable update keep their previous value."""
    if how not in ("fedavg", "median"):
        raise ValueError(f"combine by fedavg or median, not {how}")
    usable = collect_updates(updates)
    new = fedavg(usable, by) if how == "fedavg" else median_update(usable, by)
    old = previous.select(*by, F.col("value").alias("_old"))
    return new.join(old, list(by), "full_outer").select(*by, F.coalesce("value", "_old").alias("value"))


def to_rows(model: DataFrame, shapes: Mapping[str, tuple[int, ...]], by: Sequence[str] = ("round", "param")) -> DataFrame:
    """Row-major offsets back to matrix rows: ``(by.., row, x array<double>)``, one array per row of the shape."""
    width = F.lit(None).cast("int")
    for param, shape in shapes.items():
        width = F.when(F.col("param") == param, F.lit(shape[-1])).otherwise(width)
    placed = model.withColumn("row", F.floor(F.col("idx") / width).cast("int")).withColumn("col", F.col("idx") % width)
    cells = F.array_sort(F.collect_list(F.struct("col", "value")))
    return placed.groupBy(*by, "row").agg(F.transform(cells, lambda c: c["value"]).alias("x"))


def to_elements(rows: DataFrame, by: Sequence[str] = ("round", "param")) -> DataFrame:
    """Matrix rows to row-major long form."""
    long = rows.select(*by, "row", F.size("x").alias("_w"), F.posexplode("x").alias("_col", "value"))
    return long.select(*by, (F.col("row") * F.col("_w") + F.col("_col")).cast("int").alias("idx"), "value")
