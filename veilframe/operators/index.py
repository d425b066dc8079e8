"""Dense 0-based positions in a global order, without sorting everything in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.skew import attach
from veilframe.storage import materialize

BUCKET_ROWS = 100_000


def row_hash(seed: int, key: str | Column) -> Column:
    """32 hex digits that place a row in a reproducible pseudo-random order; rows with a NULL key share one place."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit(""))))


def _digits(counts: DataFrame) -> int:
    return counts.agg(F.max(F.length("_bucket"))).first()[0] or 1


def hash_counts(df: DataFrame, seed: int, key: str, by: Sequence[str] = (), lead: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Rows per ``by``, ``lead`` and leading hash digits, with ``_start`` = rows of the group placed before.

    The hash is uniform, so each of the 16^digits buckets holds an equal share of the rows however the keys look. The digits
    follow from the number of rows unless given: at most ``BUCKET_ROWS`` expected per bucket.
    """
    digits = digits or max(3, math.ceil(math.log(max(1, df.count()) / BUCKET_ROWS, 16)))
    bucket = F.substring(row_hash(seed, key), 1, digits).alias("_bucket")
    counts = materialize(df.groupBy(*by, *lead, bucket).agg(F.count(F.lit(1)).alias("_n")), "buckets")
    before = W.partitionBy(*by).orderBy(*lead, "_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def hash_index(
    df: DataFrame,
    key: str,
    seed: int = 42,
    by: Sequence[str] = (),
    lead: Sequence[str] = (),
    digits: int | None = None,
    name: str = "position",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Position of each row within ``by`` when ordered by ``lead`` and then by hash of ``key``.

    Bucket counts give each bucket its first position; a window per bucket gives the rest. Both are functions of the
    rows alone, so a recomputed task places its rows exactly as before. ``key`` must identify a row.
    """
    by, lead = list(by), list(lead)
    if counts is None:
        counts = hash_counts(df, seed, key, by, lead, digits)
    rows = df.withColumn("_hash", row_hash(seed, key)).withColumn("_bucket", F.substring("_hash", 1, _digits(counts)))
    inside = W.partitionBy(*by, *lead, "_bucket").orderBy("_hash", key)
    rows = rows.withColumn("_rank", F.row_number().over(inside))
    placed = attach(rows, counts.drop("_n"), [*by, *lead, "_bucket"], null_safe=True)
    return placed.select(*df.columns, (F.col("_start") + F.col("_rank") - 1).alias(name))


def hash_assign(
    df: DataFrame,
    key: str,
    counts: DataFrame,
    assign: Callable[[Column], Column],
    name: str,
    seed: int = 42,
    by: Sequence[str] = (),
    lead: Sequence[str] = (),
) -> DataFrame:
    """``assign(position)`` per row, for an ``assign`` that never goes back as the position grows.

    A bucket whose first and last position get the same value needs no ranks: its rows are marked by a broadcast of the
    bucket counts. Only the buckets that a boundary falls into are shuffled and ranked.
    """
    keys = [*by, *lead, "_bucket"]
    first, last = F.col("_start"), F.col("_start") + F.col("_n") - 1
    ends = counts.withColumn("_first", assign(first)).withColumn("_last", assign(last))
    rows = df.withColumn("_hash", row_hash(seed, key)).withColumn("_bucket", F.substring("_hash", 1, _digits(counts)))
    placed = attach(rows, ends, keys, null_safe=True)
    whole = placed.where("_first = _last").select(*df.columns, F.col("_first").alias(name))
    inside = W.partitionBy(*keys).orderBy("_hash", key)
    cut = placed.where("_first <> _last").withColumn("_rank", F.row_number().over(inside))
    return whole.unionByName(cut.select(*df.columns, assign(F.col("_start") + F.col("_rank") - 1).alias(name)))


def global_index(df: DataFrame, order: Sequence[str], partitions: int | None = None, name: str = "position") -> DataFrame:
    """Position of each row in the order of arbitrary columns; ``order`` must be unique per row.

    Rows are range-partitioned and written once with their partition number, because range bounds are sampled and a
    second evaluation could draw them differently. Partition sizes (one row per partition) then offset local ranks.
    """
    order = list(order)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return attach(rows, starts, ["_part"]).select(*df.columns, (F.col("_start") + F.col("_rank") - 1).alias(name))
