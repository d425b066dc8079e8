"""Preparing a labelled table: cleaning, encoding, splitting, scaling, assignment to clients."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from veilframe.operators.index import global_index, hash_assign, hash_counts, row_hash
from veilframe.skew import BROADCAST_ROWS, attach
from veilframe.storage import materialize_counted

# Candidate columns of the census income table and its missing-value marker.
NUMERIC_CANDIDATES = ["age", "capital-gain", "capital-loss", "hours-per-week", "educational-num", "education-num"]
CATEGORICAL_CANDIDATES = ["workclass", "education", "marital-status", "occupation", "relationship", "race", "gender"]
MISSING = "?"
LABEL_SKEW_NAMES = ("non-iid", "noniid", "label_skew")


def null_markers(df: DataFrame, cols: Sequence[str] | None = None, marker: str = MISSING) -> DataFrame:
    """Exact ``marker`` becomes NULL in the string columns."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    chosen = strings & set(cols if cols is not None else df.columns)
    return df.select(*[F.nullif(_c(c), F.lit(marker)).alias(c) if c in chosen else _c(c) for c in df.columns])


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows whose feature columns are all present. Call before selecting features."""
    return df.where(reduce(lambda a, b: a & b, [_c(c).isNotNull() for c in cols], F.lit(True)))


def binary_label(df: DataFrame, col: str, positive: str = ">50K", name: str = "y") -> DataFrame:
    """1 when the text without dots and outer blanks equals ``positive``, else 0 (also for NULL)."""
    text = F.trim(F.replace(_c(col).cast("string"), F.lit("."), F.lit("")))
    return df.withColumn(name, F.coalesce((text == positive).cast("int"), F.lit(0)))


def resolve_features(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Candidates that exist in ``df``, in candidate order."""
    present = set(df.columns)
    return [c for c in candidates if c in present]


def cast_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    target = {**dict.fromkeys(numeric, "double"), **dict.fromkeys(categorical, "string")}
    return df.select(*[_c(c).cast(target[c]).alias(c) if c in target else _c(c) for c in df.columns])


def onehot_fit(df: DataFrame, categorical: Sequence[str], offset: int = 0) -> DataFrame:
    """Dictionary ``(idx, name, feature, level)`` of the indicator columns.

    Levels are sorted by code point and the first of each column is dropped. Positions start at ``offset`` and follow
    the order of ``categorical``. All columns are read in one pass; only distinct levels are shuffled, and a level
    table too long for one window is numbered by range partitions.
    """
    pairs = F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("feature"), _c(c).cast("string").alias("level")) for i, c in enumerate(categorical)]
    )
    levels = df.select(F.explode(pairs).alias("p")).select("p.*").where("level IS NOT NULL").distinct()
    levels, n = materialize_counted(levels, "levels")
    if n <= BROADCAST_ROWS:
        placed = levels.withColumn("position", F.row_number().over(W.orderBy("ord", "level")) - 1)
        kept = placed.withColumn("rank", F.row_number().over(W.partitionBy("ord").orderBy("level"))).where("rank > 1")
    else:
        placed = global_index(levels, ["ord", "level"])
        first = placed.groupBy("ord").agg(F.min("position").alias("first"))
        kept = attach(placed, first, ["ord"]).where("position > first")
    # each of the ord + 1 columns up to this one gave up one level
    return kept.select(
        (F.col("position") - F.col("ord") - 1 + F.lit(offset)).cast("int").alias("idx"),
        F.concat_ws("_", "feature", "level").alias("name"),
        "feature",
        "level",
    )


def onehot_transform(df: DataFrame, dictionary: DataFrame, numeric: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide matrix ``keep.., f_0..f_{d-1}``: numeric columns first, then one indicator per dictionary row.

    Every level is a column of the plan, which suits some thousand levels; ``sparse.sparse_rows`` takes any number.
    """
    rows = dictionary.orderBy("idx").collect()
    return assemble(df, numeric, [F.when(_c(r.feature) == r.level, 1.0).otherwise(0.0) for r in rows], keep)


def assemble(df: DataFrame, numeric: Sequence[str], indicators: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Numeric columns, then indicators, as ``f_0..f_{d-1}``."""
    features = [_c(c).cast("double") for c in numeric] + list(indicators)
    return df.select(*[_c(c) for c in keep], *[f.alias(f"f_{i}") for i, f in enumerate(features)])


def onehot_sparse(df: DataFrame, dictionary: DataFrame, categorical: Sequence[str], row_key: str) -> DataFrame:
    """Non-zero indicators ``(row_key, idx)`` for any number of levels."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), _c(c).cast("string").alias("level")) for c in categorical])
    long = df.select(row_key, F.explode(pairs).alias("p")).select(row_key, "p.*")
    return attach(long, dictionary.select("feature", "level", "idx"), ["feature", "level"]).select(row_key, "idx")


def feature_columns(df: DataFrame) -> list[str]:
    """``f_0..`` of a wide matrix, in position order."""
    return sorted((c for c in df.columns if c.startswith("f_")), key=lambda c: int(c[2:]))


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42, exact: bool = False, name: str = "split"
) -> DataFrame:
    """Mark each row 'train' or 'test' with the same share of test rows in every class.

    The default compares the row's hash with a threshold: no shuffle, stable when rows are added. ``exact`` takes the
    first ``round(test * n)`` rows of each class in hash order.
    """
    if not exact:
        threshold = f"{int(test * 2**32):08x}"
        picked = F.substring(row_hash(seed, key), 1, 8) < threshold
        return df.withColumn(name, F.when(picked, "test").otherwise("train"))
    counts = hash_counts(df, seed, key, by=[label])
    total = F.sum("_n").over(W.partitionBy(label))
    counts = counts.withColumn("_wanted", F.floor(total * F.lit(test) + F.lit(0.5)))

    def side(position: Column) -> Column:
        return F.when(position < F.col("_wanted"), "test").otherwise("train")

    return hash_assign(df, key, counts, side, name, seed, by=[label])


def scale_fit(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, in one pass; a constant column gets divisor 1."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.array(*[_c(c).cast("double") for c in cols])))
    row = train.agg(summary.alias("s")).first().s
    if not row["count"]:
        raise ValueError("no rows to fit the scaling on")
    shrink = (row["count"] - 1) / row["count"]  # from the sample to the population variance
    return {c: (float(m), math.sqrt(v * shrink) or 1.0) for c, m, v in zip(cols, row["mean"], row["variance"], strict=True)}


def scale_transform(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scores with the fitted statistics as literals."""
    return df.select(
        *[
            ((_c(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c) if c in stats else _c(c)
            for c in df.columns
        ]
    )


def assign_clients(
    df: DataFrame,
    n: int,
    key: str,
    strategy: str = "iid",
    label: str = "y",
    seed: int = 42,
    label_skew: bool = False,
    name: str = "client_id",
) -> DataFrame:
    """Cut the rows into ``n`` contiguous chunks of floor(N/n); the last client takes the remainder.

    'iid' cuts hash order; 'non-iid', 'noniid', 'label_skew' (or ``label_skew=True``) cut label order, hash within
    label.
    """
    if n < 1:
        raise ValueError(f"cannot cut rows into {n} clients")
    skewed = label_skew or strategy.lower() in LABEL_SKEW_NAMES
    lead = [label] if skewed else []
    counts = hash_counts(df, seed, key, lead=lead)
    total, buckets = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    chunk = total // n
    if chunk == 0:
        raise ValueError(f"{n} clients need a row each, there are {total}")

    def client(position: Column) -> Column:
        return F.least(F.floor(position / F.lit(chunk)), F.lit(n - 1)).cast("int")

    if buckets > BROADCAST_ROWS:  # a label with very many values: order the rows themselves
        ordered = df.withColumn("_hash", row_hash(seed, key))
        placed = global_index(ordered, [*lead, "_hash", key], name="_pos")
        return placed.select(*df.columns, client(F.col("_pos")).alias(name))
    return hash_assign(df, key, counts, client, name, seed, lead=lead)


def split_summary(df: DataFrame, label: str = "y") -> DataFrame:
    """Rows and positive share per split and client."""
    return df.groupBy("split", "client_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(_c(label).cast("double")).alias("positive_share")
    )


def _c(name: str) -> Column:
    return F.col(f"`{name}`")
