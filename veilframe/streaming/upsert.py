"""Result tables that a stream in update mode keeps up to date.

Rows lie in hash buckets of their key. A micro-batch writes its changed rows, merges them with the rows of just these buckets into new
folders, and last of all commits a manifest, a small file that names the folder of every bucket. Folders are never touched again: an
earlier manifest stays readable, a batch that comes again after its manifest does nothing, and one that died before it starts over.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from veilframe.sources.events import start_batches
from veilframe.storage import commit_text, names_in, read_text

BUCKETS = 16


def _manifests(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in names_in(spark, f"{path}/manifests")]


def _folders(spark: SparkSession, path: str, batch: int | None) -> dict[int, str]:
    if batch is None:
        return {}
    return {int(k): v for k, v in json.loads(read_text(spark, f"{path}/manifests/{batch:012d}.json")).items()}


def _laid(rows: DataFrame, path: str, buckets: int) -> dict[int, str]:
    """Write rows by bucket; the folder of each bucket that has any."""
    rows.repartition(buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    names = [n for n in names_in(rows.sparkSession, path) if n.startswith("_bucket=")]
    return {int(n.split("=")[1]): f"{path}/{n}" for n in names}


def upsert(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], order: str | None = None, buckets: int = BUCKETS) -> None:
    """Replace the rows of the batch's keys. With ``order`` the last row of a key counts, else the batch has one row of each."""
    spark, keys = batch.sparkSession, list(keys)
    done = _manifests(spark, path)
    if batch_id in done:
        return
    before = _folders(spark, path, max((b for b in done if b < batch_id), default=None))
    rows = batch
    if order:
        last = F.max_by(F.struct(*batch.columns), order).alias("r")
        rows = batch.groupBy(*[F.struct(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(last).select("r.*")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    now = _laid(rows.withColumn("_bucket", bucket), f"{path}/changes/batch={batch_id}", buckets)
    touched = {b: folder for b, folder in before.items() if b in now}
    if touched:
        schema = batch.schema
        new = spark.read.schema(schema).parquet(*[now[b] for b in touched])
        old = spark.read.schema(schema).parquet(*touched.values())
        same = [old[k].eqNullSafe(new[k]) for k in keys]
        merged = old.join(new, same, "left_anti").unionByName(new).withColumn("_bucket", bucket)
        now |= _laid(merged, f"{path}/data/batch={batch_id}", buckets)
    commit_text(spark, f"{path}/manifests/{batch_id:012d}.json", json.dumps({**before, **now}))


def read_upserts(spark: SparkSession, path: str, schema: T.StructType, batch: int | None = None) -> DataFrame:
    """The table after the last committed batch, or after ``batch``."""
    done = [b for b in _manifests(spark, path) if batch is None or b <= batch]
    folders = _folders(spark, path, max(done, default=None))
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders.values())


def start_upserts(
    df: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: str | None = None,
    buckets: int = BUCKETS,
    every: str | None = None,
) -> StreamingQuery:
    """Keep ``path`` up to date with a stream's changes; ``every`` as for ``write_event_stream``."""
    return start_batches(df, lambda batch, n: upsert(batch, n, path, keys, order, buckets), checkpoint, "update", every)
