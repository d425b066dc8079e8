"""Written intermediates.

Anything that must be computed once (released noise, sealed messages with a fresh nonce, a model per round, a small side
table whose size decides the join) is written as parquet below the shared folder named by ``spark.checkpoint.dir``.
A written table has no lineage to replay, so losing an executor neither recomputes it nor changes it.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOLDER = "spark.checkpoint.dir"


@lru_cache
def _local_folder(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="veilframe-")


def scratch_dir(spark: SparkSession) -> str:
    """Shared scratch folder of this application."""
    base = spark.conf.get(_FOLDER, None) or spark.sparkContext.getConf().get(_FOLDER)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_FOLDER} to a folder every executor can reach")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/veilframe/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    return materialize_counted(df, name)[0]


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + F.lit(16)
    elif isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
        size = F.size(value) * 8 if fixed else F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    elif isinstance(kind, T.MapType):
        pairs = F.map_entries(value)
        size = F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + _bytes(x["key"], kind.keyType) + _bytes(x["value"], kind.valueType))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def row_bytes(schema: T.StructType) -> Column:
    return sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(16).cast("long"))


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and about the bytes they take."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))).first()
    return n, size


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write ``df`` once; the table read back and its row count, taken while writing."""
    return materialize_measured(df, name, F.lit(0))[:2]


def materialize_measured(df: DataFrame, name: str, size: Column | None = None) -> tuple[DataFrame, int, int]:
    """As ``materialize_counted``, with about the bytes the rows take."""
    spark = df.sparkSession
    path, seen = new_path(spark, name), Observation()
    width = row_bytes(df.schema) if size is None else size
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(width).alias("size")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"], seen.get["size"] or 0


def _hadoop(spark: SparkSession, path: str):
    """File system and path object of a URI, for small files that the driver writes itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear whole, by a rename; False if it is there already."""
    fs, at = _hadoop(spark, path)
    if fs.exists(at):
        return False
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at.getParent()}/.{at.getName()}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, at) and not fs.exists(at):
        raise OSError(f"cannot write {path}")
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if there is no such folder."""
    fs, at = _hadoop(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if not s.getPath().getName().startswith("."))
