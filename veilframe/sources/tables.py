"""Feature tables, model parameters and run metrics on files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators.metrics import run_summary
from veilframe.operators.privacy import tradeoff

# Where results go when no path is given, relative to the default file system.
MODEL_PATH = "results/model"
METRICS_PATH = "results/metrics/training"
PRIVACY_PATH = "results/metrics/privacy"

MODEL_SCHEMA = "round int, param string, idx int, value double"
ROUND_FIELDS = (
    "round int, accuracy double, total_time double, training_time double, encryption_time double, "
    "aggregation_time double, communication_size_bytes bigint"
)


def read_samples(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet", **options
) -> DataFrame:
    """Feature table with its label; any failure to load is one RuntimeError."""
    reader = spark.read.format(fmt).options(**options)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except (AnalysisException, Py4JJavaError) as e:  # a missing path, or a file whose header cannot be read
        raise RuntimeError(f"cannot load samples from {path}: {e}") from e


def write_model(model: DataFrame, path: str = MODEL_PATH) -> None:
    """Append the parameters of one or more rounds, one folder per round; a round written again is replaced."""
    model.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def read_model(spark: SparkSession, path: str, round: int | None = None) -> DataFrame:
    """Parameters of one round (only its folder is read) or of all."""
    models = spark.read.schema(MODEL_SCHEMA).parquet(path).select("round", "param", "idx", "value")
    return models if round is None else models.where(F.col("round") == round)


def write_metrics(metrics: DataFrame, path: str = METRICS_PATH, config: dict[str, str] | None = None) -> None:
    """One JSON document per run: timestamp, configuration, ordered rounds, summary."""
    names = [f.split()[0] for f in ROUND_FIELDS.split(", ")]
    rounds = metrics.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rounds"))
    summary = run_summary(metrics)
    parts = [F.lit(v).alias(k) for k, v in (config or {}).items()]
    documents = rounds.join(summary, "run").select(
        "run",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        *([F.struct(*parts).alias("config")] if parts else []),
        "rounds",
        F.struct(*[c for c in summary.columns if c != "run"]).alias("summary"),
    )
    documents.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Round metrics back from the documents."""
    documents = spark.read.schema(f"run string, rounds array<struct<{_fields()}>>").json(path)
    return documents.select("run", F.inline("rounds"))


def _fields() -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in ROUND_FIELDS.split(", "))


def write_privacy_report(recorded: DataFrame, path: str = PRIVACY_PATH, by: str | None = None) -> None:
    """Recorded rounds and their tradeoff as one JSON document, or one for every value of ``by``."""
    names = ["round", "epsilon", "accuracy", "privacy_spent", "noise_magnitude"]
    keyed = recorded.withColumn("_run", F.col(by) if by else F.lit(0))
    rounds = keyed.groupBy("_run").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("metrics"))
    found = tradeoff(keyed, ["_run"])
    analysis = found.select("_run", F.struct(*[c for c in found.columns if c != "_run"]).alias("tradeoff_analysis"))
    documents = rounds.join(analysis, "_run")
    (documents.withColumnRenamed("_run", by) if by else documents.drop("_run")).write.mode("overwrite").json(path)


def read_privacy_report(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """Recorded rounds back from the documents, with the column they were written ``by``."""
    fields = "round: int, epsilon: double, accuracy: double, privacy_spent: double, noise_magnitude: double"
    lead = f"`{by}` string, " if by else ""
    documents = spark.read.schema(f"{lead}metrics array<struct<{fields}>>").json(path)
    return documents.select(*([by] if by else []), F.inline("metrics"))
