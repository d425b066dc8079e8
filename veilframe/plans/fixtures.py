"""Federated tables derived from the star schema and event tables.

The SQL texts run unchanged in Spark and in other engines: ``{orders}`` and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.messages import next_counter, seal_messages
from veilframe.storage import materialize

TABLES = ("orders", "customer", "lineitem", "events", "embeddings", "supplier")

LABELLED = """
SELECT o.o_orderkey AS row_key,
       o.o_totalprice AS num_total,
       c.c_acctbal AS num_acctbal,
       CASE WHEN o.o_orderkey % 17 = 0 THEN '?' ELSE c.c_mktsegment END AS cat_segment,
       o.o_orderpriority AS cat_priority,
       CASE WHEN c.c_acctbal <= 5000 THEN '<=50K'
            WHEN o.o_orderkey % 2 = 0 THEN ' >50K.' ELSE '>50K' END AS raw_label
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

VECTORS = """
SELECT vec_id AS row_key, embedding AS x,
       CASE WHEN label < 5 THEN 1 ELSE 0 END AS y,
       concat('client_', CAST(vec_id % 3 AS VARCHAR(20))) AS client_id
FROM {embeddings}
"""

UPDATES = """
WITH n AS (
  SELECT CAST(month(l_shipdate) AS INT) AS round, l_suppkey, count(*) AS num_samples
  FROM {lineitem} GROUP BY month(l_shipdate), l_suppkey),
g AS (
  SELECT CAST(month(l_shipdate) AS INT) AS round, l_returnflag AS param, l_linenumber - 1 AS idx, avg(l_tax) AS global_value
  FROM {lineitem} GROUP BY month(l_shipdate), l_returnflag, l_linenumber - 1),
u AS (
  SELECT CAST(month(l_shipdate) AS INT) AS round, l_suppkey, l_returnflag AS param, l_linenumber - 1 AS idx,
         avg(l_discount) AS value
  FROM {lineitem} GROUP BY month(l_shipdate), l_suppkey, l_returnflag, l_linenumber - 1)
SELECT u.round, concat('client_', CAST(u.l_suppkey AS VARCHAR(20))) AS client_id, u.param, u.idx, u.value,
       g.global_value, n.num_samples
FROM u JOIN n ON u.round = n.round AND u.l_suppkey = n.l_suppkey
       JOIN g ON u.round = g.round AND u.param = g.param AND u.idx = g.idx
"""

GLOBAL_MODEL = """
SELECT CAST(month(l_shipdate) AS INT) AS round, l_returnflag AS param, l_linenumber - 1 AS idx, avg(l_tax) AS value
FROM {lineitem} GROUP BY month(l_shipdate), l_returnflag, l_linenumber - 1
"""

MESSAGE_FLAGS = """
SELECT event_id AS seq, ts, concat('client_', CAST(user_id AS VARCHAR(20))) AS client_id, props AS payload, value,
       user_id % 20 <> 0 AS registered,
       user_id % 20 <> 1 AS has_key,
       event_id % 23 <> 0 AS sealed_ok,
       event_id % 29 <> 0 AS tag_ok
FROM {events}
"""

MEASUREMENTS = """
SELECT CASE WHEN event_type IN ('error', 'click') THEN 'plaintext' ELSE 'encrypted' END AS run,
       CAST(day(ts) AS INT) AS round,
       CASE WHEN value > 20 THEN 1.0e0 ELSE 0.0e0 END AS accuracy,
       value AS total_time,
       CASE WHEN event_type IN ('error', 'view') THEN value ELSE 0.0e0 END AS training_time,
       CASE WHEN event_type IN ('click', 'signup') THEN value ELSE 0.0e0 END AS encryption_time,
       value AS aggregation_time,
       CAST(length(props) AS BIGINT) AS communication_size_bytes
FROM {events}
"""

FEED = """
SELECT ts, event_id AS seq, concat('client_', CAST(user_id AS VARCHAR(20))) AS client_id,
       CASE WHEN event_id % 500 = 499 THEN 'reset'
            WHEN event_type = 'view' THEN 'TRAINING'
            WHEN event_type = 'click' THEN 'ENCRYPTING'
            WHEN event_type = 'signup' THEN 'SENT'
            WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'threat_quantum'
            WHEN event_type = 'error' THEN 'threat_mitm'
            ELSE 'READY' END AS kind,
       value
FROM {events}
"""

ROUND_EVENTS = """
SELECT ts, CAST(floor(event_id / 100) AS INT) AS round,
       CASE WHEN event_id % 100 = 0 THEN 'round_start'
            WHEN event_id % 100 = 99 AND event_id % 700 <> 699 THEN 'round_complete'
            ELSE 'client_update' END AS kind
FROM {events}
"""

LEDGER = """
SELECT DISTINCT concat('client_', CAST(l_suppkey AS VARCHAR(20))) AS client_id,
       CASE WHEN month(l_shipdate) >= 7 THEN 1 ELSE 0 END AS epoch,
       CAST(month(l_shipdate) AS BIGINT) AS seq,
       CAST(month(l_shipdate) AS INT) AS round,
       CASE WHEN month(l_shipdate) < 4 THEN 1.0e0 WHEN month(l_shipdate) < 9 THEN 0.5e0 ELSE 10.0e0 END AS epsilon,
       1.0e-5 AS delta,
       CASE WHEN l_suppkey % 2 = 0 THEN 'gaussian' ELSE 'laplace' END AS mechanism
FROM {lineitem}
"""

# Budget changes an operator made: first round and the budget from then on.
BUDGET_CHANGES = """
SELECT CAST(2 * s_nationkey + 3 AS INT) AS valid_from, 0.25e0 + max(s_suppkey % 8) * 0.5e0 AS epsilon
FROM {supplier} GROUP BY s_nationkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the texts above over the tables of a folder."""
    names = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in names})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered messages with flags: stale counters every 13th, missing every 31st, damaged and forged ones."""
    counted = next_counter(view(spark, sf_dir, MESSAGE_FLAGS))
    counter = (
        F.when(F.col("seq") % 31 == 0, F.lit(None))
        .when(F.col("seq") % 13 == 0, F.col("counter") - 3)
        .otherwise(F.col("counter"))
    )
    return counted.withColumn("counter", counter.cast("bigint"))


def client_keys(msgs: DataFrame) -> DataFrame:
    """Fixture keys: hashes of the client id. Real keys come from a key service as a table of this shape."""
    ids = msgs.select("client_id").distinct()
    return ids.select(
        "client_id",
        F.unhex(F.sha2(F.concat(F.lit("session:"), "client_id"), 256)).alias("session_key"),
        F.unhex(F.sha2(F.concat(F.lit("tag:"), "client_id"), 256)).alias("tag_key"),
    )


def sealed_messages(msgs: DataFrame, payload: str = "payload") -> DataFrame:
    """Messages sealed once; the flags damage the bytes or swap in a foreign tag key."""
    keys = client_keys(msgs)
    forged = keys.withColumn("tag_key", F.col("session_key")).withColumn("tag_ok", F.lit(False))
    both = keys.withColumn("tag_ok", F.lit(True)).unionByName(forged)
    sealed = seal_messages(msgs, both, payload, ["client_id", "tag_ok"])
    # cut the last byte of the authentication tag
    cut = F.when(F.col("sealed_ok"), F.col("sealed")).otherwise(F.expr("substring(sealed, 1, length(sealed) - 1)"))
    return materialize(sealed.withColumn("sealed", cut), "sealed")


def registry_of(msgs: DataFrame) -> DataFrame:
    return msgs.where("registered").select("client_id").distinct()


def keys_of(msgs: DataFrame) -> DataFrame:
    return client_keys(msgs.where("has_key"))
