"""Registered queries: name -> (Spark query over a folder of tables, SQL stating the same result or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.noise import noise_scale, privacy_level
from veilframe.functions.numeric import fixed
from veilframe.functions.paillier import PrivateKey, generate_keypair
from veilframe.functions.sealing import aad, digest, hmac_pads, tag
from veilframe.operators import combine as cb
from veilframe.operators import encrypted as enc
from veilframe.operators import messages as msg
from veilframe.operators import metrics as mt
from veilframe.operators import model as md
from veilframe.operators import prep
from veilframe.operators import privacy as dp
from veilframe.operators import sparse as sp
from veilframe.operators import status as st
from veilframe.operators.index import global_index, hash_index
from veilframe.plans import fixtures as fx
from veilframe.plans import oracles as o
from veilframe.plans.rounds import RoundConfig, run_rounds
from veilframe.skew import attach, union_all
from veilframe.sources import events as ev
from veilframe.sources import tables as tb
from veilframe.storage import materialize, new_path
from veilframe.streaming import rounds as sr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def test_key() -> PrivateKey:
    """Repeatable 512-bit key; real runs draw a 2048-bit one."""
    return generate_keypair(512, seed=7)


# ---- sources and preparation ----

CATEGORICAL = ["cat_segment", "cat_priority"]
NUMERIC = ["num_total", "num_acctbal"]
SEED = 42


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.view(spark, sf_dir, fx.LABELLED)
    features = [c for c in raw.columns if c not in ("row_key", "raw_label")]
    marked = prep.drop_incomplete(prep.null_markers(raw, features), features)
    return prep.binary_label(marked, "raw_label").drop("raw_label")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(clean(spark, sf_dir), "clean")
    levels = prep.onehot_fit(rows, CATEGORICAL, offset=len(NUMERIC))
    return prep.onehot_transform(rows, levels, NUMERIC, keep=["row_key", "y"])


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.stratified_split(encoded(spark, sf_dir), "y", "row_key", seed=SEED)
    stats = prep.scale_fit(rows.where("split = 'train'"), prep.feature_columns(rows))
    return prep.scale_transform(rows, stats)


def client_samples(spark: SparkSession, sf_dir: str, n: int = 3, strategy: str = "iid") -> DataFrame:
    train = materialize(scaled(spark, sf_dir).where("split = 'train'"), "train")
    return prep.assign_clients(train, n, "row_key", strategy, seed=SEED)


def rounded(df: DataFrame, digits: int, cols: list[str]) -> DataFrame:
    return df.select(*[fixed(c, digits).alias(c) if c in cols else c for c in df.columns])


F_COLS = [f"f_{i}" for i in range(o.N_FEATURES)]
_F6 = ", ".join(f"{o.r(c, 6)} AS {c}" for c in F_COLS)
_TRAIN = f"(SELECT * FROM {o.SCALED} t WHERE split = 'train')"


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def source_samples(spark, sf_dir):
    schema = "c_custkey bigint, c_acctbal double, c_mktsegment string"
    return tb.read_samples(spark, f"{sf_dir}/customer.parquet", schema)


@query(f"SELECT row_key, num_total, num_acctbal, cat_segment, cat_priority, y FROM {o.CLEAN} c")
def prep_clean_label(spark, sf_dir):
    return clean(spark, sf_dir)


@query(
    f"""SELECT row_key, CAST(num_acctbal AS DOUBLE) AS num_acctbal, CAST(num_total AS DOUBLE) AS num_total,
    CAST(cat_priority AS VARCHAR) AS cat_priority FROM {o.LABELLED} l"""
)
def prep_resolve_cast(spark, sf_dir):
    raw = fx.view(spark, sf_dir, fx.LABELLED)
    numeric = prep.resolve_features(raw, ["num_acctbal", "age", "num_total"])
    categorical = prep.resolve_features(raw, ["race", "cat_priority"])
    return prep.cast_features(raw.select("row_key", *numeric, *categorical), numeric, categorical)


@query(f"SELECT * FROM {o.LEVELS} l")
def prep_onehot_levels(spark, sf_dir):
    return prep.onehot_fit(clean(spark, sf_dir), CATEGORICAL, offset=len(NUMERIC))


@query(f"SELECT * FROM {o.ONEHOT} e")
def prep_onehot(spark, sf_dir):
    return encoded(spark, sf_dir)


@query(
    f"""SELECT row_key, idx FROM {o.CLEAN} c JOIN {o.LEVELS} l
    ON (feature = 'cat_segment' AND level = cat_segment) OR (feature = 'cat_priority' AND level = cat_priority)"""
)
def prep_onehot_sparse(spark, sf_dir):
    rows = materialize(clean(spark, sf_dir), "clean")
    return prep.onehot_sparse(rows, prep.onehot_fit(rows, CATEGORICAL, len(NUMERIC)), CATEGORICAL, "row_key")


@query(f"SELECT row_key, y, split FROM {o.SPLIT} s")
def prep_split(spark, sf_dir):
    return prep.stratified_split(clean(spark, sf_dir), "y", "row_key", seed=SEED).select("row_key", "y", "split")


@query(
    f"""SELECT row_key, y, CASE WHEN k < floor(n * 0.2e0 + 0.5e0) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT row_key, y, row_number() OVER (PARTITION BY y ORDER BY {o.hashed()}) - 1 AS k,
                 count(*) OVER (PARTITION BY y) AS n FROM {o.CLEAN} c)"""
)
def prep_split_exact(spark, sf_dir):
    rows = clean(spark, sf_dir).select("row_key", "y")
    return prep.stratified_split(rows, "y", "row_key", seed=SEED, exact=True)


@query(
    f"""SELECT split, client_id, count(*) AS n_rows, {o.r('avg(CAST(y AS DOUBLE))')} AS positive_share FROM (
    SELECT 'train' AS split, client_id, y FROM {o.clients(f"(SELECT row_key, y FROM {o.SPLIT} s WHERE split = 'train')", 3)} c
    UNION ALL SELECT 'test', NULL, y FROM {o.SPLIT} s WHERE split = 'test') GROUP BY split, client_id"""
)
def prep_split_summary(spark, sf_dir):
    rows = materialize(prep.stratified_split(clean(spark, sf_dir), "y", "row_key", seed=SEED), "split")
    rows = rows.select("row_key", "y", "split")
    train = prep.assign_clients(rows.where("split = 'train'"), 3, "row_key", seed=SEED)
    test = rows.where("split = 'test'").withColumn("client_id", F.lit(None).cast("int"))
    return rounded(prep.split_summary(train.unionByName(test)), 9, ["positive_share"])


@query(f"SELECT row_key, y, split, {_F6} FROM {o.SCALED} s")
def prep_scale(spark, sf_dir):
    return rounded(scaled(spark, sf_dir), 6, F_COLS)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders")
def index_global(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return global_index(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("position").cast("bigint"))


@query(f"SELECT row_key, y, row_number() OVER (PARTITION BY y ORDER BY {o.hashed()}) - 1 AS position FROM {o.CLEAN} c")
def index_hash(spark, sf_dir):
    rows = clean(spark, sf_dir).select("row_key", "y")
    return hash_index(rows, "row_key", SEED, by=["y"]).withColumn("position", F.col("position").cast("bigint"))


@query(f"SELECT row_key, y, client_id FROM {o.clients(o.CLEAN, 5)} c")
def clients_iid(spark, sf_dir):
    return prep.assign_clients(clean(spark, sf_dir).select("row_key", "y"), 5, "row_key", seed=SEED)


@query(f"SELECT row_key, y, client_id FROM {o.clients(o.CLEAN, 5, 'y, ')} c")
def clients_label_skew(spark, sf_dir):
    return prep.assign_clients(clean(spark, sf_dir).select("row_key", "y"), 5, "row_key", "non-iid", seed=SEED)


# ---- model ----


def start_model(spark: SparkSession, d: int) -> DataFrame:
    weight = (F.col("idx") % 7 - 3) / F.lit(50.0)
    value = F.when(F.col("param") == "W", weight).otherwise(F.lit(o.START_BIAS))
    return md.init_model(spark, d).withColumn("value", value)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, fx.VECTORS)


VECTOR_D = 64


@query(
    f"""SELECT 0 AS round, 'W' AS param, CAST(i AS INT) AS idx, 0.0e0 AS value
    FROM (SELECT unnest(range((SELECT 2 + count(*) FROM {o.LEVELS} l))) AS i) UNION ALL SELECT 0, 'b', 0, 0.0e0"""
)
def model_initial(spark, sf_dir):
    levels = prep.onehot_fit(clean(spark, sf_dir), CATEGORICAL, offset=len(NUMERIC))
    return md.init_model(spark, len(NUMERIC) + levels.count())


@query(f"SELECT round, param, idx, {o.r('value')} AS value FROM {o.GLOBAL_MODEL} g WHERE round = (SELECT max(round) FROM {o.GLOBAL_MODEL} h)")
def model_current(spark, sf_dir):
    return rounded(md.current_model(fx.view(spark, sf_dir, fx.GLOBAL_MODEL)), 9, ["value"])


@query(f"SELECT round, param, idx, {o.r('value')} AS value FROM {o.GLOBAL_MODEL} g WHERE round = 6")
def model_store(spark, sf_dir):
    path = new_path(spark, "model-store")
    tb.write_model(fx.view(spark, sf_dir, fx.GLOBAL_MODEL), path)
    return rounded(tb.read_model(spark, path, 6), 9, ["value"])


@query(o.gradient_step(o.clients(_TRAIN, 3), o.N_FEATURES, lambda i: f"f_{i}"))
def model_gradient_step(spark, sf_dir):
    samples = client_samples(spark, sf_dir)
    return rounded(md.local_gradient_step(samples, start_model(spark, o.N_FEATURES)), 9, ["value"])


@query(o.gradient_step(o.VECTORS, VECTOR_D, lambda i: f"CAST(x[{i + 1}] AS DOUBLE)"))
def model_gradient_step_array(spark, sf_dir):
    step = md.local_gradient_step(vectors(spark, sf_dir), start_model(spark, VECTOR_D), array_col="x")
    return rounded(step, 9, ["value"])


def sparse_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Split sparse rows and the scaling of their train part."""
    rows = materialize(clean(spark, sf_dir), "clean")
    levels = prep.onehot_fit(rows, CATEGORICAL, offset=len(NUMERIC))
    sparse = sp.sparse_rows(rows, levels, NUMERIC, CATEGORICAL, ["row_key", "y"])
    sparse = materialize(prep.stratified_split(sparse, "y", "row_key", seed=SEED), "sparse")
    return sparse, sp.sparse_scale_fit(sparse.where("split = 'train'"))


_SCALE_ROWS = " UNION ALL ".join(f"SELECT {i} AS idx, avg(f_{i}) AS m, stddev_pop(f_{i}) AS s FROM t" for i in range(o.N_FEATURES))


@query(
    f"""WITH t AS MATERIALIZED (SELECT * FROM {o.SPLIT} x WHERE split = 'train')
    SELECT idx, {o.r('m', 6)} AS mean, {o.r('CASE WHEN s = 0 THEN 1.0e0 ELSE s END', 6)} AS scale FROM ({_SCALE_ROWS}) WHERE m <> 0"""
)
def prep_scale_sparse(spark, sf_dir):
    return rounded(sparse_samples(spark, sf_dir)[1], 6, ["mean", "scale"])


@query(o.gradient_step(o.clients(_TRAIN, 3), o.N_FEATURES, lambda i: f"f_{i}"))
def model_gradient_step_sparse(spark, sf_dir):
    rows, stats = sparse_samples(spark, sf_dir)
    samples = prep.assign_clients(rows.where("split = 'train'"), 3, "row_key", seed=SEED)
    return rounded(sp.sparse_gradient_step(samples, start_model(spark, o.N_FEATURES), stats), 9, ["value"])


_ACCURACY = f"""SELECT split, {o.r('avg(CASE WHEN (m > 0) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END)')} AS accuracy, count(*) AS n_rows
    FROM (SELECT split, y, {o.margin(o.N_FEATURES, lambda i: f'f_{i}')} AS m FROM {o.SCALED} s) GROUP BY split"""


@query(_ACCURACY)
def model_accuracy_sparse(spark, sf_dir):
    rows, stats = sparse_samples(spark, sf_dir)
    return rounded(md.accuracy(sp.sparse_predict(rows, start_model(spark, o.N_FEATURES), stats), ["split"]), 9, ["accuracy"])


@query(
    f"""SELECT split, {o.r('avg(CASE WHEN (m > 0) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END)')} AS accuracy, count(*) AS n_rows
    FROM (SELECT split, y, {o.margin(o.N_FEATURES, lambda i: f'f_{i}')} AS m FROM {o.SCALED} s) GROUP BY split"""
)
def model_accuracy(spark, sf_dir):
    scored = md.predict(scaled(spark, sf_dir), start_model(spark, o.N_FEATURES))
    return rounded(md.accuracy(scored, ["split"]), 9, ["accuracy"])


@query(
    f"""WITH m AS ({o.gradient_step(o.VECTORS, VECTOR_D, lambda i: f"CAST(x[{i + 1}] AS DOUBLE)", 15)}),
    w AS (SELECT client_id, list(value ORDER BY idx) FILTER (WHERE param = 'W') AS w, max(value) FILTER (WHERE param = 'b') AS b
          FROM m GROUP BY client_id)
    SELECT w.client_id, {o.r("avg(CASE WHEN (list_inner_product(CAST(v.x AS DOUBLE[]), w.w) + w.b > 0) = (v.y = 1) THEN 1.0e0 ELSE 0.0e0 END)")} AS accuracy,
           count(*) AS n_rows
    FROM {o.VECTORS} v, w GROUP BY w.client_id"""
)
def model_accuracy_by_client(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    models = md.local_gradient_step(rows, start_model(spark, VECTOR_D), array_col="x")
    return rounded(md.evaluate_clients(rows, models, "x"), 9, ["accuracy"])


@query(o.sgd_epoch(o.clients(_TRAIN, 3), o.N_FEATURES, 8))
def model_sgd_epoch(spark, sf_dir):
    samples = client_samples(spark, sf_dir)
    return rounded(md.local_sgd_epoch(samples, md.init_model(spark, o.N_FEATURES)), 9, ["value"])


def private_rounds(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """Accuracy and parameters of three private rounds; ``sealed`` sends updates encrypted in sealed messages."""
    rows = materialize(scaled(spark, sf_dir), "samples")
    train = materialize(prep.assign_clients(rows.where("split = 'train'"), 3, "row_key", seed=SEED), "train")
    train = train.withColumn("client_id", F.col("client_id").cast("string"))
    config = RoundConfig(rounds=3, lr=0.5, clip=0.3, seed=SEED, key=more.get("key"))
    parties = train.select("client_id").distinct()
    known = (parties, fx.client_keys(parties)) if more.get("sealed") else ()
    result = run_rounds(train, rows.where("split = 'test'"), config, *known)
    name = F.when(F.col("param") == "b", "p_b").otherwise(F.concat(F.lit("p_"), F.col("idx").cast("string")))
    params = [f"p_{i}" for i in range(o.N_FEATURES)] + ["p_b"]
    wide = result.models.select("round", name.alias("name"), fixed("value", 7).alias("value")).groupBy("round").pivot("name", params).max("value")
    return rounded(result.metrics.select("round", "accuracy").join(wide, "round"), 9, ["accuracy"])


_ROUNDS = o.private_rounds(o.clients(_TRAIN, 3), f"(SELECT * FROM {o.SCALED} t WHERE split = 'test')", 3, 0.5, 0.3, SEED)


@query(_ROUNDS)
def federated_rounds(spark, sf_dir):
    return private_rounds(spark, sf_dir)


@query(_ROUNDS)
def federated_rounds_encrypted(spark, sf_dir):
    return private_rounds(spark, sf_dir, sealed=True, key=test_key())


# ---- privacy ----


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, fx.UPDATES)


def local_and_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return updates(spark, sf_dir).drop("global_value"), fx.view(spark, sf_dir, fx.GLOBAL_MODEL)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, fx.LEDGER)


ROUND_ELEMENT = ["round", "param", "idx"]
NOISE_KEYS = ["round", "client_id", "param", "idx"]


@query(f"SELECT round, client_id, param, idx, {o.r('delta')} AS delta FROM {o.DELTAS} d")
def dp_delta(spark, sf_dir):
    moved = dp.update_delta(*local_and_model(spark, sf_dir), on=ROUND_ELEMENT)
    return rounded(moved.select(*NOISE_KEYS, "delta"), 9, ["delta"])


@query(f"SELECT round, client_id, param, {o.r('sqrt(sum(value * value))')} AS norm FROM {o.UPDATES} u GROUP BY round, client_id, param")
def dp_norm(spark, sf_dir):
    return rounded(dp.l2_norm(updates(spark, sf_dir)), 9, ["norm"])


@query(f"SELECT round, client_id, param, idx, {o.r('delta * factor')} AS clipped, {o.r('factor')} AS factor FROM {o.CLIPPED} c")
def dp_clip(spark, sf_dir):
    moved = updates(spark, sf_dir).withColumn("delta", F.col("value") - F.col("global_value"))
    return rounded(dp.clip_l2(moved, o.CLIP, "delta").select(*NOISE_KEYS, "clipped", "factor"), 9, ["clipped", "factor"])


@query(
    f"""SELECT round, client_id, {o.r('min(factor)')} AS min_factor,
    count(DISTINCT CASE WHEN factor < 1 THEN param END) AS clipped_tensors FROM {o.CLIPPED} c GROUP BY round, client_id"""
)
def dp_clip_min_factor(spark, sf_dir):
    moved = updates(spark, sf_dir).withColumn("delta", F.col("value") - F.col("global_value"))
    return rounded(dp.clip_tensors(moved, o.CLIP, "delta"), 9, ["min_factor"])


@query(
    f"""SELECT client_id, round, {o.r(f"CASE mechanism WHEN 'laplace' THEN 2.0e0 / epsilon ELSE {o.GAUSS_FACTOR} * 2.0e0 / epsilon END")} AS scale
    FROM {o.LEDGER} l"""
)
def dp_scale(spark, sf_dir):
    scale = noise_scale(F.col("mechanism"), F.col("epsilon"), F.col("delta"), 2.0)
    return ledger(spark, sf_dir).select("client_id", "round", fixed(scale).alias("scale"))


@query(f"SELECT round, client_id, param, idx, {o.r('value + ' + o.gaussian('0.5e0', o.noise_text('42')), 8)} AS noisy FROM {o.UPDATES} u")
def dp_gaussian(spark, sf_dir):
    noisy = dp.add_gaussian(updates(spark, sf_dir), "value", F.lit(0.5), NOISE_KEYS, SEED)
    return rounded(noisy.select(*NOISE_KEYS, "noisy"), 8, ["noisy"])


@query(f"SELECT round, client_id, param, idx, {o.r('value + ' + o.laplace('2.0e0', o.noise_text('42')), 8)} AS noisy FROM {o.UPDATES} u")
def dp_laplace(spark, sf_dir):
    noisy = dp.add_laplace(updates(spark, sf_dir), "value", F.lit(2.0), NOISE_KEYS, SEED)
    return rounded(noisy.select(*NOISE_KEYS, "noisy"), 8, ["noisy"])


@query(
    f"""SELECT round, client_id, param, idx,
    {o.r("value + CASE WHEN param = 'A' THEN " + o.laplace('0.25e0', o.noise_text('7')) + " ELSE " + o.gaussian(o.GAUSS_FACTOR + ' / 4.0e0', o.noise_text('7')) + " END", 8)} AS noisy
    FROM {o.UPDATES} u"""
)
def dp_noise_tensors(spark, sf_dir):
    mechanism = F.when(F.col("param") == "A", "laplace").otherwise("gaussian")
    noisy = dp.add_noise_tensors(updates(spark, sf_dir), mechanism, 4.0, seed=7)
    return rounded(noisy.select(*NOISE_KEYS, "noisy"), 8, ["noisy"])


@query(
    f"""SELECT round, client_id, param, idx, num_samples,
    {o.r(f"global_value + delta * factor + {o.gaussian(f'{o.GAUSS_FACTOR} * {o.CLIP}e0 / 10.0e0', o.noise_text('42'))}", 8)} AS value
    FROM {o.CLIPPED} c"""
)
def dp_privatize(spark, sf_dir):
    sent = dp.privatize_updates(*local_and_model(spark, sf_dir), o.CLIP, 10.0, seed=SEED, on=ROUND_ELEMENT)
    return rounded(sent.select(*NOISE_KEYS, "num_samples", "value"), 8, ["value"])


@query(
    f"""SELECT client_id, 0 AS epoch, CAST(round AS BIGINT) AS seq, round, 1.0e0 AS epsilon, count(DISTINCT param) AS tensors
    FROM {o.UPDATES} u GROUP BY client_id, round"""
)
def dp_account_steps(spark, sf_dir):
    steps = dp.account_steps(updates(spark, sf_dir), 1.0, 1e-5, "gaussian")
    return steps.select("client_id", "epoch", "seq", "round", "epsilon", "tensors")


_RUN = "OVER (PARTITION BY client_id, epoch ORDER BY seq)"


@query(f"SELECT client_id, epoch, seq, sum(epsilon) {_RUN} AS spent, count(*) {_RUN} AS steps FROM {o.LEDGER} l")
def dp_ledger_running(spark, sf_dir):
    return dp.spent_so_far(ledger(spark, sf_dir)).select("client_id", "epoch", "seq", "spent", "steps")


@query(
    f"""SELECT client_id, epoch, sum(epsilon) AS spent, count(*) AS steps FROM {o.LEDGER} l
    WHERE epoch = (SELECT max(epoch) FROM {o.LEDGER} m WHERE m.client_id = l.client_id) GROUP BY client_id, epoch"""
)
def dp_totals(spark, sf_dir):
    return dp.budget_totals(dp.current_epoch(ledger(spark, sf_dir)))


@query(f"SELECT client_id, max(epoch) + 1 AS epoch, 0.0e0 AS spent, CAST(0 AS BIGINT) AS steps FROM {o.LEDGER} l GROUP BY client_id")
def dp_reset(spark, sf_dir):
    return dp.reset_budget(ledger(spark, sf_dir))


@query(
    f"""SELECT client_id, round, coalesce((SELECT max_by(b.epsilon, b.valid_from) FROM {o.BUDGET} b WHERE b.valid_from <= l.round), epsilon) AS epsilon
    FROM {o.LEDGER} l"""
)
def dp_budget_asof(spark, sf_dir):
    config = fx.view(spark, sf_dir, fx.BUDGET_CHANGES)
    return dp.set_budget(ledger(spark, sf_dir), config).select("client_id", "round", "epsilon")


_BANDS = """CASE WHEN epsilon < 0.1 THEN 'Extremely Strong (epsilon < 0.1)'
WHEN epsilon < 0.5 THEN 'Very Strong (0.1 <= epsilon < 0.5)'
WHEN epsilon < 1 THEN 'Strong (0.5 <= epsilon < 1.0) [RECOMMENDED]'
WHEN epsilon < 5 THEN 'Moderate (1.0 <= epsilon < 5.0)'
WHEN epsilon < 10 THEN 'Weak (5.0 <= epsilon < 10.0)' ELSE 'Very Weak (epsilon >= 10.0)' END"""


@query(
    f"""SELECT client_id, epsilon AS epsilon_per_round, spent AS total_privacy_spent, steps AS rounds_executed, delta,
       mechanism AS noise_mechanism,
       {o.r(f"CASE mechanism WHEN 'laplace' THEN 1.0e0 / epsilon ELSE {o.GAUSS_FACTOR} / epsilon END")} AS noise_scale,
       {_BANDS} AS privacy_level, spent * 2.0e0 AS eps_basic_composition
    FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY epoch DESC, seq DESC) AS k,
                 sum(epsilon) OVER (PARTITION BY client_id, epoch) AS spent,
                 count(*) OVER (PARTITION BY client_id, epoch) AS steps FROM {o.LEDGER} l) WHERE k = 1"""
)
def dp_report(spark, sf_dir):
    return rounded(dp.privacy_report(ledger(spark, sf_dir)), 9, ["noise_scale"])


@query(f"SELECT client_id, round, {_BANDS} AS privacy_level FROM (SELECT client_id, round, epsilon / 7 AS epsilon FROM {o.LEDGER} l)")
def dp_levels(spark, sf_dir):
    return ledger(spark, sf_dir).select("client_id", "round", privacy_level(F.col("epsilon") / 7).alias("privacy_level"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = mt.round_metrics(fx.view(spark, sf_dir, fx.MEASUREMENTS))
    noise = updates(spark, sf_dir).select("round", (F.col("value") - F.col("global_value")).alias("noise"))
    return dp.record_rounds(metrics, ledger(spark, sf_dir), noise, by=["run"])


_RECORDED = f"""(
SELECT m.run, m.round, l.epsilon, m.accuracy, l.spent AS privacy_spent, coalesce(n.noise_magnitude, 0) AS noise_magnitude
FROM {o.METRICS} m
LEFT JOIN (SELECT round, epsilon, sum(epsilon) OVER (PARTITION BY client_id, epoch ORDER BY seq) AS spent FROM {o.LEDGER} a
           WHERE client_id = (SELECT min(client_id) FROM {o.LEDGER} b)) l ON m.round = l.round
LEFT JOIN (SELECT round, avg(abs(delta)) AS noise_magnitude FROM {o.DELTAS} d GROUP BY round) n ON m.round = n.round)"""


_RECORDED9 = f"""SELECT run, round, epsilon, {o.r('accuracy')} AS accuracy, privacy_spent, {o.r('noise_magnitude')} AS noise_magnitude
    FROM {_RECORDED} r"""


@query(_RECORDED9)
def dp_record_rounds(spark, sf_dir):
    return rounded(recorded(spark, sf_dir), 9, ["accuracy", "noise_magnitude"])


@query(_RECORDED9)
def dp_report_json(spark, sf_dir):
    path = new_path(spark, "privacy-report")
    tb.write_privacy_report(recorded(spark, sf_dir), path, "run")
    return rounded(tb.read_privacy_report(spark, path, "run"), 9, ["accuracy", "noise_magnitude"])


_FIRST, _LAST = "min_by(accuracy, round)", "max_by(accuracy, round)"


@query(
    f"""SELECT run, 'ok' AS status, count(*) AS rounds_executed, {o.r(_FIRST)} AS initial_accuracy, {o.r(_LAST)} AS final_accuracy,
    max_by(privacy_spent, round) AS total_privacy_budget_spent,
    {o.r('avg(noise_magnitude)')} AS avg_noise_magnitude, {o.r('max(noise_magnitude)')} AS max_noise_magnitude,
    {o.r(f'{_FIRST} - {_LAST}')} AS accuracy_drop, {o.r(f'({_FIRST} - {_LAST}) * 100.0e0 / {_FIRST}', 8)} AS accuracy_drop_percentage
    FROM {_RECORDED} r GROUP BY run"""
)
def dp_tradeoff(spark, sf_dir):
    result = dp.tradeoff(recorded(spark, sf_dir), ["run"])
    nine = ["initial_accuracy", "final_accuracy", "avg_noise_magnitude", "max_noise_magnitude", "accuracy_drop"]
    return rounded(rounded(result, 9, nine), 8, ["accuracy_drop_percentage"])


# ---- combining ----

_FEDAVG = f"(SELECT round, param, idx, sum(num_samples * value) / sum(num_samples) AS value FROM {o.UPDATES} u GROUP BY round, param, idx)"
_MEDIAN = f"(SELECT round, param, idx, median(value) AS value FROM {o.UPDATES} u GROUP BY round, param, idx)"
_ELEMENT9 = f"SELECT round, param, idx, {o.r('value')} AS value FROM"


@query(f"SELECT round, param, idx, count(*) AS n_clients, CAST(sum(num_samples) AS BIGINT) AS total_samples FROM {o.UPDATES} u GROUP BY round, param, idx")
def update_counts(spark, sf_dir):
    return cb.element_counts(cb.collect_updates(updates(spark, sf_dir)))


@query(f"{_ELEMENT9} {_FEDAVG} f")
def fedavg(spark, sf_dir):
    return rounded(cb.fedavg(updates(spark, sf_dir)), 9, ["value"])


@query(f"{_ELEMENT9} {_MEDIAN} f")
def median_update(spark, sf_dir):
    return rounded(cb.median_update(updates(spark, sf_dir)), 9, ["value"])


RANK_ERROR = 0.02  # of the count; about 1.7 % at the sketch's size


def rank_checked(medians: DataFrame, rows: DataFrame) -> DataFrame:
    """Whether the rank of each sketched median is within ``RANK_ERROR`` of the middle; ties share a range of ranks."""
    met = attach(rows.select(*ROUND_ELEMENT, F.col("value").alias("v")), medians, ROUND_ELEMENT)
    ranks = met.groupBy(*ROUND_ELEMENT, "n").agg(F.sum((F.col("v") < F.col("value")).cast("int")).alias("a"), F.sum((F.col("v") <= F.col("value")).cast("int")).alias("b"))
    room = F.col("n") * RANK_ERROR + 1
    return ranks.select(*ROUND_ELEMENT, "n", ((F.col("a") <= F.col("n") / 2 + room) & (F.col("b") >= F.col("n") / 2 - room)).alias("near"))


_NEAR = f"SELECT round, param, idx, count(*) AS n, true AS near FROM {o.UPDATES} u GROUP BY round, param, idx"


@query(_NEAR)
def median_sketch(spark, sf_dir):
    rows = cb.collect_updates(updates(spark, sf_dir))
    parts = [cb.median_sketch(rows.where(F.pmod(F.xxhash64("client_id"), F.lit(3)) == i)) for i in range(3)]
    merged = cb.merge_sketches(materialize(union_all(parts), "sketches"))
    return rank_checked(cb.sketch_median(merged), rows)


def sparse_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that leave some elements without any client."""
    return updates(spark, sf_dir).where("NOT (param = 'N' AND idx >= 4)")


@query(
    f"""SELECT g.round, g.param, g.idx, {o.r('coalesce(f.value, g.value)')} AS value FROM {o.GLOBAL_MODEL} g
    LEFT JOIN (SELECT * FROM {_MEDIAN} m WHERE NOT (param = 'N' AND idx >= 4)) f
    ON f.round = g.round AND f.param = g.param AND f.idx = g.idx"""
)
def combine_keep_previous(spark, sf_dir):
    model = fx.view(spark, sf_dir, fx.GLOBAL_MODEL)
    return rounded(cb.combine(sparse_updates(spark, sf_dir), model, "median"), 9, ["value"])


@query(
    f"""SELECT round, param, "row", string_agg({o.fixed_text('value', 9)}, ',' ORDER BY col) AS x
    FROM (SELECT round, param, value, CASE WHEN param = 'A' THEN 0 ELSE idx END AS "row",
                 CASE WHEN param = 'A' THEN idx ELSE 0 END AS col FROM {o.GLOBAL_MODEL} g)
    GROUP BY round, param, "row" """
)
def reshape_rows(spark, sf_dir):
    rows = cb.to_rows(fx.view(spark, sf_dir, fx.GLOBAL_MODEL), {"A": (1, 7), "N": (7, 1), "R": (7, 1)})
    text = F.array_join(F.transform("x", lambda v: mt.fixed_text(v, 9)), ",")
    return rows.select("round", "param", "row", text.alias("x"))


@query(f"{_ELEMENT9} {o.GLOBAL_MODEL} g")
def reshape_elements(spark, sf_dir):
    rows = cb.to_rows(fx.view(spark, sf_dir, fx.GLOBAL_MODEL), {"A": (1, 7), "N": (7, 1), "R": (7, 1)})
    return rounded(cb.to_elements(rows), 9, ["value"])


@query(f"SELECT round, client_id, param, idx, {o.r('delta')} AS value FROM {o.DELTAS} d")
def he_roundtrip(spark, sf_dir):
    key = test_key()
    deltas = updates(spark, sf_dir).select(*NOISE_KEYS, (F.col("value") - F.col("global_value")).alias("value"))
    rows = materialize(deltas, "deltas")  # the plan and the encryption read them
    owner, plan = ["round", "client_id", "param"], enc.plan_packing(rows, key.public)
    sent = enc.he_encrypt_packed(rows, owner, key.public, plan, tasks=spark.sparkContext.defaultParallelism)
    wire = sent.withColumn("cipher", enc.from_wire(enc.to_wire("cipher")))
    back = enc.he_decrypt_packed(wire, owner, key, plan)
    return rounded(back.select(*NOISE_KEYS[:3], F.col("idx").cast("int").alias("idx"), "value"), 9, ["value"])


@query(f"{_ELEMENT9} {_FEDAVG} f")
def he_fedavg(spark, sf_dir):
    key = test_key()
    rows = materialize(updates(spark, sf_dir).select(*ROUND_ELEMENT, "client_id", "value", "num_samples"), "updates")
    plan = enc.plan_packing(rows, key.public, ROUND_ELEMENT, weight="num_samples")
    owner = ["round", "param", "client_id"]
    sent = materialize(enc.he_encrypt_packed(rows, owner, key.public, plan, weight="num_samples", tasks=spark.sparkContext.defaultParallelism), "packed")
    mean = enc.he_fedavg_packed(sent, ["round", "param"], key, plan)
    return rounded(mean.select("round", "param", F.col("idx").cast("int").alias("idx"), "value"), 9, ["value"])


# ---- messages ----


@query(
    """SELECT client_id, max(event_id) AS seq, max_by(sha256(props), event_id) AS public_key, CAST(-1 AS BIGINT) AS last_counter
    FROM (SELECT *, concat('client_', user_id) AS client_id FROM events WHERE event_type = 'signup') GROUP BY client_id"""
)
def msg_register(spark, sf_dir):
    signups = fx.table(spark, sf_dir, "events").where("event_type = 'signup'")
    return msg.register(
        signups.select(
            F.concat(F.lit("client_"), F.col("user_id").cast("string")).alias("client_id"),
            F.col("event_id").alias("seq"),
            F.sha2("props", 256).alias("public_key"),
        )
    )


@query(f"SELECT seq, client_id FROM {o.MESSAGES} m WHERE NOT registered")
def msg_unregistered(spark, sf_dir):
    rows = fx.view(spark, sf_dir, fx.MESSAGE_FLAGS)
    return msg.reject_unregistered(rows, fx.registry_of(rows)).select("seq", "client_id")


@query(f"SELECT seq, client_id FROM {o.MESSAGES} m WHERE NOT has_key")
def msg_no_session(spark, sf_dir):
    rows = fx.view(spark, sf_dir, fx.MESSAGE_FLAGS)
    return msg.require_session(rows, fx.keys_of(rows)).select("seq", "client_id")


@query(f"SELECT seq, client_id, last_counter, ctr <= last_counter AS replayed FROM {o.ADMITTED} a")
def msg_replay(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    judged = msg.reject_replays(rows, F.col("registered") & F.col("has_key") & F.col("sealed_ok"))
    return judged.select("seq", "client_id", "last_counter", "replayed")


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.messages(spark, sf_dir)
    return msg.admit(fx.sealed_messages(rows), fx.registry_of(rows), fx.keys_of(rows))


@query(f"SELECT seq, client_id, status, CASE WHEN status = 'ok' THEN payload END AS payload FROM {o.ADMITTED} a")
def msg_admit(spark, sf_dir):
    return admitted(spark, sf_dir).select("seq", "client_id", "status", "payload")


@query(f"SELECT client_id, status, count(*) AS n_messages FROM {o.ADMITTED} a GROUP BY client_id, status")
def msg_admit_summary(spark, sf_dir):
    return msg.admission_summary(admitted(spark, sf_dir))


@query(
    f"""SELECT seq, client_id, CASE WHEN has_key AND sealed_ok THEN payload END AS payload,
    registered AND has_key AND sealed_ok AND tag_ok AS authentic FROM {o.MESSAGES} m"""
)
def msg_seal_open(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    keyed = msg.with_keys(fx.sealed_messages(rows), fx.registry_of(rows), fx.keys_of(rows))
    opened = msg.open_messages(keyed)
    return opened.select("seq", "client_id", "payload", (F.col("authentic") & F.col("_registered")).alias("authentic"))


@query(
    f"""SELECT seq, '{{"client_id":"' || client_id || '","counter":' || coalesce(counter, -1) || ',"type":"model_update"}}' AS aad
    FROM {o.MESSAGES} m"""
)
def msg_aad(spark, sf_dir):
    return fx.messages(spark, sf_dir).select("seq", aad().alias("aad"))


@query(f"SELECT seq, sha256(payload) AS digest, seq % 29 <> 0 AS intact FROM {o.MESSAGES} m")
def msg_digest(spark, sf_dir):
    rows = fx.view(spark, sf_dir, fx.MESSAGE_FLAGS).withColumn("digest", digest(F.col("payload")))
    received = rows.withColumn("payload", F.when(F.col("tag_ok"), F.col("payload")).otherwise(F.concat("payload", F.lit("x"))))
    return msg.verify_digest(received, "payload", "digest").select("seq", "digest", "intact")


@query(o.hmac("payload", "client_id"))
def msg_tag(spark, sf_dir):
    rows = fx.view(spark, sf_dir, fx.MESSAGE_FLAGS)
    inner, outer = hmac_pads(F.col("tag_key"))
    keys = fx.client_keys(rows).select("client_id", inner.alias("i"), outer.alias("o"))
    keyed = attach(rows, keys, ["client_id"], written=False)
    return keyed.select("seq", "client_id", tag(F.col("payload"), F.col("i"), F.col("o")).alias("tag"))


@query("SELECT event_id AS seq, concat('client_', user_id) AS client_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS counter FROM events")
def msg_counter(spark, sf_dir):
    return msg.next_counter(fx.view(spark, sf_dir, fx.MESSAGE_FLAGS)).select("seq", "client_id", "counter")


@query(
    """SELECT round, count(*) AS n_messages,
    CAST(sum(strlen('{"client_id":"client_' || user_id || '","text":"' || replace(props, '"', '\\"') || '"}')) AS BIGINT) AS total_bytes
    FROM (SELECT *, CAST(day(ts) AS INT) AS round FROM events) GROUP BY round"""
)
def msg_size(spark, sf_dir):
    rows = fx.view(spark, sf_dir, fx.MESSAGE_FLAGS).withColumnRenamed("payload", "text")
    sized = msg.payload_size(rows, ["client_id", "text"]).withColumn("round", F.dayofmonth("ts"))
    return sized.groupBy("round").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("size_bytes").alias("total_bytes"))


def update_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose payload is a model update built from the event value."""
    body = F.struct(
        (F.col("seq") % 50 + 1).alias("num_samples"),
        F.create_map(F.lit("W"), F.array("value", F.col("value") * 2.0), F.lit("b"), F.array(-F.col("value"))).alias("model_params"),
    )
    return fx.messages(spark, sf_dir).withColumn("payload", F.to_json(body)).drop("value")


@query(
    f"""SELECT a.seq, a.client_id, a.seq % 50 + 1 AS num_samples, p.param, p.idx,
    CASE WHEN p.param = 'b' THEN -e.value WHEN p.idx = 1 THEN e.value * 2.0e0 ELSE e.value END AS value
    FROM {o.ADMITTED} a JOIN events e ON e.event_id = a.seq,
    (VALUES ('W', 0), ('W', 1), ('b', 0)) p(param, idx) WHERE a.status = 'ok'"""
)
def msg_updates(spark, sf_dir):
    rows = update_payloads(spark, sf_dir)
    done = msg.admit(fx.sealed_messages(rows), fx.registry_of(rows), fx.keys_of(rows))
    return msg.extract_updates(done)


# ---- metrics ----


def round_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.round_metrics(fx.view(spark, sf_dir, fx.MEASUREMENTS))


def round_view(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, 9, ["accuracy"]), 6, ["total_time", *mt.TIMES])


SUMMARY_COLS = [
    "avg_round_time",
    "total_training_time",
    "total_encryption_time",
    "total_aggregation_time",
    "total_communication_mb",
    "avg_communication_per_round_kb",
]


@query(f"SELECT {o.METRIC_COLUMNS} FROM {o.METRICS} m")
def metrics_rounds(spark, sf_dir):
    return round_view(round_rows(spark, sf_dir))


@query(f"SELECT {o.METRIC_COLUMNS} FROM {o.METRICS} m")
def metrics_json(spark, sf_dir):
    path = new_path(spark, "metrics")
    tb.write_metrics(round_rows(spark, sf_dir), path, {"num_rounds": "30"})
    return round_view(tb.read_metrics(spark, path))


@query(f"SELECT run, {o.r('final_accuracy')} AS final_accuracy, {', '.join(f'{o.r(c, 6)} AS {c}' for c in SUMMARY_COLS)} FROM {o.SUMMARY} s")
def metrics_summary(spark, sf_dir):
    return rounded(rounded(mt.run_summary(round_rows(spark, sf_dir)), 9, ["final_accuracy"]), 6, SUMMARY_COLS)


COMPARISON_COLS = [
    "accuracy_difference",
    "time_overhead_percentage",
    "communication_overhead_percentage",
    "encryption_overhead_seconds",
]


@query(f"SELECT {', '.join(f'{o.r(c, 6)} AS {c}' for c in COMPARISON_COLS)} FROM {o.COMPARISON} c")
def metrics_compare(spark, sf_dir):
    summary = mt.run_summary(round_rows(spark, sf_dir))
    return rounded(mt.compare_runs(summary, "plaintext", "encrypted"), 6, COMPARISON_COLS)


@query(
    f"""SELECT run, ord, segment, {o.r('seconds', 6)} AS seconds,
    {o.r('coalesce(sum(seconds) OVER (PARTITION BY run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 6)} AS base
    FROM (SELECT run, 0 AS ord, 'training' AS segment, total_training_time AS seconds FROM {o.SUMMARY} a
          UNION ALL SELECT run, 1, 'encryption', total_encryption_time FROM {o.SUMMARY} b
          UNION ALL SELECT run, 2, 'aggregation', total_aggregation_time FROM {o.SUMMARY} c)"""
)
def metrics_breakdown(spark, sf_dir):
    return rounded(mt.time_breakdown(mt.run_summary(round_rows(spark, sf_dir))), 6, ["seconds", "base"])


_SERIES = ", ".join(
    f"{o.r(o.of(run, expr), 6)} AS {run}_{name}"
    for run in ("plaintext", "encrypted")
    for name, expr in (("accuracy", "accuracy"), ("seconds", "total_time"), ("kb", "communication_size_bytes / 1024.0e0"))
)


@query(f"SELECT round, {_SERIES} FROM {o.METRICS} m GROUP BY round")
def metrics_series(spark, sf_dir):
    aligned = mt.series(round_rows(spark, sf_dir), ["plaintext", "encrypted"])
    return rounded(aligned, 6, [c for c in aligned.columns if c != "round"])


@query(f"SELECT {o.r('min(accuracy) - 0.05e0', 8)} AS axis_min, {o.r('max(accuracy) + 0.05e0', 8)} AS axis_max FROM {o.METRICS} m")
def metrics_axis(spark, sf_dir):
    return rounded(mt.accuracy_axis(round_rows(spark, sf_dir)), 8, ["axis_min", "axis_max"])


def _text_row(ord: int, name: str, col: str, digits: int, unit: str, over: str, over_digits: int, over_unit: str) -> str:
    cell = "(SELECT {} FROM s WHERE run = '{}') || '{}'"
    text = o.fixed_text(col, digits)
    return (
        f"SELECT {ord} AS ord, '{name}' AS metric, {cell.format(text, 'plaintext', unit)} AS baseline, "
        f"{cell.format(text, 'encrypted', unit)} AS other, (SELECT {o.fixed_text(over, over_digits)} FROM c) || '{over_unit}' AS overhead"
    )


@query(
    f"WITH s AS (SELECT * FROM {o.SUMMARY} x), c AS (SELECT * FROM {o.COMPARISON} y) "
    + " UNION ALL ".join(
        [
            _text_row(0, "Final Accuracy", "final_accuracy", 4, "", "accuracy_difference", 4, ""),
            _text_row(1, "Avg Round Time", "avg_round_time", 2, "s", "time_overhead_percentage", 1, "%"),
            _text_row(2, "Total Comm.", "total_communication_mb", 2, " MB", "communication_overhead_percentage", 1, "%"),
            _text_row(3, "Encryption Time", "total_encryption_time", 2, "s", "encryption_overhead_seconds", 2, "s"),
        ]
    )
)
def metrics_text(spark, sf_dir):
    summary = materialize(mt.run_summary(round_rows(spark, sf_dir)), "summary")
    comparison = mt.compare_runs(summary, "plaintext", "encrypted")
    return mt.format_summary(summary, comparison, "plaintext", "encrypted")


@query(
    f"""SELECT run, string_agg(CAST(round AS VARCHAR) || ':' || {o.fixed_text('accuracy', 4)}, ',' ORDER BY round) AS history
    FROM {o.METRICS} m GROUP BY run"""
)
def accuracy_history(spark, sf_dir):
    history = mt.accuracy_history(round_rows(spark, sf_dir))
    point = F.transform("history", lambda h: F.concat(h["round"].cast("string"), F.lit(":"), mt.fixed_text(h["accuracy"], 4)))
    return history.select("run", F.array_join(point, ",").alias("history"))


# ---- feed ----


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, fx.FEED)


_STATUS = f"""
WITH f AS (SELECT * FROM {o.FEED} x), z AS (SELECT coalesce(max(seq), -1) AS reset FROM f WHERE kind = 'reset'),
c AS (SELECT client_id, max(seq) FILTER (WHERE kind IN ('TRAINING', 'ENCRYPTING', 'SENT', 'READY')) AS seq,
             max_by(kind, seq) FILTER (WHERE kind IN ('TRAINING', 'ENCRYPTING', 'SENT', 'READY')) AS status,
             max_by(value, seq) FILTER (WHERE kind IN ('TRAINING', 'ENCRYPTING', 'SENT', 'READY')) AS value
      FROM f WHERE kind <> 'reset' GROUP BY client_id)
SELECT client_id, CASE WHEN seq > reset THEN status ELSE 'IDLE' END AS status,
       CASE WHEN seq > reset THEN value ELSE 0.0e0 END AS value FROM c, z"""


@query(
    f"""SELECT (SELECT max(round) FROM {o.ROUND_EVENTS} r WHERE kind = 'round_start') AS round,
    (SELECT max_by({o.LEVEL}, seq) FROM {o.FEED} f WHERE {o.LEVEL} IS NOT NULL) AS threat_level,
    (SELECT count(DISTINCT client_id) FROM {o.FEED} f) AS num_clients,
    (SELECT max_by(epsilon, valid_from) FROM {o.BUDGET} b) AS epsilon,
    (SELECT count(*) FROM {o.METRICS} m WHERE run = 'encrypted') AS rounds_done,
    (SELECT {o.r('max_by(accuracy, round)')} FROM {o.METRICS} m WHERE run = 'encrypted') AS last_accuracy,
    {o.N_FEATURES} AS num_features"""
)
def status_snapshot(spark, sf_dir):
    row = st.status_snapshot(
        feed(spark, sf_dir),
        fx.view(spark, sf_dir, fx.ROUND_EVENTS),
        fx.view(spark, sf_dir, fx.BUDGET_CHANGES),
        round_rows(spark, sf_dir).where("run = 'encrypted'"),
        o.N_FEATURES,
    )
    return rounded(row, 9, ["last_accuracy"])


@query(_STATUS)
def client_status(spark, sf_dir):
    return st.client_status(feed(spark, sf_dir))


@query(f"SELECT coalesce(max_by({o.LEVEL}, seq) FILTER (WHERE {o.LEVEL} IS NOT NULL), 'LOW') AS threat_level FROM {o.FEED} f")
def severity(spark, sf_dir):
    return st.severity(feed(spark, sf_dir))


@query(
    f"""SELECT client_id, coalesce(max_by({o.LEVEL}, seq) FILTER (WHERE {o.LEVEL} IS NOT NULL), 'LOW') AS threat_level
    FROM {o.FEED} f GROUP BY client_id"""
)
def severity_by_client(spark, sf_dir):
    return st.severity(feed(spark, sf_dir), ["client_id"])


@query(f"SELECT seq, client_id, kind, value FROM {o.FEED} f ORDER BY seq DESC LIMIT 40")
def last_n(spark, sf_dir):
    return st.last_n(feed(spark, sf_dir).select("seq", "client_id", "kind", "value"), 40)


@query(
    f"""SELECT seq, client_id, kind, value FROM (
    SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC) AS k FROM {o.FEED} f) WHERE k <= 5"""
)
def last_n_by_client(spark, sf_dir):
    return st.last_n(feed(spark, sf_dir).select("seq", "client_id", "kind", "value"), 5, ["client_id"])


@query(
    f"""SELECT seq, CASE WHEN kind = 'reset' THEN 'Pipeline reset. Ready for new training.'
    WHEN kind = 'threat_quantum' THEN 'QUANTUM WAVEFRONT DETECTED' WHEN kind = 'threat_mitm' THEN 'PACKET INTERCEPTED'
    WHEN kind = 'READY' THEN '[' || client_id || '] Acc: ' || {o.fixed_text('value', 1)} || '%'
    ELSE '[' || client_id || '] ' || kind END AS text,
    CASE WHEN kind = 'reset' THEN 'success' WHEN kind LIKE 'threat!_%' ESCAPE '!' THEN 'warn' ELSE 'info' END AS type
    FROM {o.FEED} f"""
)
def log_lines(spark, sf_dir):
    return st.log_lines(feed(spark, sf_dir))


@query(
    f"""SELECT run, round, 'Round ' || round || ' Global Accuracy: ' || {o.fixed_text('accuracy * 100.0e0', 2)} || '%' AS text,
    'success' AS type FROM {o.METRICS} m"""
)
def round_lines(spark, sf_dir):
    return st.round_lines(round_rows(spark, sf_dir))


@query(
    f"""SELECT round, started, ended, date_diff('microsecond', started, ended) / 1e6 AS seconds,
    CASE WHEN ended IS NULL THEN 'aborted' ELSE 'completed' END AS status
    FROM (SELECT round, min(ts) FILTER (WHERE kind = 'round_start') AS started, max(ts) FILTER (WHERE kind = 'round_complete') AS ended
          FROM {o.ROUND_EVENTS} r GROUP BY round)"""
)
def round_spans(spark, sf_dir):
    return st.rounds_from_events(fx.view(spark, sf_dir, fx.ROUND_EVENTS))


# ---- streams ----


def filed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates, written once in folders of two rounds; a day per round."""
    day = F.timestamp_seconds(F.col("round").cast("bigint") * 86_400)
    rows = updates(spark, sf_dir).drop("global_value").withColumns({"ts": day, "pair": F.floor(F.col("round") / 2).cast("int")})
    path = new_path(spark, "updates")
    rows.write.partitionBy("pair").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def update_stream(spark: SparkSession, filed: DataFrame) -> DataFrame:
    """The updates as a stream of files in the order of rounds; a micro-batch has about a file per core, as many as a pair of rounds."""
    files, path, schema = spark.sparkContext.defaultParallelism, new_path(spark, "update-stream"), filed.drop("pair").schema
    for pair in range(7):  # two rounds at a time, as they end; every client sends in each
        filed.where(F.col("pair") == pair).drop("pair").repartition(files, "client_id").write.mode("append").parquet(path)
    return ev.read_event_stream(spark, path, schema, files_per_trigger=files)


@query(
    """SELECT event_id, event_type, value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k FROM events"""
)
def stream_events(spark, sf_dir):
    events = ev.read_event_stream(spark, sf_dir, glob="events.parquet", props="k int")
    rows = events.select("event_id", "event_type", "value", "props.k")
    path, checkpoint = new_path(spark, "events"), new_path(spark, "events-checkpoint")
    ev.write_event_stream(rows, path, checkpoint).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query(f"{_ELEMENT9} {_FEDAVG} f")
def stream_fedavg(spark, sf_dir):
    result = sr.latest_result(sr.stream_combine(update_stream(spark, filed_updates(spark, sf_dir)), "1 day", "2 days"), spark, "fedavg", ["round_start", "param", "idx"])
    round_no = (F.unix_seconds("round_start") / 86_400).cast("int").alias("round")
    return rounded(result.select(round_no, "param", "idx", "value"), 9, ["value"])


@query(f"{_ELEMENT9} {_MEDIAN} f")
def stream_median(spark, sf_dir):
    return rounded(sr.stream_median(update_stream(spark, filed_updates(spark, sf_dir)), spark), 9, ["value"])


@query(_NEAR)
def stream_median_sketch(spark, sf_dir):
    filed = filed_updates(spark, sf_dir)
    medians = sr.stream_median_sketch(update_stream(spark, filed), spark, "1 day", "2 days")
    round_no = (F.unix_seconds("round_start") / 86_400).cast("int").alias("round")
    return rank_checked(medians.select(round_no, "param", "idx", "n", "value"), cb.collect_updates(filed))


@query(f"SELECT seq, client_id, status FROM {o.ADMITTED} a")
def stream_admit(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    sealed = fx.sealed_messages(rows)
    clients = materialize(rows.select("client_id", "registered", "has_key").distinct(), "clients")  # every micro-batch joins them
    source, out, checkpoint = (new_path(spark, n) for n in ("inbox", "outbox", "outbox-checkpoint"))
    end = sealed.agg(F.max("seq")).first()[0] + 1
    parts = 5
    for part in range(parts):  # messages arrive in order; the stream is stopped and resumed in between
        low, high = part * end // parts, (part + 1) * end // parts
        sealed.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(source)
        stream = ev.read_event_stream(spark, source, sealed.schema)
        sr.stream_admit(stream, fx.registry_of(clients), fx.keys_of(clients), out, checkpoint)
    return spark.read.schema("seq bigint, client_id string, status string").parquet(out)


@query(f"SELECT client_id, epoch, sum(epsilon) AS spent, count(*) AS steps FROM {o.LEDGER} l GROUP BY client_id, epoch")
def stream_ledger(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    path = new_path(spark, "ledger-stream")
    rows.repartition(4, "client_id").write.parquet(path)
    stream = ev.read_event_stream(spark, path, rows.schema, files_per_trigger=2)
    return sr.latest_result(sr.stream_ledger(stream), spark, "ledger", ["client_id", "epoch"])


@query(_STATUS)
def stream_client_status(spark, sf_dir):
    stream = ev.read_event_stream(spark, sf_dir, glob="events.parquet")
    return sr.stream_status(spark.sql(fx.FEED, events=stream), spark)


@query(
    f"""SELECT round, CAST(started AS TIMESTAMP) AS started, CAST(ended AS TIMESTAMP) AS ended, date_diff('microsecond', started, ended) / 1e6 AS seconds,
    CASE WHEN ended IS NULL THEN 'aborted' ELSE 'completed' END AS status
    FROM (SELECT round, min(ts) FILTER (WHERE kind = 'round_start') AS started, max(ts) FILTER (WHERE kind = 'round_complete') AS ended
          FROM {o.ROUND_EVENTS} r GROUP BY round)"""
)
def stream_round_spans(spark, sf_dir):
    """The round feed in the order of time, with a heartbeat a day after its end that lets the watermark pass the last rounds."""
    rows = fx.view(spark, sf_dir, fx.ROUND_EVENTS).withColumn("ts", ev.utc("ts"))
    rows = materialize(rows, "round-events")
    path = new_path(spark, "round-feed")
    low, high = rows.agg(F.min("round"), F.max("round")).first()
    for part in range(4):
        mine = F.floor((F.col("round") - low) * 4 / F.lit(high - low + 1)) == part
        rows.where(mine).write.mode("append").parquet(path)
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select("ts", F.lit(None).cast("int").alias("round"), F.lit("heartbeat").alias("kind"))
    beat.write.mode("append").parquet(path)
    feed = ev.read_event_stream(spark, path, rows.schema, files_per_trigger=8)
    spans = sr.stream_spans(feed, spark, "1 hour", 3_600_000).where("round IS NOT NULL")
    return spans.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})
