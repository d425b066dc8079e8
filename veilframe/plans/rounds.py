"""Federated training: the round loop over the operators."""

from __future__ import annotations

import json
import secrets
import time
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.paillier import PrivateKey
from veilframe.operators.combine import combine
from veilframe.operators.encrypted import from_wire, he_encrypt, he_fedavg, to_wire
from veilframe.operators.messages import admit, extract_updates, payload_size, seal_messages
from veilframe.operators.model import accuracy, init_model, local_gradient_step, local_sgd_epoch, predict
from veilframe.operators.prep import feature_columns
from veilframe.operators.privacy import account_steps, privatize_updates
from veilframe.skew import attach
from veilframe.storage import commit_text, materialize, names_in, new_path, read_text


@dataclass(frozen=True)
class RoundConfig:
    """Defaults: 10 rounds, budget 10 per update, clipping norm 2."""

    rounds: int = 10
    solver: str = "gradient"  # or 'sgd': an epoch of mini-batches
    lr: float = 0.01
    l2: float = 1e-4
    steps: int = 1
    privacy: bool = True
    epsilon: float = 10.0
    delta: float = 1e-5
    clip: float = 2.0
    mechanism: str = "gaussian"
    seed: int | str | None = None
    how: str = "fedavg"  # or 'median'
    key: PrivateKey | None = None  # combine under encryption
    run: str = "run"


@dataclass(frozen=True)
class RunResult:
    models: DataFrame
    metrics: DataFrame
    ledger: DataFrame | None
    released: DataFrame
    admissions: DataFrame | None


def run_rounds(
    train: DataFrame,
    test: DataFrame,
    config: RoundConfig | None = None,
    registry: DataFrame | None = None,
    keys: DataFrame | None = None,
    log: str | None = None,
) -> RunResult:
    """Train, privatise, seal and admit, combine, evaluate, record; all clients in one job per step.

    ``train`` is ``(client_id, row_key, y, f_0..)``. Updates and models are written per round, so a plan never spans
    rounds. With ``registry`` and ``keys`` updates travel as sealed messages and rejected ones are left out; a message of an
    earlier round, or with a counter the registry has seen, is a replay. With ``config.key`` every client encrypts its update
    before it is sealed, and only the sum over clients is decrypted.

    ``log`` is a folder to go on from. A round's tables get folders of their own and count once its note, which names them, has been
    committed, last of all and whole; a run that died goes on after the last note. The seed of a round's noise is noted before
    the first use, so a repeated round releases the same values again and the ledger charges them once. Keep the folder as secret as
    the seed.
    """
    config = config or RoundConfig()
    if config.key is not None and config.how != "fedavg":
        raise ValueError(f"ciphertexts can be added but not combined by {config.how}")
    spark = train.sparkSession
    folder = log or new_path(spark, "rounds")
    settings = json.dumps({f.name: str(getattr(config, f.name)) for f in fields(config) if f.name not in ("rounds", "key", "seed")})
    if not commit_text(spark, f"{folder}/settings.json", settings) and read_text(spark, f"{folder}/settings.json") != settings:
        raise ValueError(f"the rounds in {folder} were run with other settings")
    notes = {int(n.removesuffix(".json")): json.loads(read_text(spark, f"{folder}/notes/{n}")) for n in names_in(spark, f"{folder}/notes")}

    def finish(round: int, tables: dict[str, list[str]], metrics: list | None = None) -> None:
        note = {"tables": tables, "metrics": metrics}
        commit_text(spark, f"{folder}/notes/{round:06d}.json", json.dumps(note))
        notes[round] = note

    def back(names: list[str]) -> dict[str, DataFrame]:
        """The tables of all finished rounds that have them."""
        out = {}
        for name in names:
            found = [n["tables"][name] for _, n in sorted(notes.items()) if name in n["tables"]]
            if found:
                out[name] = spark.read.schema(found[0][1]).parquet(*[path for path, _ in found])
        return out

    def last(name: str) -> DataFrame | None:
        found = [n["tables"][name] for _, n in sorted(notes.items()) if name in n["tables"]]
        return spark.read.schema(found[-1][1]).parquet(found[-1][0]) if found else None

    if 0 not in notes:
        tables: dict[str, list[str]] = {}
        _keep(init_model(spark, len(feature_columns(train))), "model", folder, 0, tables)
        finish(0, tables)
    start = None
    if registry is not None and "last_counter" in registry.columns:
        start = registry.groupBy("client_id").agg(F.max("last_counter").alias("start_counter"))
    for round in range(max(notes) + 1, config.rounds + 1):
        tables = {}
        started = time.monotonic()
        model = last("model")
        if config.solver == "sgd":
            local = local_sgd_epoch(train, model, lr=config.lr, l2=config.l2)
        else:
            local = local_gradient_step(train, model, config.lr, config.l2, config.steps)
        local = _keep(local.withColumn("round", F.lit(round)), "local", folder, round, tables)
        trained = time.monotonic()
        if config.privacy:
            seed = f"{secrets.token_hex(16) if config.seed is None else config.seed}:{round}"
            commit_text(spark, f"{folder}/seeds/{round:06d}", seed)
            seed = read_text(spark, f"{folder}/seeds/{round:06d}")
            sent = privatize_updates(
                local, model, config.clip, config.epsilon, config.delta, config.mechanism, seed
            )
            _keep(account_steps(sent, config.epsilon, config.delta, config.mechanism, config.clip), "ledger", folder, round, tables)
            _keep(sent.select("round", "client_id", "param", "idx", "noise"), "released", folder, round, tables)
        else:
            sent = local
        size = None
        if config.key is not None:
            plain = sent.select("round", "client_id", "param", "idx", "value", "num_samples")
            ciphers = he_encrypt(plain, "value", config.key.public).withColumn("value", to_wire("cipher")).drop("cipher")
            sent = materialize(ciphers, "ciphers")  # encryption is random: once
        if registry is not None and keys is not None:
            seen = last("counters")
            seen = start if seen is None else seen
            packed = _pack(sent, round)
            if start is not None:
                held = attach(packed, start, ["client_id"], "left")
                since = F.greatest(F.coalesce("start_counter", F.lit(0)), F.lit(0))
                packed = held.withColumn("counter", since + F.col("counter")).drop("start_counter")
            size = packed.agg(F.sum("size_bytes")).first()[0]
            sealed = materialize(seal_messages(packed.drop("size_bytes"), keys), "sealed")
            messages = sealed if seen is None else attach(sealed, seen, ["client_id"], "left")
            admitted = materialize(admit(messages, registry, keys), "admitted")
            _keep(admitted.select(F.lit(round).alias("round"), "client_id", "counter", "status"), "admissions", folder, round, tables)
            now = admitted.where("status = 'ok'").select("client_id", F.col("counter").alias("start_counter"))
            both = now if seen is None else now.unionByName(seen)
            _keep(both.groupBy("client_id").agg(F.max("start_counter").alias("start_counter")), "counters", folder, round, tables)
            element = "double" if config.key is None else "string"
            sent = extract_updates(admitted, ["client_id"], element).withColumn("round", F.lit(round))
        encrypted = time.monotonic()
        previous = model.withColumn("round", F.lit(round))
        if config.key is not None:
            arrived = sent.select("param", "idx", from_wire("value").alias("cipher"), "num_samples")
            mean = he_fedavg(arrived, ["param", "idx"], config.key).withColumn("num_samples", F.lit(1))
            new = combine(mean.withColumn("round", F.lit(round)), previous)
        else:
            new = combine(sent, previous, config.how)
        new = _keep(new, "model", folder, round, tables)
        combined = time.monotonic()
        score = accuracy(predict(test, new)).first()
        times = [time.monotonic() - started, trained - started, encrypted - trained, combined - encrypted]
        finish(round, tables, [config.run, round, score.accuracy, *times, size])
    rows = spark.createDataFrame(
        [tuple(n["metrics"]) for _, n in sorted(notes.items()) if n["metrics"]],
        "run string, round int, accuracy double, total_time double, training_time double, encryption_time double, "
        "aggregation_time double, communication_size_bytes bigint",
    )
    found = back(["model", "ledger", "released", "admissions"])
    return RunResult(found["model"], rows, *[found.get(name) for name in ("ledger", "released", "admissions")])


def _keep(df: DataFrame, name: str, folder: str, round: int, tables: dict[str, list[str]]) -> DataFrame:
    """Write a table of a round into a folder of its own and name it in ``tables``; the table read back."""
    path = f"{folder}/round-{round:06d}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tables[name] = [path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pack(sent: DataFrame, round: int) -> DataFrame:
    """One message per client: its parameters as JSON; the counter is the round."""
    tensors = sent.groupBy("client_id", "param").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda e: e["value"]).alias("x"),
        F.max("num_samples").alias("num_samples"),
    )
    messages = tensors.groupBy("client_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "x")))).alias("model_params"),
        F.max("num_samples").alias("num_samples"),
    )
    sized = payload_size(messages, ["client_id", "model_params", "num_samples"])
    return sized.select(
        "client_id",
        F.lit(round).cast("bigint").alias("seq"),
        F.lit(round).cast("bigint").alias("counter"),
        F.to_json(F.struct("client_id", "model_params", "num_samples")).alias("payload"),
        "size_bytes",
    )
