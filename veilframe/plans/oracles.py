"""SQL texts that state what each registered query must return, over the plain tables."""

from __future__ import annotations

from veilframe.plans import fixtures as fx

_NAMES = {t: t for t in fx.TABLES}


def sub(text: str) -> str:
    return f"({text.format(**_NAMES)})"


def r(expr: str, digits: int = 9) -> str:
    """Rounding that matches functions.numeric.fixed."""
    return f"floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits}"


LABELLED, VECTORS, UPDATES = sub(fx.LABELLED), sub(fx.VECTORS), sub(fx.UPDATES)
GLOBAL_MODEL, MEASUREMENTS, FEED = sub(fx.GLOBAL_MODEL), sub(fx.MEASUREMENTS), sub(fx.FEED)
ROUND_EVENTS, LEDGER, BUDGET = sub(fx.ROUND_EVENTS), sub(fx.LEDGER), sub(fx.BUDGET_CHANGES)

# ---- preparation ----

CLEAN = f"""(
SELECT row_key, num_total, num_acctbal, cat_segment, cat_priority,
       CASE WHEN trim(replace(raw_label, '.', '')) = '>50K' THEN 1 ELSE 0 END AS y
FROM (SELECT * REPLACE (nullif(cat_segment, '?') AS cat_segment) FROM {LABELLED} l)
WHERE cat_segment IS NOT NULL AND cat_priority IS NOT NULL)"""

LEVELS = f"""(
SELECT CAST(row_number() OVER (ORDER BY ord, level) - 1 + 2 AS INT) AS idx, feature || '_' || level AS name, feature, level
FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY level) AS k
      FROM (SELECT DISTINCT 0 AS ord, 'cat_segment' AS feature, cat_segment AS level FROM {CLEAN} a
            UNION SELECT DISTINCT 1, 'cat_priority', cat_priority FROM {CLEAN} b))
WHERE k > 1)"""

N_FEATURES = 10  # two numeric, 5 - 1 segments, 5 - 1 priorities


def _indicator(idx: int) -> str:
    feature = "cat_segment" if idx < 6 else "cat_priority"
    return f"CASE WHEN {feature} = (SELECT level FROM lv WHERE idx = {idx}) THEN 1.0e0 ELSE 0.0e0 END AS f_{idx}"


ONEHOT = f"""(
WITH lv AS (SELECT * FROM {LEVELS} x)
SELECT row_key, y, num_total AS f_0, num_acctbal AS f_1, {", ".join(_indicator(i) for i in range(2, N_FEATURES))}
FROM {CLEAN} c)"""


def hashed(seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST(row_key AS VARCHAR))"


SPLIT = f"""(
SELECT *, CASE WHEN substr({hashed()}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split FROM {ONEHOT} o)"""

_STATS = ", ".join(f"avg(f_{i}) AS m_{i}, stddev_pop(f_{i}) AS s_{i}" for i in range(N_FEATURES))
_SCALED = ", ".join(
    f"(f_{i} - m_{i}) / CASE WHEN s_{i} = 0 THEN 1.0e0 ELSE s_{i} END AS f_{i}" for i in range(N_FEATURES)
)
SCALED = f"""(
WITH sp AS MATERIALIZED (SELECT * FROM {SPLIT} s), st AS (SELECT {_STATS} FROM sp WHERE split = 'train')
SELECT row_key, y, split, {_SCALED} FROM sp, st)"""


def clients(source: str, n: int, lead: str = "") -> str:
    return f"""(
SELECT *, CAST(least(i // (total // {n}), {n - 1}) AS INT) AS client_id
FROM (SELECT *, row_number() OVER (ORDER BY {lead}{hashed()}) - 1 AS i, count(*) OVER () AS total FROM {source} q))"""


# ---- model ----


def start_weight(i: int) -> float:
    """Start model of the training queries."""
    return (i % 7 - 3) / 50


START_BIAS = 0.05


def margin(d: int, feature) -> str:
    return " + ".join([f"{START_BIAS!r}e0"] + [f"({start_weight(i)!r}e0) * {feature(i)}" for i in range(d)])


def gradient_step(source: str, d: int, feature, digits: int = 9) -> str:
    lr, l2 = 0.01, 1e-4
    grads = ", ".join(f"avg(err * {feature(i)}) AS g_{i}" for i in range(d))
    rows = " UNION ALL ".join(
        [
            f"SELECT client_id, 'W' AS param, {i} AS idx, {start_weight(i)!r}e0 * {1 - lr * l2!r}e0 - {lr}e0 * g_{i} AS v, n FROM gr"
            for i in range(d)
        ]
        + [f"SELECT client_id, 'b', 0, {START_BIAS!r}e0 - {lr}e0 * gb, n FROM gr"]
    )
    return f"""
WITH e AS (SELECT *, 1.0e0 / (1.0e0 + exp(-({margin(d, feature)}))) - y AS err FROM {source} t),
gr AS MATERIALIZED (SELECT client_id, {grads}, avg(err) AS gb, count(*) AS n FROM e GROUP BY client_id)
SELECT client_id, param, idx, {r('v', digits)} AS value, n AS num_samples FROM ({rows})"""


def sgd_epoch(source: str, d: int, steps: int, lr: float = 0.01, l2: float = 1e-4, seed: int = 42) -> str:
    """Mini-batch steps of every client in hash order from zero, one common table per step."""
    x = ", ".join(f"f_{i}" for i in range(d))
    tables = [
        f"""t AS MATERIALIZED (SELECT client_id, y, [{x}] AS x, size AS n, (place * {steps}) // size AS batch FROM (
            SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {hashed(seed)}) - 1 AS place, count(*) OVER (PARTITION BY client_id) AS size FROM {source} q))""",
        f"p0 AS (SELECT DISTINCT client_id, n, [{', '.join(['0.0e0'] * d)}] AS w, 0.0e0 AS b FROM t)",
    ]
    grads = ", ".join(f"avg(err * x[{i + 1}])" for i in range(d))
    for s in range(steps):
        tables.append(
            f"""p{s + 1} AS MATERIALIZED (SELECT p.client_id, p.n,
                CASE WHEN g IS NULL THEN w ELSE list_transform(list_zip(w, g), lambda e: e[1] * {1 - lr * l2!r}e0 - {lr}e0 * e[2]) END AS w,
                CASE WHEN g IS NULL THEN b ELSE b - {lr}e0 * gb END AS b
            FROM p{s} p LEFT JOIN (SELECT client_id, [{grads}] AS g, avg(err) AS gb FROM (
                SELECT t.client_id, x, 1.0e0 / (1.0e0 + exp(-(list_inner_product(w, x) + b))) - y AS err FROM t JOIN p{s} USING (client_id) WHERE batch = {s})
                GROUP BY client_id) USING (client_id))"""
        )
    last = f"p{steps}"
    return f"""
WITH {", ".join(tables)}
SELECT client_id, 'W' AS param, CAST(i - 1 AS INTEGER) AS idx, {r('w[i]')} AS value, n AS num_samples FROM {last}, unnest(range(1, {d + 1})) AS u(i)
UNION ALL SELECT client_id, 'b', 0, {r('b')}, n FROM {last}"""


# ---- privacy ----


def uniform(text: str, lane: int = 0) -> str:
    part = f"CAST('0x' || substr(sha256({text}), {1 + 13 * lane}, 13) AS BIGINT)"
    return f"((CAST({part} AS DOUBLE) + 0.5e0) / {float(2**52)!r})"


def gaussian(scale: str, text: str) -> str:
    return f"({scale}) * sqrt(-2.0e0 * ln({uniform(text)})) * cos({2 * 3.141592653589793!r}e0 * {uniform(text, 1)})"


def laplace(scale: str, text: str) -> str:
    u = f"({uniform(text)} - 0.5e0)"
    return f"-({scale}) * sign({u}) * ln(1.0e0 - 2.0e0 * abs({u}))"


def noise_text(seed: str) -> str:
    return key_text(f"'{seed}'", "round", "client_id", "param", "idx")


def key_text(*parts: str) -> str:
    """Each part as ``length:text,`` and NULL as ``-,``."""
    texts = [f"coalesce(length(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR) || ',', '-,')" for p in parts]
    return " || ".join(texts)


GAUSS_FACTOR = "sqrt(2.0e0 * ln(1.25e0 / 1.0e-5))"

CLIP = 0.1
DELTAS = f"(SELECT *, value - global_value AS delta FROM {UPDATES} u)"
CLIPPED = f"""(
SELECT *, CASE WHEN norm > {CLIP} THEN {CLIP}e0 / norm ELSE 1.0e0 END AS factor
FROM (SELECT *, sqrt(sum(delta * delta) OVER (PARTITION BY round, client_id, param)) AS norm FROM {DELTAS} d))"""


def private_rounds(train: str, test: str, rounds: int, lr: float, clip: float, seed: int, epsilon: float = 10.0) -> str:
    """Accuracy and all parameters of every round of private training from a zero model, one block of CTEs per round."""
    d, l2 = N_FEATURES, 1e-4
    params = [f"p_{i}" for i in range(d)] + ["p_b"]
    scale = f"{GAUSS_FACTOR} * {clip}e0 / {epsilon}e0"
    ctes = [
        f"tr AS MATERIALIZED (SELECT * FROM {train} t)",
        f"te AS MATERIALIZED (SELECT * FROM {test} t)",
        f"m0 AS (SELECT {', '.join(f'0.0e0 AS {p}' for p in params)})",
    ]
    margin_text = " + ".join(["p_b"] + [f"p_{i} * f_{i}" for i in range(d)])
    for k in range(1, rounds + 1):
        grads = ", ".join(f"avg(err * f_{i}) AS g_{i}" for i in range(d))
        deltas = ", ".join(f"p_{i} * {1 - lr * l2!r}e0 - {lr}e0 * g_{i} - p_{i} AS d_{i}" for i in range(d))
        norm = "sqrt(" + " + ".join(f"d_{i} * d_{i}" for i in range(d)) + ")"

        def sent(param: str, idx: int, delta: str, size: str, start: str, k: int = k) -> str:
            factor = f"CASE WHEN {size} > {clip} THEN {clip}e0 / {size} ELSE 1.0e0 END"
            text = key_text(f"'{seed}:{k}'", str(k), "client_id", f"'{param}'", str(idx))
            return f"sum(n * ({start} + {delta} * {factor} + {gaussian(scale, text)})) / sum(n)"

        mixed = ", ".join(
            [f"{sent('W', i, f'd_{i}', 'norm_w', f'p_{i}')} AS p_{i}" for i in range(d)]
            + [f"{sent('b', 0, 'd_b', 'abs(d_b)', 'p_b')} AS p_b"]
        )
        ctes += [
            f"e{k} AS (SELECT tr.*, 1.0e0 / (1.0e0 + exp(-({margin_text}))) - y AS err FROM tr, m{k - 1})",
            f"g{k} AS MATERIALIZED (SELECT client_id, {grads}, avg(err) AS g_b, count(*) AS n FROM e{k} GROUP BY client_id)",
            f"l{k} AS (SELECT *, {deltas}, -{lr}e0 * g_b AS d_b FROM g{k}, m{k - 1})",
            f"c{k} AS (SELECT *, {norm} AS norm_w FROM l{k})",
            f"m{k} AS MATERIALIZED (SELECT {mixed} FROM c{k})",
        ]
    hit = f"avg(CASE WHEN ({margin_text} > 0) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END)"
    scores = " UNION ALL ".join(
        f"SELECT {k} AS round, {r(hit)} AS accuracy, {', '.join(f'{r(f"max({p})", 7)} AS {p}' for p in params)} FROM te, m{k}"
        for k in range(1, rounds + 1)
    )
    return f"WITH {', '.join(ctes)} {scores}"


# ---- messages ----

MESSAGES = f"""(
WITH e AS (
  SELECT event_id, ts, user_id, props, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS rn
  FROM events)
SELECT event_id AS seq, ts, concat('client_', user_id) AS client_id,
       CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 13 = 0 THEN rn - 3 ELSE rn END AS counter,
       props AS payload, user_id % 20 <> 0 AS registered, user_id % 20 <> 1 AS has_key,
       event_id % 23 <> 0 AS sealed_ok, event_id % 29 <> 0 AS tag_ok
FROM e)"""

ADMITTED = f"""(
WITH s AS (
  SELECT *, coalesce(counter, -1) AS ctr,
         coalesce(max(CASE WHEN registered AND has_key AND sealed_ok THEN greatest(coalesce(counter, -1), -1) END)
           OVER (PARTITION BY client_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_counter
  FROM {MESSAGES} m)
SELECT *, CASE WHEN NOT registered THEN 'unregistered_client' WHEN ctr <= last_counter THEN 'replay_detected'
               WHEN NOT has_key THEN 'no_session_key' WHEN NOT sealed_ok THEN 'decryption_failed'
               WHEN NOT tag_ok THEN 'invalid_signature' ELSE 'ok' END AS status
FROM s)"""


def hmac(payload: str, client: str) -> str:
    """HMAC-SHA256 under the fixture key sha256('tag:' || client)."""

    def pad(word: int) -> str:
        words = [
            f"format('{{:08x}}', xor(CAST('0x' || substr(rpad(k, 128, '0'), {8 * i + 1}, 8) AS BIGINT), {word}))"
            for i in range(16)
        ]
        return f"unhex({' || '.join(words)})"

    return f"""
SELECT seq, client_id, sha256(o || unhex(sha256(i || encode({payload})))) AS tag
FROM (SELECT *, {pad(0x36363636)} AS i, {pad(0x5C5C5C5C)} AS o
      FROM (SELECT *, sha256('tag:' || {client}) AS k FROM {MESSAGES} m))"""


# ---- metrics and feed ----

METRICS = f"""(
SELECT run, round, avg(accuracy) AS accuracy, sum(total_time) AS total_time, sum(training_time) AS training_time,
       sum(encryption_time) AS encryption_time, max(aggregation_time) AS aggregation_time,
       CAST(sum(communication_size_bytes) AS BIGINT) AS communication_size_bytes
FROM {MEASUREMENTS} m GROUP BY run, round)"""

METRIC_COLUMNS = ", ".join(
    ["run", "round", f"{r('accuracy')} AS accuracy"]
    + [f"{r(c, 6)} AS {c}" for c in ("total_time", "training_time", "encryption_time", "aggregation_time")]
    + ["communication_size_bytes"]
)

SUMMARY = f"""(
SELECT run, max_by(accuracy, round) AS final_accuracy, avg(total_time) AS avg_round_time,
       sum(training_time) AS total_training_time, sum(encryption_time) AS total_encryption_time,
       sum(aggregation_time) AS total_aggregation_time,
       sum(communication_size_bytes) / 1048576.0e0 AS total_communication_mb,
       sum(communication_size_bytes) / count(*) / 1024.0e0 AS avg_communication_per_round_kb
FROM {METRICS} m GROUP BY run)"""


def of(run: str, col: str) -> str:
    return f"max(CASE WHEN run = '{run}' THEN {col} END)"


def overhead(col: str) -> str:
    base, other = of("plaintext", col), of("encrypted", col)
    return f"({other} - {base}) * 100.0e0 / nullif({base}, 0)"


COMPARISON = f"""(
SELECT {of('encrypted', 'final_accuracy')} - {of('plaintext', 'final_accuracy')} AS accuracy_difference,
       {overhead('avg_round_time')} AS time_overhead_percentage,
       {overhead('total_communication_mb')} AS communication_overhead_percentage,
       {of('encrypted', 'total_encryption_time')} - {of('plaintext', 'total_encryption_time')} AS encryption_overhead_seconds
FROM {SUMMARY} s)"""


def fixed_text(expr: str, digits: int) -> str:
    n = f"CAST(floor(abs({expr}) * {float(10**digits)!r}e0 + 0.5e0) AS BIGINT)"
    return (
        f"(CASE WHEN ({expr}) < 0 AND {n} > 0 THEN '-' ELSE '' END || CAST({n} // {10**digits} AS VARCHAR) || '.' || "
        f"lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0'))"
    )


LEVEL = "CASE kind WHEN 'threat_quantum' THEN 'CRITICAL' WHEN 'threat_mitm' THEN 'HIGH' WHEN 'reset' THEN 'LOW' END"
