"""Shared by the test files."""

import hashlib

import numpy as np


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def key_table(spark, clients):
    rows = [(c, hashlib.sha256(b"s" + c.encode()).digest(), hashlib.sha256(b"t" + c.encode()).digest()) for c in clients]
    return spark.createDataFrame(rows, "client_id string, session_key binary, tag_key binary")


def gradient(x, y, w, b, lr, l2, steps):
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w * (1 - lr * l2) - lr * (err[:, None] * x).mean(axis=0), b - lr * err.mean()
    return [*w, b]
