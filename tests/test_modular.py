"""Modular powers inside tasks: the library's results are Python's, at a fraction of the time."""

import secrets
import time

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilframe.functions import modular
from veilframe.functions.modular import FixedBase, FixedExponent
from veilframe.functions.paillier import Decryptor, Encryptor, generate_keypair
from veilframe.operators import encrypted as enc


@pytest.mark.parametrize("with_library", [True, False])
def test_powers_equal_those_of_python(monkeypatch, with_library):
    if not with_library:
        monkeypatch.setattr(modular, "library", lambda: None)
    for bits in (16, 255, 512, 1024):
        m = secrets.randbits(bits) | 1 | 1 << (bits - 1)
        e, base = secrets.randbits(bits), secrets.randbelow(m)
        power, powers = FixedExponent(m, e), FixedBase(m, base, 5)
        for x in (0, 1, 2, m - 1, m, m + 3, m * m - 1, secrets.randbelow(m)):
            assert power(x) == pow(x, e, m)
        for exponent in (bytes(5), b"\x01" + bytes(4), b"\xff" * 5, secrets.token_bytes(5)):
            assert powers(exponent) == pow(base, int.from_bytes(exponent, "little"), m)


def test_keys_work_across_library_and_plain_integers(monkeypatch):
    key = generate_keypair(512, seed=7)
    quick = Encryptor(key.public), Decryptor(key)
    monkeypatch.setattr(modular, "library", lambda: None)
    plain = Encryptor(key.public), Decryptor(key)
    for m in (0, 1, -1, key.public.n // 4, -(key.public.n // 4)):
        for e in (quick[0], plain[0]):
            c = e.encrypt_integer(m)
            assert quick[1].decrypt(c) == plain[1].decrypt(c) == m


@pytest.mark.skipif(modular.library() is None, reason="no libcrypto here")
def test_a_decryption_costs_a_fraction_of_plain_powers():
    key = generate_keypair(512, seed=7)
    e, d = Encryptor(key.public), Decryptor(key)
    ciphers = [e.encrypt_integer(i) for i in range(60)]

    def least(run):
        times = []
        for _ in range(5):
            started = time.perf_counter()
            for c in ciphers:
                run(c)
            times.append(time.perf_counter() - started)
        return min(times)

    squares = [(p * p, p - 1) for p in (key.p, key.q)]
    assert least(d.decrypt) < least(lambda c: [pow(c, e_, m) for m, e_ in squares]) / 2


@pytest.mark.parametrize("kept", [enc.OPEN_WEIGHTS, 2])
def test_a_fold_raises_once_per_weight_of_a_group(monkeypatch, kept):
    key, bits = generate_keypair(256, seed=5), 64
    e, d = Encryptor(key.public, bits), Decryptor(key, bits)
    rows = [(g, i - 50, (7, 0, 12, 1, 30)[i % 5]) for g in range(2) for i in range(100)]
    ciphers = [{"ciphertext": str(e.encrypt_integer(x)), "exponent": -bits} for _, x, _ in rows]
    schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("cipher", enc.CIPHER), T.StructField("w", T.LongType())])
    columns = [[r[0] for r in rows], ciphers, [r[2] for r in rows]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], schema=to_arrow_schema(schema))
    powers = []
    monkeypatch.setattr(enc, "pow", lambda *a: powers.append(a[1]) or pow(*a), raising=False)
    monkeypatch.setattr(enc, "OPEN_WEIGHTS", kept)
    out = pa.Table.from_batches(enc._fold(schema, 1, key.public, True, bits)([batch.slice(0, 37), batch.slice(37)])).to_pylist()
    want = [(g, sum(x * w for h, x, w in rows if h == g), sum(w for h, _, w in rows if h == g)) for g in range(2)]
    assert [(r["g"], d.decrypt(int(r["cipher"]["ciphertext"])), r["w"]) for r in out] == want
    assert kept == 2 or len(powers) == 10
