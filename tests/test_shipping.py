"""Task code runs in workers that do not have the package."""

import subprocess
import sys
from pathlib import Path

from pyspark import cloudpickle

from veilframe.functions.paillier import Decryptor, Encryptor, generate_keypair
from veilframe.operators.model import _multiply

LOAD = """
import pickle, sys
key, encrypt, decrypt, hits = pickle.load(sys.stdin.buffer)
assert not any(m.startswith("veilframe") for m in sys.modules)
import pyarrow as pa
print(decrypt(key).value(encrypt(key.public).encrypt(-2.5)), hits(pa.table({"x": [[2.0]], "y": [1]}), pa.table({"c": ["a"], "_p": [[1.0, 1.0]]})).to_pylist())
"""


def test_task_code_needs_no_installed_package(tmp_path):
    def encrypt(key):
        return Encryptor(key)

    def decrypt(key):
        return Decryptor(key)

    data = cloudpickle.dumps((generate_keypair(256, seed=1), encrypt, decrypt, _multiply("c", 1)))
    run = subprocess.run([sys.executable, "-c", LOAD], input=data, capture_output=True, cwd=tmp_path)
    assert run.stdout.decode().strip() == "-2.5 [{'c': 'a', 'hits': 1, 'n': 1}]", run.stderr.decode()


def test_base_queries_remain_without_a_package_of_the_optional_part():
    code = "import sys; sys.modules['xxhash'] = sys.modules['zstandard'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()) >= 88)"
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, cwd=Path(__file__).resolve().parents[1])
    assert run.stdout.decode().strip() == "True", run.stderr.decode()
