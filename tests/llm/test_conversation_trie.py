import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.llm import conversation_trie as ct


def brute(rows):
    """Nodes by trying all prefixes; ``rows`` are (conv, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            p = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((turn is not None, turn or 0, role, p, (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        saved = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        parts = [below(p) for p in children[path]]
        return sum(x for x, _ in parts) or 1, saved + sum(x for _, x in parts)

    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if built[c] == path)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(cs), len(path), parent, len(cs), len(children[path]), *below(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def got(df, ranges):
    return sorted((tuple(r) for r in ct.branched_trie(df, ranges).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("ranges", [1, 7])
def test_random_conversations(spark, ranges):
    rng = random.Random(ranges)
    rows = []
    for c in range(60):
        n = rng.randrange(1, 6) if c % 9 else 40
        rows += [(c, i, rng.choice(["user", "bot"]), rng.choice(["a", "b", "ü" * 3, ""])) for i in range(n)]
    for c in range(100, 180):  # copies of one long path, more than a range holds
        rows += [(c * 5, i, "user", f"same {i}") for i in range(12)]
    rows += [(1, 2, None, None), (1, None, "x", "first"), (1, None, "x", "first"), (1, 0, None, "tie"), (None, 1, "a", "b"), (7777, 3, "only", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("c", "path", "part", "node", "sizes", "b", "x")})
    assert got(df.repartition(3), ranges) == brute(rows)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty, 3) == [] == got(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA), 3)


def test_skeleton_is_numbered_in_preorder():
    a, b, c = (bytes([i]) * ct.WIDTH for i in range(3))
    s = ct.Skeleton([a + a, a, a + b, b + c])
    assert s.rows() == [(0, -1, 5, 2), (1, 0, 3, 2), (2, 1, 2, 0), (3, 1, 3, 0), (4, 0, 5, 1), (5, 4, 5, 0)]
    assert ct.shared_turns(a + b, a + c) == 1 and ct.shared_turns(a, a + b) == 1 and ct.shared_turns(b"", a) == 0 and ct.shared_turns(a + b + c, a + b + c) == 3


def test_ids_of_a_split_node_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOB", 20)
    rows = [(5 * c, i, "u", str(i)) for c in range(300) for i in range(9)]
    assert got(spark.createDataFrame(rows, SCHEMA), 5) == brute(rows)
