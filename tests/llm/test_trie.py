import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, pos string"


def brute(rows, rebuild=True):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = (turns.get(c - int(np.fmod(c, 100)), [])[:h] if rebuild else []) + own[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, inside in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(inside) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, inside in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(built[c]) == len(path)))
        out.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, rebuild=True, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    c = F.col("conv_id")
    how = (F.crc32(c.cast("string").cast("binary")) % 6, c - c % 100, 5) if rebuild else ()
    return sorted((tuple(r) for r in trie.trie(df, *how).collect()), key=str)


def made(rng, convs, kinds, longest):
    return [(int(c), t, "ua"[t % 2], f"w{rng.integers(kinds)} ü") for c in convs for t in range(int(rng.integers(1, longest)))]


@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_a_trie_of_dictionaries(spark, rebuild):
    rng = np.random.default_rng(6)
    rows = made(rng, [*range(60), *range(100, 140), 205, 207, -3, -100, -105], 2, 9)
    rows += [(150, None, None, None), (150, None, None, None), (150, 1, "u", "w0 ü"), (150, 1, "u", "w1 ü"), (None, 1, "u", "x"), (151, 5, None, ""), (300, 0, "u", "")]
    assert found(spark, rows, rebuild) == brute(rows, rebuild)


def test_copies_and_long_shared_prefixes(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BITS", 3)
    long = [("u", f"turn {i}") for i in range(40)]
    rows = [(c, i, *t) for c in (1, 2, 3, 11) for i, t in enumerate(long[: 40 if c < 3 else 37])]
    rows += [(c, 0, "u", "hello") for c in range(20, 80)] + [(c, 1, "a", "hi") for c in range(50, 80)]
    rows += [(7, i, "u", "a very long conversation") for i in range(120)]
    assert found(spark, rows, False) == brute(rows, False)


def test_conversation_over_many_parts_and_joins_of_many_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(common, "HEAVY", 20)
    rng = np.random.default_rng(8)
    rows = made(rng, range(1, 40), 3, 6) + [(100, i % 50, "u", f"w{i % 3}") for i in range(260)] + [(101, i, "u", f"w{i % 3}") for i in range(90)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table_single_and_turnless(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(spark, [(5, 0, "u", "x")], False) == brute([(5, 0, "u", "x")], False)
    few = [(c, 0, "u", "x") for c in range(101, 130)]  # no conversation 100: those with head turns keep none
    assert found(spark, few) == brute(few)


def test_long_text(spark):
    text = "é" * 300_000
    rows = [(1, 0, "u", text), (2, 0, "u", text), (2, 1, "a", text + "x")]
    assert found(spark, rows, False) == brute(rows, False)
