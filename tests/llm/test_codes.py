import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import codes, common
from colloquy.llm.codes import nearest

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int"


def brute(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks by plain loops; zeros behind shorter vectors."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    real = max((len(r[1]) for r in kept), default=0)
    size = -(-real // parts)
    whole = [[math.floor(scale * x) for x in r[1]] + [0] * (size * parts - len(r[1])) for r in kept]
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, list(kept[i][1])))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    choose = lambda p, v: min((apart(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        named = [[choose(p, v[p])[1] for p in range(parts)] for v in cut]
        new = []
        for p in range(parts):
            book = []
            for k, old in enumerate(books[p]):
                own = [v[p] for v, n in zip(cut, named) if n[p] == k]
                book.append(tuple(sum(x) // len(own) for x in zip(*own)) if own and size else old)
            new.append(book)
        books = new
    out = []
    for r, v in zip(kept, cut):
        found = [choose(p, v[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books, real


def compared(spark, rows, parts, entries, rounds=2):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    coded, books = codes.encoded(df, parts, entries, rounds, keep=("label",))
    got = codes.with_label_error(coded).collect()
    expected, told, real = brute(rows, parts, entries, rounds, codes.SCALE)
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + tuple(r[2:])
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got), key=key) == sorted(expected, key=key)
    by = {}
    for _, label, _, error in expected:
        by[label] = by.get(label, 0) + error
    assert all(r.label_error == by[r.label] for r in got)
    size = -(-real // parts)
    shown = [[[x for k, x in enumerate(e) if p * size + k < real] for e in book] for p, book in enumerate(told)]
    assert books == shown
    assert codes.digest(books) == hashlib.sha256(",".join(str(x) for b in shown for e in b for x in e).encode()).hexdigest()


def test_equals_plain_loops_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-3, 4, 8) / 256).tolist(), int(i) % 3) for i in rng.permutation(200)]
    rows += [(500 + i, rows[0][1], 1) for i in range(80)] + [(3, rows[5][1], None), (3, rows[5][1], None), (None, rows[6][1], 2)]
    rows += [(901, None, 1), (902, [0.1] * 7 + [None], 1), (903, [0.1] * 7 + [float("nan")], 1), (904, [float("-inf")] * 8, 1)]
    rows += [(905, [0.001, -0.001], None), (906, [], 0)]
    compared(spark, rows, 4, 16)


def test_few_rows_uneven_lengths_and_empty_tables(spark):
    compared(spark, [(7, [0.5, -0.25, 1.0], 1), (5, [0.0, 0.0, 0.0], 1)], 2, 64)
    compared(spark, [(1, [], 1), (2, [], None)], 2, 4)
    empty = spark.createDataFrame([], SCHEMA)
    coded, books = codes.encoded(empty, keep=("label",))
    assert coded.count() == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert codes.with_label_error(coded).count() == 0


def test_components_beyond_the_bound_count_as_the_bound(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0], 1), (2, [-1e300, 0.0], 1), (3, [1e300, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    coded, _ = codes.encoded(df, 2, 1, 0)
    got = {r.vec_id: r.error for r in coded.collect()}
    assert got[1] == got[3] == 0 and 0 < got[2] < 1 << 62


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_annulus_finds_the_nearest_and_the_lowest_of_ties(spread):
    rng = np.random.default_rng(spread)
    points, entries = rng.integers(-spread, spread + 1, (3000, 4)), rng.integers(-spread, spread + 1, (64, 4))
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    index, distance = nearest(points, entries)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert [len(x) for x in nearest(points[:0], entries)] == [0, 0]


def test_only_the_annulus_is_compared(monkeypatch):
    rng = np.random.default_rng(1)
    entries = (rng.normal(size=(64, 4)) * np.linspace(1, 400, 64)[:, None]).astype(np.int64)
    points = entries[rng.integers(0, 64, 1000)] + rng.integers(-1, 2, (1000, 4))
    pairs = []
    repeat = np.repeat
    monkeypatch.setattr(codes.np, "repeat", lambda a, n: pairs.append(int(np.sum(n))) or repeat(a, n))
    index, _ = nearest(points, entries)
    assert (index == ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert 0 < max(pairs) < 8 * len(points)  # of 64 entries each


def test_many_keys_are_looked_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    rows = [(i % 50 if i % 3 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int")
    monkeypatch.setattr(common, "HEAVY", 5)
    table = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    got = common.looked_up(df, table, "k", "n").collect()
    sums = {}
    for k, v in rows:
        sums[k] = sums.get(k, 0) + v
    assert sorted((r.v, r.s) for r in got) == sorted((v, sums[k]) for k, v in rows)
