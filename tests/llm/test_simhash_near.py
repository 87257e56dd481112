import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from colloquy.llm import simhash_near
from colloquy.llm.common import utf8


def kept_by_all_pairs(rows):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_stage_equals_all_pairs_at_planted_similarities(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one  TWO"), (5, "one two three")]
    planted = 0
    for size in (60, 200, 1000):
        for k in range(16):
            base = [rng.choice(vocabulary) for _ in range(size)]
            rows.append((len(rows) + 1, " ".join(base)))
            for similarity in (0.7, 0.8, 0.85, 0.9, 0.95):
                # one run at an end: (size - 4 - cut) of the shingles are left
                cut, copy = int((size - 4) * (1 - similarity)), list(base)
                for i in range(cut):
                    copy[size - 1 - i] = f"x{len(rows)}_{i}"
                rows.append((len(rows) + 1, " ".join(copy[: size - cut] if k % 2 else copy)))
                planted += 1
    hub = [rng.choice(vocabulary) for _ in range(300)]  # copies near to the first only, with edits at other places each
    rows.append((len(rows) + 1, " ".join(hub)))
    for k in range(40):
        copy = list(hub)
        for i in rng.sample(range(300), 5):
            copy[i] = f"y{k}_{i}"
        rows.append((len(rows) + 1, " ".join(copy)))
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = kept_by_all_pairs(rows)
    assert len(want) < len(rows) - planted // 2
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("part,shingles", [(4096, 1 << 21), (8, 900)])
def test_parts_of_any_size_give_the_same_groups(spark, part, shingles, monkeypatch):
    monkeypatch.setattr(simhash_near, "PART", part)
    monkeypatch.setattr(simhash_near, "PART_SHINGLES", shingles)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = [(k + 10, " ".join(w if rng.random() > 0.02 else f"z{rng.randint(0, 99)}" for w in base)) for k in range(120)]
    rows += [(500 + k, rows[k % 7][1]) for k in range(60)] + [(600 + k, " ".join(rng.choice(base) for _ in range(60))) for k in range(40)]
    got = simhash_near.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_all_pairs(rows)


def test_nulls_ties_and_clashing_names(spark):
    rows = [(7, "a b c d e f", 1), (7, "a b c d e f", 2), (None, "a b c d e f", 3), (None, "only here", 4), (3, None, 5), (2, "", 6), (9, "x " * 200_000, 7)]
    names = ["_row", "_set", "_size", "_fp0", "_bands", "_key", "root", "node", "_n", "_gone", "_pair", "_side", "_first", "a", "b", "_text"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").selectExpr("*", *(f"k as {n}" for n in names))
    got = simhash_near.deduplicated(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in kept) == [("2", ""), ("7", "a b c d e"), ("9", "x x x x x"), ("None", "only here")]
    assert all(r[n] == r.k for r in kept for n in names)


def test_shingles_are_those_of_words():
    texts = ["A b  c d e f", "a b c d e", "a b", "a", "", None, "a b c d e f a b c d e f", "b a"]
    sets = simhash_near.shingle_sets(*utf8(pa.array(texts)))
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 0, 6, 1]
    assert np.isin(sets[1], sets[0]).all() and np.isin(sets[0], sets[6]).all()
    assert sets[2] != sets[7] and sets[2] != sets[3]


def test_empty_table(spark):
    assert simhash_near.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lists_say_what_bits_say(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(40)]
        rows += [(len(rows) + 1, " ".join(base)), (len(rows) + 2, " ".join(base[:-2] + ["x", "y"])), (len(rows) + 3, " ".join(base[:20]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_all_pairs(rows)
    assert sorted(r.doc_id for r in simhash_near.deduplicated(docs).collect()) == want
    # the workers make bits or lists by the module's bound, so the two are compared here
    texts = pa.array([t for _, t in rows])
    sets = simhash_near.shingle_sets(*utf8(texts))
    distinct, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    bits = simhash_near._by_bits(back, np.where(n > 1, np.cumsum(n > 1) - 1, -1), starts, ends, int((n > 1).sum()))
    lists = simhash_near._by_lists(back, starts, ends, len(distinct))
    every = np.arange(len(sets))
    for i in range(len(sets)):
        real = [len(np.intersect1d(sets[i], s)) for s in sets]
        js = every[every != i]
        assert bits(i, js).tolist() == lists(i, js).tolist() == [real[j] for j in js]


def test_many_short_texts_in_a_part_need_no_matrix():
    rng = np.random.default_rng(9)
    words = rng.integers(0, 1 << 40, (100_000, 4))
    texts = [" ".join(f"w{x}" for x in row) + " a b" for row in words.tolist()]
    texts[1::2] = texts[::2]  # each twice, so that all shingles are shared
    n = len(texts)
    columns = [np.zeros(n, np.int64), np.full(n, 2, np.int8), np.arange(n), np.full(n, 2), np.arange(n, dtype=np.int64) // 2, np.zeros(n, np.int64)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts)], ["key", "side", "set", "size", "fp0", "fp1", "text"])
    sets = simhash_near.shingle_sets(*utf8(batch.column(6)))
    distinct, back, _ = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    assert len(sets) * (len(distinct) // 64 + 1) * 8 > simhash_near.MATRIX
    common = simhash_near._by_lists(back, starts, ends, len(distinct))
    assert common(0, np.arange(1, n))[0] == 2 and common(0, np.arange(2, n)).max() <= 1
