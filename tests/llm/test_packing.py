import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from colloquy.llm import packing


def checked(histogram, rows, capacity):
    """Every rank of every length once, every sequence gapless and within the capacity; the number of sequences."""
    ranks, fill = {}, {}
    for n, a, b, first, offset in rows:
        ranks.setdefault(n, []).append((a, b))
        for k in range(b - a):
            fill.setdefault(first + k, []).append((offset, n))
    for n, count in histogram.items():
        parts = sorted(ranks.pop(n))
        assert [parts[0][0], *(b for _, b in parts)] == [*(a for a, _ in parts), count]
    assert not ranks
    for items in fill.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return len(fill)


@pytest.mark.parametrize("seed", range(4))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 129, 3000), np.clip(rng.gamma(2, 20, 900).astype(int) + 1, 1, 128), rng.integers(40, 90, 500), rng.integers(1, 9, 7)][seed]
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    least = -(-int(lengths.sum()) // 128)
    for small in (1 / 16, 1 / 4):
        found = checked(histogram, packing.plan(histogram, 128, 32, small), 128)
        assert least <= found <= 1.002 * best_fit(lengths, 128) + 1


def best_fit(lengths, capacity):
    """Sequences that best fit of single lengths, longest first, opens."""
    rooms = [0] * capacity + [10**9]
    for n in sorted(lengths.tolist(), reverse=True):
        room = next(r for r in range(n, capacity + 1) if rooms[r])
        rooms[room] -= 1
        rooms[room - n] += 1
    return 10**9 - rooms[capacity]


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_billions_take_few_steps(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 1025), 700, replace=False), rng.integers(1, 10**9, 700))}
    rows = packing.plan(histogram)
    sequences = max(first + b - a for _, a, b, first, _ in rows)
    plain = packing._Runs(1024)
    for n in sorted(histogram, reverse=True):
        plain.fit(n, 0, histogram[n])
    assert len(rows) < 20_000 and sequences <= 1.001 * plain.next


def test_grouping_alone_is_as_good_as_best_fit_of_single_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    histogram = {r.length: r.n for r in packing.pieces(docs).groupBy("length").count().withColumnRenamed("count", "n").collect()}
    lengths = np.repeat(list(histogram), list(histogram.values()))
    assert checked(histogram, packing.plan(histogram), 1024) <= best_fit(lengths, 1024)


def test_known_optimum():
    assert checked({60: 4, 40: 4}, packing.plan({60: 4, 40: 4}, 100), 100) == 4
    assert packing.plan({}) == []


ROWS = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "word " * 3000), (5, "é\U0001f600 \n\n  x"), (3, "a <|endoftext|> b"), (None, "null id"), (6, "x" * 20000), (7, "y " * 1023)]


def test_packed_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as piece", "'q' as ids")
    rows = packing.packed(docs).collect()
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(str(reference.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in ROWS)
    by_sequence, documents = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, {}).setdefault(r.start, []).append(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    texts = []
    for parts in documents.values():
        for copy in range(len(parts[0])):
            texts.append(str([i for start in sorted(parts) for i in parts[start][copy]]))
    assert sorted(texts) == want
    least = -(-sum(r.length for r in rows) // 1024)
    assert len(by_sequence) <= least + 1


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), ids=False).count() == 0
