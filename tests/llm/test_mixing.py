import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import mixing
from colloquy.llm.common import utf8


def corpus(n=150):
    rng = random.Random(8)
    parts = ["the", "an", "ing", "er", "on", "st", "re", "Ti", "é"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 150)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, " \t\x0b"), (None, "The the\x1cx"), (3, rows[3][1]), (3, rows[3][1]), (903, "z" * 30000)]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    return [*low.split(), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n", "3 as score")
    return rows, mixing.scored(docs).collect()


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_base_equals_brute_force(spark, head, monkeypatch):
    monkeypatch.setattr(mixing, "HEAD_WORDS", head)  # with 50, most words take the way of the join
    rows = corpus()
    got = mixing.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts = collections.Counter(t for d, text in rows if not held(d) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((len(t := tokens(text)), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in t)) for _, text in rows)
    found = sorted((r.n_tokens, r.n_known, r.base_score) for r in got)
    assert {r.train_tokens for r in got} == {total}
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in found], [x[2] for x in want])


def test_model_scores(scored):
    rows, got = scored
    assert len(got) == len(rows) and all(r.score < 0 for r in got)
    new = [r for r in got if held(r.doc_id) and r.doc_id < 800]
    assert 0 < np.mean([r.bits_per_byte for r in new]) < 3
    assert len({round(r.score, 3) for r in got if r.doc_id == 3}) == 1
    long_run = next(r for r in got if r.doc_id == 903)
    assert long_run.bits_per_byte < 2.5  # the weights adapt within the text


def test_codes_are_prefix_codes_and_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 50, (256, 256)) * (rng.random((256, 256)) < 0.1)
    pairs[7] = 0
    code = mixing.code_of(pairs)
    assert np.allclose((0.5 ** code.lengths.reshape(256, 256)).sum(axis=1), 1)
    sizes = mixing.sizes_of(1000)
    model = mixing.Model(code, sizes, [rng.integers(-127, 128, s + mixing.NODES).astype(np.int8) for s in sizes], mixing.start_weights())
    data, offsets = utf8(pa.array([chr(a) for a in range(1, 128)]))
    texts = mixing.texts_of(data, offsets)
    bits = mixing.bits_of(texts, code, sizes, texts.first, np.ones(len(texts.first), np.int64))
    gates = np.minimum(np.arange(bits.counts.shape[1]), mixing.GATES - 1)
    logs, _ = mixing._passed(bits.sign, model.stretched(bits), np.repeat(model.weights[None], 127, axis=0)[:, gates], bits.counts)
    # of each one-byte text only its first byte's bits: they share one context, so the bytes' probabilities sum to at most one
    p = [2.0 ** logs[a:b].sum() for a, b in zip(bits.firsts, bits.firsts[1:])]
    assert 0 < sum(p) <= 1 + 1e-5


def test_bits_equal_a_walk_along_the_code():
    rng = np.random.default_rng(1)
    code, sizes = mixing.code_of(rng.integers(0, 9, (256, 256))), mixing.sizes_of(10)
    data, offsets = utf8(pa.array(["the end", "", "a", "zzz é"]))
    texts = mixing.texts_of(data, offsets)
    bits = mixing.bits_of(texts, code, sizes, texts.first, texts.sizes)
    row, want = 0, []
    for i, a in enumerate(texts.first):
        before = 0
        for byte in [*data[offsets[i] : offsets[i + 1]].tolist(), 0]:
            at = code.starts[before << 8 | byte]
            want += [(i, before * mixing.NODES + (s >> 1), 2 * (s & 1) - 1) for s in code.steps[at : at + code.lengths[before << 8 | byte]].tolist()]
            before = byte
    row = np.repeat(np.arange(4), np.diff(bits.firsts))
    assert sorted(want) == sorted(zip(row.tolist(), bits.slots[0].tolist(), bits.sign.astype(int).tolist()))


def test_a_score_does_not_depend_on_other_texts():
    rng = np.random.default_rng(2)
    sizes = mixing.sizes_of(1000)
    model = mixing.Model(mixing.code_of(rng.integers(0, 9, (256, 256))), sizes, [rng.integers(-99, 99, s + mixing.NODES).astype(np.int8) for s in sizes], mixing.start_weights())
    texts = ["x" * 3000, "", "of one thing " * 90, "a", "of one thing " * 200]
    together = mixing.text_logs(model, *utf8(pa.array(texts)))
    assert np.allclose(together, [mixing.text_logs(model, *utf8(pa.array([t])))[0] for t in texts], rtol=1e-6)


@pytest.mark.parametrize("most", [0, 3, 40, 10**6])
def test_the_head_is_bounded(spark, most, monkeypatch):
    monkeypatch.setattr(mixing, "HEAD_WORDS", most)
    words = spark.createDataFrame([(k, k // 2 + 1) for k in range(50)] + [(99, 10**7)], "key long, n long")
    assert words.filter(words.n >= mixing._least_of_head(words)).count() <= most


def test_empty_table(spark):
    assert mixing.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_head_finds_its_words_alone(n):
    rng = np.random.default_rng(n)
    words = np.unique(rng.integers(-(1 << 62), 1 << 62, n) >> 43 << 43)  # many share their leading bits
    head = mixing.Head.of(words)
    asked = np.concatenate([words, words + 2, np.array([0, -2, 1 << 40])])
    want = [np.flatnonzero(words == h)[0] if (words == h).any() else -1 for h in asked]
    assert head.find(asked).tolist() == want
