import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from colloquy.llm import toxicity
from colloquy.llm.common import utf8


def corpus(n=600, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 3 == 0
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["scoundrel", "Rascal", "knave"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_defined_cases(spark):
    docs, labels = corpus()
    rows = docs + [(1000, None), (1001, ""), (1002, "!!"), (None, "knave scoundrel"), (5, docs[5][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as label", "1.0 as score")
    truth = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(frame, truth)
    got = toxicity.scored(frame, model).collect()
    assert len(got) == len(rows)
    scores = {r.doc_id: r.score for r in got}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(scores[i] >= toxicity.THRESHOLD) == bool(labels[i][1]) for i in held]
    assert np.mean(right) > 0.97
    assert scores[1000] == scores[1001] == scores[1002] < toxicity.THRESHOLD
    assert scores[None] > 0.5
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_probabilities_sum_to_one(spark):
    docs, labels = corpus(300)
    model = toxicity.fitted(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert np.allclose(model.unigrams.sum(axis=1), 1, atol=1e-3)
    assert (model.backoff >= -1e-3).all() and (model.seen >= model.backoff - 1e-3).all()


def test_words_do_not_span_rows():
    hashes, first = toxicity._words(*utf8(pa.array(["ab", "cd", None, "", "Ab!cd"])))
    assert first.tolist() == [0, 1, 2, 2, 2, 4]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fitted(docs, none) is None
    assert toxicity.scored(docs, None).first().score == 0.0


def plain_model(docs, labels):
    """Class-conditional Kneser-Ney from dictionaries: (word before, word, class) to probability."""
    truth = dict(labels)
    words = [collections.Counter(), collections.Counter()]
    pairs = [collections.Counter(), collections.Counter()]
    for d, text in docs:
        if zlib.crc32(str(d).encode()) % 4 in (0, 1):
            found = re.findall("[a-z0-9]+", text.lower())
            words[truth[d]].update(set(found))
            pairs[truth[d]].update(set(zip([None, *found], found)))
    every = set(pairs[0]) | set(pairs[1])
    follows = collections.Counter(w for _, w in every)
    rare = lambda counts, key, least: counts[0][key] + counts[1][key] < least
    cut = lambda counts, c, key, least: 0.0 if rare(counts, key, least) else max(counts[c][key] - toxicity.DISCOUNT, 0.0)

    def probability(before, word, c):
        total = sum(words[c].values())
        shared = (follows[word] + 0.5) / (len(every) + 0.5 * toxicity.SLOTS)
        one = (cut(words, c, word, toxicity.RARE_WORD) + (total - sum(cut(words, c, w, toxicity.RARE_WORD) for w in words[c])) * shared) / total
        after = [p for p in pairs[c] if p[0] == before]
        seen = sum(pairs[c][p] for p in after)
        if not seen:
            return one
        left = seen - sum(cut(pairs, c, p, toxicity.RARE_PAIR) for p in after)
        return cut(pairs, c, (before, word), toxicity.RARE_PAIR) / seen + left / seen * one

    return probability


def test_ratios_and_features_equal_dictionaries(spark):
    docs, labels = corpus(400, 9)
    model = toxicity.fitted(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    plain = plain_model(docs, labels)
    texts = [docs[3][1], docs[4][1], "knave w3 w5 unseen knave", "", "w1"]
    hashes, first = toxicity._words(*utf8(pa.array(texts)))
    got, want = model.ratios(hashes, first), []
    for text in texts:
        found = re.findall("[a-z0-9]+", text.lower())
        want += [math.log2(plain(b, w, 1) + 1e-12) - math.log2(plain(b, w, 0) + 1e-12) for b, w in zip([None, *found], found)]
    assert np.allclose(got, want, atol=2e-3)
    features, at = model.features(*utf8(pa.array(texts))), 0
    for text, x in zip(texts, features):
        part = want[at : at + len(text.split())]
        at += len(part)
        windows = [sum(part[i : i + toxicity.WINDOW]) / toxicity.WINDOW for i in range(len(part))]
        assert np.allclose(x, [1, np.mean(part) if part else 0, max(part, default=0), max(windows, default=0), math.log1p(len(part)) / 10], atol=2e-3)


def test_empty_table_and_a_long_text(spark):
    docs, labels = corpus(300)
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.fitted(empty, truth) is None and toxicity.scored(empty, None).count() == 0
    long_text = "w1 w2 w3 " * 300_000
    model = toxicity.fitted(spark.createDataFrame(docs, "doc_id long, text string"), truth)
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame([(1, long_text), (2, long_text + " knave knave knave")], "doc_id long, text string"), model).collect()}
    assert 0 <= got[1] < got[2] <= 1  # the strongest window counts however long the text
