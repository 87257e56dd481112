import random
import zlib

import numpy as np
import pyarrow as pa

from colloquy.llm import quality
from colloquy.llm.common import utf8


def corpus(n=800, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        kind = i % 4
        text = " ".join(words) + "."
        if kind == 0:
            text = [" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(words[:2] * 40)][i // 4 % 3]
        docs.append((i, text))
        labels.append((i, int(kind != 0)))
    return docs, labels


def test_held_out_accuracy_and_defined_cases(spark):
    docs, labels = corpus()
    rows = docs + [(5000, None), (5001, ""), (None, docs[1][1]), (3, docs[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as score", "1 as _x")
    truth = spark.createDataFrame(labels + [(7, None)], "doc_id long, quality int")
    model = quality.fitted(frame.select("doc_id", "text"), truth)
    got = {r.doc_id: r.score for r in quality.scored(frame.select("doc_id", "text"), model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= quality.THRESHOLD) == bool(labels[i][1]) for i in held]) > 0.97
    assert got[5000] == got[5001] and got[None] == got[1]
    kept = quality.filtered(frame, truth)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 2 and abs(len(ids) - 600) < 30


def test_compiled_expression_equals_the_rules(spark):
    docs, labels = corpus(200)
    x = quality.measured(*utf8(pa.array([t for _, t in docs])))
    model = quality.ensemble(x, np.array([y for _, y in labels], float))
    want = 1 / (1 + np.exp(-(model.bias + sum(w * quality.held(r, x) for r, w in model.rules))))
    got = quality.scored(spark.createDataFrame(docs, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], want)
    assert 0 < len(model.rules) < 150


def test_statistics_one_by_one():
    texts = ["Ab cd\ncd ef", None, "", "x", "A!! B|\n\nA!! B|", "é 12"]
    together = quality.measured(*utf8(pa.array(texts)))
    apart = np.concatenate([quality.measured(*utf8(pa.array([t], pa.string()))) for t in texts])
    assert np.array_equal(together, apart)
    at = dict(zip(quality.STATISTICS, together[0]))
    assert at["distinct_words"] == 0.75 and at["words"] == np.round(np.log1p(4), 9) and at["lines"] == np.round(np.log1p(2), 9)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.filtered(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 1


def test_filtered_keeps_all_columns_and_an_empty_table(spark):
    names = ["_quality", "_statistics", "score", "words", "_quality1"]
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string").selectExpr("*", *(f"7 as {n}" for n in names))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.filtered(docs, labels)
    assert got.columns == docs.columns and [tuple(r)[2:] for r in got.collect()] == [(7,) * 5] * 2
    model = quality.Ensemble(0.0, ((((0, True, 0.1),), 3.0), (((0, False, 0.1),), -3.0)))
    rows = quality.scored(docs, model, "q").collect()
    assert {r.doc_id: r.q > 0.5 for r in rows} == {1: True, 2: False} and all(r._statistics == 7 for r in rows)
    assert quality.filtered(docs.limit(0), labels).count() == 0
