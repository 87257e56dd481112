"""Toxicity by class-conditional Kneser-Ney models.

Word unigrams and bigrams of toxic and of ordinary labelled texts are counted by Spark, once for a text, in tables of fixed
size (a word's or pair's hash picks its slot), so a model is as large whatever the corpus. Each class interpolates its bigrams with its
unigrams, with absolute discounts, and these with continuation counts that both classes share: how many words a word
follows, in either class. Words and pairs that are rare in both classes together give all their mass to these shared
counts, so that chance meetings with one class say nothing. A text's features are the log-likelihood ratio, normalised by
length, of the whole text and of its strongest word and window of words; a logistic function of them, fitted on labelled
texts that the counts have not seen, is the score.

Labels are learned from at most ``SAMPLE`` labelled documents, those of the smallest hash of their id. Of these, three folds
of the id's crc32 (modulo four) are used: two for counts, one for the logistic function; the fourth is held out.

Defined cases: a null or empty text has the features of no evidence and the score that follows from them; texts are scored
whole; without labels of both classes all scores are 0; equal texts score equally; repeated and null ids are scored each;
other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.materialize import written
from colloquy.llm.common import distinct_labels, fold, held_out, lowered, runs, scrambled, slices, utf8, word_hashes

SAMPLE = 8_000
SLOTS = 1 << 20
PAIR_SLOTS = 1 << 21
DISCOUNT = 0.75
#: Words and pairs in fewer texts of both classes together are left to the shared counts.
RARE_WORD = 5
RARE_PAIR = 5
WINDOW = 4
THRESHOLD = 0.3
_WORD, _PAIR = range(2)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters, digits, non-ASCII) in lower case, and the number of words before each row."""
    low = lowered(data)
    inside = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    fenced = np.zeros(len(low) + len(offsets), bool)
    place = np.arange(len(low)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    fenced[place] = inside  # a gap after each row, so that no word spans two
    starts, ends = runs(fenced)
    row_first = offsets[:-1] + np.arange(len(offsets) - 1)
    row = np.searchsorted(row_first, starts, "right") - 1
    hashes = word_hashes(low, starts - row, ends - row)
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word before (0 at a row's start) and of the pair."""
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])[: len(hashes)]
    before[first[:-1][np.diff(first) > 0]] = 0
    return before, scrambled(before * np.uint64(3) + hashes)


@dataclass
class Model:
    unigrams: np.ndarray  # two classes by slots: the probability after backing off to the shared counts
    bigrams: np.ndarray  # two classes by pair slots: discounted counts
    seen: np.ndarray  # counts of a word as the first of a pair
    backoff: np.ndarray  # the part of these that the discounts leave
    weights: np.ndarray

    def ratios(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log2 of toxic over ordinary probability for each word."""
        before, pair = _pairs(hashes, first)
        w, b = ((x & np.uint64(SLOTS - 1)).astype(np.int64) for x in (hashes, before))
        p = (pair & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        logs = []
        for c in (0, 1):
            seen = self.seen[c][b]
            left = np.where(seen > 0, self.backoff[c][b] / np.maximum(seen, 1), 1.0)
            high = np.where(seen > 0, self.bigrams[c][p] / np.maximum(seen, 1), 0.0)
            logs.append(np.log2((high + left * self.unigrams[c][w]).astype(np.float64) + 1e-12))
        return logs[1] - logs[0]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, first = _words(data, offsets)
        ratios = self.ratios(hashes, first) if len(hashes) else np.zeros(0)
        ratios = np.round(ratios * 2**20) / 2**20  # so that sums are exact wherever in a batch a text stands
        sums = np.concatenate([[0.0], np.cumsum(ratios)])
        n = np.diff(first)
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        full, best, window = n > 0, np.zeros(len(n)), np.zeros(len(n))
        if len(ratios):
            stop = np.minimum(np.arange(len(ratios)) + WINDOW, np.repeat(first[1:], n))
            best[full] = np.maximum.reduceat(ratios, first[:-1][full])
            window[full] = np.maximum.reduceat((sums[stop] - sums[:-1]) / WINDOW, first[:-1][full])
        return np.stack([np.ones(len(n)), mean, best, window, np.log1p(n) / 10], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(data, offsets) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def _once(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A place of each distinct key of each row: repeated lines must not look like frequent words."""
    order = np.lexsort((key, row))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
    return order[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (kind, label, key, before, word, n): a word's slot, or a pair's hash and the slots of its words."""
    mask = np.uint64(SLOTS - 1)
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for a, b in slices(batch.column("text"), 4 << 20):
            hashes, first = _words(*utf8(batch.column("text").slice(a, b - a)))
            before, pair = _pairs(hashes, first)
            row = np.repeat(np.arange(b - a), np.diff(first))
            for kind, key in ((_WORD, hashes & mask), (_PAIR, pair & np.uint64((1 << 62) - 1))):
                once = _once(key, row)
                label = labels[a:b][row[once]].astype(np.int64)
                keys, at, n = np.unique(key[once].astype(np.int64) * 2 + label, return_index=True, return_counts=True)
                places = [((x[once][at] & mask) if kind == _PAIR else np.zeros(len(at), np.uint64)).astype(np.int32) for x in (before, hashes)]
                columns = [np.full(len(keys), kind, np.int32), (keys & 1).astype(np.int32), keys >> 1, *places, n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "label", "key", "before", "word", "n"])


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``most`` labelled ids that are not held out."""
    known = distinct_labels(labels, label).filter(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("fold", fold())


def _filled(slot, value, size: int) -> np.ndarray:
    out = np.zeros(size, np.float32)
    np.add.at(out, np.asarray(slot, np.int64), np.asarray(value, np.float32))
    return out


def _pair_table(pairs: DataFrame) -> np.ndarray:
    """Discounted counts of both classes in a row for each pair slot that is in use."""
    high = (F.sum(F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0))).cast("float").alias(f"h{c}") for c in (0, 1))
    got = pairs.groupBy(F.col("key").bitwiseAND(PAIR_SLOTS - 1).cast("int").alias("slot")).agg(*high).toPandas()
    return np.stack([_filled(got["slot"], got[f"h{c}"], PAIR_SLOTS) for c in (0, 1)])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model | None:
    rows = sampled(docs, labels, label, most)
    counts = rows.filter("fold in (0, 1)").select("label", "text").mapInArrow(_counted, "kind int, label int, key long, before int, word int, n long")
    n_of = [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)) for c in (0, 1)]
    summed = written(counts.groupBy("kind", "key", "before", "word").agg(*(n.alias(f"n{c}") for c, n in enumerate(n_of))), "ngrams")
    words, pairs = summed.filter(F.col("kind") == _WORD), summed.filter(F.col("kind") == _PAIR)
    kept = F.col("n0") + F.col("n1") >= RARE_PAIR
    high = [F.when(kept, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0))).otherwise(0.0) for c in (0, 1)]
    firsts = pairs.groupBy(F.col("before").alias("slot")).agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in (0, 1)), *(F.sum(h).alias(f"h{c}") for c, h in enumerate(high)))
    follows = pairs.groupBy(F.col("word").alias("slot")).agg(F.count("*").alias("k"))
    # at most one row for each slot; of the pairs those that are not rare
    table = words.select(F.col("key").cast("int").alias("slot"), "n0", "n1").join(firsts, "slot", "full").join(follows, "slot", "full").fillna(0)
    got = table.select("slot", *(F.col(c).cast("float") for c in ("n0", "n1", "s0", "s1", "h0", "h1", "k"))).toPandas()
    arrays = {c: _filled(got["slot"], got[c], SLOTS) for c in ("n0", "n1", "s0", "s1", "h0", "h1", "k")}
    n = np.stack([arrays["n0"], arrays["n1"]])
    totals = n.sum(axis=1)
    if not totals.all():
        return None
    shared = (arrays["k"] + 0.5) / (arrays["k"].sum() + 0.5 * SLOTS)
    discounted = np.where(n.sum(axis=0) >= RARE_WORD, np.maximum(n - DISCOUNT, 0), 0)
    unigrams = (discounted + (totals - discounted.sum(axis=1))[:, None] * shared) / totals[:, None]
    seen = np.stack([arrays["s0"], arrays["s1"]])
    model = Model(unigrams.astype(np.float32), _pair_table(pairs.filter(kept)), seen, seen - np.stack([arrays["h0"], arrays["h1"]]), np.zeros(5))
    shape = rows.filter("fold = 3").select("label", "text").mapInArrow(_featured(rows.sparkSession.sparkContext.broadcast(model)), "label int, x array<double>")
    fit = shape.toPandas()  # at most a fold of the sample
    if fit["label"].nunique() < 2:
        return None
    model.weights = logistic(np.stack(fit["x"].to_numpy()), fit["label"].to_numpy(float))
    return model


def _featured(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), 4 << 20):
                x = model.value.features(*utf8(batch.column("text").slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    return run


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text) to (doc_id, score)."""
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), 2 << 20):
                scores = shared.value.scores(*utf8(batch.column("text").slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0.0).alias("score")).schema)
