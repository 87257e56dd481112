"""Quality by a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on statistics of labelled texts; each path from a root to an inner node or leaf becomes a
conjunctive rule, a lasso-penalised logistic regression keeps few rules, and these are compiled into one Spark column
expression over the statistics. Statistics are computed for all rows of an Arrow batch at once.

Labels are learned from at most ``SAMPLE`` labelled documents that are not held out, those of the smallest hash of their id.

Defined cases: a null or empty text has statistics of zero and the score that its rules give; texts are measured whole;
without labels of both classes every score is 1; equal texts score equally; repeated and null ids are scored each; other
columns are kept by ``filtered`` and do not matter otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import distinct_labels, fresh, held_out, lowered, runs, slices, utf8, word_hashes

SAMPLE = 20_000
THRESHOLD = 0.7
STATISTICS = (
    "words", "mean_word", "upper", "digit", "symbol", "bar", "punctuation", "other_byte", "distinct_words", "repeated_pairs",
    "sentences", "lines", "distinct_lines", "longest_word", "capitals", "marked_words",
)
_SCHEMA = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
_TYPE = pa.struct([(s, pa.float64()) for s in STATISTICS])

#: Byte classes: 1 lower, 2 upper, 3 digit, 4 white, 5 sentence mark, 6 other punctuation of prose, 7 bar, 8 symbol, 9 beyond ASCII.
CLASSES = np.full(256, 8, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 1, 2, 3, 9
CLASSES[[32, *range(9, 14)]] = 4
CLASSES[[ord(c) for c in ".!?"]] = 5
CLASSES[[ord(c) for c in ",;:'\"()-"]] = 6
CLASSES[ord("|")] = 7


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows).astype(np.float64)


def _fenced(kinds: np.ndarray, offsets: np.ndarray, separators: tuple[int, ...], data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes between separators; none spans two rows."""
    rows = len(offsets) - 1
    inside = np.zeros(len(kinds) + rows, bool)
    inside[np.arange(len(kinds)) + np.repeat(np.arange(rows), np.diff(offsets))] = ~np.isin(kinds, separators) if separators else data != 10
    starts, ends = runs(inside)
    row = np.searchsorted(offsets[:-1] + np.arange(rows), starts, "right") - 1
    return starts - row, ends - row, row


def measured(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each row, in the order of STATISTICS."""
    rows, n = len(offsets) - 1, np.maximum(np.diff(offsets), 1).astype(np.float64)
    kinds = CLASSES[data]
    share = {k: _per_row(kinds == k, offsets) / n for k in (2, 3, 5, 6, 7, 8, 9)}
    starts, ends, row = _fenced(kinds, offsets, (4,), data)
    words = np.bincount(row, minlength=rows).astype(np.float64)
    some = np.maximum(words, 1)
    low = lowered(data)
    hashes = word_hashes(low, starts, ends)
    pairs = hashes[1:] * np.uint64(3) + hashes[:-1]
    same = row[1:] == row[:-1]
    longest = np.zeros(rows)
    np.maximum.at(longest, row, (ends - starts).astype(np.float64))
    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    capital = kinds[starts] == 2 if len(starts) else np.zeros(0, bool)
    begin, finish, line_row = _fenced(kinds, offsets, (), data)
    lines = np.bincount(line_row, minlength=rows).astype(np.float64)
    line_hashes = word_hashes(low, begin, finish)
    couples = np.bincount(row[1:][same], minlength=rows).astype(np.float64)
    columns = (
        np.log1p(words), np.bincount(row, weights=ends - starts, minlength=rows) / some, share[2], share[3], share[8], share[7], share[5] + share[6], share[9],
        _distinct(hashes, row, rows) / some, 1 - _distinct(pairs[same], row[1:][same], rows) / np.maximum(couples, 1) * (couples > 0) - (couples == 0),
        share[5] * n / some, np.log1p(lines), _distinct(line_hashes, line_row, rows) / np.maximum(lines, 1), np.log1p(longest),
        np.bincount(row, weights=capital, minlength=rows) / some, np.bincount(row, weights=np.isin(last, (7, 8)), minlength=rows) / some,
    )
    return np.round(np.stack(columns, axis=1), 9)


@F.arrow_udf(_SCHEMA)
def statistics(text: pa.Array) -> pa.Array:
    parts = [measured(*utf8(text.slice(a, b - a))) for a, b in slices(text)]
    table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(table.shape[1])], fields=list(_TYPE))


#: A rule: conditions (statistic, whether above, bound) that must all hold.
Rule = tuple[tuple[int, bool, float], ...]


def grown(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48) -> list[Rule]:
    """Rules of all paths of boosted trees with logistic loss."""
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], axis=1)
    total, found = np.zeros(len(y)), {}

    def split(rows: np.ndarray, path: Rule, left: int, g: np.ndarray, h: np.ndarray) -> None:
        best = (1e-3, -1, 0)
        if left and len(rows) >= 20:
            for j, b in enumerate(bounds):
                if not len(b):
                    continue
                gs, hs = (np.bincount(codes[rows, j], weights=v[rows], minlength=len(b) + 1) for v in (g, h))
                gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                gr, hr = gs.sum() - gl, hs.sum() - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs.sum() ** 2 / (hs.sum() + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0] and hl[k] > 0.5 and hr[k] > 0.5:
                    best = (float(gain[k]), j, k)
        if path:
            found[tuple(sorted(path))] = None
        _, j, k = best
        if j < 0:
            total[rows] -= rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        above = codes[rows, j] > k
        bound = float(bounds[j][k])
        split(rows[~above], (*path, (j, False, bound)), left - 1, g, h)
        split(rows[above], (*path, (j, True, bound)), left - 1, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        split(np.arange(len(y)), (), depth, p - y, p * (1 - p))
    return list(found)


def held(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, ((x[:, j] > bound) if above else (x[:, j] <= bound) for j, above, bound in rule))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = 1.5e-3, rounds: int = 400) -> np.ndarray:
    """Weights of logistic regression under an L1 penalty (not on the first column), by accelerated proximal steps."""
    w = np.zeros(z.shape[1])
    v, t = w, 1.0
    step = 1 / (0.25 * np.linalg.norm(z, 2) ** 2 / len(y))
    shrink = np.full(len(w), penalty * step)
    shrink[0] = 0
    for _ in range(rounds):
        gradient = z.T @ (1 / (1 + np.exp(-(z @ v))) - y) / len(y)
        new = v - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, statistics: str) -> Column:
        """The compiled expression over a struct column of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            parts = [(F.col(f"{statistics}.{STATISTICS[j]}") > b) if above else (F.col(f"{statistics}.{STATISTICS[j]}") <= b) for j, above, b in rule]
            total = total + F.when(reduce(lambda a, b: a & b, parts), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def ensemble(x: np.ndarray, y: np.ndarray) -> Ensemble:
    rules = grown(x, y)
    z = np.stack([np.ones(len(y)), *(held(r, x).astype(np.float64) for r in rules)], axis=1)
    spread = z[:, 1:].std(axis=0)
    z[:, 1:] /= np.where(spread > 0, spread, np.inf)
    w = lasso(z, y)
    w[1:] /= np.where(spread > 0, spread, np.inf)
    return Ensemble(float(w[0]), tuple((r, float(v)) for r, v in zip(rules, w[1:]) if abs(v) > 1e-4))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Ensemble | None:
    known = distinct_labels(labels, label).filter(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", statistics("text").alias("s")).select("label", "s.*")
    sample = rows.toPandas()  # at most ``most`` ids and their statistics
    if sample["label"].nunique() < 2:
        return None
    sample = sample.sort_values(["label", *STATISTICS])
    return ensemble(sample[list(STATISTICS)].to_numpy(np.float64), sample["label"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Ensemble | None, name: str = "score") -> DataFrame:
    """``docs`` with the score as a further column."""
    if model is None:
        return docs.withColumn(name, F.lit(1.0))
    held = fresh(docs, "statistics")
    return docs.withColumn(held, statistics("text")).withColumn(name, model.score(held)).drop(held)


def filtered(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose score is under ``least``."""
    name = fresh(docs, "quality")
    return scored(docs, fitted(docs, labels), name).filter(F.col(name) >= least).drop(name)
