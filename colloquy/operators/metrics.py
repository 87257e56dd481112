"""Evaluation of routes, rankings and answers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import scoring_tokens


def accuracy(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.when(F.col(gold).eqNullSafe(F.col(pred)), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def confusion(rows: DataFrame, labels: Sequence, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """A row for each pair of labels, with 0 where none occurs; other labels are left out."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(g, p) for g in labels for p in labels], f"gold {rows.schema[gold].dataType.simpleString()}, pred {rows.schema[pred].dataType.simpleString()}")
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def macro_f1(rows: DataFrame, labels: Sequence, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The mean F1 over the given labels; one that never occurs counts 0."""
    parts = []
    for i, label in enumerate(labels):
        is_gold, is_pred = F.col(gold) == F.lit(label), F.col(pred) == F.lit(label)
        counts = (is_gold & is_pred, is_pred & ~F.coalesce(is_gold, F.lit(False)), is_gold & ~F.coalesce(is_pred, F.lit(False)))
        parts += [F.count(F.when(c, 1)).alias(f"{name}{i}") for name, c in zip(("tp", "fp", "fn"), counts)]
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"tp{i}"), 2.0 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")), F.lit(0.0)) for i in range(len(labels))]
    return rows.agg(*parts).select((sum(f1[1:], f1[0]) / len(labels)).alias("macro_f1"))


def ranking(gold: DataFrame, ranked: DataFrame, query: str, key: str, k: int = 3) -> DataFrame:
    """(query, recall, reciprocal): whether a gold row is among the first k, and 1 / rank of the best one; 0 without."""
    best = ranked.select(query, key, F.col("rank").alias("_rank"))
    rows = gold.select(query, key).distinct().join(best, [query, key], "left").groupBy(query).agg(F.min("_rank").alias("_best"))
    return rows.select(query, F.when(F.col("_best") <= k, 1.0).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("_best"), F.lit(0.0)).alias("reciprocal"))


def exact_match(answer: Column, spans: Column) -> Column:
    """1 if all gold spans, one at least, are in the answer, case aside."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when((F.size(spans) > 0) & F.forall(spans, lambda s: F.contains(low, F.lower(s))), 1.0).otherwise(0.0)


def _ids(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists of longs and the row of each."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


@F.arrow_udf(T.DoubleType())
def _multiset_f1(answer: pa.Array, gold: pa.Array) -> pa.Array:
    """2 * common / all of two multisets of hashes in each row; 0 where either is empty."""
    (a, a_row), (g, g_row) = _ids(answer), _ids(gold)
    value, row, mine = np.concatenate([a, g]), np.concatenate([a_row, g_row]), np.concatenate([np.ones(len(a)), np.zeros(len(g))])
    order = np.lexsort((value, row))
    value, row, mine = value[order], row[order], mine[order]
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])) if len(value) else np.zeros(0, int)
    ours = np.add.reduceat(mine, first) if len(first) else mine
    sizes = np.diff(np.append(first, len(value)))
    both = np.bincount(row[first], np.minimum(ours, sizes - ours), len(answer))
    return pa.array(2 * both / np.maximum(np.bincount(row, minlength=len(answer)), 1))


def token_f1(rows: DataFrame, key: str, answer: str, gold: str) -> DataFrame:
    """(key, f1) by the multisets of tokens of both texts, row by row."""
    hashed = lambda c: F.transform(F.coalesce(scoring_tokens(F.col(c)), F.array().cast("array<string>")), lambda t: F.xxhash64(t))
    return rows.select(key, _multiset_f1(hashed(answer), hashed(gold)).alias("f1"))


def report(routes: DataFrame, retrieval: DataFrame, answers: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row with all figures of an evaluation, to four places.

    ``routes``: (gold, pred); ``retrieval``: (recall, reciprocal) of items with gold rows; ``answers``: (em, f1) of items with
    gold spans, whose means are null where there are none.
    """
    mean = lambda c: F.round(F.avg(c), 4)
    ranked = retrieval.agg(F.count("*").alias("retrieval_n"), F.coalesce(mean("recall"), F.lit(0.0)).alias("recall_at_k"), F.coalesce(mean("reciprocal"), F.lit(0.0)).alias("mrr"))
    spoken = answers.agg(F.count("*").alias("generation_n"), mean("em").alias("exact_match"), mean("f1").alias("token_f1"))
    agreed = accuracy(routes).crossJoin(macro_f1(routes, labels)).crossJoin(routes.agg(F.count("*").alias("route_n")))  # one row each
    return agreed.crossJoin(ranked).crossJoin(spoken).withColumns({c: F.round(c, 4) for c in ("accuracy", "macro_f1")})
