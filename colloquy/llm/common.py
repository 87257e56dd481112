"""What several training-data operators share: checked columns, vectorised word hashes, ranks without hot tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.materialize import cut

#: Odd multiplier of the polynomial word hash, its inverse modulo 2**64 and a finalising multiplier.
RADIX = 0x9E3779B97F4A7C15
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93


def held_out(doc_id: str | Column = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id is never held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == part, F.lit(False))


def fold(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def distinct_labels(labels: DataFrame, label: str) -> DataFrame:
    """One row (doc_id, label) for each labelled id: the largest where several disagree, none for nulls."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, null as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows, in order, with about ``most`` bytes each; a longer row stands alone."""
    _, offsets = utf8(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def scrambled(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(MIX)
    values ^= values >> np.uint64(32)
    values *= np.uint64(RADIX)
    values ^= values >> np.uint64(29)
    return values


def powers(count: int, base: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each byte range, from prefix sums of a polynomial in an odd radix."""
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(len(data), RADIX)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    raw = (sums[ends] - sums[starts]) * powers(len(data) + 1, RADIX_INVERSE)[starts]
    return scrambled(raw ^ (ends - starts).astype(np.uint64))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with a gapless rank from 0 within each group, as ``name``.

    A group may hold most rows: they are dealt over ``parts`` buckets by a hash of ``order``, ranked there, and moved by
    the counts of the buckets before. ``rows`` is evaluated twice, so it should be materialised.
    """
    parts = parts or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*order), F.lit(parts))
    dealt = rows.withColumn("_bucket", bucket)
    counts = dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    keyed = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    keys = [*group, "_bucket"]
    joined = keyed.join(shifts, keys)
    return joined.withColumn(name, (F.col("_rank") + F.col("_shift")).cast("long")).drop("_bucket", "_rank", "_shift")


#: Rows of ids and a few numbers that may be broadcast, some ten megabytes.
BROADCAST_ROWS = 1 << 18


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not have, in any case of letters."""
    taken = {c.lower() for c in rows.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"_{name}{k or ''}").lower() not in taken)


def broadcastable(rows: DataFrame) -> DataFrame:
    """``rows``, computed once, marked for a broadcast if they are few; else a join shuffles them."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key``, nulls included, is not in ``gone``; they stay where they are if few go."""
    other = fresh(rows, "gone")
    few = broadcastable(gone.select(F.col(key).alias(other)).distinct())
    return rows.join(few, rows[key].eqNullSafe(few[other]), "left_anti")


#: A key of more than a thousandth of all rows is looked up where its rows are, in any join of ``looked_up``.
HEAVY = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str | Sequence[str], weight: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key (null is a key too) and the key's rows as ``weight``.

    A small table is broadcast whole. Of a larger one the keys of many rows are, at most ``HEAVY`` of them, and all others are
    joined by a shuffle, in which no key has more than a small share of the rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    table = cut(table)

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        other = right.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & left[k].eqNullSafe(other[f"_key{i}"])
        out = left.join(F.broadcast(other) if right is often else other, same, how)
        return out if how == "left_anti" else out.drop(*(f"_key{i}" for i in range(len(keys))))

    n = table.agg(F.count("*").alias("keys"), F.coalesce(F.sum(weight), F.lit(0)).alias("rows")).first()
    if n["keys"] <= BROADCAST_ROWS:
        often = table
        return joined(rows, often)
    heavy = F.col(weight) > n["rows"] / HEAVY
    often = table.filter(heavy)
    rest = joined(rows, often, "left_anti")
    return joined(rows, often).unionByName(joined(rest, table.filter(~heavy)))


#: Rows of one key that a task can always hold.
LIGHT = 10_000


def joined_apart(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` to ``table``, which has a row for each key and its number of rows as ``weight``, by a shuffle; keys of
    more than a thousandth of ``total`` rows (at most ``HEAVY`` of them), if any, by a broadcast. Nothing is materialised."""
    least = max(total // HEAVY, LIGHT)
    if total <= least:
        return rows.join(table.drop(weight), key)
    heavy = F.col(weight) > least
    if table.filter(heavy).isEmpty():
        return rows.join(table.drop(weight), key)
    often = F.broadcast(table.filter(heavy).drop(weight))
    rest = rows.join(often.select(key), key, "left_anti").join(table.filter(~heavy).drop(weight), key)
    return rows.join(often, key).unionByName(rest)
