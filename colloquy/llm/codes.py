"""Vector codes: each of a vector's equal parts is named by the nearest entry of that part's codebook.

Codebooks start as the parts of the first vectors by id and are refined in rounds, each a pass over all vectors: every task
sums its parts by nearest entry, Spark adds these sums up, and only the new entries, a number fixed by parameters, come to
the driver. The nearest entry is found by annular norm pruning. Entries are sorted by norm; those nearest to a part in norm
give a first distance; as a difference of norms is never above a distance, the entries that may be as near are those whose
norm is within that distance of the part's, an interval that binary search finds; these alone, ends included, are compared
exactly in whole numbers.

Defined cases: vectors that are null or hold a null, infinite or not-a-number component have no code; a vector shorter than
the longest counts as if zeros followed, and so do all where the length is no multiple of the parts (such zeros are no
components of the codebooks); components beyond what keeps sums of squares within 64 bits (over 500,000 at 64 dimensions)
count as that bound; rows of equal or null id are separate rows, nulls after all ids, ties by vector; fewer rows than entries
give smaller codebooks; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.materialize import written
from colloquy.llm.common import looked_up
from colloquy.llm.integral import integers, largest, usable, width

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries nearest in norm that give a part its first distance, and pairs compared at once.
FIRST = 4
PAIRS = 1 << 14


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point (a row of whole numbers) the nearest entry (of at most 256), the lowest of several, and the squared distance."""
    norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    own = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
    index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    if not len(points):
        return index, distance
    # a component at a time, as one-dimensional arrays
    sides = [(np.ascontiguousarray(points[:, c]), np.ascontiguousarray(entries[order, c])) for c in range(points.shape[1])]

    def apart(of: Callable[[np.ndarray], np.ndarray], entry: np.ndarray) -> np.ndarray:
        total = np.zeros(entry.shape, np.int64)
        for mine, theirs in sides:
            difference = of(mine) - theirs[entry]
            difference *= difference
            total += difference
        return total

    at = np.searchsorted(norms, own)
    best = np.full(len(points), np.iinfo(np.int64).max)
    for step in range(-(FIRST // 2), FIRST - FIRST // 2):
        np.minimum(best, apart(lambda mine: mine, np.clip(at + step, 0, len(norms) - 1)), out=best)
    # a little wider than the distance, so that rounding of norms excludes nothing
    reach = np.sqrt(best.astype(np.float64))
    reach += 1e-9 * (1 + own + reach)
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    counts = high - low
    ends = np.cumsum(counts)
    first = 0
    while first < len(points):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        here = counts[first:last]
        starts = ends[first:last] - here - before
        entry = np.arange(int(here.sum())) + np.repeat(low[first:last] - starts, here)
        each = apart(lambda mine: np.repeat(mine[first:last], here), entry)
        if each.max() < 1 << 54:
            # distance and entry in one number, so that the least of it has both
            least = np.minimum.reduceat(each << 8 | order[entry], starts)
            distance[first:last], index[first:last] = least >> 8, least & 255
        else:
            least = np.minimum.reduceat(each, starts)
            distance[first:last] = least
            index[first:last] = np.minimum.reduceat(np.where(each == np.repeat(least, here), order[entry], len(entries)), starts)
        first = last
    return index, distance


def _cut(whole: np.ndarray, parts: int) -> np.ndarray:
    """Rows of components to (part, row, component)."""
    return whole.reshape(len(whole), parts, -1).transpose(1, 0, 2)


def _summed(read: Callable[[pa.Array], np.ndarray], books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for part, points in enumerate(_cut(read(batch.column(0)), len(books))):
                index, _ = nearest(points, books[part])
                np.add.at(sums[part], index, points)
                counts[part] += np.bincount(index, minlength=len(books[part]))
        part, entry, at = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, books.shape))
        columns = [part, entry, at, sums[part, entry, at], counts[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "at", "total", "n"])

    return run


def _named(read: Callable[[pa.Array], np.ndarray], books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    hexes = np.array([f"{i:02x}" for i in range(max(books.shape[1], 1))], "S")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, error = [], np.zeros(batch.num_rows, np.int64)
            for part, points in enumerate(_cut(read(batch.column(0)), len(books))):
                index, distance = nearest(points, books[part])
                names.append(hexes[index])
                error += distance
            code = [b"".join(x) for x in zip(*(n.tolist() for n in names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code, pa.binary()).cast(pa.string()), pa.array(error)], [*batch.schema.names[1:], "code", "error"])

    return run


def encoded(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[list[list[int]]]]:
    """Usable rows as (id, the columns to ``keep``, code, error), and the codebooks: by part, entry and component.

    ``entries`` is at most 256, two hexadecimal digits each. ``rows`` is read once for each round and once more.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has room for 1 to 256 entries")
    used = rows.filter(usable(vector))
    real = width(used, vector)
    length = -(-real // parts) * parts
    most = largest(max(length, 1), 60)
    vectors = used.select(F.col(vector).cast("array<double>").alias("_vector"), id, *keep)
    head = vectors.orderBy(F.col(id).asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()
    read = lambda column: integers(column, scale, length, most)
    first = read(pa.array([r[0] for r in head], pa.list_(pa.float64())))
    books = np.ascontiguousarray(_cut(first, parts)) if len(first) else np.zeros((parts, 0, length // parts), np.int64)
    for _ in range(rounds if len(first) else 0):
        sums = vectors.select("_vector").mapInArrow(_summed(read, books), "part long, entry long, at long, total long, n long")
        totals = sums.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in totals.collect():
            books[r.part, r.entry, r.at] = int(r.total) // r.n
    kinds = dict(used.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (id, *keep))
    coded = vectors.mapInArrow(_named(read, books), f"{fields}, code string, error long")
    size = length // parts
    return coded, [[[int(x) for k, x in enumerate(entry) if part * size + k < real] for entry in book] for part, book in enumerate(books)]


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` rows with the sum of ``error`` over the rows of their label, nulls together, as ``label_error``; a sum ends at the largest long."""
    rows = written(coded, "codes")
    summed = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    return looked_up(rows, rows.groupBy(label).agg(summed.alias("label_error"), F.count("*").alias("_n")), label, "_n").drop("_n")


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
