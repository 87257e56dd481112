"""Best-fit packing of token sequences by linear grouping, planned on the histogram of lengths.

A document's ids and an end id are cut, if they are too many, into full pieces with a shorter one first. The plan never sees
single pieces: Spark counts the pieces of each length, at most as many rows as a sequence has tokens. Lengths above a small
share of the capacity are sorted and cut into groups of equal cardinality, each rounded up to its largest length; the few
sizes that result make a configuration problem, solved by column generation. Whole multiples of its configurations are
opened and the real lengths take the places of the rounded ones, the last place going to the longest that then fits; what is
left over and the small lengths are best-fitted, longest first, into the room that fits tightest. A plan row says which ranks of a length go
to which sequences at which offset. Pieces get their rank within their length by two small windows over hash buckets and
find their place by one broadcast join with the plan, whose size depends on the capacity alone.

Defined cases: a null or empty text is its end id alone; texts are taken whole; repeated rows and null ids are packed each;
an empty table gives no sequence; other columns do not matter.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.materialize import cut, written
from colloquy.llm.common import ranked, slices

CAPACITY = 1024
END = 2
GROUPS = 64
#: Lengths up to this share of the capacity are small.
SMALL = 1 / 8
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The byte-level BPE of a rank file, the same ids as its JSON form gives."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit numbers."""
    path = ranks_path or _ranks_path()
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_to_numpy
        for batch in batches:
            for a, b in slices(batch.column("text")):
                owner, number, starts, lengths, ids = [], [], [], [], []
                for row, text in enumerate(batch.column("text").slice(a, b - a).to_pylist(), a):
                    tokens = np.append(encode(text or "", allowed_special="all"), end).astype("<u4")
                    cuts = [0, *range((len(tokens) - 1) % capacity + 1, len(tokens) + 1, capacity)]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(row)
                        number.append(k)
                        starts.append(i)
                        lengths.append(j - i)
                        ids.append(tokens[i:j].tobytes())
                columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, schema)


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the highest value that fits (an unbounded knapsack)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        gains = np.where(fits, best[np.maximum(room - sizes, 0)] + values, -1.0)
        k = int(np.argmax(gains))
        best[room], pick[room] = (gains[k], k) if gains[k] > best[room - 1] else (best[room - 1], -1)
    counts, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use them, the optimum of the fractional problem by column generation."""
    basis = np.diag(capacity // sizes).astype(float)
    amount = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = _best_pattern(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        amount = np.maximum(amount - step * move, 0)
        amount[out] = step
        basis[:, out] = pattern
    return [(basis[:, k].astype(int), float(amount[k])) for k in range(len(sizes))]


class _Runs:
    """Sequences of like content, kept together: how many, from which number, and what they hold, by the room they have left.

    An item (length, rank, offset) of a run stands for the ranks from ``rank`` on, one for each of its sequences.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.next = capacity, 0
        self.open: dict[int, list] = {}

    def add(self, first: int, count: int, room: int, items: list[tuple[int, int, int]]) -> None:
        self.open.setdefault(room, []).append((first, count, items))

    def fresh(self, count: int) -> int:
        self.next += count
        return self.next - count

    def fit(self, length: int, rank: int, count: int) -> None:
        """Best fit of ``count`` items of one length: a sequence takes as many as it holds before the next is begun."""
        while count:
            rooms = [r for r in self.open if r >= length and self.open[r]]
            if rooms:
                room = min(rooms)
                first, have, items = self.open[room].pop()
            else:
                room, items = self.capacity, []
                have = -(-count // (room // length))
                first = self.fresh(have)
            each = min(room // length, count)
            used = min(have, count // each)
            used_at = self.capacity - room
            placed = [*items, *((length, rank + k * used, used_at + k * length) for k in range(each))]
            self.add(first, used, room - each * length, placed)
            rank, count = rank + each * used, count - each * used
            if have > used:
                self.add(first + used, have - used, room, [(n, r + used, o) for n, r, o in items])


class _Stock:
    """The large lengths that are not placed yet: how many, and the rank of the first."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.rank = dict.fromkeys(histogram, 0)
        self.count = dict(histogram)
        self.lengths = sorted(histogram)

    def longest(self, most: int) -> int | None:
        """The longest length up to ``most`` of which some are left."""
        at = bisect.bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else None

    def take(self, length: int, count: int) -> int:
        """The rank of the first of ``count`` of one length."""
        rank = self.rank[length]
        self.rank[length] += count
        self.count[length] -= count
        if not self.count[length]:
            self.lengths.remove(length)
        return rank


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, sequence, offset): rank r of a length goes to ``sequence + r - rank_from``."""
    state = _Runs(capacity)
    least = int(capacity * small)
    large = {n: c for n, c in histogram.items() if n > least}
    stock = _Stock(large)
    if large:
        sizes, demand = grouped(large, groups)
        # patterns that hold the longest first: their lengths have the fewest places
        for pattern, amount in sorted(configurations(sizes, demand, capacity), key=lambda p: [-int(n) for n in p[0][::-1]]):
            slots = [int(sizes[k]) for k in np.flatnonzero(pattern)[::-1] for _ in range(pattern[k])]
            below = {int(n): int(sizes[k - 1]) if k else 0 for k, n in enumerate(sizes)}
            _substitute(state, stock, slots, below, int(amount + 1e-9), capacity)
    for n in reversed(list(stock.lengths)):
        state.fit(n, stock.rank[n], stock.count[n])
    for n in sorted((n for n in histogram if n <= least), reverse=True):
        state.fit(n, 0, histogram[n])
    rows = []
    for runs in state.open.values():
        for first, count, items in runs:
            rows += [(n, rank, rank + count, first, offset) for n, rank, offset in items if count]
    return sorted(rows)


def grouped(large: dict[int, int], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest length of each group of near equal cardinality and the number of its members; a length is in one group."""
    lengths = np.array(sorted(large), int)
    ends = np.cumsum([large[n] for n in lengths.tolist()])
    group = np.minimum((ends - 1) * groups // ends[-1], groups - 1)
    last = np.append(np.flatnonzero(np.diff(group)), len(group) - 1)
    return lengths[last], np.diff(ends[last], prepend=0).astype(float)


def _substitute(state: _Runs, stock: _Stock, slots: list[int], below: dict[int, int], times: int, capacity: int) -> None:
    """Opens up to ``times`` sequences of one configuration.

    Each slot but the last gets the longest real length of its group; the last one, as the real lengths leave more room than
    the rounded ones, the longest that fits, and so on while one fits.
    """
    while times > 0:
        chosen: list[int] = []
        used: dict[int, int] = {}

        def pick(most: int) -> int | None:
            while (n := stock.longest(most)) is not None and used.get(n, 0) >= stock.count[n]:
                most = n - 1
            return n

        for slot in slots[:-1]:
            n = pick(slot)
            if n is None or n <= below[slot]:  # its group is used up
                return
            chosen.append(n)
            used[n] = used.get(n, 0) + 1
        while (n := pick(capacity - sum(chosen))) is not None:
            chosen.append(n)
            used[n] = used.get(n, 0) + 1
        if len(chosen) < len(slots):
            return
        many = min(times, *(stock.count[n] // k for n, k in used.items()))
        first, offset, items = state.fresh(many), 0, []
        for n in chosen:
            items.append((n, stock.take(n, many), offset))
            offset += n
        state.add(first, many, capacity - offset, items)
        times -= many


def packed(docs: DataFrame, capacity: int = CAPACITY, ids: bool = True, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, piece, start, length, ids_crc32, sequence_id, offset), with the ids if they are wanted."""
    spark = docs.sparkSession
    cut_up = pieces(docs, capacity, ranks_path=ranks_path).withColumn("ids_crc32", F.crc32("ids"))
    rows = written(cut_up, "pieces") if ids else cut(cut_up.drop("ids"))
    histogram = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(
        plan(histogram, capacity), "_length long, _from long, _to long, _sequence long, offset long"
    )
    numbered = ranked(rows, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank_of")
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank_of") >= F.col("_from")) & (F.col("_rank_of") < F.col("_to"))
    placed = numbered.join(F.broadcast(places), inside).withColumn("sequence_id", F.col("_sequence") + F.col("_rank_of") - F.col("_from"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if ids else []))
