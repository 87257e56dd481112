"""Near duplicates of a Jaccard similarity, by SimHash: tiled exact comparison at a similarity instead of a radius.

A radius that 64 bits must have for a similarity of 0.8 joins a good part of all unlike pairs, and leaves no tile to skip. So
three steps take its place. Texts of equal shingle sets are one class. Classes that share a band of minimum hashes (a pair at
0.8 does with probability 0.99997) are a block; within blocks SimHash fingerprints of 128 bits are compared by exclusive-or
and bit counts, at a radius that a pair at 0.8 exceeds once in about four thousand times and one of 0.3 rarely keeps. The
components of these links are compared exactly: the shingles that a component's texts share are bits, a tile of texts is
compared with others by exclusive-or and bit counts, tiles whose population counts exclude the similarity are skipped, and
each tile pair gives a spanning forest of what is alike. Where the bits would take more than ``MATRIX``, sorted lists say the same. Only true similarities of ``least`` or more join documents.

Blocks and components of any size are cut into parts of bounded size, pairs of which are separate tasks; no step gives out
a pair for each two members.

Defined cases: words are runs between white space, A-Z in lower case; a text of fewer than five words has one shingle; null
texts and texts without words are equal to each other; of a group the row with the smallest id stays, a null id only if
there is no other; an empty table gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.materialize import cut, written
from colloquy.llm.common import broadcastable, fresh, looked_up, lowered, runs, scrambled, slices, utf8, without, word_hashes
from colloquy.llm.simhash import contracted

SHINGLE = 5
LEAST = 0.8
BANDS = 20
ROWS = 4
SEED = 42
#: Bits of 128 by which fingerprints may differ: 19.4 are the mean at 0.8 and 4.1 the standard deviation.
RADIUS = 34
#: Classes in a part of a block, and shingles in a part of a component.
PART, PART_SHINGLES = 4096, 1 << 21
TILE = 64
#: Odd multipliers and masks of the minimum hashes.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64) | np.array([[[1]], [[0]]], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """For each row the distinct hashes of its word shingles, sorted."""
    low, rows = lowered(data), len(offsets) - 1
    white = (low == 32) | ((low >= 9) & (low <= 13))
    inside = np.zeros(len(low) + rows, bool)
    inside[np.arange(len(low)) + np.repeat(np.arange(rows), np.diff(offsets))] = ~white
    starts, ends = runs(inside)
    row = np.searchsorted(offsets[:-1] + np.arange(rows), starts, "right") - 1
    words = word_hashes(low, starts - row, ends - row)
    first = np.searchsorted(row, np.arange(rows + 1))
    # a shingle's sum over places k of word * (2k + 1), and of the words that a short text has
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    whole = sum((padded[k : k + len(words)] * np.uint64(2 * k + 1) for k in range(size)), np.zeros(len(words), np.uint64))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(scrambled(whole[a : b - size + 1])))
        elif b > a:
            out.append(scrambled((words[a:b] * np.arange(1, 2 * (b - a), 2, dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(words[:0])
    return out


def bands(found: np.ndarray) -> list[int]:
    """A signed hash for each band of minimum hashes; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(found), 2048):
        np.minimum(least, ((found[None, first : first + 2048] ^ _FACTORS[1]) * _FACTORS[0]).min(axis=1), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """SimHash of a set, two words of 64 bits."""
    out = []
    for hashes in (found, scrambled(found ^ np.uint64(SEED))):
        ones = np.zeros(64, np.int64)
        for first in range(0, len(hashes), 1 << 14):
            part = np.ascontiguousarray(hashes[first : first + (1 << 14)]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


_SKETCH = "_set long, _size long, _fp0 long, _fp1 long, _bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(2)):
            sets = shingle_sets(*utf8(batch.column(2).slice(a, b - a)))
            prints = np.array([fingerprint(s) for s in sets], np.int64)
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            columns = [keys, np.array([len(s) for s in sets], np.int64), prints[:, 0], prints[:, 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, columns), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["_row", "doc_id", "_set", "_size", "_fp0", "_fp1", "_bands"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by their first column, a table for each of its values."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        keys = table.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(bounds[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def forest(side: np.ndarray, size: np.ndarray, prints: np.ndarray, radius: int, alike=None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of a spanning forest: of rows of sides 0 and 1 with each other, or, of side 2, of all.

    Rows are taken in order of size, in tiles; a tile meets only sizes that the similarity allows. ``alike(i, js)`` says which
    of the candidates within the radius are links; without it all are.
    """
    order = np.argsort(size, kind="stable")
    side, size, prints = side[order], size[order], prints[order]
    part, out = np.arange(len(order)), []
    right = np.flatnonzero(side != 0)
    for first in range(0, len(order), TILE):
        tile = np.arange(first, min(first + TILE, len(order)))
        tile = tile[side[tile] != 1]
        if not len(tile):
            continue
        low, high = (np.searchsorted(size[right], x, s) for x, s in ((LEAST * size[tile[0]] - 1e-9, "left"), (size[tile[-1]] / LEAST + 1e-9, "right")))
        near = right[low:high]
        close = (np.bitwise_count(prints[tile, None, :] ^ prints[None, near, :]).sum(axis=2) <= radius) if len(near) else np.zeros((len(tile), 0), bool)
        for k, i in enumerate(tile.tolist()):
            js = near[close[k]]
            js = js[(part[js] != part[i]) & ((side[js] == 1) | (js > i))]
            if len(js) and alike is not None:
                js = js[alike(order[i], order[js])]
            if len(js):
                parts, at = np.unique(part[js], return_index=True)
                part[np.isin(part, parts)] = part[i]
                out.append((np.full(len(at), order[i]), order[js[at]]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, side, set, size, fp0, fp1), sorted by key, to a forest of the sets whose fingerprints are near."""
    found, many = [], 0
    for group in _groups(batches):
        side, sets, size, *words = (group.column(k).to_numpy() for k in range(1, 6))
        i, j = forest(side, size, np.stack(words, axis=1).view(np.uint64), RADIUS)
        found.append((sets[i], sets[j]))
        many += len(i)
        if many > 10_000:
            yield _edges(found)
            found, many = [], 0
    yield _edges(found)


def _by_bits(back: np.ndarray, shared: np.ndarray, starts: np.ndarray, ends: np.ndarray, columns: int):
    """Shingles that row i and each of rows js have in common, by exclusive-or and bit counts of dense rows of bits."""
    bits = np.zeros((len(starts), columns // 64 + 1), np.uint64)
    for row, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        here = np.zeros(bits.shape[1] * 64, bool)
        here[shared[back[a:b]][shared[back[a:b]] >= 0]] = True
        bits[row] = np.packbits(here, bitorder="little").view("<u8")
    own = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    def common(i: int, js: np.ndarray) -> np.ndarray:
        out = np.zeros(len(js), np.int64)
        step = max(1, (1 << 20) // bits.shape[1])
        for k in range(0, len(js), step):
            some = js[k : k + step]
            out[k : k + step] = (own[some] + own[i] - np.bitwise_count(bits[some] ^ bits[i]).sum(axis=1, dtype=np.int64)) // 2
        return out

    return common


def _by_lists(back: np.ndarray, starts: np.ndarray, ends: np.ndarray, many: int):
    """The same by marks of row i's shingles that the rows js are looked up in, for many short rows of unlike shingles."""
    marks = np.zeros(many, bool)

    def common(i: int, js: np.ndarray) -> np.ndarray:
        out = np.zeros(len(js), np.int64)
        mine = back[starts[i] : ends[i]]
        marks[mine] = True
        sizes = ends[js] - starts[js]
        for k in range(0, len(js), 4096):
            some, n = js[k : k + 4096], sizes[k : k + 4096]
            row = np.repeat(np.arange(len(some)), n)
            place = np.arange(n.sum()) + np.repeat(starts[some] - (np.cumsum(n) - n), n)
            out[k : k + 4096] = np.bincount(row, marks[back[place]], len(some))
        marks[mine] = False
        return out

    return common


#: Bytes of the bits of a part at most; a part that would need more is compared by lists.
MATRIX = 1 << 26


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, side, set, size, fp0, fp1, text), sorted by key, to a forest of the sets that are alike."""
    found = []
    for group in _groups(batches):
        side, names, size, *words = (group.column(k).to_numpy() for k in range(1, 6))
        sets = shingle_sets(*utf8(group.column(6)))
        distinct, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(s) for s in sets])
        starts = ends - [len(s) for s in sets]
        columns = int((n > 1).sum())  # shingles that two texts have
        if len(sets) * (columns // 64 + 1) * 8 <= MATRIX:
            common = _by_bits(back, np.where(n > 1, np.cumsum(n > 1) - 1, -1), starts, ends, columns)
        else:
            common = _by_lists(back, starts, ends, len(distinct))
        alike = lambda i, js: (both := common(i, js)) >= LEAST * (size[js] + size[i] - both) - 1e-9
        i, j = forest(side, size, np.stack(words, axis=1).view(np.uint64), RADIUS, alike)
        found.append((names[i], names[j]))
        if len(found) > 1000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _paired(rows: DataFrame, key: str, parts) -> DataFrame:
    """Rows dealt by their set into ``parts`` parts of their key, once for each pair of parts that they are in."""
    own = F.pmod(F.xxhash64("_set", F.lit(5)), F.col("_parts")).cast("int")
    dealt = rows.withColumn("_parts", parts).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1).cast("byte")
    return dealt.withColumn("_pair", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).withColumn("_side", side).drop("_parts", "_own", "_other")


def _linked(rows: DataFrame, compare, columns: list[str]) -> DataFrame:
    dealt = rows.select("_pair", "_side", *columns).repartition("_pair").sortWithinPartitions("_pair")
    return dealt.mapInArrow(compare, "a long, b long")


def _blocked(keyed: DataFrame) -> DataFrame:
    """Rows whose key others share, with the number of them; frequent keys, few by nature, do not gather their rows."""
    blocks = cut(keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1"))
    hot = broadcastable(blocks.filter(F.col("_n") > PART))
    rest = keyed.join(hot.select("_key"), "_key", "left_anti").join(blocks.filter(F.col("_n") <= PART), "_key")
    return keyed.join(hot, "_key").unionByName(rest)


def _roots(classes: DataFrame, marked: DataFrame, row: str) -> DataFrame:
    """(node, root) of the classes that are not their group's root."""
    prints = ["_set", "_size", "_fp0", "_fp1"]
    keyed = classes.select(*prints, F.explode("_bands").alias("_key"))
    near = contracted(_linked(_paired(_blocked(keyed), "_key", F.ceil(F.col("_n") / PART).cast("int")), _near, prints))
    named = near.select(F.col("node").alias("_set"), "root").unionByName(near.select(F.col("root").alias("_set"), "root").distinct())
    members = cut(classes.select(*prints, row).join(named, "_set"))
    parts = members.groupBy("root").agg(F.ceil(F.sum("_size") / PART_SHINGLES).cast("int").alias("_n"), F.count("*").alias("_members"))
    few = broadcastable(looked_up(members, parts, "root", "_members").drop("_members"))
    texts = marked.select(row, "text").join(few, row)
    return contracted(_linked(_paired(texts, "root", F.col("_n")), _compared, [*prints, "text"]))


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of the documents that stay: of each group the row with the smallest id (of several such, one)."""
    row = fresh(docs, "row")
    marked = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-duplicates")
    schema = marked.select(F.col(row).alias("_row"), "doc_id").schema
    for field in docs.sparkSession.createDataFrame([], _SKETCH).schema:
        schema = schema.add(field)
    sketches = cut(marked.select(F.col(row).alias("_row"), "doc_id", "text").mapInArrow(_sketched, schema))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first")
    same = [F.first(c).alias(c) for c in ("_size", "_fp0", "_fp1", "_bands")]  # equal in a class
    classes = cut(sketches.groupBy("_set").agg(first, *same).withColumn(row, F.col("_first._row")))
    roots = _roots(classes, marked, row)
    rooted = classes.join(roots, F.col("_set") == F.col("node"), "left").groupBy(F.coalesce("root", "_set").alias("root")).agg(F.min("_first")["_row"].alias("_row"))
    gone = sketches.select("_row").join(rooted, "_row", "left_anti").withColumnRenamed("_row", row)
    return without(marked, gone, row).drop(row)
