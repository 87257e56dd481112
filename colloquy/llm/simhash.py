"""Near duplicates by 64-bit SimHash, linked by tiled exact comparison.

Fingerprints come from the hashes of word shingles in one pass over the texts. The distinct ones are laid out in tiles by
the population counts of their four 16-bit quarters. Two fingerprints differ in at least as many bits as their quarters'
counts differ in sum, so only tile pairs within the radius are compared, each by exclusive-or and bit counts in numpy. A
tile pair gives at most a spanning forest of its links, never all pairs, and a tile of many fingerprints is cut into
blocks of bounded size. Components come from alternating star contraction over the distinct fingerprints.

Defined cases: a null or empty text has fingerprint zero, linked like any other; equal texts share a fingerprint; null
ids are kept but never name a component unless it has no other; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.materialize import cut
from colloquy.llm.common import joined_apart, utf8

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints in a block of a tile.
BLOCK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of one lower-cased text; 0 if it has no words."""
    words = text.split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 14):
        part = hashes[first : first + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``docs`` with the column ``_fp`` (signed 64 bits) in the place of its text."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("_fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            raw = data.tobytes()
            prints = [fingerprint(raw[a:b].lower(), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(prints, np.uint64).view(np.int64))], [*kept, "_fp"])

    return docs.mapInArrow(run, schema)


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two blocks (or within one, given twice)."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    at_left, at_right = place[: len(left)], place[len(left) :]
    root = np.arange(len(nodes))
    out: list[np.ndarray] = []
    for first in range(0, len(left), 256):
        distance = np.bitwise_count(left[first : first + 256, None] ^ right[None, :])
        i, j = np.nonzero(distance <= radius)
        a, b = at_left[first + i], at_right[j]
        apart = a != b
        a, b = a[apart], b[apart]
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            picked, at = np.unique(high, return_index=True)  # one link for each root, to a smaller one: no cycle
            root[picked] = low[at]
            out.append(np.stack([a[at], b[at]]))
            while (above := root[root]).tolist() != root.tolist():
                root = above
    if not out:
        return nodes[:0], nodes[:0]
    edges = np.concatenate(out, axis=1)
    return nodes[edges[0]], nodes[edges[1]]


def _compared(radius: int):
    """Streams rows (key, side, fp) sorted by key into the links of each key's two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def links(key, side, fp):
            left, right = fp[side != 1].view(np.uint64), fp[side != 0].view(np.uint64)  # side 2: both
            return _forest(left, right, radius) if len(left) and len(right) else (left[:0], left[:0])

        def grouped(key, side, fp, last):
            cuts = np.flatnonzero(np.diff(key)) + 1
            bounds = [0, *cuts.tolist(), len(key)]
            n = len(bounds) - 1 if last else len(bounds) - 2
            found = [links(key[a:b], side[a:b], fp[a:b]) for a, b in zip(bounds[:n], bounds[1 : n + 1])]
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
            left = slice(bounds[n], None)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]), (key[left], side[left], fp[left])

        for batch in batches:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if rest is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(rest, now))
            if len(now[0]):
                out, rest = grouped(*now, last=False)
                yield out
        if rest is not None and len(rest[0]):
            yield grouped(*rest, last=True)[0]

    return run


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints ``_fp`` to (a, b): links that join what the radius joins, a forest for each pair of blocks.

    Tiles are at most 17**4 whatever the input, and so are small rows of counts. ``prints`` is read three times.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("_fp", 16 * i).bitwiseAND(0xFFFF)).cast("int") for i in range(4)]
    # a mixed hash decides the block in a tile, so that a tile's blocks are of like size
    tiled = prints.select("_fp", *(q.alias(f"_q{i}") for i, q in enumerate(quarters)))
    tile = [f"_q{i}" for i in range(4)]
    sizes = tiled.groupBy(*tile).agg(F.ceil(F.count("*") / block).cast("int").alias("_cuts"))
    steps = [
        (a, b, c, d)
        for a in range(-radius, radius + 1)
        for b in range(-radius, radius + 1)
        for c in range(-radius, radius + 1)
        for d in range(-radius, radius + 1)
        if sum(map(abs, (a, b, c, d))) <= radius and (a, b, c, d) >= (0, 0, 0, 0)
    ]
    sizes = cut(sizes)
    moved = sizes.withColumn("_step", F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))))
    near = moved.select(
        *(F.col(t).alias(f"_a{i}") for i, t in enumerate(tile)), F.col("_cuts").alias("_cuts_a"), *((F.col(t) + F.col("_step")[i]).alias(t) for i, t in enumerate(tile))
    ).join(sizes.withColumnRenamed("_cuts", "_cuts_b"), tile)
    own = F.lit(True)
    for i, t in enumerate(tile):
        own = own & (F.col(f"_a{i}") == F.col(t))
    # a pair of blocks: (tile a, cut i) against (tile b, cut j); within one tile only i <= j
    i, j = F.col("_i"), F.col("_j")
    pairs = (
        near.withColumn("_own", own)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_cuts_a") - 1)))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_cuts_b") - 1)))
        .filter(~F.col("_own") | (i <= j))
    )
    names = [*(f"_a{k}" for k in range(4)), *tile, "_i", "_j"]
    pairs = pairs.withColumn("key", F.xxhash64(*names))
    both = F.col("_own") & (i == j)
    side_a = pairs.select(*(F.col(f"_a{k}").alias(f"_q{k}") for k in range(4)), i.alias("_cut"), "key", F.when(both, 2).otherwise(0).cast("byte").alias("side"))
    side_b = pairs.filter(~both).select(*tile, j.alias("_cut"), "key", F.lit(1).cast("byte").alias("side"))
    places = side_a.unionByName(side_b)
    cuts = tiled.join(F.broadcast(sizes), tile).withColumn("_cut", F.pmod(F.xxhash64("_fp", F.lit(7)), F.col("_cuts")).cast("int"))
    rows = cuts.join(places, [*tile, "_cut"]).select("key", "side", "_fp")
    dealt = rows.repartition("key").sortWithinPartitions("key", "side")
    return dealt.mapInArrow(_compared(radius), "a long, b long")


def contracted(edges: DataFrame, most: int = 60) -> DataFrame:
    """(a, b) edges to (node, root): each node's smallest node of its component, by large and small stars in turn."""
    edges = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most):
        both = edges.union(edges.select("b", "a"))
        # a star's centre may have most of the links: such are looked up where the links are
        total = 2 * edges.count()
        lowest = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        large = joined_apart(both, lowest, "a", "_n", total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        small = joined_apart(large, lowest, "a", "_n", total).selectExpr("explode(array(struct(a, m as b), struct(b as a, m as b))) as e").select("e.*")
        now = cut(small.filter("a != b").distinct())
        change = now.exceptAll(edges).isEmpty() and edges.exceptAll(now).isEmpty()
        edges = now
        if change:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def with_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Materialised rows with ``_fp`` and ``doc_id`` to the same rows with ``component_id``."""
    classes = cut(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")))
    roots = contracted(links(classes.select("_fp"), radius))
    moved = classes.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", "_n", F.coalesce("root", "_fp").alias("_root"))
    least = moved.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_size"))
    # neither a component's fingerprints nor a fingerprint's rows are gathered where there are many
    total = prints.count()
    named = cut(joined_apart(moved, least, "_root", "_size", total).select("_fp", "_root", "_n", "component_id"))
    return joined_apart(prints, named, "_fp", "_n", total)


def components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to (doc_id, fingerprint, component_id), a row for each input row."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), shingle))
    rows = with_components(prints, radius)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
