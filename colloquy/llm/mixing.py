"""Language-model scores by logistic context mixing over bits.

Texts are lower-cased (A-Z), as UTF-8 bytes and one end byte. A byte is a path in the prefix code of the byte before it, so
that likely bytes are few bits; the codes are made from the corpus's pairs of bytes. Several predictors, each a table of the
log odds of bits in hashed contexts (one byte and three bytes before, the word so far, and the word so far with the word
before it), say how likely a bit is; they are summed with weights that a gate picks by the depth in the code, and the sum's
logistic is the probability. Spark counts the tables over five of the training folds; starting weights are learned online by
all tasks over the sixth, then averaged. Within a text the weights are refined online: after each ``BLOCK`` bytes, by the
gradient of what they cost. A text's score thus depends on the text and the model alone.

The tables have four slots for each word that the corpus distinguishes, up to ``LARGEST``, which bounds what is broadcast. A
task hands on the slots it used, so it is best given much text: up to ``PARTITIONS_PER_TASK`` partitions are one task.

The base score needs the count of every word. Words that occur often in all texts, a bounded number, are looked up where the
text is; the others, each of them rare and so no hot key, travel as hashes and are joined with their counts. Words are known
by hashes of 63 bits.

Defined cases: null and empty texts are their end alone; texts are scored whole; without training texts no word is known
and all bits are even; repeated rows and null ids are scored each; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.materialize import cut
from colloquy.llm.common import fold, held_out, lowered, powers, runs, slices, utf8, word_hashes

FOLDS, HELD_OUT, MIXING_FOLD = 7, 2, 6
PREDICTORS, GATES = 4, 16
#: Least and most slots of a hashed table; the table of one byte before has one for each node of each code.
SMALLEST, LARGEST = 1 << 16, 1 << 20
#: A code has at most 255 nodes, so a context's slots are so many from its base on.
NODES = 256
HEAD_WORDS = 1 << 18
BYTES = 1 << 17
BLOCK = 512
RATE = 0.05
#: Steps of a stored log odd.
SCALE = np.float32(16)
CHUNK = 1 << 16
#: Partitions counted by one task: at most so many, and fewer while there are not as many tasks for a core.
PARTITIONS_PER_TASK, TASKS_PER_CORE = 8, 4
_DEEPEST = 64


@dataclass
class Code:
    """For each pair of bytes the number of bits of the second and where they begin among the steps, 2 * node + bit each."""

    lengths: np.ndarray
    starts: np.ndarray
    steps: np.ndarray


def _tree(weights: list[float]) -> list[list[int]]:
    """The steps of each byte in the prefix code of these weights."""
    heap = [(w, byte) for byte, w in enumerate(weights)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for node in range(len(weights) - 1):
        (p, a), (q, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (node, 0), (node, 1)
        heapq.heappush(heap, (p + q, len(weights) + node))
    paths: list[list[int]] = []
    for byte in range(len(weights)):
        at, path = byte, []
        while at in parent:
            node, bit = parent[at]
            path.append(2 * node + bit)
            at = len(weights) + node
        paths.append(path[::-1])
    return paths


def code_of(pairs: np.ndarray) -> Code:
    """The codes for counts of (byte before, byte); bytes that never follow share a little of the whole."""
    single = pairs.sum(axis=0) + 1.0
    single /= single.sum()
    paths = []
    for row in pairs:
        paths += _tree((row + (row.sum() + 1) * (1e-3 * single + 1e-6)).tolist()) if row.any() else _tree(single.tolist())
    lengths = np.array([len(p) for p in paths], np.int64)
    return Code(lengths, np.cumsum(lengths) - lengths, np.array([s for p in paths for s in p], np.int16))


def _hashed(x: np.ndarray, size: int) -> np.ndarray:
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return (x >> np.uint32(33 - size.bit_length())).astype(np.int32)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, and each one's row."""
    rows = len(offsets) - 1
    white = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.zeros(len(data) + rows, bool)
    inside[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))] = ~white
    starts, ends = runs(inside)
    row = np.searchsorted(offsets[:-1] + np.arange(rows), starts, "right") - 1
    return word_hashes(data, starts - row, ends - row).view(np.int64) & np.int64(-2), row  # the last bit is for a mark


@dataclass
class Texts:
    """The bytes of a batch, an end byte after each row."""

    sizes: np.ndarray
    first: np.ndarray  # bytes before each row
    pair: np.ndarray  # 256 * the byte before + the byte
    contexts: list[np.ndarray]  # 32-bit contexts of the predictors


def texts_of(data: np.ndarray, offsets: np.ndarray) -> Texts:
    rows = len(offsets) - 1
    text = np.zeros(len(data) + rows, np.uint8)
    keep = np.ones(len(text), bool)
    keep[offsets[1:] + np.arange(rows)] = False
    text[keep] = data
    sizes = np.diff(offsets) + 1
    first = np.cumsum(sizes) - sizes
    begin = np.repeat(first, sizes)
    at = np.arange(len(text))
    before = []
    for k in (1, 2, 3):
        back = np.zeros(len(text), np.uint32)
        back[k:] = text[:-k]
        back[at - begin < k] = 0
        before.append(back)
    white = (text == 32) | ((text >= 9) & (text <= 13)) | (text == 0)
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(white, at, -1))[:-1]])
    start = np.maximum(last + 1, begin)
    radix = powers(len(text) + 1, 0x01000193).astype(np.uint32)
    inverse = powers(len(text) + 1, pow(0x01000193, -1, 1 << 32)).astype(np.uint32)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum((text.astype(np.uint32) + np.uint32(1)) * radix[:-1], dtype=np.uint32)])
    word = (sums[at] - sums[start]) * inverse[start]
    previous = np.where(last >= begin, word[last], np.uint32(0))
    own = before[0] * np.uint32(0x9E3779B1)  # the codes differ by the byte before
    contexts = [before[0], before[0] | before[1] << np.uint32(8) | before[2] << np.uint32(16), word + own, word + own + (previous ^ np.uint32(0x5BD1E995)) * np.uint32(0x2C1B3C6D)]
    return Texts(sizes, first, before[0].astype(np.int64) << 8 | text, contexts)


@dataclass
class Bits:
    """Bits of byte ranges: by range, then depth, so that each (range, depth) is a run; ``counts`` are their sizes."""

    sign: np.ndarray
    slots: list[np.ndarray]
    counts: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """The bits before each range, and all."""
        return np.concatenate([[0], np.cumsum(self.counts.sum(axis=1))])


def bits_of(texts: Texts, code: Code, sizes: list[int], starts: np.ndarray, lengths: np.ndarray) -> Bits:
    """The bits of the ranges of so many bytes each."""
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)
    pair = texts.pair[place]
    depth = code.lengths[pair]
    key = np.repeat(np.arange(len(lengths)) * _DEEPEST, lengths) + depth
    histogram = np.bincount(key, minlength=len(lengths) * _DEEPEST).reshape(-1, _DEEPEST)
    top = int(depth.max()) if len(depth) else 1
    counts = lengths[:, None] - np.cumsum(histogram, axis=1)[:, :top]  # bytes of more than d bits
    backward = key + _DEEPEST - 1 - 2 * depth  # deepest first, so that the bytes with a bit at a depth are the first of a range
    order = np.argsort(backward.astype(np.uint16) if len(lengths) * _DEEPEST < 1 << 16 else backward, kind="stable")
    place, pair = place[order], pair[order]
    run = counts.ravel()
    ends = np.cumsum(run)
    at = np.repeat(np.repeat(before, top) - (ends - run), run) + np.arange(int(ends[-1]) if len(ends) else 0)
    step = code.steps.take(code.starts[pair].take(at) + np.repeat(np.tile(np.arange(top), len(lengths)), run))
    node = (step >> 1).astype(np.int64)
    sign = ((step & 1) * 2 - 1).astype(np.float32)
    bases = [texts.contexts[0][place].astype(np.int32) * NODES, *(_hashed(c[place], s) for c, s in zip(texts.contexts[1:], sizes[1:]))]
    together = np.stack(bases, axis=1).take(at, axis=0)
    return Bits(sign, [together[:, k] + node for k in range(len(bases))], counts)


def sizes_of(words: int) -> list[int]:
    """Slots of the tables of a corpus with so many distinct words."""
    hashed = min(LARGEST, max(SMALLEST, 1 << (4 * words).bit_length()))
    return [256 * NODES, *[hashed] * (PREDICTORS - 1)]


@dataclass
class Model:
    code: Code
    sizes: list[int]
    tables: list[np.ndarray]  # log odds of a one in steps of 1 / SCALE, for each predictor's slots
    weights: np.ndarray  # gates by predictors
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    end_count: int = 0
    total: int = 0
    distinct: int = 0

    def stretched(self, bits: Bits) -> list[np.ndarray]:
        return [t.take(s).astype(np.float32) for t, s in zip(self.tables, bits.slots)]


@dataclass
class Head:
    """Places of the head's words by a table of the hashes' leading bits; words whose place is taken are looked up beside it."""

    words: np.ndarray
    place: np.ndarray
    other: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray) -> Head:
        place = np.zeros(1 << 20, np.int32)
        slots = (words.view(np.uint64) >> np.uint64(44)).astype(np.int64)
        place[slots] = np.arange(len(words))
        return cls(words, place, np.flatnonzero(place[slots] != np.arange(len(words))))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the words; -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = self.place[(hashes.view(np.uint64) >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        missed = np.flatnonzero(self.words[at] != hashes)
        at[missed] = -1
        if len(self.other):
            rest = self.words[self.other]
            near = np.minimum(np.searchsorted(rest, hashes[missed]), len(rest) - 1)
            found = rest[near] == hashes[missed]
            at[missed[found]] = self.other[near[found]]
        return at


def start_weights() -> np.ndarray:
    return np.full((GATES, PREDICTORS), 0.3 / SCALE, np.float32)


def _passed(sign: np.ndarray, stretched: list[np.ndarray], weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the probability of each bit, and how far the prediction was off; weights and counts by range and depth."""
    total, runs_ = np.zeros(len(sign), np.float32), counts.ravel()
    for k, s in enumerate(stretched):
        total += np.repeat(weights[..., k].ravel(), runs_) * s
    total *= sign
    odds = np.exp(-np.clip(total, -30, 30))
    return -np.log2(1 + odds), sign * (odds / (1 + odds))


def _gradient(error: np.ndarray, stretched: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of error by input, and bits, for each range, gate and predictor."""
    runs_ = counts.ravel()
    used = runs_ > 0
    starts = (np.cumsum(runs_) - runs_)[used]
    sums = np.zeros((len(runs_), len(stretched)), np.float32)
    for k, s in enumerate(stretched):
        sums[used, k] = np.add.reduceat(error * s, starts)
    sums = sums.reshape(*counts.shape, len(stretched))
    if counts.shape[1] > GATES:
        sums = np.concatenate([sums[:, : GATES - 1], sums[:, GATES - 1 :].sum(axis=1, keepdims=True)], axis=1)
        counts = np.concatenate([counts[:, : GATES - 1], counts[:, GATES - 1 :].sum(axis=1, keepdims=True)], axis=1)
    return sums / SCALE, counts


def text_logs(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log2 of each row's probability, the weights refined from block to block of each row."""
    texts = texts_of(data, offsets)
    rows = len(texts.sizes)
    longest = np.argsort(-texts.sizes, kind="stable")  # the rows that have a block are then the first ones
    blocks = -(-texts.sizes[longest] // BLOCK)
    row = np.repeat(np.arange(rows), blocks)
    block = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    order = np.lexsort((row, block))
    row, block = row[order], block[order]
    starts = texts.first[longest][row] + block * BLOCK
    lengths = np.minimum(texts.sizes[longest][row] - block * BLOCK, BLOCK)
    edges = np.concatenate([[0], np.cumsum(np.bincount(block))])  # ranges before each block
    sums = np.concatenate([[0], np.cumsum(lengths)])[edges]
    weights = np.repeat(model.weights[None], rows, axis=0)
    out, b, last = np.zeros(rows), 0, len(edges) - 1
    while b < last:
        stop = max(b + 1, int(np.searchsorted(sums, sums[b] + BYTES, "right")) - 1)
        bits = bits_of(texts, model.code, model.sizes, starts[edges[b] : edges[stop]], lengths[edges[b] : edges[stop]])
        stretched, firsts = model.stretched(bits), bits.firsts
        gates = np.minimum(np.arange(bits.counts.shape[1]), GATES - 1)
        for k in range(b, stop):
            i, j = edges[k] - edges[b], edges[k + 1] - edges[b]
            part, counts, many = slice(firsts[i], firsts[j]), bits.counts[i:j], j - i
            inputs = [s[part] for s in stretched]
            logs, error = _passed(bits.sign[part], inputs, weights[:many][:, gates], counts)
            out[:many] += np.add.reduceat(logs, firsts[i:j] - firsts[i])
            if k + 1 < last:
                more = edges[k + 2] - edges[k + 1]  # rows that go on
                end = firsts[i + more] - firsts[i]
                gradient, n = _gradient(error[:end], [s[:end] for s in inputs], counts[:more])
                weights[:more, : gradient.shape[1]] += RATE / SCALE * gradient / np.sqrt(n + 1.0)[..., None].astype(np.float32)
        b = stop
    back = np.empty(rows)
    back[longest] = out
    return back


def learned_weights(model: Model, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one pass over the texts, a step after each few thousand bits; and the bits each gate has seen."""
    weights, seen = start_weights(), np.zeros(GATES, np.int64)
    for batch in batches:
        for a, b in slices(batch.column("text"), 1 << 14):
            data, offsets = utf8(batch.column("text").slice(a, b - a))
            texts = texts_of(lowered(data), offsets)
            bits = bits_of(texts, model.code, model.sizes, np.zeros(1, np.int64), texts.sizes.sum(keepdims=True))
            stretched, gates = model.stretched(bits), np.minimum(np.arange(bits.counts.shape[1]), GATES - 1)
            _, error = _passed(bits.sign, stretched, weights[None, gates], bits.counts)
            sums, n = (x[0] for x in _gradient(error, stretched, bits.counts))
            many = len(n)
            seen[:many] += n
            weights[:many] += 0.5 / SCALE * sums / np.maximum(n, 1)[:, None] * np.minimum(1, 50 / np.sqrt(seen[:many] + 1))[:, None]
    return weights, seen


_WORDS, _PAIRS, _TEXTS = range(3)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, train, bits) to (kind, key, trained, n): places of a word in training and in all texts, pairs of bytes, texts."""
    pairs, texts = np.zeros(1 << 16, np.int64), 0

    def rows(kind: int, key: np.ndarray, trained: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), *(pa.array(np.asarray(x, np.int64)) for x in (key, trained, n))], ["kind", "key", "trained", "n"])

    for batch in batches:
        train, wanted = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("train", "bits"))
        texts += int(train.sum())
        for a, b in slices(batch.column("text"), 8 << 20):
            data, offsets = utf8(batch.column("text").slice(a, b - a))
            data = lowered(data)
            hashes, row = words_of(data, offsets)
            marked = np.sort(hashes | train[a:b][row])
            first = np.flatnonzero(np.diff(marked >> 1, prepend=marked[:1] >> 1 ^ 1)) if len(marked) else np.zeros(0, int)
            yield rows(_WORDS, marked[first] & np.int64(-2), np.add.reduceat(marked & 1, first) if len(first) else first, np.diff(np.append(first, len(marked))))
            begin = offsets[:-1] + np.arange(b - a)
            text = np.zeros(len(data) + b - a, np.int64)
            keep = np.ones(len(text), bool)
            keep[begin + np.diff(offsets)] = False
            text[keep] = data
            before = np.concatenate([[0], text[:-1]])
            before[begin] = 0
            pairs += np.bincount((before << 8 | text)[np.repeat(wanted[a:b], np.diff(offsets) + 1)], minlength=len(pairs))
    used = np.flatnonzero(pairs)
    yield rows(_PAIRS, used, pairs[used], pairs[used])
    yield rows(_TEXTS, np.zeros(1), np.full(1, texts), np.full(1, texts))


_PART = "predictor int, chunk int, slots binary, counts binary"


def _counted(code: Code, sizes: list[int]):
    """(text) to the slots that were used, by predictor and chunk of slots, with the zeros and ones seen there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * (size + NODES), np.int32) for size in sizes]
        for batch in batches:
            for a, b in slices(batch.column("text"), BYTES):
                data, offsets = utf8(batch.column("text").slice(a, b - a))
                texts = texts_of(lowered(data), offsets)
                for first in range(0, int(texts.sizes.sum()), BYTES):
                    size = min(BYTES, int(texts.sizes.sum()) - first)
                    bits = bits_of(texts, code, sizes, np.array([first]), np.array([size]))
                    one = (bits.sign > 0).astype(np.int64)
                    tables[0] += np.bincount(2 * bits.slots[0] + one, minlength=len(tables[0])).astype(np.int32)
                    for table, slots in zip(tables[1:], bits.slots[1:]):
                        np.add.at(table, 2 * slots + one, np.int32(1))
        for k, table in enumerate(tables):
            for chunk in range(0, len(table), 2 * CHUNK):
                part = table[chunk : chunk + 2 * CHUNK].reshape(-1, 2)
                used = np.flatnonzero(part.any(axis=1))
                if len(used):
                    found = [[k], [chunk // (2 * CHUNK)], [used.astype("<u2").tobytes()], [part[used].astype("<i4").tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.binary()), pa.array(found[3], pa.binary())], ["predictor", "chunk", "slots", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts to (predictor, chunk, odds): a byte for each slot. All parts of a chunk are in one partition."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k, chunk, slots, counts in zip(*(batch.column(i) for i in range(4))):
            total = sums.setdefault((k.as_py(), chunk.as_py()), np.zeros((CHUNK, 2), np.int64))
            total[np.frombuffer(slots.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), "<i4").reshape(-1, 2)
    for (k, chunk), n in sums.items():
        odds = np.clip(np.round(np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)) * SCALE), -127, 127).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int32()), pa.array([odds.tobytes()], pa.binary())], ["predictor", "chunk", "odds"])


def _tables(texts: DataFrame, code: Code, sizes: list[int]) -> list[np.ndarray]:
    least = TASKS_PER_CORE * texts.sparkSession.sparkContext.defaultParallelism
    few = texts.coalesce(max(least, -(-texts.rdd.getNumPartitions() // PARTITIONS_PER_TASK)))
    parts = few.mapInArrow(_counted(code, sizes), _PART).repartition("predictor", "chunk")
    got = parts.mapInArrow(_summed, "predictor int, chunk int, odds binary").toArrow()  # a byte for each slot
    tables = [np.zeros(-(-(size + NODES) // CHUNK) * CHUNK, np.int8) for size in sizes]
    for k, chunk, odds in zip(*(got.column(i).to_pylist() for i in range(3))):
        tables[k][chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(odds, np.int8)
    return tables


def _least_of_head(words: DataFrame) -> int:
    """The fewest places of a word of the head: as low as keeps the head within its bound."""
    steps = F.floor(F.log2("n") * 16)
    often = words.groupBy(steps.cast("int").alias("step")).agg(F.count("*").alias("v"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # 16 rows for each doubling
    least, room = 1 << 62, HEAD_WORDS
    for row in often:
        if row["v"] > room:
            break
        least, room = row["least"], room - row["v"]
    return max(least, 2)


def fitted(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (key, n) of the trained words beyond its head."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), (~held_out(parts=FOLDS, part=HELD_OUT)).alias("train"), "doc_id")
    texts = texts.select("text", "train", (F.col("train") & (fold(parts=FOLDS) != MIXING_FOLD)).alias("bits"))
    listed = texts.mapInArrow(_listed, "kind byte, key long, trained long, n long")
    summed = cut(listed.groupBy("kind", "key").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n")))
    pairs = np.zeros(1 << 16, np.int64)
    for row in summed.filter(F.col("kind") == _PAIRS).collect():  # at most one for each pair of bytes
        pairs[row["key"]] = row["n"]
    ends = summed.filter(F.col("kind") == _TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    words = summed.filter(F.col("kind") == _WORDS).select("key", "trained", "n")
    known = F.col("trained") > 0
    size = words.agg(F.count_if(known).alias("v"), F.coalesce(F.sum("trained"), F.lit(0)).alias("n")).first()
    least = _least_of_head(words)
    head = words.filter(F.col("n") >= least).select("key", "trained").toArrow().sort_by("key")
    code, sizes = code_of(pairs.reshape(256, 256)), sizes_of(int(size["v"]))
    tables = _tables(texts.filter("bits").select("text"), code, sizes)
    model = Model(code, sizes, tables, start_weights(), head.column("key").to_numpy(), head.column("trained").to_numpy(), ends, int(size["n"]) + ends, int(size["v"]) + (ends > 0))
    shared = spark.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = learned_weights(shared.value, batches)
        gate, predictor = np.indices(weights.shape)
        columns = [gate.ravel().astype(np.int32), predictor.ravel().astype(np.int32), weights.ravel().astype(np.float64), np.repeat(seen, weights.shape[1]).astype(np.float64)]
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gate", "predictor", "w", "seen"])

    learned = texts.filter(F.col("train") & ~F.col("bits")).select("text").mapInArrow(learn, "gate int, predictor int, w double, seen double")
    averaged = learned.groupBy("gate", "predictor").agg((F.sum(F.col("w") * F.col("seen")) / F.nullif(F.sum("seen"), F.lit(0.0))).alias("w")).dropna().collect()
    for row in averaged:
        model.weights[row["gate"], row["predictor"]] = row["w"]
    return model, words.filter((F.col("n") < least) & known).select("key", F.col("trained").alias("n"))


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)."""
    model, tail = fitted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    schema = rows.select("doc_id", "_row", *(F.lit(0).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("_known", "long"), ("_logs", "double"), ("score", "double"), ("_bytes", "long"))), F.array(F.lit(0).cast("long")).alias("_tail")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        head, head_logs = Head.of(m.words), np.log10(m.counts + 1.0)
        for batch in batches:
            for a, b in slices(batch.column("text"), BYTES):
                data, offsets = utf8(batch.column("text").slice(a, b - a))
                data, n = lowered(data), b - a
                hashes, row = words_of(data, offsets)
                at = head.find(hashes)
                hit = at >= 0
                sums = np.bincount(row[hit], head_logs[at[hit]], n) + np.log10(m.end_count + 1.0)
                known = np.bincount(row[hit], m.counts[at[hit]] > 0, n).astype(np.int64)
                many = np.bincount(row, minlength=n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=n))]).astype(np.int32)
                unknown = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[~hit]))
                score = text_logs(m, data, offsets) * np.log10(2)
                columns = [many + 1, known + (m.end_count > 0), sums, score, np.diff(offsets)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), batch.column("_row").slice(a, n), *(pa.array(c) for c in columns), unknown], schema.names)

    found = rows.mapInArrow(run, schema)
    # a row for each unknown word, and before them one that carries the text's sums under a key of its own
    spread = found.select("*", F.posexplode(F.concat(F.array(F.xxhash64("_row", F.lit("text"))), "_tail")).alias("_at", "key")).drop("_tail")
    first = F.col("_at") == 0
    carried = ["doc_id", "n_tokens", "_known", "_logs", "score", "_bytes"]
    thin = spread.select("_row", "key", first.alias("_first"), F.when(first, F.struct(*carried)).alias("_text"))
    joined = thin.join(tail, "key", "left").select("_row", "_text", F.when(F.col("_first"), None).otherwise(F.col("n")).alias("n"))
    summed = joined.groupBy("_row").agg(F.max("_text").alias("t"), F.count("n").alias("k"), F.coalesce(F.sum(F.log10(F.col("n") + 1)), F.lit(0.0)).alias("l"))
    penalty = float(np.log10(model.total + model.distinct + 1.0))
    return summed.select(
        "t.doc_id", "t.n_tokens", (F.col("t._known") + F.col("k")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("t._logs") + F.col("l") - F.col("t.n_tokens") * penalty).alias("base_score"), "t.score",
        (-F.col("t.score") / float(np.log10(2)) / F.greatest("t._bytes", F.lit(1))).alias("bits_per_byte"),
    )
