"""Tables of literal patterns met with texts: which occur, and one replaced after the other.

A table may have any number of patterns. It is taken in blocks of bounded characters; each block goes to all tasks as one
automaton, which reads a text once however many patterns it looks for. Texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from colloquy.functions.materialize import collected, cut, written

#: Characters of the patterns that every task holds at a time.
BLOCK_CHARS = 1 << 21
#: A maximal run of word characters of any script; most are ASCII, of which a run is known as one by what follows it.
WORD = r"[A-Za-z0-9_]++(?!(?U:\w))|(?U:\w++)"
#: Bytes of texts whose words are paired at a time; one text at least.
PAIR_BYTES = 1 << 24


def _automaton(patterns: list[str]) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for i, pattern in enumerate(patterns):
        made.add_word(pattern, i)
    made.make_automaton()
    return made if patterns else None


def occurring(texts: DataFrame, patterns: DataFrame, key: str, text: str, fold_case: bool = True) -> DataFrame:
    """(key, pattern_id): the patterns that occur in each text as it is or, with ``fold_case``, in lower case; each pair once.

    ``patterns``: (pattern_id long, pattern). Null texts and empty patterns have no matches.
    """
    known = cut(patterns.select(F.col("pattern_id").cast("long").alias("pattern_id"), "pattern").filter("pattern <> ''").distinct())
    size = known.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    of = texts.select(key, F.col(text).cast("string").alias("_text")).filter("_text is not null")
    schema = StructType([texts.schema[key], StructField("pattern_id", LongType())])

    def block(number: int) -> DataFrame:
        here: dict[str, list[int]] = {}
        for r in known.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == number).collect():
            here.setdefault(r["pattern"], []).append(r["pattern_id"])
        return of.mapInArrow(_found(here, key, fold_case), schema)

    if blocks == 1:
        return block(0)
    return collected(map(block, range(blocks)), "occurring").distinct()


def _found(here: dict[str, list[int]], key: str, fold_case: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = list(here)
        machine = _automaton(words)
        for batch in batches:
            rows: list[int] = []
            ids: list[int] = []
            for row in range(batch.num_rows if machine else 0):
                body = batch.column(1)[row].as_py()
                found = {i for _, i in machine.iter(body)}
                if fold_case and (low := body.lower()) != body:
                    found |= {i for _, i in machine.iter(low)}
                own = {i for w in found for i in here[words[w]]}
                rows += [row] * len(own)
                ids += sorted(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64())], [key, "pattern_id"])

    return run


def _in_turn(entries: list[tuple[str, str]]) -> Callable[[str], str]:
    """Every entry's source replaced by its value, in the order given; a value may be a later entry's source."""
    machine = _automaton([source for source, _ in entries])

    def change(text: str) -> str:
        done = -1
        while True:
            # only what occurs now and is not yet past needs a replacement
            due = min((i for _, i in machine.iter(text) if i > done), default=None)
            if due is None:
                return text
            text = text.replace(*entries[due])
            done = due

    return change


def _replaced(entries: list[tuple[str, str]], at: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = _in_turn(entries)
        for batch in batches:
            made = pa.array([None if t is None else change(t) for t in (x.as_py() for x in batch.column(at))], pa.string())
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], names)

    return run


def replaced_in_turn(texts: DataFrame, entries: DataFrame, text: str) -> DataFrame:
    """``texts`` with all entries replaced in column ``text``: the longest source first, equal lengths in order of the source.

    ``entries``: (source, value), of a source that repeats the last value in order; any number. Blocks follow one another in that
    order, so the result is that of one replacement after the other.
    """
    known = entries.filter("source <> '' and value is not null").groupBy("source").agg(F.max("value").alias("value"))
    order = [F.length("source").desc(), F.col("source")]
    # sources by length, then prefix sums of their characters over lengths: blocks without a sort of all in one task
    sizes = known.groupBy(F.length("source").alias("length")).agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("length")).over(before), F.lit(0)))
    numbered = known.withColumn("length", F.length("source")).join(F.broadcast(starts), "length")
    within = F.row_number().over(Window.partitionBy("length").orderBy("source")) - 1
    dealt = cut(numbered.withColumn("block", F.floor((F.col("before") + within * F.col("length")) / BLOCK_CHARS)).select("source", "value", "block"))
    out = texts
    at = texts.columns.index(text)
    numbers = [r["block"] for r in dealt.select("block").distinct().orderBy("block").collect()]
    for number in numbers:
        here = [(r["source"], r["value"]) for r in dealt.filter(F.col("block") == number).orderBy(*order).collect()]
        out = out.withColumn(text, F.col(text).cast("string")).mapInArrow(_replaced(here, at, texts.columns), out.schema)
        if len(numbers) > 1:
            out = written(out, "replaced")
    return out


def replaced_by_row(text: Column, entries: Column, ignore_case: bool = True) -> Column:
    """A row's own (source, value) pairs replaced one after the other, the longest source first, ties as they come."""
    placed = F.sort_array(F.transform(F.filter(entries, lambda e: e["source"] != ""), lambda e, i: F.struct((-F.length(e["source"])).alias("n"), i.alias("i"), e["source"].alias("source"), e["value"].alias("value"))))
    quoted = lambda s: F.concat(F.lit("(?iu)\\Q" if ignore_case else "\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.aggregate(placed, text, lambda t, e: F.regexp_replace(t, quoted(e["source"]), plain(e["value"])))


def put(body: str, words: list[str], by: dict[str, str]) -> str:
    """A text with each of its tokens ``words``, in order, by its value where it has one."""
    out, done = [], 0
    for word in words:  # between two tokens nothing can be one, so the next place of its letters is its own
        at = body.index(word, done)
        out += (body[done:at], by.get(word, word))
        done = at + len(word)
    return "".join([*out, body[done:]])


@F.arrow_udf(StringType())
def _put(text: pa.Array, tokens: pa.Array, sources: pa.Array, values: pa.Array) -> pa.Array:
    """A text with each of its tokens, in order, by the value at its place in the row's sources where there is one; null where none are."""
    def whole(body: str | None, words: list | None, known: list | None, said: list | None) -> str | None:
        if body is None or known is None:
            return None
        return put(body, words, {s: v for s, v in zip(known, said) if v is not None})

    return pa.array([whole(*(c[i].as_py() for c in (text, tokens, sources, values))) for i in range(len(text))], pa.string())


def replaced_tokens(texts: DataFrame, table: DataFrame, key: str, text: str, token: str = WORD) -> DataFrame:
    """``texts`` with each token, a maximal run of ``token``, that ``table`` has put by its value, what is between as it is.

    ``key`` names one row of ``texts``; ``table``: (token, value), or (key, token, value) where a token's value is a text's own;
    of several values the last in order. A text is searched for tokens once; its distinct tokens, not its places, meet the table,
    and each place is looked up in the values of its text once, however many these are.
    """
    rows = table.select(*([key] if key in table.columns else []), "token", "value")
    if key not in table.columns:
        rows = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0)))).alias("token")).join(rows, "token")
    pairs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", "value"))).alias("_values"))
    joined = texts.join(pairs, key, "left")
    has = F.col("_values").isNotNull()
    tokens = F.when(has, F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0)))
    return joined.withColumn(text, F.coalesce(_put(F.when(has, F.col(text)), tokens, F.col("_values.token"), F.col("_values.value")), F.col(text))).drop("_values").select(texts.columns)


def pairs_counted(texts: DataFrame, text: str, letters: str) -> DataFrame:
    """(before, token, n): how often each word, a run of ``letters`` (a regex class of ASCII characters), follows each other one in
    a text; before the first one null. Words are numbered and their pairs counted where the texts are."""
    schema = StructType([StructField("before", StringType()), StructField("token", StringType()), StructField("n", LongType())])
    counts = texts.select(F.col(text).cast("string").alias("_text")).filter("_text is not null").mapInArrow(_paired(letters), schema)
    return counts.groupBy("before", "token").agg(F.sum("n").alias("n"))


def _paired(letters: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(texts: pa.Array) -> pa.RecordBatch:
        parts = pc.split_pattern_regex(texts, f"[^{letters}]+")
        words, row = parts.flatten(), pc.list_parent_indices(parts)
        full = pc.greater(pc.binary_length(words), 0)  # nothing stands before a text's first gap and after its last
        coded, row = words.filter(full).dictionary_encode(), row.filter(full).to_numpy()
        code, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        before = np.full(len(code), -1)
        before[1:] = np.where(row[1:] == row[:-1], code[:-1], -1)
        pair, n = np.unique((before + 1) * max(many, 1) + code, return_counts=True)
        first = pair // max(many, 1) - 1
        left = coded.dictionary.take(pa.array(np.maximum(first, 0), mask=first < 0))
        return pa.RecordBatch.from_arrays([left, coded.dictionary.take(pa.array(pair % max(many, 1))), pa.array(n.astype(np.int64))], ["before", "token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(ends):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIR_BYTES, "right")))
                yield counted(batch.column(0).slice(first, last - first))
                first = last

    return run
