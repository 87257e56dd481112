"""Places of regex matches in a text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<value:string,start:int,stop:int>"
#: Items folded together; n items cost about n * CHUNK steps, never n * n.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(items: Column) -> Column:
    """``items`` in order as arrays of at most CHUNK; none for an empty array."""
    count = F.floor((F.size(items) + CHUNK - 1) / CHUNK).cast("int")
    cuts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(cuts, lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def folded(items: Column, first: Column, over: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column], kind: str) -> Column:
    """``told`` (of type ``kind``) of the state before each item and the item; ``over`` gives the state after it.

    States are carried from chunk to chunk before results are made, so that no array grows by one item at a time.
    """
    outs = f"array<{kind}>"

    def inside(chunk: Column, state: Column) -> Column:
        zero = F.struct(state.alias("state"), F.array().cast(outs).alias("out"))
        step = lambda a, x: F.struct(over(a["state"], x).alias("state"), F.concat(a["out"], F.array(told(a["state"], x))).cast(outs).alias("out"))
        return F.aggregate(chunk, zero, step, lambda a: a["out"])

    def carried(parts: Column) -> Column:
        states = F.aggregate(parts, F.array(first), lambda a, c: F.concat(a, F.array(F.aggregate(c, F.element_at(a, -1), over))))
        return let(states, lambda s: F.flatten(F.transform(parts, lambda c, i: inside(c, F.get(s, i)))))

    return F.when(F.size(items) > 0, let(chunks(items), carried)).otherwise(F.array().cast(outs))


#: Characters of a block.
BLOCK = 512


def blocks(text: Column) -> Column:
    """A text in blocks of BLOCK code points, so that a part of it is found without a walk from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(of: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to ``stop`` (exclusive) of the text that ``blocks`` cut up."""
    low = F.floor(start / BLOCK).cast("int")
    count = F.floor((stop - 1) / BLOCK).cast("int") - low + 1
    joined = F.array_join(F.slice(of, low + 1, count), "")
    return F.when(stop > start, F.substring(joined, start - low * BLOCK + 1, stop - start)).otherwise("")


def matches(text: Column, pattern: Column | str) -> Column:
    """(value, start, stop) of each match, leftmost first, in code points; the pattern must not match the empty string.

    Spark has no function for places: they follow from the lengths of the matches and of what lies between them.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        F.transform(F.split(text, pattern, -1), F.length),
        lambda m, g: F.struct(m.alias("value"), F.length(m).alias("size"), g.alias("gap")),
    )  # the last gap has no match
    start = lambda at, p: at + p["gap"]
    span = lambda at, p: F.struct(p["value"].alias("value"), start(at, p).alias("start"), (start(at, p) + p["size"]).alias("stop"))
    return let(F.filter(parts, lambda p: p["value"].isNotNull()), lambda found: folded(found, F.lit(0), lambda at, p: start(at, p) + p["size"], span, SPAN))
