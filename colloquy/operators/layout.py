"""Word boxes on pages: lines, phrases and annotations; and runs of a script in a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colloquy.functions.text import strip

#: Pages that a task takes apart at a time.
PAGES = 256


def lines(words: DataFrame, group: list[str], order: str, slant: float = 0.35, back: float = 2.0) -> DataFrame:
    """Each word's line number from 0: a new line where x falls back, or where centres differ by more than a share of the
    average height (heights of 0 stay on the line)."""
    w = Window.partitionBy(*group).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    centre = F.col("y") + F.col("height") / 2
    height = (F.col("height") + before("height")) / 2
    moved = (height > 0) & (F.abs(centre - before(centre)) > slant * height)
    new = F.when(before("x").isNull(), 0).when((F.col("x") + back < before("x")) | moved, 1).otherwise(0)
    marked = words.withColumn("_new", new)
    return marked.withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def boxes(words: DataFrame, group: list[str], order: str) -> DataFrame:
    """The bounding box of each group's words and its first word."""
    out = words.groupBy(*group).agg(
        F.min_by("text", order).alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("_right"), F.max(F.col("y") + F.col("height")).alias("_bottom"),
    )
    return out.withColumn("width", F.col("_right") - F.col("x")).withColumn("height", F.col("_bottom") - F.col("y")).drop("_right", "_bottom")


def placed(words: DataFrame, group: list[str], order: str) -> DataFrame:
    """``words`` with their place ``pos`` on their page, from 0."""
    return words.withColumn("pos", F.row_number().over(Window.partitionBy(*group, "page").orderBy(order)) - 1)


def phrase_places(placed_words: DataFrame, terms: DataFrame, group: list[str]) -> DataFrame:
    """(group, page, pos, id, parts): all places where following words of a page begin with the parts of a term.

    ``placed_words``: (group, page, pos, text); ``terms``: (id, parts) and, if terms belong to a group, its columns; parts in
    lower case. A term is looked for by its longest part: each distinct word of a group meets, as one of its own beginnings, the
    part that equals it, so no key is shared by words that have nothing in common. Places found so are then compared part by
    part, each with the one word that must have it; the plan is the same for terms of any length.
    """
    own = [c for c in group if c in terms.columns]
    low = placed_words.select(*group, "page", "pos", F.lower("text").alias("word"))
    longest = F.array_max(F.transform("parts", lambda p, k: F.struct(F.length(p).alias("size"), (-k).alias("k"), p.alias("part"))))
    anchored = terms.filter(F.size("parts") > 0).withColumn("_a", longest).select(*own, "id", "parts", F.col("_a.part").alias("_part"), (-F.col("_a.k")).alias("_k"))
    most = anchored.agg(F.coalesce(F.max(F.length("_part")), F.lit(0))).first()[0]
    vocabulary = low.select(*own, "word").filter("word <> ''").distinct()
    beginnings = vocabulary.select(*own, "word", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(max(most, 1)))), lambda n: F.substring("word", F.lit(1), n))).alias("_part"))
    hits = beginnings.join(anchored, [*own, "_part"]).drop("_part")
    places = low.join(hits, [*own, "word"]).withColumn("pos", F.col("pos") - F.col("_k")).filter("pos >= 0").select(*group, "page", "pos", "id", "parts")
    single = places.filter(F.size("parts") == 1)
    wanted = places.filter(F.size("parts") > 1).select("*", F.posexplode("parts").alias("_k", "_part"))
    met = wanted.withColumn("_at", F.col("pos") + F.col("_k")).join(low.withColumnRenamed("pos", "_at"), [*group, "page", "_at"]).filter(F.startswith("word", F.col("_part")))
    several = met.groupBy(*group, "page", "pos", "id").agg(F.first("parts").alias("parts"), F.count("*").alias("_n")).filter(F.col("_n") == F.size("parts"))
    return single.unionByName(several.drop("_n"))


def _own_places(words: DataFrame, terms: DataFrame, group: list[str], own: list[str], order: str) -> DataFrame:
    """(group, id, page, words): the words of the first place in ``order`` of each term of a group, all columns of theirs.

    Words are moved once, to their group, where each page is one list that meets the group's terms; only matched words go on.
    """
    columns = [c for c in words.columns if c not in (*group, "page")]
    pages = words.groupBy(*group, "page").agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order)))).alias("_words"))
    each = terms.filter(F.size("parts") > 0).groupBy(*own).agg(F.collect_list(F.struct("id", "parts")).alias("_terms"))
    met = pages.join(each.hint("shuffle_hash"), own).select(*group, "page", "_words", F.transform("_words", lambda w: F.lower(w["text"])).alias("_low"), "_terms")
    schema = T.StructType([*(met.schema[c] for c in (*group, "page")), T.StructField("id", terms.schema["id"].dataType), T.StructField("words", met.schema["_words"].dataType)])
    found = met.mapInArrow(_first_places, schema)
    first = found.groupBy(*group, "id").agg(F.min_by(F.struct("page", "words"), F.get("words", F.lit(0))[order]).alias("_m"))
    return first.select(*group, "id", "_m.page", "_m.words")


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, page, _words, _low, _terms) to (group, page, id, words): where on its page a term's parts first begin following words."""
    for whole in batches:
        for at in range(0, whole.num_rows, PAGES):
            batch = whole.slice(at, PAGES)
            lists, low = batch.column("_words"), batch.column("_low").to_pylist()
            rows, ids, taken, ends = [], [], [], [0]
            for row, terms in enumerate(batch.column("_terms").to_pylist()):
                said, base = low[row], lists.offsets[row].as_py()
                for term in terms:
                    parts = term["parts"]
                    longest = max(range(len(parts)), key=lambda i: len(parts[i]))
                    part, last = parts[longest], len(said) - len(parts)
                    for place in (i - longest for i, w in enumerate(said) if w is not None and w.startswith(part)):
                        if 0 <= place <= last and all(w is not None and w.startswith(p) for w, p in zip(said[place : place + len(parts)], parts)):
                            rows.append(row)
                            ids.append(term["id"])
                            taken += range(base + place, base + place + len(parts))
                            ends.append(len(taken))
                            break
            kept = batch.select([c for c in batch.schema.names if not c.startswith("_")]).take(pa.array(rows, pa.int64()))
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.values.take(pa.array(taken, pa.int64())))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids, batch.column("_terms").type.value_type.field("id").type), words], [*kept.schema.names, "id", "words"])


def phrase_matches(words: DataFrame, terms: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, term, start, n): for each group and term the first place in ``order`` where following words of a page begin with
    the term's parts. ``terms``: (term, parts) and, if terms belong to a group, its columns."""
    own, terms = [c for c in group if c in terms.columns], terms.withColumnRenamed("term", "id")
    if own:
        first = _own_places(words.select(*group, "page", order, "text"), terms, group, own, order)
        return first.select(*group, F.col("id").alias("term"), F.get("words", F.lit(0))[order].alias("start"), F.size("words").alias("n"))
    numbered = placed(words, group, order)
    at = numbered.select(*group, "page", "pos", F.col(order).alias("start"))
    places = phrase_places(numbered, terms, group).join(at, [*group, "page", "pos"])
    return places.groupBy(*group, "id").agg(F.min("start").alias("start"), F.first(F.size("parts")).alias("n")).withColumnRenamed("id", "term")


def distinct_terms(terms: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, id, term, definition, parts): terms of two characters or more, each once for its lower-case form (``id``), as the
    first in ``order`` spells and defines it. Terms without the columns of ``group`` hold for all groups."""
    own = [c for c in group if c in terms.columns]
    trimmed = terms.withColumns({"term": strip(F.coalesce("term", F.lit(""))), "definition": strip(F.coalesce("definition", F.lit("")))}).filter(F.length("term") >= 2)
    first = trimmed.groupBy(*own, F.lower("term").alias("id")).agg(F.min_by(F.struct("term", "definition"), F.struct(order, "term", "definition")).alias("_t"))
    return first.select(*own, "id", "_t.term", "_t.definition", F.filter(F.split("id", r"(?U)\s+"), lambda p: p != "").alias("parts"))


def annotations(words: DataFrame, terms: DataFrame, group: list[str], order: str, term_order: str) -> DataFrame:
    """(group, term, definition, page, line, text, x, y, width, height): one box for each line of the first match of each distinct
    term, as it was first spelled and defined. ``terms``: (term, definition, ``term_order``) and, if they belong to a group, its columns."""
    kept = distinct_terms(terms, group, term_order)
    own = [c for c in group if c in kept.columns]
    if own:
        matched = _own_places(words, kept.select(*own, "id", "parts"), group, own, order).select(*group, "id", "page", F.inline("words"))
    else:
        numbered = placed(words, group, order)
        at = numbered.select(*group, "page", "pos", F.col(order).alias("_start"))
        places = phrase_places(numbered, kept.select("id", "parts"), group).join(at, [*group, "page", "pos"])
        first = places.groupBy(*group, "id").agg(F.min_by(F.struct("page", "pos", F.size("parts").alias("n")), "_start").alias("_m"))
        spread = first.select(*group, "id", "_m.page", F.explode(F.sequence(F.col("_m.pos"), F.col("_m.pos") + F.col("_m.n") - 1)).alias("pos"))
        matched = numbered.join(spread, [*group, "page", "pos"])
    boxed = boxes(lines(matched, [*group, "id"], order), [*group, "id", "page", "line"], order)
    return boxed.join(kept.select(*own, "id", "term", "definition"), [*own, "id"]).drop("id")


def script_runs(texts: DataFrame, key: str, text: str, kind: Column, default: str) -> DataFrame:
    """(key, run, kind, text): characters in runs of one kind; those of no kind join the run before, or the default.

    ``kind`` is an expression over a column ``char``.
    """
    chars = texts.select(key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("at", "char")).withColumn("_kind", kind)
    w = Window.partitionBy(key).orderBy("at")
    settled = chars.withColumn("kind", F.coalesce(F.last("_kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)))
    changed = settled.withColumn("_new", F.when(F.lag("kind").over(w) != F.col("kind"), 1).otherwise(0))
    run = changed.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    out = run.groupBy(key, "run").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("at", "char"))).alias("_c"))
    return out.select(key, "run", "kind", F.array_join(F.transform("_c", lambda c: c["char"]), "").alias("text"))
