"""Text made ready for speech, and what is to be done with its Latin tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from colloquy.functions.text import (
    AMBIGUOUS, BEFORE, LETTERS, NUMERALS, OTHER_SCRIPT, is_ambiguous, is_roman, name_candidates, nonblank, outside_urls, quoted, replaced, speakable_text, spelled, strip, token_kind, up_to_last, without_urls,
)
from colloquy.operators.patterns import WORD, put, replaced_by_row, replaced_in_turn, replaced_tokens

TOKEN = "[A-Za-z][A-Za-z0-9]*"
#: Words after which an ambiguous numeral is one.
UNITS = (
    "english", "physics", "mathematics", "math", "programming", "electronics", "semester", "lab", "chemistry", "language",
    "year", "chapter", "volume", "part", "type", "level", "generation", "machine", "learning",
)
KINDS = ("word", "spell", "roman")
MOST = 4000
#: Characters of the texts whose tokens' kinds are looked up together.
PART_CHARS = 1 << 25
#: Texts of a part that are read at a time.
TEXTS = 500
#: Stands around each word of a text that has none of it.
MARK = "\x01"


def prepared(text: Column, names: Sequence[tuple[str, str]] = (), titles: Sequence[tuple[str, str]] = (), people: dict[str, str] | None = None, lexicon: dict[str, str] | None = None, most: int = MOST) -> Column:
    """The chain from an answer to what is spoken: no addresses, no Latin asides, names and titles as they sound, phrases
    parted by pauses, the lexicon's keys (parts of words too) last, and at most so many characters."""
    spoken = speakable_text(replaced(before_names(text, names, titles), people or {}))
    return strip(F.substring(replaced(spoken, lexicon or {}), 1, most))


def before_names(text: Column, names: Sequence[tuple[str, str]] = (), titles: Sequence[tuple[str, str]] = ()) -> Column:
    """No addresses, no Latin asides, fixed names and titles as they sound."""
    once = lambda t: F.regexp_replace(t, r"[ \t]{2,}", " ")
    aside = lambda t: F.regexp_replace(t, rf"[(（](?![^()（）{OTHER_SCRIPT}]*+[{OTHER_SCRIPT}])[^()（）]*+[)）]", "")
    spoken = once(up_to_last(without_urls(text), ")）", aside))
    for name, sound in names:
        spoken = F.regexp_replace(spoken, "(?i)" + quoted(name), sound)
    for title, sound in titles:
        spoken = F.regexp_replace(spoken, rf"(?i){BEFORE}{quoted(title)}\.?(?=\s|\z)", sound)
    return strip(once(spoken))


def is_speakable(text: Column, warning: str, prompt: str) -> Column:
    """Whether an answer is worth speaking: not blank, no warning, not the fixed prompt."""
    body = strip(F.coalesce(text, F.lit("")))
    return (body != "") & ~F.startswith(body, F.lit(warning)) & (body != prompt)


def name_of_stem(stem: Column) -> Column:
    """A person's name from a file's: words parted by underscores, each with a capital."""
    return F.initcap(F.array_join(F.filter(F.split(stem, "_"), lambda w: w != ""), " "))


def bare_name(source: Column, titles: Sequence[str]) -> Column:
    """A name without a title before it."""
    words = F.split(strip(source), r"(?U)\s+")
    titled = F.regexp_replace(words[0], r"\.+\z", "").isin(*titles)
    return F.when(titled, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(strip(source))


def is_known_person(source: Column, known: Sequence[str], titles: Sequence[str]) -> Column:
    """Whether a name, with or without its title, is a known one; no address and no acronym of two to eight capitals is."""
    body, bare = strip(source), bare_name(source, titles)
    names = [n.casefold() for n in known]
    acronym = F.regexp_replace(body, "[. -]", "").rlike(r"^\p{Lu}{2,8}\z")
    return ~F.contains(body, F.lit("@")) & ~acronym & (bare != "") & (F.lower(body).isin(*names) | F.lower(bare).isin(*names))


def is_keepable_key(source: Column, known: Sequence[str], titles: Sequence[str], honorifics: Sequence[str]) -> Column:
    return strip(source).isin(*honorifics) | is_known_person(source, known, titles)


def latin_tokens(texts: DataFrame, key: str, text: str = "text", units: Sequence[str] = UNITS) -> DataFrame:
    """(key, token, numeral): a text's Latin tokens, each once, and whether one of its places makes it a numeral: an ambiguous
    one after a unit word."""
    schema = StructType([texts.schema[key], StructField("token", StringType()), StructField("numeral", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(units)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                found = [find(body) for body in batch.column(1).slice(at, TEXTS).to_pylist()]
                rows = pa.array([at + row for row, own in enumerate(found) for _ in own], pa.int64())
                tokens, numerals = [t for own in found for t in own], [n for own in found for n in own.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(tokens, pa.string()), pa.array(numerals, pa.bool_())], [key, "token", "numeral"])

    return texts.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def token_set(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token): the Latin tokens of all texts, each once."""
    schema = StructType([StructField("_part", LongType()), StructField("token", StringType())])
    return texts.select(F.lit(0).cast("long"), F.col(text).cast("string")).mapInArrow(_tokens_of_parts, schema).select("token").distinct()


def _finder(units: Sequence[str]) -> Callable[[str | None], dict[str, bool]]:
    """A text's Latin tokens, each once, with whether it is a numeral at one of its places."""
    read, before = re.compile(TOKEN).findall, frozenset(units)
    ambiguous = frozenset(AMBIGUOUS) | {a.lower() for a in AMBIGUOUS}

    def find(body: str | None) -> dict[str, bool]:
        words = read(body or "")
        found = dict.fromkeys(words, False)
        if not ambiguous.isdisjoint(found):
            found |= {word: True for last, word in zip(words, words[1:]) if word in ambiguous and last.lower() in before}
        return found

    return find


def resolved_kinds(tokens: DataFrame, cache: DataFrame, lexicon: DataFrame, model: DataFrame, key: str, fallback: Column | None = None, numerals: Sequence[str] = tuple(NUMERALS)) -> DataFrame:
    """(key, token, kind, stored): what each token is, and the kind that the cache should learn.

    Numerals by their place or shape come first; then what the cache knows, but not of ambiguous ones; then the model's word
    (``model``: key, token, kind), or the fallback where the model said anything for the text. Tokens of the lexicon keep what
    the cache knows.
    """
    kept = cache.filter(F.col("kind").isin(*KINDS) & ~is_ambiguous(F.col("token")))
    known = kept.select("token", F.col("kind").alias("_cached"))
    listed = lexicon.select("token").distinct().withColumn("_listed", F.lit(True))
    said = model.filter(F.col("kind").isin(*KINDS)).groupBy(key, "token").agg(F.max("kind").alias("_said"))
    spoke = said.join(tokens.select(key, "token"), [key, "token"], "left_semi").select(key).distinct().withColumn("_spoke", F.lit(True))
    rows = tokens.join(known, "token", "left").join(listed, "token", "left").join(said, [key, "token"], "left").join(spoke, key, "left")
    roman, unsure = is_roman(F.col("token"), numerals), is_ambiguous(F.col("token"))
    pending = F.col("_listed").isNull() & ~roman & ~F.col("numeral") & (F.col("_cached").isNull() | unsure)
    new = F.when(pending, F.coalesce("_said", F.when(F.col("_spoke"), token_kind(F.col("token"), numerals) if fallback is None else fallback)))
    kind = F.when(F.col("numeral") | roman, "roman").otherwise(F.coalesce(new, "_cached"))
    return rows.select(key, "token", kind.alias("kind"), F.when(roman, "roman").when(~unsure, new).alias("stored"))


def _in_parts(texts: DataFrame, cache: DataFrame, lexicon: DataFrame, model: DataFrame, key: str, text: str, units: Sequence[str], fallback: Column | None, numerals: Sequence[str], more: dict[str, Column], give: Callable, schema: StructType) -> DataFrame:
    """What ``give`` makes of parts of ``texts`` (key and text, or all columns with ``more``) and of the kinds of each one's Latin tokens, as ``resolved_kinds`` has them.

    Texts are dealt by their key over parts of about ``PART_CHARS`` characters. A token meets the cache and the lexicon once for
    each part, not for each text, and a part's texts and tokens come together in a task: a text is moved once, its tokens never.
    """
    chars = texts.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64(key), F.lit(max(1, -(-chars // PART_CHARS)))).alias("_part")
    token = F.col("token")
    known = cache.filter(F.col("kind").isin(*KINDS) & ~is_ambiguous(token)).select("token", F.col("kind").alias("_cached"))
    listed = lexicon.select("token").distinct().withColumn("_listed", F.lit(True))
    asked = texts.select(part, F.col(text).cast("string").alias("_text")).mapInArrow(_tokens_of_parts, StructType([StructField("_part", LongType()), StructField("token", StringType())]))
    rows = asked.repartition("token").distinct().join(known, "token", "left").join(listed, "token", "left")
    roman = is_roman(token, numerals)
    pending = F.col("_listed").isNull() & ~roman & (F.col("_cached").isNull() | is_ambiguous(token))
    plain = F.when(roman, "roman").otherwise(F.col("_cached"))
    new = token_kind(token, numerals) if fallback is None else fallback
    # a token that no row is given for is open and a word
    known_rows = rows.select("_part", F.lit(None).cast(texts.schema[key].dataType).alias(key), "token", pending.alias("pending"), roman.alias("sure"), plain.alias("plain"), F.when(pending, new).alias("new"))
    notes = known_rows.filter(~F.col("pending") | ~F.col("new").eqNullSafe(F.lit("word")))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("pending", "boolean"), ("sure", "boolean"), ("plain", "string"))]
    said = model.filter(F.col("kind").isin(*KINDS) & F.col(key).isNotNull()).select(part, F.col(key).cast(texts.schema[key].dataType).alias(key), "token", *none, F.col("kind").alias("new"))
    held = texts.withColumns(more).select(part, "*") if more else texts.select(part, key, text)
    make = lambda left, right: give(left.drop_columns(["_part"]), _kinds(left, right, key, text, units))
    return held.groupBy("_part").cogroup(notes.unionByName(said).groupBy("_part")).applyInArrow(make, schema)


def _tokens_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) to the Latin tokens of each part, once for a batch."""
    read = re.compile(TOKEN).findall
    for batch in batches:
        found: dict[int, set[str]] = {}
        for at in range(0, batch.num_rows, TEXTS):
            for part, body in zip(*(c.slice(at, TEXTS).to_pylist() for c in batch.columns)):
                found.setdefault(part, set()).update(read(body or ""))
        for part, tokens in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(tokens), pa.int64()), pa.array(list(tokens), pa.string())], ["_part", "token"])


def _rows(held: pa.Table, columns: Sequence[str]) -> Iterator[tuple]:
    for at in range(0, held.num_rows, TEXTS):
        yield from zip(*(held.column(c).slice(at, TEXTS).to_pylist() for c in columns))


def _kinds(held: pa.Table, notes: pa.Table, key: str, text: str, units: Sequence[str]) -> Iterator[dict[str, tuple[str | None, str | None]]]:
    """For each text the (kind, stored) of its Latin tokens."""
    find, ambiguous = _finder(units), frozenset(AMBIGUOUS)
    known: dict[str, tuple[bool, bool, str | None, str | None]] = {}
    said: dict[object, dict[str, str]] = {}
    for of, token, *note in zip(*(notes.column(c).to_pylist() for c in (key, "token", "pending", "sure", "plain", "new"))):
        if of is None:
            known[token] = tuple(note)
        else:
            own = said.setdefault(of, {})
            own[token] = max(own.get(token, ""), note[-1])
    for of, body in _rows(held, (key, text)):
        found, own = find(body), said.get(of, {})
        spoke = any(token in found for token in own)
        kinds = {}
        for token, numeral in found.items():
            pending, sure, plain, last = known.get(token, (True, False, None, "word"))
            new = own.get(token, last if spoke else None) if pending and not numeral else None
            kinds[token] = "roman" if numeral or sure else plain if new is None else new, "roman" if sure else None if token.upper() in ambiguous else new
        yield kinds


def kinds_of_texts(texts: DataFrame, cache: DataFrame, lexicon: DataFrame, model: DataFrame, key: str, text: str = "text", units: Sequence[str] = UNITS, fallback: Column | None = None, numerals: Sequence[str] = tuple(NUMERALS)) -> DataFrame:
    """``resolved_kinds`` of the texts' own ``latin_tokens``, without a row of a text's token being moved. ``fallback`` is of the token alone."""
    schema = StructType([texts.schema[key], *(StructField(c, StringType()) for c in ("token", "kind", "stored"))])

    def give(held: pa.Table, kinds: Iterator[dict[str, tuple[str | None, str | None]]]) -> pa.Table:
        rows, made = [], ([], [], [])
        for row, own in enumerate(kinds):
            rows += [row] * len(own)
            made[0].extend(own)
            for column, values in zip(made[1:], zip(*own.values())):
                column.extend(values)
        return pa.table([held.column(key).take(pa.array(rows, pa.int64())), *(pa.array(m, pa.string()) for m in made)], names=schema.names)

    return _in_parts(texts, cache, lexicon, model, key, text, units, fallback, numerals, {}, give, schema)


def texts_spoken(
    texts: DataFrame, cache: DataFrame, lexicon: DataFrame, model: DataFrame, key: str, text: str = "text", units: Sequence[str] = UNITS, fallback: Column | None = None, numerals: dict[str, str] = NUMERALS, letters: dict[str, str] = LETTERS,
) -> DataFrame:
    """``tokens_spoken`` with the kinds of the texts' own tokens. A text of a null key stays as it is."""
    body = F.col(text).cast("string")
    clear = ~F.contains(body, F.lit(MARK))
    more = {text: F.when(clear, F.regexp_replace(body, WORD, f"{MARK}$0{MARK}")).otherwise(body), "_tokens": F.when(~clear, F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))}
    schema = texts.withColumn(text, body).schema

    def give(held: pa.Table, kinds: Iterator[dict[str, tuple[str | None, str | None]]]) -> pa.Table:
        spelt: dict[str, str] = {}

        def value(token: str, kind: str | None) -> str | None:
            if kind == "spell" and token not in spelt:
                spelt[token] = " ".join(letters.get(c.upper(), c) for c in token)
            return numerals.get(token.upper()) if kind == "roman" else spelt[token] if kind == "spell" else None

        out, done = [], []
        for (of, said, words), own in zip(_rows(held, (key, text, "_tokens")), kinds):
            by = {} if of is None else {token: v for token, (kind, _) in own.items() if (v := value(token, kind)) is not None}
            if said is not None and words is None:
                pieces = said.split(MARK)
                pieces[1::2] = [by.get(word, word) for word in pieces[1::2]]
                said = "".join(pieces)
            elif said is not None:
                said = put(said, words, by)
            out.append(said)
            if len(out) == TEXTS:
                done.append(pa.array(out, pa.string()))
                out = []
        texts_ = pa.chunked_array([*done, pa.array(out, pa.string())])
        return held.set_column(held.column_names.index(text), text, texts_).select(schema.names)

    return _in_parts(texts.withColumn(text, body), cache, lexicon, model, key, text, units, fallback, tuple(numerals), more, give, schema)


def accepted_entries(entries: DataFrame, lexicon: DataFrame, known: Sequence[str], titles: Sequence[str], honorifics: Sequence[str]) -> DataFrame:
    """Of what a model says (source, spoken, kind), trimmed, as (source, value): honorifics that are ones, names of known people, nothing
    blank, and nothing that the lexicon has."""
    rows = entries.select(*(strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("source", "spoken", "kind"))).filter("source <> '' and spoken <> ''")
    right = ((F.col("kind") == "honorific") & F.col("source").isin(*honorifics)) | ((F.col("kind") == "person_name") & is_known_person(F.col("source"), known, titles))
    return rows.filter(right).join(lexicon.select("source").distinct(), "source", "left_anti").select("source", F.col("spoken").alias("value"))


def merged_kinds(cache: DataFrame, entries: DataFrame, order: str, numerals: Sequence[str] = tuple(NUMERALS)) -> DataFrame:
    """(token, kind) of a cache after ``entries`` (token, kind, ``order``): the last of a token wins, of those and the cache's what is
    blank, of no kind or ambiguous goes, and a sure numeral is one."""
    rows = cache.select("token", "kind", F.lit(None).alias(order)).unionByName(entries.select("token", "kind", order))
    rows = rows.withColumns({"token": strip(F.col("token")), "kind": strip(F.col("kind"))}).filter((F.col("token") != "") & F.col("kind").isin(*KINDS) & ~is_ambiguous(F.col("token")))
    last = rows.groupBy("token").agg(F.max_by("kind", F.struct(F.col(order).isNotNull(), order, "kind")).alias("kind"))
    return last.withColumn("kind", F.when(is_roman(F.col("token"), numerals), "roman").otherwise(F.col("kind")))


def merged_lexicon(lexicon: DataFrame, entries: DataFrame, order: str, keepable: Callable[[Column], Column]) -> DataFrame:
    """(source, value) of a lexicon after ``entries`` (source, value, ``order``): the last of a source wins; blank and other keys, the
    lexicon's too, go."""
    rows = lexicon.select("source", "value", F.lit(None).alias(order)).unionByName(entries.select("source", "value", order))
    kept = rows.filter(nonblank(F.col("source")) & nonblank(F.col("value")) & keepable(F.col("source")))
    return kept.groupBy("source").agg(F.max_by("value", F.struct(F.col(order).isNotNull(), order, "value")).alias("value"))


def tokens_spoken(texts: DataFrame, kinds: DataFrame, key: str, text: str = "text", numerals: dict[str, str] = NUMERALS, letters: dict[str, str] = LETTERS) -> DataFrame:
    """``texts`` with numerals as they sound and letters spelled out, by the kind (key, token, kind) of each whole token."""
    sounds = F.create_map(*(F.lit(x) for pair in numerals.items() for x in pair))
    token = F.col("token")
    value = F.when(F.col("kind") == "roman", F.try_element_at(sounds, F.upper(token))).when(F.col("kind") == "spell", spelled(token, letters))
    on = [c for c in (key, "token") if c in kinds.columns]
    return replaced_tokens(texts, kinds.select(*on, value.alias("value")).filter("value is not null"), key, text)


def text_key(text: Column) -> Column:
    """What is found for a text is stored under this."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def names_spoken(texts: DataFrame, names: DataFrame, key: str, text: str = "text", blocked: Sequence[str] = ()) -> DataFrame:
    """``texts`` with the names that were found for them, outside addresses and in any case of letters, as they sound.

    ``names``: (text_key, at, source, value) in order ``at``; blank ones and those of a blocked word go, the longest comes first.
    A text without a name's form is not looked up.
    """
    words = F.split(F.lower(F.regexp_replace(F.col("source"), r"(?iU)^Dr\.?\s+", "")), r"(?U)\s+")
    dotless = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+\z", ""))
    clear = ~F.arrays_overlap(dotless, F.array(*map(F.lit, blocked))) if blocked else F.lit(True)
    trimmed = names.withColumns({"source": strip(F.col("source")), "value": strip(F.col("value"))}).filter((F.col("source") != "") & (F.col("value") != "")).filter(clear)
    listed = trimmed.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("at", "source", "value"))).alias("_names"))
    asked = texts.filter(F.size(name_candidates(F.col(text), blocked)) > 0).select(key, text_key(F.col(text)).alias("text_key"))
    found = asked.join(listed, "text_key").select(key, "_names")
    spoken = outside_urls(F.col(text), lambda part: replaced_by_row(part, F.col("_names")))
    return texts.join(found, key, "left").withColumn(text, F.when(F.col("_names").isNull(), F.col(text)).otherwise(spoken)).drop("_names")


def answers_prepared(
    texts: DataFrame, key: str, text: str = "text", names: Sequence[tuple[str, str]] = (), titles: Sequence[tuple[str, str]] = (), blocked: Sequence[str] = (), found: DataFrame | None = None,
    lexicon: DataFrame | None = None, kinds: Callable[[DataFrame], DataFrame] | None = None, most: int = MOST,
) -> DataFrame:
    """The whole chain over a table: fixed names and titles, names found for the text (``found``), phrases, the lexicon (source, value)
    one key after the other, Latin tokens by what ``kinds`` says of the texts so far, and the cut. ``key`` names one row."""
    rows = texts.withColumn(text, before_names(F.col(text), names, titles))
    rows = rows if found is None else names_spoken(rows, found, key, text, blocked)
    rows = rows.withColumn(text, speakable_text(F.col(text)))
    rows = rows if lexicon is None else replaced_in_turn(rows, lexicon, text)
    rows = rows if kinds is None else tokens_spoken(rows, kinds(rows), key, text)
    return rows.withColumn(text, strip(F.substring(text, 1, most)))


def overlaid(base: Column, later: Column) -> Column:
    """Two maps as one; of a key in both the later value."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(later, k)), later)
