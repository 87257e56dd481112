"""Phrases and boxes against plain loops over the words."""

import random

import pytest

from colloquy.operators import layout

WORD = "doc int, at int, page int, text string, x double, y double, width double, height double"


def rows_of(doc, texts, page=1, first=0):
    return [(doc, first + i, page, w, 10.0 * i, 0.0, 9.0, 10.0) for i, w in enumerate(texts)]


def first_places(words, terms):
    """By document and term the first word from which the next ones of its page begin with the parts."""
    out = set()
    for doc, term, parts in terms:
        own = sorted((w for w in words if w[0] == doc), key=lambda w: w[1])
        for i, w in enumerate(own):
            run = own[i : i + len(parts)]
            if parts and len(run) == len(parts) and all(r[2] == w[2] and r[3].lower().startswith(p) for r, p in zip(run, parts)):
                out.add((doc, term, w[1], len(parts)))
                break
    return out


def test_phrases_of_1_to_50_parts_equal_a_plain_search(spark):
    rng = random.Random(3)
    texts = {d: [rng.choice(["a", "ab", "Abc", "b", "ba", "É", "éa", "x" * 40]) for _ in range(300)] for d in range(6)}
    words = [(d, i, i // 70, w, 0.0, 0.0, 1.0, 1.0) for d, ws in texts.items() for i, w in enumerate(ws)]
    terms = []
    for d, ws in texts.items():
        for n in (1, 2, 3, 5, 20, 50, 71):
            at = rng.randrange(len(ws) - n)
            parts = [w.lower()[: rng.randrange(1, 4)] for w in ws[at : at + n]]
            terms.append((d, f"{n}", parts))
    terms += [(0, "none", []), (1, "absent", ["zz"]), (2, "too long", ["a"] * 400)]
    df = spark.createDataFrame(words, WORD).repartition(3)
    got = layout.phrase_matches(df, spark.createDataFrame(terms, "doc int, term string, parts array<string>"), ["doc"], "at").collect()
    assert {(r.doc, r.term, r.start, r.n) for r in got} == first_places(words, terms) and len(got) == len(first_places(words, terms))
    # terms without a document hold for all
    shared = layout.phrase_matches(df, spark.createDataFrame([("t", ["a", "b"])], "term string, parts array<string>"), ["doc"], "at").collect()
    assert {(r.doc, r.term, r.start, r.n) for r in shared} == first_places(words, [(d, "t", ["a", "b"]) for d in texts])


@pytest.mark.parametrize("own", [True, False])
def test_annotations_keep_the_first_spelling_and_definition(spark, own):
    words = rows_of(1, ["The", "Big", "Dataset", "and", "big", "data"]) + rows_of(1, ["big"], 1, 6) + rows_of(1, ["data"], 2, 7) + rows_of(2, ["big", "cat"])
    terms = [(1, " Big  data ", " first ", 2), (1, "BIG  DATA", "second", 3), (1, "b", "short", 0), (1, "  ", "blank", 1), (1, None, "null", 1), (1, "big cat", None, 4)]
    given = spark.createDataFrame(terms, "doc int, term string, definition string, n int")
    got = layout.annotations(spark.createDataFrame(words, WORD), given if own else given.drop("doc"), ["doc"], "at", "n").collect()
    expected = {(1, "Big  data", "first", "Big", 10.0, 19.0)} | (set() if own else {(2, "big cat", "", "big", 0.0, 19.0)})
    assert {(r.doc, r.term, r.definition, r.text, r.x, r.width) for r in got} == expected


def test_wrapped_and_slanted_phrases_give_a_box_for_each_line(spark):
    words = [
        (1, 0, 1, "big", 80.0, 0.0, 9.0, 10.0), (1, 1, 1, "data", 0.0, 12.0, 9.0, 10.0),  # wrapped
        (2, 0, 1, "big", 0.0, 0.0, 9.0, 10.0), (2, 1, 1, "data", 10.0, 3.5, 9.0, 10.0),  # just on the line
        (3, 0, 1, "big", 0.0, 0.0, 9.0, 10.0), (3, 1, 1, "data", 10.0, 3.6, 9.0, 10.0),  # off it
        (4, 0, 1, "big", 0.0, 0.0, 9.0, 0.0), (4, 1, 1, "data", 10.0, 90.0, 9.0, 0.0),  # no height
        (5, 0, 1, "big", 0.0, 0.0, 9.0, 10.0), (5, 1, 2, "data", 10.0, 0.0, 9.0, 10.0),  # over two pages
    ]
    terms = spark.createDataFrame([("Big data", "d", 1)], "term string, definition string, n int")
    got = layout.annotations(spark.createDataFrame(words, WORD), terms, ["doc"], "at", "n").groupBy("doc").count().collect()
    assert {(r["doc"], r["count"]) for r in got} == {(1, 2), (2, 1), (3, 2), (4, 1)}


def test_no_words_no_terms(spark):
    words = spark.createDataFrame(rows_of(1, ["big"]), WORD)
    terms = spark.createDataFrame([("Big", "d", 1)], "term string, definition string, n int")
    assert layout.annotations(words.limit(0), terms, ["doc"], "at", "n").count() == 0
    assert layout.annotations(words, terms.limit(0), ["doc"], "at", "n").count() == 0


def test_words_of_groups_with_own_terms_are_moved_once(spark):
    words = spark.createDataFrame(rows_of(1, ["The", "Big", "Dataset"]) + rows_of(2, ["a", None, "big"]), WORD)
    terms = spark.createDataFrame([(1, "big data", ["big", "data"]), (2, "big", ["big"]), (2, "a big", ["a", "big"])], "doc int, term string, parts array<string>")
    found = layout.phrase_matches(words, terms, ["doc"], "at")
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert {tuple(r) for r in found.collect()} == {(1, "big data", 1, 2), (2, "big", 2, 1)}
    assert plan.count("Exchange hashpartitioning") <= 4  # words, terms, places
