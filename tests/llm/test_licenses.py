import time

import random
import re
from dataclasses import replace
from re import _parser

from colloquy.llm import licenses

PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
ROWS = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "x under\nthe--MIT license y UNDER the mit LICENSE z"),
    (5, "under the mit licenses"), (6, "Licensed under the Apache License, Version 2.0."), (7, "CC...BY\nNC cc by nc"), (8, "é under the mit licensé"),
    (9, "// SPDX-License-Identifier: GPL-3.0-or-later\n"), (10, "This work is licensed under the GNU General Public License, version 3."),
    (11, "nothing here 12"), (12, "All rights reserved."), (13, "K under the mit license \U0001f600 a"), (14, "license: MIT. See https://opensource.org/licenses/bsd-3-clause"),
    (3, "Released under the MIT License."), (15, "Licensed under CC BY-NC 4.0."), (16, "a " * 3000 + "under the mit license " * 300),
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "0 as n_words", "'q' as labels")
    got = sorted(licenses.scanned(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert [tuple(r) for r in got] == sorted((d, *brute(t)) for d, t in ROWS)


def test_method_labels(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert got[9].labels == "gpl-3" and got[9].score == 1.0
    assert got[10].labels == "gpl-3"
    assert got[14].labels == "bsd-3-clause,mit"
    assert got[15].labels == "cc-by-nc" and got[15].n_base == 1
    assert got[12].labels == "proprietary"
    assert got[6].labels == "apache-2"
    assert got[11].labels == "" and got[11].score == 0.0 and got[1].labels == ""
    assert got[16].labels == "mit"
    for r in got.values():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_suppression(spark):
    rule = licenses.Rule
    known = [rule("long", "a", "a b c d", 2, 0.9), rule("inside", "b", "b c", 2, 0.9), rule("stronger", "c", "c d", 3, 0.9), rule("weaker", "a", "a b c d e", 1, 0.9)]
    docs = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    assert licenses.scanned(docs, known).first().detections is None
    text = "license a b c d e"
    got = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"), known).first().detections
    # the match of priority 1 is kept: nothing of its priority or above reaches as far
    assert [(text[d.start : d.stop], d.label) for d in got] == [("a b c d e", "weaker"), ("a b c d", "long"), ("c d", "stronger")]


def test_hundreds_of_distinct_rules():
    known = licenses.rules()
    assert len(known) > 500 and len({r.pattern for r in licenses._written()}) > 180
    assert [r.priority for r in known] == sorted((r.priority for r in known), reverse=True)


def test_long_identifier_lists_and_runs_do_not_recurse(spark):
    many = "SPDX-License-Identifier: " + "foo or " * 20_000
    texts = [many + "MIT", many, "SPDX-License-Identifier: (Apache-2.0 OR (MIT AND BSD-3-Clause)) WITH x", "license " + "under the " * 50_000, "http://" + "licenses/" * 50_000, "license permission " * 20_000, "copyright " + "gnu " * 50_000]
    got = [r.labels for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:3] == ["mit", "", "apache-2,bsd-3-clause,mit"] and got[3:] == [""] * 4


def test_hand_written_signatures(spark):
    want = {
        "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software": "mit",
        "licensed under either of Apache License, Version 2.0 or MIT license at your option": "apache-2,mit",
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl-2-or-later",
        "dual-licensed under MIT and Apache-2.0": "apache-2,mit",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "License :: OSI Approved :: MIT License": "mit",
        "The Software shall be used for Good, not Evil.": "json",
        "THE BEER: As long as you retain this notice you\n# can do whatever you want with this stuff": "beerware",
    }
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == list(want.values())


def test_empty_table(spark):
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sample(tree, rng, gap):
    """A text that a parsed pattern matches, its branches and repeats at random."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name in ("ANY", "NOT_LITERAL"):
            out += "x"
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng, gap)
        elif name == "SUBPATTERN":
            out += sample(arg[-1], rng, gap)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            is_gap = str(inner[0][0]) == "IN" and (_parser.LITERAL, ord("#")) in inner[0][1]
            times = 1 if is_gap else rng.randint(least, min(most, least + 1))
            out += gap if is_gap else "".join(sample(inner, rng, gap) for _ in range(times))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else "x"
        else:
            assert name in ("ASSERT_NOT", "ASSERT"), name
    return out


def test_gate_and_keywords_are_necessary_for_every_rule():
    rng, gates = random.Random(2), licenses.gates(licenses.rules())
    for rule in licenses.rules():
        held, pattern = 0, rule.pattern.replace(f"[-{licenses.GAP}]", r"[-\s*#/>+]")  # a class in a class, which Python reads otherwise
        for _ in range(60):
            text = sample(_parser.parse(pattern), rng, rng.choice((" ", "\n", "\n * ", "\n# ", "\n// ")))
            if re.search(pattern, text):
                held += 1
                assert any(all(w in text for w in g) for g in gates) or re.search(licenses.CC_BY, text) or "under" in text and any(v in text for v in licenses.VERBS), (rule.label, text)
                assert any(all(w in text for w in a.split()) for a in rule.keywords.split("|")), (rule.label, rule.keywords, text)
        assert held, rule


def test_gated_equal_ungated(spark):
    texts = [
        "Released under MIT", "distributed under the GNU GPL", "wtfpl", "simplified BSD", "2-clause BSD", "available\n * under BSD", "all rights\n * reserved", "released into the public\n# domain", "GNU\nFree Documentation License", "Business\nSource License",
        "SIL\nOpen Font License", "Server\n// Side Public License", "Common\n * Development and Distribution License", "Open\nDatabase License", "GNU\n GPL", "nothing here",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lower = licenses.ascii_lower(docs.text)
    ungated = docs.select("doc_id", licenses.detections(lower, [replace(r, keywords="") for r in licenses.rules()]).alias("want"))
    for r in licenses.scanned(docs).join(ungated, "doc_id").collect():
        assert (r.detections or []) == r.want
        assert (r.score > 0) == (texts[r.doc_id] != "nothing here"), texts[r.doc_id]


def test_many_matches_in_one_text_cost_in_proportion(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "licensed under the mit license. " * n)], "doc_id long, text string")
        began = time.perf_counter()
        row = licenses.scanned(docs).select("n_base", "labels").first()
        assert row.n_base == n and "mit" in row.labels
        return time.perf_counter() - began

    seconds(1)
    # the square of 16 would be 256
    assert seconds(64_000) < 30 * max(seconds(4_000), 0.5)
