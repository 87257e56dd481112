"""Tables of patterns against plain loops; the speech chain over tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as t
from colloquy.operators import patterns, routing, speech

TEXTS = "id int, text string"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c0 string").select(column.alias("v")).first().v


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_any_number_of_hints(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_CHARS", block)
    rng = random.Random(1)
    letters = "abAÉé ß"
    texts = [(i, "".join(rng.choice(letters) for _ in range(60))) for i in range(40)] + [(40, None), (41, "")]
    hints = [(f"p{i % 30}", i % 30, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5)))) for i in range(200)] + [("empty", 99, ""), ("null", 98, None)]
    df = spark.createDataFrame(texts, TEXTS).repartition(3)
    got = routing.matched_profiles(df, spark.createDataFrame(hints, "profile string, ordinal int, hint string"), "id").collect()
    expected = {(i, p, o) for i, x in texts if x for p, o, h in hints if h and (h in x or h in x.lower())}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert routing.matched_profiles(df, spark.createDataFrame([], "profile string, ordinal int, hint string"), "id").count() == 0


def test_first_and_all_profiles(spark):
    texts = spark.createDataFrame([(1, "x Ann y bob"), (2, "BOB"), (3, "none")], TEXTS)
    hints = spark.createDataFrame([("b", 1, "bob"), ("a", 2, "ann"), ("a", 0, "zoe"), ("c", 3, "Ann")], "profile string, ordinal int, hint string")
    assert {tuple(r) for r in routing.first_profile(texts, hints, "id").collect()} == {(1, "a"), (2, "b")}
    assert {(r.id, tuple(r.profiles)) for r in routing.all_profiles(texts, hints, "id").collect()} == {(1, ("a", "b", "c")), (2, ("b",))}


def test_expansion_with_history_and_research(spark):
    rows = [
        (1, " who is Ann? ", "bob said"), (2, "a paper of Ann", None), (3, "and then", "Ann and Bob"), (4, "which paper and on what topic of all the many topics", "Bob"),
        (5, "a question about something else altogether, with no hint", "Bob"), (6, "short", None), (7, None, "Ann"), (8, "  ", ""),
    ]
    texts = spark.createDataFrame(rows, "id int, text string, history string")
    hints = spark.createDataFrame([("a", 0, "ann"), ("b", 1, "bob")], "profile string, ordinal int, hint string")
    terms = spark.createDataFrame([("a", "Dr. Ann"), ("b", "Dr. Bob")], "profile string, terms string")
    got = {r.id: r.text for r in routing.expanded(texts, hints, terms, "id", followup=["then"], research=["paper"], added=("research", "papers")).collect()}
    assert got == {
        1: "who is Ann?\nDr. Ann", 2: "a paper of Ann\nDr. Ann\nresearch", 3: "and then\nDr. Ann Dr. Bob", 4: "which paper and on what topic of all the many topics\nDr. Bob papers",
        5: rows[4][1], 6: "short", 7: "", 8: "",
    }
    assert {r.id: r.text for r in routing.expanded(texts.drop("history"), hints, terms, "id").collect()}[1] == "who is Ann?\nDr. Ann"


@pytest.mark.parametrize("block", [1 << 21, 12])
def test_entries_follow_one_another(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_CHARS", block)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc$\\") for _ in range(rng.randrange(1, n)))
    entries = list({word(5): word(4) for _ in range(40)}.items())
    texts = [(i, word(80)) for i in range(50)] + [(50, None), (51, "")]
    got = patterns.replaced_in_turn(spark.createDataFrame(texts, TEXTS).repartition(2), spark.createDataFrame([*entries, ("", "x")], "source string, value string"), "text")

    def plain(x):
        for source, value in sorted(entries, key=lambda e: (-len(e[0]), e[0])):
            x = x.replace(source, value)
        return x

    assert got.columns == ["id", "text"]
    assert {r.id: r.text for r in got.collect()} == {i: x if x is None else plain(x) for i, x in texts}
    assert patterns.replaced_in_turn(got, spark.createDataFrame([], "source string, value string"), "text").count() == len(texts)


def test_tokens_are_replaced_whole(spark):
    texts = [(1, "ID2 I, IDs ID2! éID2 _ID2 x"), (2, "nothing"), (3, None), (4, ""), (5, "…"), (6, "I")]
    table = spark.createDataFrame([("ID2", "eye $1"), ("I", "one")], "token string, value string")
    got = {r.id: r.text for r in patterns.replaced_tokens(spark.createDataFrame(texts, TEXTS), table, "id", "text").collect()}
    assert got == {1: "eye $1 one, IDs eye $1! éID2 _ID2 x", 2: "nothing", 3: None, 4: "", 5: "…", 6: "one"}
    own = spark.createDataFrame([(6, "I", "six")], "id int, token string, value string")
    assert {r.id: r.text for r in patterns.replaced_tokens(spark.createDataFrame(texts, TEXTS), own, "id", "text").collect()}[6] == "six"


def test_numerals_letters_and_context(spark):
    kinds = {"II": "roman", "ii": "roman", "I": "word", "i": "word", "x": "word", "ID": "spell", "B2": "spell", "Room": "word", "NodeJsApi": "spell", "XXI": "word", "Python": "word", "I2": "spell"}
    assert {k: one(spark, t.token_kind(F.col("c0")), k) for k in kinds} == kinds
    texts = spark.createDataFrame([(1, "Semester I and Physics v, Lab x. I said 3D Semester II ID"), (2, "section I"), (3, "I")], TEXTS)
    got = {(r.id, r.token) for r in speech.latin_tokens(texts, "id").filter("numeral").collect()}
    assert got == {(1, "I"), (1, "v"), (1, "x")}
    assert {r.token for r in speech.latin_tokens(texts, "id").filter("id = 1").collect()} == {"Semester", "I", "and", "Physics", "v", "Lab", "x", "said", "D", "II", "ID"}


def test_chain_over_a_table(spark):
    texts = spark.createDataFrame([(1, "Ask dr. Ann Lee (no) at http://x.y/z about Semester II, ID and KLMN. Tom May too."), (2, " "), (3, "x" * 5000)], TEXTS)
    ready = speech.answers_prepared(texts, "id", names=[("Ann Lee", "WA")], titles=[("Dr", "Doctor")]).filter("id = 1").first().text
    found = spark.createDataFrame([(None, 0, "tom may", "TM"), (None, 1, "Doctor", "never")], "text_key string, at int, source string, value string")
    before = texts.select("id", speech.before_names(F.col("text"), [("Ann Lee", "WA")], [("Dr", "Doctor")]).alias("text"))
    found = before.filter("id = 1").select(speech.text_key(F.col("text")).alias("text_key")).crossJoin(found.drop("text_key"))

    def kinds(rows):
        tokens = speech.latin_tokens(rows, "id")
        none = spark.createDataFrame([], "id int, token string, kind string")
        cache = spark.createDataFrame([("KLMN", "spell"), ("ID", "spell"), ("I", "spell")], "token string, kind string")
        return speech.resolved_kinds(tokens, cache, none.select("token"), none, "id")

    lexicon = spark.createDataFrame([("Ask", "Tell"), ("ell", "ELL")], "source string, value string")
    got = {r.id: r.text for r in speech.answers_prepared(texts, "id", names=[("Ann Lee", "WA")], titles=[("Dr", "Doctor")], blocked=["doctor"], found=found, lexicon=lexicon, kinds=kinds).collect()}
    assert "Tom May" in ready and ready.startswith("Ask Doctor WA")
    spelled = lambda w: " ".join(t.LETTERS[c] for c in w)
    assert got[1] == ready.replace("Tom May", "TM").replace("Ask", "TELL").replace("II,", t.NUMERALS["II"] + ",").replace("ID", spelled("ID")).replace("KLMN", spelled("KLMN")).replace("TELL", "TELL")
    assert got[2] == "" and len(got[3]) == speech.MOST


def test_caches_are_merged_and_pruned(spark):
    cache = spark.createDataFrame([("ID", "word"), ("I", "spell"), (" AD ", "spell"), ("xx", "odd"), ("ii", "word")], "token string, kind string")
    entries = spark.createDataFrame([("ID", "spell", 1), ("ID", "word", 0), ("", "word", 2), ("V", "roman", 3)], "token string, kind string, at int")
    assert {tuple(r) for r in speech.merged_kinds(cache, entries, "at").collect()} == {("ID", "spell"), ("AD", "spell"), ("ii", "roman")}
    lexicon = spark.createDataFrame([("Dr", "old"), ("Python", "x"), ("Ann Lee", "AL")], "source string, value string")
    new = spark.createDataFrame([("Dr", "new", 5), ("Dr", "newer", 7), (" ", "x", 6), ("Ann Lee", " ", 9)], "source string, value string, at int")
    keepable = lambda c: speech.is_keepable_key(c, ["Ann Lee"], ["Dr"], ["Dr", "Dr."])
    assert {tuple(r) for r in speech.merged_lexicon(lexicon, new, "at", keepable).collect()} == {("Dr", "newer"), ("Ann Lee", "AL")}


def test_particles(spark):
    final = re.compile("(ခင်ဗျာ|ရှင်|ဗျာ)(\\s*)(။|\\?|!)")

    def thinned(text):
        found = list(final.finditer(text))
        out, at = "", 0
        for m in found[:-1]:
            prefix = text[at : m.start()]
            out += prefix + ("" if prefix.endswith(("ပါ", "တယ်")) else "ပါ") + m.group(2) + m.group(3)
            at = m.end()
        return out + text[at:]

    for text in ("", "a", "aဗျာ။", "aဗျာ။ bတယ်ရှင် ? cပါခင်ဗျာ! dဗျာ။ e", "ဗျာ။ဗျာ။ဗျာ။", "x ရှင် ။ " * 50):
        assert one(spark, t.finals_thinned(F.col("c0")), text) == thinned(text)
    assert one(spark, t.finals_thinned(F.col("c0")), None) is None
    cases = {" \n go": "go", "ဗျာ၊ ရှင်\tgo": "go", "go ဗျာ": "go ဗျာ", "ဗျာ": "", "": ""}
    assert {k: one(spark, t.leading_particles_off(F.col("c0")), k) for k in cases} == cases


def test_answer_metrics(spark):
    share, mix = t.script_share(F.col("c0")), t.mix_penalty(F.col("c0"))
    cases = {"": 0.0, "  ": 0.0, "က ခ a b": 0.5, "ကခ ```x\ny``` `zz`": 1.0, "abc": 0.0}
    assert {k: one(spark, share, k) for k in cases} == cases
    cases = {"": 1.0, "word": 1.0, "က word": 1.0, "က" * 16 + " word": 0.5, "က" * 16 + " wor word1 `code`": 0.0, "က" * 80 + " four five": 0.2}
    assert {k: one(spark, mix, k) for k in cases} == cases
    assert one(spark, t.ends_with(F.col("c0")), "x။ \n") and not one(spark, t.ends_with(F.col("c0")), "။x")


def test_tables_and_titles(spark):
    repaired = t.table_repaired(F.col("c0"))
    cases = {"| A | B | |---|---| | C | D | | E | F |": "| A | B |\n|---|---|\n| C | D |\n| E | F |", "no bar": "no bar", "a | b": "a | b", "| A | B |\n|---|---|": "| A | B |\n|---|---|"}
    assert {k: one(spark, repaired, k) for k in cases} == cases
    titles = {' "A title." ': "A title", "''": "New chat", ".": "New chat", "x" * 90: "x" * 80, "a..": "a.", '" a "': "a"}
    assert {k: one(spark, t.generated_title(F.col("c0")), k) for k in titles} == titles
    assert one(spark, t.name_candidates(F.col("c0"), ["world"]), "Ann Lee at http://x.y/Tom May, ann lee Ann Lee, Hello World, Dr. Bo Ly") == ["Ann Lee", "Dr. Bo Ly"]


def test_long_texts_cost_in_proportion(spark):
    text = "aဗျာ။ Bo Ly ID " * 20_000
    rows = spark.createDataFrame([(1, text)], TEXTS)
    out = rows.select("id", t.finals_thinned(F.col("text")).alias("text"))
    kinds = spark.createDataFrame([("ID", "spell")], "token string, kind string")
    assert speech.tokens_spoken(out, kinds, "id").first().text.count(t.LETTERS["D"]) == 20_000
    assert len(rows.select(t.name_candidates(F.col("text"), []).alias("n")).first().n) == 1
