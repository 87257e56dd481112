"""What a query does for each row, pair or place, as that is what grows with the tables."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as t
from colloquy.operators import metrics, patterns, retrieval, speech
from colloquy.plans import catalogue, dialogue
from colloquy.plans.queries import QUERIES
from tests.test_catalogue import SF_DIR
from tests.test_odd_tables import both


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_common_terms_are_not_counted_row_by_row(monkeypatch):
    asked = pa.table({"q": pa.array(range(20), pa.int64())})
    run = retrieval._counted([retrieval._gram_terms], asked, np.repeat(np.arange(5), 20), np.tile(np.arange(20), 5), 3, "q", "doc")
    counts = []
    kept = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: counts.append(1) or kept(*a, **k))
    list(run(iter([pa.record_batch({"doc": pa.array(range(500), pa.int64()), "terms": pa.array(["some words"] * 500)})])))
    assert len(counts) < 50


@pytest.mark.parametrize("cells", [1 << 22, 40, 9])
def test_common_and_rare_terms_are_counted_alike(spark, monkeypatch, cells):
    monkeypatch.setattr(retrieval, "CELLS", cells)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    some = lambda n: " ".join(rng.choice(words[: rng.choice([3, 30])]) for _ in range(n))
    asked, docs = [(q, some(6)) for q in range(9)], [(d, some(9)) for d in range(70)]
    got = retrieval.by_tokens(spark.createDataFrame(asked, "q int, question string"), spark.createDataFrame(docs, "doc int, text string"), "q", "doc", 4)
    expected = set()
    for q, question in asked:
        found = sorted((-len(set(question.split()) & set(text.split())), d) for d, text in docs)
        expected |= {(q, n, d, float(-s)) for n, (s, d) in enumerate([f for f in found if f[0]][:4], 1)}
    assert {(r.q, r["rank"], r.doc, r.score) for r in got.collect()} == expected


def test_a_text_is_read_in_small_parts():
    assert max(len(terms) for _, terms in retrieval._gram_terms(pa.array(["ab c" * 500_000]))) <= 1 << 18


def test_no_more_near_rows_than_are_wanted_leave_a_task(spark, monkeypatch):
    asked = []
    kept = retrieval.by_vector
    monkeypatch.setattr(retrieval, "by_vector", lambda *a, **k: asked.append(k.get("k")) or kept(*a, **k))
    dialogue.hybrid_retrieval(spark, SF_DIR)
    assert asked == [6]


def test_gold_is_found_in_one_pass_and_read_once(spark, tmp_path):
    docs = {"doc_id": pa.array([1, 2, 3, 4], pa.int64()), "text": ["The fox ran", "the fox ran home", None, ""]}
    items = {"item_id": pa.array([1, 2, 3], pa.int64()), "text": ["fox ran", "Fox", ""]}
    got, expected = both(spark, tmp_path, "recall_and_mrr", documents=docs, benchmark=items)
    assert got == expected and len(got) == 2
    searched = plan(catalogue._gold(spark, str(tmp_path)))
    assert "MapInArrow" in searched
    spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "q int, d int").write.parquet(f"{tmp_path}/gold")
    ranked = spark.createDataFrame([(1, 1, 2), (1, 1, 1)], "q int, d int, rank int")
    rows = metrics.ranking(spark.read.parquet(f"{tmp_path}/gold"), ranked, "q", "d")
    assert plan(rows).count("FileScan") == 1
    assert sorted((r.q, r.recall, r.reciprocal) for r in rows.collect()) == [(1, 1.0, 1.0), (2, 0.0, 0.0)]


@pytest.mark.parametrize("size", [1 << 24, 8])
def test_pairs_of_words_are_counted_where_the_texts_are(spark, monkeypatch, size):
    monkeypatch.setattr(patterns, "PAIR_BYTES", size)
    texts = ["a b a b", "", None, " ", "É a1-b, a1 b.", "Zß9x", "...a", "b"] * 3
    got = patterns.pairs_counted(spark.createDataFrame([(x,) for x in texts], "text string").repartition(2), "text", "A-Za-z0-9").collect()
    expected = Counter()
    for x in texts:
        words = re.findall("[A-Za-z0-9]+", x or "")
        expected.update(zip([None, *words], words))
    assert {(r.before, r.token): r.n for r in got} == expected and len(got) == len(expected)
    assert "Generate" not in plan(QUERIES["prev_token_context"](spark, SF_DIR))


def test_tokens_of_all_texts_are_made_once(spark):
    assert "regexp_extract_all" not in plan(QUERIES["spell_cache"](spark, SF_DIR))


def test_a_place_is_not_compared_with_all_values_of_its_text(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = spark.createDataFrame([(1, ", ".join(words)), (2, "w1"), (3, None), (4, "…w1 w2")], "id int, text string")
    values = spark.createDataFrame([(1, w, w.upper()) for w in words] + [(4, "w1", None), (4, "w2", "x"), (9, "w1", "y")], "id int, token string, value string")
    out = patterns.replaced_tokens(texts, values, "id", "text")
    assert "element_at" not in plan(out)
    assert {r.id: r.text for r in out.collect()} == {1: ", ".join(words).upper(), 2: "w1", 3: None, 4: "…w1 x"}


def test_parentheses_that_stay_open_are_read_once(spark):
    texts = ["a (b c", "a (b) c", "x (က b) c (d", "((a) b", "( က", "(a（b）c)", "a) (b", "", "(" * 50, "see [src](http://x.org/a) now. more"]
    own = r"က-႟"
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    found = rows.select("id", speech.before_names(F.col("text")).alias("a"), t.without_parentheses(F.col("text"), t.OTHER_SCRIPT).alias("b"))
    assert plan(found).count("*+") >= 4

    def aside(x):
        x = re.sub(r"(?i)https?://\S+", " ", x)
        x = re.sub(r"[ \t]+", " ", x).strip()
        x = re.sub(rf"[(（](?![^()（）]*[{own}])[^()（）]*[)）]", "", x)
        return re.sub(r"[ \t]{2,}", " ", x).strip()

    def bare(x):
        while (y := re.sub(rf"\((?![^()]*[{own}])[^()]*\)", " ", x)) != x:
            x = y
        return x

    got = {r.id: (r.a, r.b) for r in found.collect()}
    assert got == {i: (aside(x), bare(x)) for i, x in enumerate(texts)}


def test_what_is_behind_the_last_mark_is_not_searched(spark):
    texts = ["a(b)c", "", "none", ")", "x）y)z", "𝄞)𝄞", None]
    seen = spark.createDataFrame([(x,) for x in texts], "text string").select(t.up_to_last(F.col("text"), ")）", lambda h: F.concat(F.lit("<"), h, F.lit(">"))).alias("v"))
    assert [r.v for r in seen.collect()] == ["<a(b)>c", "<>", "<>none", "<)>", "<x）y)>z", "<𝄞)>𝄞", None]


def test_words_of_any_script(spark):
    texts = ["abc dé é1 _x-y", "éa aé", "က္ခ ab\u0301c", "x\u200dy", "a\u203fb", "", "中文abc中"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    got = rows.select(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", patterns.WORD), ("b", r"(?U)\w+")))).collect()
    assert all(r.a == r.b for r in got)


@pytest.mark.parametrize("chars", [1 << 25, 60])
def test_tokens_are_looked_up_for_parts_of_texts(spark, monkeypatch, chars):
    monkeypatch.setattr(speech, "PART_CHARS", chars)
    monkeypatch.setattr(speech, "TEXTS", 2)
    words = ["part", "I", "i", "v", "X", "II", "XV3", "xv", "ID", "NodeJsApi", "B2", "say", "éID", "ID2", "_I", "KLMN", "bold", "1st"]
    rng = random.Random(8)
    texts = [(n, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x01"[: n % 2]]) for _ in range(rng.randrange(14)))) for n in range(60)] + [(60, None), (61, ""), (None, "part I ID II"), (62, "\x01\x01ID\x01")]
    texts = spark.createDataFrame(texts, "id int, text string").repartition(3)
    cache = spark.createDataFrame([("ID", "spell"), ("I", "spell"), ("KLMN", "spell"), ("say", "word"), ("B2", "roman"), ("bold", "odd")], "token string, kind string")
    listed = spark.createDataFrame([("bold",), ("NodeJsApi",), ("ID",)], "token string")
    model = [(n, w, k) for n in range(0, 60, 3) for w, k in [("say", "spell"), ("B2", "word"), ("I", "spell"), ("never", "word"), ("ID", "word"), ("ID2", "roman"), ("ID2", "word"), ("KLMN", "no")]] + [(None, "ID", "word")]
    model = spark.createDataFrame(model, "id int, token string, kind string")
    slow = speech.resolved_kinds(speech.latin_tokens(texts, "id"), cache, listed, model, "id")
    fast = speech.kinds_of_texts(texts, cache, listed, model, "id")
    assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))
    spoken = speech.texts_spoken(texts, cache, listed, model, "id")
    assert spoken.schema == texts.schema
    assert sorted(map(str, spoken.collect())) == sorted(map(str, speech.tokens_spoken(texts, slow, "id").collect()))
    for name in ("spoken_tokens", "spell_cache"):
        assert "doc_id" not in " ".join(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin) \[.*", plan(QUERIES[name](spark, SF_DIR))))


@pytest.mark.parametrize("sizes", [(1 << 22, 1 << 22, 16_384, 16_384), (40, 30, 4, 7)])
def test_rank_of_a_gold_row_without_the_rows_before_it(spark, monkeypatch, sizes):
    for name, size in zip(("CELLS", "HITS", "FIRST_ROWS", "QUERY_BLOCK"), sizes):
        monkeypatch.setattr(retrieval, name, size)
    rng = random.Random(6)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    some = lambda n: " ".join(rng.choice(words[: rng.choice([3, 20])]) for _ in range(n))
    queries = spark.createDataFrame([(q, some(6)) for q in range(20)] + [(20, "none"), (21, ""), (22, None)], "q int, question string")
    rows = spark.createDataFrame([(d, some(rng.randrange(12))) for d in range(60)] + [(60, None)], "d int, text string").repartition(3)
    gold = spark.createDataFrame([(q, rng.randrange(62)) for q in range(23) for _ in range(6)] + [(99, 1)], "q int, d int")
    ranks, found = retrieval.ranks_by_tokens(gold, queries, rows, "q", "d", 4)
    ranked = retrieval.by_tokens(queries, rows, "q", "d", 4)
    assert {r.q for r in found.collect()} == {r.q for r in ranked.collect()}
    measured = lambda of: sorted(map(str, metrics.ranking(gold, of, "q", "d").collect()))
    assert measured(ranks) == measured(ranked) and ranks.count() > 3


def test_the_evaluation_job_does_not_meet_all_texts_with_all_questions(spark, monkeypatch):
    asked = pa.table({"q": pa.array(range(300), pa.int64()), "terms": pa.array([[1, 2]] * 300, pa.list_(pa.int64())), "_score": pa.array([1] * 300), "_best": pa.array([10**6] * 300)})
    pairs = []
    kept = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: pairs.append(k.get("minlength", 0)) or kept(*a, **k))
    docs = pa.record_batch({"d": pa.array(range(5000), pa.int64()), "terms": pa.array([[1, 2, 3]] * 5000, pa.list_(pa.int64()))})
    out = next(retrieval._before(asked, 5, "q")(iter([docs, docs])))
    assert out.column("_n").to_pylist() == [5] * 300 and sum(pairs) < 300 * 50
    monkeypatch.setattr(retrieval, "by_tokens", None)
    assert QUERIES["evaluation_job"](spark, SF_DIR).count() == 1
