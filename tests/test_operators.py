"""Edge cases of the operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import replies
from colloquy.functions import text as t
from colloquy.functions.vectors import cosine
from colloquy.operators import context, metrics, retrieval, routing, sessions, speech
from colloquy.sources import ingest
from colloquy.streaming import status


def value(spark, column, *literals):
    row = spark.createDataFrame([tuple(literals)], ", ".join(f"c{i} {'string' if isinstance(x, str) or x is None else 'array<double>'}" for i, x in enumerate(literals)))
    return row.select(column).first()[0]


def found(spark, queries, rows, **options):
    q = spark.createDataFrame(queries, "query string, vector array<double>")
    r = spark.createDataFrame(rows, "key string, embedding array<double>")
    return [(x["query"], x["key"], round(x["score"], 4)) for x in retrieval.by_vector(q, r, "query", "key", **options).orderBy("query", "rank").collect()]


def test_nearest_vector_ties_and_threshold(spark):
    assert found(spark, [("q", [0.99, 0.01, 0.0])], [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], k=1, least=0.5) == [("q", "a", 0.9999)]
    assert found(spark, [("q", [1.0, 0.0])], [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], k=3, least=1.1) == []
    same = [(k, [1.0, 0.0]) for k in "bac"]
    assert [k for _, k, _ in found(spark, [("q", [1.0, 0.0])], same, k=2)] == ["a", "b"]


def test_zero_norm_scores_zero(spark):
    assert value(spark, cosine(F.col("c0"), F.col("c1")), [0.0, 0.0], [1.0, 0.0]) == 0.0


def test_blocks_of_queries_lose_none(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    queries = [(str(i), [1.0, float(i)]) for i in range(10)]
    rows = [(f"r{i}", [float(i), 1.0]) for i in range(5)]
    assert len(found(spark, queries, rows, k=2)) == 20


@pytest.mark.parametrize(("text", "grams"), [("", []), ("ab", ["ab"]), ("abc", ["abc"]), ("ABAB", ["aba", "bab"]), ("xxxxx", ["xxx"]), ("a😀b", ["a😀b"])])
def test_ngrams(spark, text, grams):
    assert sorted(value(spark, t.ngrams(F.col("c0")), text)) == grams


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "a"), ("a", "a")], "gold string, pred string")
    assert metrics.accuracy(rows).first()[0] == 0.75
    assert metrics.macro_f1(rows, ["a", "b", "c"]).first()[0] == pytest.approx(0.6)
    assert metrics.accuracy(rows.limit(0)).first()[0] == 0.0
    gold = spark.createDataFrame([("q", "x")], "query string, key string")
    ranked = spark.createDataFrame([("q", "y", 1), ("q", "x", 2)], "query string, key string, rank int")
    assert metrics.ranking(gold, ranked, "query", "key").first().asDict() == {"query": "q", "recall": 1.0, "reciprocal": 0.5}
    answers = spark.createDataFrame([(1, "Ann Lee of Oldtown", "ann lee"), (2, "", "x"), (3, None, None)], "id int, answer string, gold string")
    assert {r["id"]: round(r["f1"], 4) for r in metrics.token_f1(answers, "id", "answer", "gold").collect()} == {1: 0.6667, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize(
    ("text", "parts"),
    [("One three. Four?", ["One three.", "Four?"]), ("Put it in. Then go.", ["Put it in. Then go."]), ("It is 3.14 now.", ["It is 3.14 now."]), ("Ask Dr. Smith today.", ["Ask Dr. Smith today."]), ("", [])],
)
def test_sentences(spark, text, parts):
    assert value(spark, t.sentences(F.col("c0")), text) == parts


def test_speech_text(spark):
    assert value(spark, t.without_parentheses(F.col("c0")), "a (b (c) d) e") == "a   e"
    deep = "(" * 40 + "x" + ")" * 40
    assert value(spark, t.without_parentheses(F.col("c0")), f"a {deep} ((( b )( c") == "a   (( ( c"
    assert value(spark, t.without_parentheses(F.col("c0"), t.OTHER_SCRIPT), "a (မြန်မာ (b)) (c)") == "a (မြန်မာ  )  "
    assert value(spark, t.without_urls(F.col("c0")), " see https://x.org/a now\n\n\n\nend ") == "see now\n\nend"
    assert value(spark, t.phrases(F.col("c0")), "## Head\n| a |  | b  c |\n|---|:-:|\n- three. Two?  x\n| cut") == ["Head", "a၊ b c", "- three.", "Two?", "x", "| cut"]
    assert value(spark, t.phrases(F.col("c0")), "စာ။ ခင်ဗျာ။") == ["စာ ခင်ဗျာ။"]
    assert value(spark, t.courtesy_merged(F.array(F.lit("One။"), F.lit("ရှင်။"), F.col("c0"))), "two") == ["One ရှင်။", "two"]
    assert value(spark, t.without_markdown(F.col("c0")), "![x](y) [](z) `` `a`") == "!x [](z) ` a`"
    assert value(spark, t.row_phrase(F.col("c0"), ", "), "| a |  | b |") == "a, b"
    spoken = speech.prepared(F.col("c0"), names=[("Ann Lee", "WA")], titles=[("Dr", "Doctor")], lexicon={"ab": "AB"})
    assert value(spark, spoken, "Ask dr. ann lee (no） at http://x.y/z about ab, cab.") == "Ask Doctor WA at ABout AB, cAB."
    assert value(spark, t.outside_urls(F.col("c0"), F.upper), "go http://a.b/c on") == "GO http://a.b/c ON"
    assert [value(spark, t.token_kind(F.col("c0")), x) for x in ("II", "I", "ID", "Room", "B2")] == ["roman", "word", "spell", "word", "spell"]


def test_replies_and_titles(spark):
    routes = ["local", "other"]
    cases = {'"local"': None, "local now": "local", '{"route": " LOCAL "}': "local", '```json\n{"route": "other"}\n```': "other", "[1]": None, "": None, '{"a": 1}': None, "{other}:": "other", "null": None}
    assert {k: value(spark, t.route_of_reply(F.col("c0"), routes), k) for k in cases} == cases
    titles = {"Who is Tom?": "Who is Tom?", 'UPLOADED "a b.pdf"': "a b.pdf", " ": "New chat", "x" * 90: "x" * 80, "one\r\ntwo": "one"}
    assert {k: value(spark, t.session_title(F.col("c0")), k) for k in titles} == titles
    who = t.profile_title(F.col("c0"), F.lit("Dr. Ann Lee"), F.lit(False))
    assert value(spark, who, "About lee") == "About lee" and value(spark, who, "About") is None
    assert value(spark, t.corrected_title(F.lit("On Tom"), F.col("c0"), F.lit("Dr. Ann Lee"), F.lit(False)), "q") == "Who is Dr. Ann Lee"
    quota = {"HTTP 429 Too Many Requests": True, "rate_limit": True, "ResourceExhausted": True, "other": False}
    assert {k: value(spark, t.is_quota(F.col("c0")), k) for k in quota} == quota
    assert value(spark, t.is_overload(F.col("c0"), F.lit(520)), "x") and not value(spark, t.is_overload(F.col("c0"), F.lit(501)), "x") and value(spark, t.is_overload(F.col("c0"), F.lit(None).cast("int")), "high demand")
    assert value(spark, replies.embedding_of(F.col("c0")), '{"embedding": {"values": [1, 2.5]}}') == [1.0, 2.5] and value(spark, replies.embedding_of(F.col("c0")), "[]") is None
    assert value(spark, replies.descriptions(F.array(F.col("c0"), F.lit(None).cast("string"), F.lit("b"))), "a") == "a\n\nb"
    boxes = value(spark, replies.annotations_of(replies.annotations_json(replies.annotations_of(F.col("c0")))), '[{"term": "a", "definition": "b", "page": "2", "x": 1, "y": "0.5", "width": 3, "height": 4}]')
    assert boxes[0].page == 2 and boxes[0].y == 0.5


def test_names_and_cache(spark):
    known = ["Ann Lee", "Tom May"]
    cases = {"Dr. Ann Lee": True, "tom may": True, "a@b.c": False, "ABC": False, "Dr.": False, "Other": False}
    assert {k: value(spark, speech.is_known_person(F.col("c0"), known, ["Dr", "Prof"]), k) for k in cases} == cases
    assert value(spark, speech.is_keepable_key(F.col("c0"), known, ["Dr"], ["Sir"]), "Sir")
    assert value(spark, speech.name_of_stem(F.col("c0")), "ann_lee__x") == "Ann Lee X"
    assert value(spark, speech.overlaid(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))), "") == {"a": 1, "b": 3}
    tokens = speech.latin_tokens(spark.createDataFrame([(1, "Part I of II, I said ID")], "id int, text string"), "id")
    assert {(r.token, r.numeral) for r in tokens.collect()} == {("Part", False), ("I", True), ("of", False), ("II", False), ("said", False), ("ID", False)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    for _ in range(2):
        ingest.appended(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    content = spark.createDataFrame([(bytes.fromhex("ffd8ff"),), (b"RIFFxxxxWEBP",), (b"",)], "c binary")
    assert [r[0] for r in content.select(ingest.image_kind(F.col("c"))).collect()] == ["jpeg", "webp", "png"]


def test_stored_files_are_read(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps({"active_id": "zz", "conversations": [{"id": "a", "turns": [{"question": "q"}]}, {"id": "b", "turns": []}], "deleted_ids": ["x"]}))
    (tmp_path / "broken.json").write_text("{oops")
    store = ingest.chat_store(spark, str(tmp_path / "store.json")).first()
    assert store.active_id == "b" and store.deleted_ids == ["x"]
    (tmp_path / "items.jsonl").write_text('{"id": "1", "question": "q", "gold_route": "local", "gold_spans": ["s"]}\n')
    assert ingest.evaluation_items(spark, str(tmp_path / "items.jsonl")).first().gold_spans == ["s"]
    (tmp_path / "k" / "x").mkdir(parents=True)
    (tmp_path / "k" / "x" / "n.jsonl").write_text('{"id": "1", "text": "t", "sources": "u"}\n')
    assert [tuple(r) for r in ingest.categories(spark, str(tmp_path / "k"), ["x"]).select("id", "category", "sources").collect()] == [("1", "x", ["u"])]
    assert ingest.notes(spark, str(tmp_path / "k" / "x")).count() == 1 and ingest.freshness(spark, str(tmp_path / "k")).first().stamp > 0
    (tmp_path / "index.json").write_text(json.dumps({"embed_model": "m", "built_at": "t", "chunks": [{"id": "1", "text": "t", "sources": [], "embedding": [1.0]}, {"id": "2", "text": " ", "embedding": [1.0]}]}))
    assert ingest.index(spark, str(tmp_path / "index.json")).count() == 1


def test_most_shared_terms_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    docs = spark.createDataFrame([(k, f"alpha beta{k % 3} gamma") for k in range(40)], "doc int, text string").repartition(5)
    asked = spark.createDataFrame([(q, f"beta{q} Alpha none") for q in range(4)], "q int, question string")
    got = {}
    for r in retrieval.by_tokens(asked, docs, "q", "doc", k=3).collect():
        got.setdefault(r.q, []).append((r["rank"], r.doc, r.score))
    assert {q: [(d, s) for _, d, s in sorted(v)] for q, v in got.items()} == {0: [(0, 2.0), (3, 2.0), (6, 2.0)], 1: [(1, 2.0), (4, 2.0), (7, 2.0)], 2: [(2, 2.0), (5, 2.0), (8, 2.0)], 3: [(0, 1.0), (1, 1.0), (2, 1.0)]}


def test_first_of_repeated_keys_counts(spark):
    new = spark.createDataFrame([(1, "z"), (1, "a"), (2, "b")], "id int, text string").coalesce(1)
    old = new.limit(0).withColumn("content_hash", F.lit(""))
    assert {(r.id, r.text) for r in ingest.applied(old, new, ["id"]).collect()} == {(1, "z"), (2, "b")}
    assert {(r.id, r.copies) for r in ingest.changes(old, new, ["id"]).collect()} == {(1, 2), (2, 1)}


def test_other_text_functions(spark):
    assert value(spark, t.orphans_merged(F.split("c0", ";"), lambda p: F.length(p) < 2), "ab;c;de") == ["ab c", "de"]
    assert value(spark, t.voice(F.lit(None).cast("string"), F.col("c0"), F.lit("s"), {"m": ["he"]}), "HE is") == "m"
    assert value(spark, t.has_latin(F.col("c0")), "မြ a")
    assert value(spark, context.picked(F.col("c0"), ["a", "b"]), "k") in ("a", "b")


def test_routes_inherit_and_resolve(spark):
    turns = spark.createDataFrame([(1, 1, "domain"), (1, 2, None), (1, 3, None), (2, 1, None)], "thread int, turn int, route string")
    got = {(r["thread"], r["turn"]): r["inherited"] for r in routing.inherited(turns, "thread", "turn", "route").collect()}
    assert got == {(1, 1): None, (1, 2): "domain", (1, 3): "domain", (2, 1): None}


def test_retrieval_query_blank_takes_a_slot(spark):
    turns = spark.createDataFrame([(1, i, q) for i, q in enumerate(["a", "b", " ", "d"])], "thread int, turn int, q string")
    rows = context.retrieval_query(turns, "thread", "turn", "q").orderBy("turn").collect()
    assert [r["query"] for r in rows] == ["a", "a b", "a b", "b d"]


def test_budget_cuts_the_last(spark):
    rows = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, " "), (1, 3, "bbbb"), (1, 4, "cccc")], "g int, o int, text string")
    assert [r["text"] for r in context.budgeted(rows, "g", "o", "text", budget=8).orderBy("o").collect()] == ["aaaa", "bb"]


def test_changes_of_a_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, text string").withColumn("content_hash", t.content_key(F.col("text")))
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "D"), (5, "e"), (5, "e")], "id int, text string")
    failed = spark.createDataFrame([(4,)], "id int")
    assert {r["id"]: r["action"] for r in ingest.changes(old, new, ["id"], failed).collect()} == {1: "noop", 2: "update", 3: "delete", 4: "noop", 5: "insert"}
    after = ingest.applied(old, new, ["id"], failed)
    assert {(r["id"], r["text"]) for r in after.collect()} == {(1, "a"), (2, "B"), (4, "d"), (5, "e")}
    assert {r["action"] for r in ingest.changes(after, after.drop("content_hash"), ["id"]).collect()} == {"noop"}
    assert {r["action"] for r in ingest.changes(old, new.limit(0), ["id"]).collect()} == {"delete"}


def test_notes_read_tolerantly(spark, tmp_path):
    lines = [{"id": "a", "text": " x ", "sources": ["s", ""]}, {"id": 7, "text": "y"}, {"id": "b", "text": ""}, {"id": "c", "text": "z", "sources": "t", "name": "N"}]
    (tmp_path / "n.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", "[1]", ""]))
    (tmp_path / "_skip.jsonl").write_text(json.dumps({"id": "q", "text": "q"}))
    got = {r["id"]: (r["text"], r["sources"]) for r in ingest.tolerant_notes(spark, str(tmp_path)).collect()}
    assert got == {"a": ("x", ["s"]), "c": ("N\nz", ["t"])}


def test_chunks_of_text(spark):
    rows = spark.createDataFrame([("a", " " + "x" * 3001), ("b", "  "), ("c", None)], "id string, text string")
    assert [(r["chunk_id"], len(r["text"])) for r in ingest.chunked(rows, "id").orderBy("chunk_id").collect()] == [("a-1", 1500), ("a-2", 1500), ("a-3", 1)]


def test_chat_store_rests(spark):
    rows = spark.createDataFrame([("a", 1, ["q"]), ("b", 2, []), ("c", 3, []), ("d", 4, ["q"])], "id string, updated int, turns array<string>")
    gone = spark.createDataFrame([("d",)], "id string")
    assert {r["id"] for r in sessions.finalized(rows, gone).collect()} == {"a", "c"}


def test_session_without_user_message_stands_by_creation(spark):
    s = spark.createDataFrame([(1, 10, 0), (2, 5, 0), (3, 1, 1)], "session_id int, created_at int, owner int")
    m = spark.createDataFrame([(1, 11, "assistant"), (2, 12, "user")], "session_id int, created_at int, role string")
    assert [r["session_id"] for r in sessions.recent_sessions(s, m, F.col("owner") == 0).collect()] == [2, 1]
    assert sessions.recent_sessions(s, m, F.col("owner") == 0, offset=5).collect() == []


def test_streamed_ingest_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "a"}\n{"id": "b"}')
    seen = []

    def merge(batch, _):
        seen.extend(r["id"] for r in batch.collect())

    for _ in range(2):
        status.ingest(spark, str(tmp_path / "in"), "id string", str(tmp_path / "checkpoint"), merge).awaitTermination(60)
    assert sorted(seen) == ["a", "b"]
