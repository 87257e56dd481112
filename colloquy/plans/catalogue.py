"""Queries over the test tables, each with the SQL that says the same.

Mapping of concepts: a session is a conversation and its turn its time; notes are documents, their category the language
and their id the doc_id; knowledge vectors are embeddings, the category the label; predicted labels come from rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as t
from colloquy.functions.vectors import cosine
from colloquy.operators import context, layout, metrics, retrieval, routing, sessions
from colloquy.operators.patterns import occurring, pairs_counted
from colloquy.plans.registry import query
from colloquy.plans.registry import table as _table
from colloquy.sources import ingest
from colloquy.streaming import status

def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", "text")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).groupBy("session_id").agg(F.min("created_at").alias("created_at")).withColumn("owner", F.col("session_id") % 7)


_SESSIONS_SQL = "s AS (SELECT conv_id AS session_id, min(turn) AS created_at, conv_id % 7 AS owner FROM conversations GROUP BY conv_id)"
_RECENT_SQL = f"""WITH {_SESSIONS_SQL},
l AS (SELECT conv_id AS session_id, max(turn) AS last_user_at FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT s.session_id, s.created_at, l.last_user_at FROM s LEFT JOIN l USING (session_id) WHERE owner = 3
ORDER BY coalesce(last_user_at, created_at) DESC, session_id LIMIT 20 OFFSET """


@query(_RECENT_SQL + "0")
def sessions_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.recent_sessions(_sessions(spark, sf_dir), _messages(spark, sf_dir), F.col("owner") == 3)
    return rows.select("session_id", "created_at", "last_user_at")


@query(_RECENT_SQL + "5")
def sessions_recent_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.recent_sessions(_sessions(spark, sf_dir), _messages(spark, sf_dir), F.col("owner") == 3, offset=5)
    return rows.select("session_id", "created_at", "last_user_at")


@query("SELECT conv_id AS session_id, turn AS created_at, role, text FROM conversations WHERE conv_id = 5 ORDER BY turn LIMIT 50")
def messages_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.page(_messages(spark, sf_dir).filter("session_id = 5"), [F.col("created_at")], 50)


@query("""SELECT session_id, created_at, role FROM (SELECT conv_id AS session_id, turn AS created_at, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""")
def messages_recent_chrono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest(_messages(spark, sf_dir), ["session_id"], ["created_at"], 3).select("session_id", "created_at", "role")


@query("SELECT conv_id AS session_id, arg_max(role, turn) AS role, max(turn) AS created_at FROM conversations GROUP BY conv_id")
def latest_message_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest(_messages(spark, sf_dir), ["session_id"], ["created_at"]).select("session_id", "role", "created_at")


@query("SELECT doc_id, source FROM documents WHERE source = 'src1' ORDER BY doc_id DESC LIMIT 20")
def documents_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.page(_table(spark, sf_dir, "documents").filter("source = 'src1'").select("doc_id", "source"), [F.col("doc_id").desc()], 20)


@query("SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def owned_sessions_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = _table(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("session_id"))
    return sessions.owned(_sessions(spark, sf_dir), owners, ["session_id"]).select("session_id")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def message_label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.with_lookup(_table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels"), "doc_id", ["quality"])


@query("SELECT conv_id AS session_id, turn AS created_at FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def tombstone_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("session_id"))
    return sessions.without(_messages(spark, sf_dir), gone, ["session_id"]).select("session_id", "created_at")


@query("SELECT conv_id AS session_id, turn AS created_at, CASE WHEN turn + conv_id * 7 IN (SELECT doc_id FROM documents WHERE lang = 'de') THEN NULL ELSE turn + conv_id * 7 END AS document_id FROM conversations")
def set_null_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).select("session_id", "created_at", (F.col("created_at") + F.col("session_id") * 7).alias("document_id"))
    return sessions.nulled(rows, _table(spark, sf_dir, "documents").filter("lang = 'de'"), "document_id", "doc_id")


@query("""SELECT session_id, arg_max(role, (created_at, n)) AS role, max(created_at) AS created_at FROM (
SELECT conv_id AS session_id, turn AS created_at, role, 0 AS n FROM conversations UNION ALL SELECT conv_id, turn + 1, upper(role), 1 FROM conversations WHERE conv_id % 2 = 0) GROUP BY session_id""")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _messages(spark, sf_dir).select("session_id", "created_at", "role")
    new = base.filter("session_id % 2 = 0").select("session_id", (F.col("created_at") + 1).alias("created_at"), F.upper("role").alias("role"))
    return sessions.upserted(base, new, ["session_id"], "created_at")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'flagged' END, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def patch_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("source"))
    return sessions.patched(_table(spark, sf_dir, "documents").select("doc_id", "source"), patch, "doc_id", ["source"])


@query("""SELECT conv_id AS id, max(turn) AS updated FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 ORDER BY updated DESC, id LIMIT 30""")
def sidebar_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("updated"), F.count_if(F.col("role") == "user").alias("questions"))
    return sessions.sidebar(rows, 30).select("id", "updated")


@query("SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 200")
def tombstones_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.kept_tombstones(_table(spark, sf_dir, "events").filter("event_type = 'error'"), "ts", "user_id")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label"))
    return asked, rows


_COSINE_SQL = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_PAIRS_SQL = f"p AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS q_label, {_COSINE_SQL} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"
_TOP_SQL = "SELECT query_id, vec_id, round(s, 6) AS score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM p {where})"


@query(f"WITH {_PAIRS_SQL} {_TOP_SQL.format(where='')} WHERE n <= 5")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = _vectors(spark, sf_dir)
    found = retrieval.by_vector(asked.drop("label"), rows, "query_id", "vec_id")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_PAIRS_SQL} {_TOP_SQL.format(where='WHERE s >= 0.3')} WHERE n <= 5")
def vec_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = _vectors(spark, sf_dir)
    found = retrieval.by_vector(asked.drop("label"), rows, "query_id", "vec_id", least=0.3)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_PAIRS_SQL} {_TOP_SQL.format(where='WHERE label = q_label')} WHERE n <= 5")
def vec_topk_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = _vectors(spark, sf_dir)
    found = retrieval.by_vector(asked, rows, "query_id", "vec_id", same=["label"])
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_PAIRS_SQL} {_TOP_SQL.format(where='')} WHERE n <= CASE query_id // 20 % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 12 ELSE 5 END")
def vec_topk_adaptive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = _vectors(spark, sf_dir)
    intent = F.element_at(F.array(*map(F.lit, ("overview", "papers", "curriculum", "none"))), (F.floor(F.col("query_id") / 20) % 4 + 1).cast("int"))
    found = retrieval.by_vector(asked.drop("label"), rows, "query_id", "vec_id", k=retrieval.limit_for(intent))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_PAIRS_SQL}, m AS (SELECT *, query_id // 20 % 13 AS pool FROM p), f AS (SELECT * FROM m WHERE label = pool OR pool NOT IN (SELECT label FROM embeddings))
SELECT query_id, vec_id, round(s, 6) AS score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM f) WHERE n <= 5""")
def pool_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = _vectors(spark, sf_dir)
    scoped = asked.drop("label").withColumn("label", (F.floor(F.col("query_id") / 20) % 13).cast("int"))
    found = retrieval.in_pool(scoped, rows, "query_id", "vec_id", "label")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


_TOKENS_SQL = "list_distinct(list_transform(regexp_extract_all({x}, '([A-Za-z][A-Za-z0-9+#-]*)', 1), lambda w: lower(w)))"
_OVERLAP_SQL = f"""q AS (SELECT item_id AS query_id, unnest({_TOKENS_SQL.format(x='text')}) AS w FROM benchmark),
r AS (SELECT doc_id, unnest({_TOKENS_SQL.format(x='text')}) AS w FROM documents),
c AS (SELECT query_id, doc_id, count(*) AS s FROM q JOIN r USING (w) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS n FROM c)"""


@query(f"WITH {_OVERLAP_SQL} SELECT query_id, doc_id, s::DOUBLE AS score, n AS rank FROM o WHERE n <= 5")
def token_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.by_tokens(_asked(spark, sf_dir), _table(spark, sf_dir, "documents").select("doc_id", "text"), "query_id", "doc_id")
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_GRAMS_SQL = """q AS (SELECT item_id AS query_id, list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substring(lower(text), i, 3))) AS g FROM benchmark),
r AS (SELECT doc_id, list_distinct(list_concat(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substring(lower(text), i, 3)), list_transform(range(1, greatest(length(doc_id::VARCHAR) - 2, 1) + 1), lambda i: substring(doc_id::VARCHAR, i, 3)))) AS g FROM documents),
c AS (SELECT query_id, doc_id, count(*) / any_value(size) AS s FROM (SELECT query_id, len(g) AS size, unnest(g) AS w FROM q) JOIN (SELECT doc_id, unnest(g) AS w FROM r) USING (w) GROUP BY query_id, doc_id)"""


@query(f"""WITH {_GRAMS_SQL}
SELECT query_id, doc_id, round(s, 6) AS score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS n FROM c) WHERE n <= 5""")
def ngram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.by_ngrams(_asked(spark, sf_dir), _table(spark, sf_dir, "documents").select("doc_id", "text"), "query_id", "doc_id")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_PAIRS_SQL}, {_GRAMS_SQL}, v AS (SELECT query_id, vec_id AS id, s FROM p WHERE s >= 0.6 AND vec_id <> query_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS n FROM c),
g AS (SELECT a.vec_id AS query_id, doc_id AS id, s FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) a JOIN o ON o.query_id = a.vec_id // 20 WHERE n <= 5 AND a.vec_id NOT IN (SELECT query_id FROM v)),
u AS (SELECT *, 0 AS stage FROM v UNION ALL SELECT *, 1 FROM g) SELECT query_id, id, stage, round(s, 6) AS score FROM u""")
def retrieval_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are near enough, else character n-grams of the question over the texts."""
    asked, rows = _vectors(spark, sf_dir)

    def near(queries: DataFrame) -> DataFrame:
        found = retrieval.by_vector(queries, rows, "query_id", "vec_id", k=None, least=0.6).filter("vec_id <> query_id")
        return found.select("query_id", F.col("vec_id").alias("id"), "score")

    def grams(queries: DataFrame) -> DataFrame:
        items = _table(spark, sf_dir, "benchmark").select((F.col("item_id") * 20).alias("query_id"), F.col("text").alias("question"))
        questions = items.join(queries.select("query_id"), "query_id", "left_semi")
        found = retrieval.by_ngrams(questions, _table(spark, sf_dir, "documents").select("doc_id", "text"), "query_id", "doc_id")
        return found.select("query_id", F.col("doc_id").alias("id"), "score")

    found = retrieval.first_with_result(asked.drop("label"), [near, grams], "query_id")
    return found.select("query_id", "id", "stage", F.round("score", 6).alias("score"))


#: Ids as a note's would be: a name by the language, an institute's own or not.
_ID_SQL = "CASE lang WHEN 'fr' THEN 'Tin-' WHEN 'de' THEN 'cse-y' WHEN 'es' THEN 'plan-' ELSE 'institute-' END || doc_id"
PARTS = {"faculty": ["tin", "zar"], "courses": ["cse", "ece"], "campus": ["institute"]}
TITLES = {"faculty": "Faculty:", "campus": "Campus:", "courses": "Courses:"}


@query(f"""WITH {_OVERLAP_SQL}, s AS (SELECT query_id, doc_id, n, text, {_ID_SQL} AS id FROM o JOIN documents USING (doc_id) WHERE n <= 8),
f AS (SELECT *, count(*) FILTER (starts_with(id, 'institute-')) OVER (PARTITION BY query_id) AS own FROM s),
k AS (SELECT *, CASE WHEN contains(lower(id), 'tin') OR contains(lower(id), 'zar') THEN 'faculty' WHEN contains(lower(id), 'cse') OR contains(lower(id), 'ece') THEN 'courses' ELSE 'campus' END AS specialist FROM f WHERE query_id % 3 <> 0 OR own = 0 OR starts_with(id, 'institute-')),
w AS (SELECT *, CASE query_id % 4 WHEN 1 THEN specialist = 'faculty' WHEN 2 THEN specialist IN ('courses', 'campus') ELSE true END AS fits FROM k), a AS (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS any_fits FROM w)
SELECT query_id, doc_id, specialist, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT any_fits THEN 0 WHEN specialist = 'faculty' THEN 0 WHEN specialist = 'campus' THEN 1 ELSE 2 END, n) AS position,
md5(CASE WHEN any_fits THEN CASE specialist WHEN 'faculty' THEN 'Faculty:' WHEN 'campus' THEN 'Campus:' ELSE 'Courses:' END || chr(10) || text ELSE text END) AS digest FROM a WHERE fits OR NOT any_fits""")
def specialist_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by specialist: an overview's own rows, wanted specialists only, titles; unchanged where nothing would be left."""
    docs = _table(spark, sf_dir, "documents")
    lead = F.when(F.col("lang") == "fr", "Tin-").when(F.col("lang") == "de", "cse-y").when(F.col("lang") == "es", "plan-").otherwise("institute-")
    named = docs.select("doc_id", "text", F.concat(lead, F.col("doc_id").cast("string")).alias("id"))
    found = retrieval.by_tokens(_asked(spark, sf_dir), docs.select("doc_id", "text"), "query_id", "doc_id", k=8).join(named, "doc_id")
    routes = F.when(F.col("query_id") % 4 == 1, F.array(F.lit("faculty"))).when(F.col("query_id") % 4 == 2, F.array(F.lit("courses"), F.lit("campus"))).otherwise(F.array().cast("array<string>"))
    about = (F.col("query_id") % 3 != 0) | F.startswith("id", F.lit("institute-"))
    rows = retrieval.regrouped(found.withColumn("routes", routes), "query_id", retrieval.specialist_of(F.col("id"), PARTS, "campus"), ["faculty", "campus", "courses"], "routes", about, TITLES)
    return rows.select("query_id", "doc_id", "specialist", F.col("position").cast("long").alias("position"), F.md5("text").alias("digest"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"
_TRIMMED = f"trim({{x}}, {_BLANKS})"
#: Hints of the queries on synthetic texts; real ones are the caller's.
HINTS = {"license": ["license", "apache"], "contact": ["@mail", "token ="], "junk": ["!!", "###", " | "]}


@query("SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), '!!') AS hit FROM documents")
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", t.contains_any(F.col("text"), ["LICENSE", "!!"]).alias("hit"))


_LABELS_SQL = """list_filter([CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'apache') THEN 'license' END,
CASE WHEN contains(lower(text), '@mail') OR contains(lower(text), 'token =') THEN 'contact' END,
CASE WHEN contains(lower(text), '!!') OR contains(lower(text), '###') OR contains(lower(text), ' | ') THEN 'junk' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT doc_id, array_to_string({_LABELS_SQL}, ',') AS labels, {_LABELS_SQL}[1] AS first_label FROM documents")
def multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(routing.labels(text, HINTS), ",").alias("labels"), routing.first_label(text, HINTS).alias("first_label"))


def _profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, i, hint) for i, (name, hints) in enumerate(HINTS.items()) for hint in hints], "profile string, ordinal int, hint string")


@query(f"SELECT doc_id, {_LABELS_SQL}[1] AS profile FROM documents WHERE len({_LABELS_SQL}) > 0")
def first_match_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.first_profile(_table(spark, sf_dir, "documents"), _profiles(spark), "doc_id")


@query(f"SELECT doc_id, array_to_string({_LABELS_SQL}, ',') AS profiles FROM documents WHERE len({_LABELS_SQL}) > 0")
def all_match_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.all_profiles(_table(spark, sf_dir, "documents"), _profiles(spark), "doc_id")
    return rows.select("doc_id", F.array_join("profiles", ",").alias("profiles"))


@query(f"""SELECT doc_id, md5(CASE WHEN len({_LABELS_SQL}) > 0 THEN {_TRIMMED.format(x='text')} || chr(10) || array_to_string(list_transform({_LABELS_SQL}, lambda x: 'about ' || x), ' ') ELSE {_TRIMMED.format(x='text')} END) AS digest FROM documents""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(name, f"about {name}") for name in HINTS], "profile string, terms string")
    rows = routing.expanded(_table(spark, sf_dir, "documents").select("doc_id", "text"), _profiles(spark), terms, "doc_id")
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query("""WITH v AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(text, '\\w+'), lambda w: length(w) >= 6)) AS hint FROM benchmark)
SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n, min(item_id) AS first FROM documents d JOIN v ON contains(d.text, v.hint) OR contains(lower(d.text), v.hint) GROUP BY doc_id""")
def hint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of the longer words of a benchmark item in them: a table of hints that grows with the data."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))
    hints = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("profile"), F.col("item_id").alias("ordinal"), words.alias("hint")).filter(F.length("hint") >= 6)
    found = routing.matched_profiles(_table(spark, sf_dir, "documents"), hints, "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("profile").alias("first"))


_SEEKS = ["paper", "the the", "ence"]


@query(f"""WITH t AS (SELECT conv_id, turn, trim(text, {_BLANKS}) AS q, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS h FROM conversations),
p AS (SELECT * FROM (VALUES ('a', 0, 'ention', 'about a'), ('a', 0, 'icht', 'about a'), ('b', 1, 'that', 'about b'), ('b', 1, 'Que la', 'about b'), ('c', 2, 'hablar', 'about c')) AS p(profile, ordinal, hint, terms)),
o AS (SELECT conv_id, turn, string_agg(terms, ' ' ORDER BY ordinal) AS own FROM (SELECT DISTINCT conv_id, turn, profile, ordinal, terms FROM t JOIN p ON contains(q, hint) OR contains(lower(q), hint)) GROUP BY ALL),
e AS (SELECT conv_id, turn, string_agg(terms, ' ' ORDER BY ordinal) AS earlier FROM (SELECT DISTINCT conv_id, turn, profile, ordinal, terms FROM t JOIN p ON contains(trim(h, {_BLANKS}), hint) OR contains(lower(trim(h, {_BLANKS})), hint)) GROUP BY ALL),
s AS (SELECT t.*, own, earlier, contains(lower(q), 'paper') OR contains(lower(q), 'the the') OR contains(lower(q), 'ence') AS seeks, contains(lower(q), 'then') OR (length(q) > 0 AND length(q) <= 48) AS follows, q || coalesce(chr(10) || own, '') AS base FROM t LEFT JOIN o USING (conv_id, turn) LEFT JOIN e USING (conv_id, turn))
SELECT conv_id, turn, md5(CASE WHEN own IS NOT NULL THEN base || CASE WHEN seeks THEN chr(10) || 'research papers' ELSE '' END WHEN earlier IS NOT NULL AND (follows OR seeks) THEN base || chr(10) || earlier || CASE WHEN seeks THEN ' papers of the thread' ELSE '' END ELSE base END) AS digest FROM s""")
def thread_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the terms of the profiles that they, or the turns before, name."""
    hints = spark.createDataFrame([("a", 0, "ention"), ("a", 0, "icht"), ("b", 1, "that"), ("b", 1, "Que la"), ("c", 2, "hablar")], "profile string, ordinal int, hint string")
    terms = spark.createDataFrame([(p, f"about {p}") for p in "abc"], "profile string, terms string")
    earlier = F.array_join(F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), "\n")
    turns = _table(spark, sf_dir, "conversations").withColumn("history", earlier).withColumn("at", F.concat_ws(":", "conv_id", "turn"))
    rows = routing.expanded(turns, hints, terms, "at", followup=["then"], research=_SEEKS, added=("research papers", "papers of the thread"))
    return rows.select("conv_id", "turn", F.md5("text").alias("digest"))


PRIMARY, PROGRAMMING = ["explain", "what"], ["code", "python", "function"]


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.col("role") == "user", F.col("text"))
    return _table(spark, sf_dir, "conversations").withColumn("route", routing.rule_route(F.coalesce(user, F.lit("")), F.lit(""), PRIMARY, PROGRAMMING))


_ROUTE_SQL = """r AS (SELECT *, CASE WHEN role <> 'user' THEN NULL WHEN regexp_matches(lower(text), 'explain|what') THEN 'domain' WHEN regexp_matches(lower(text), 'code|python|function') THEN 'programming' END AS route FROM conversations)"""
_INHERIT_SQL = "last_value(route IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {_ROUTE_SQL} SELECT conv_id, turn, route FROM r")
def rule_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("conv_id", "turn", "route")


@query(f"WITH {_ROUTE_SQL} SELECT conv_id, turn, {_INHERIT_SQL} AS inherited FROM r")
def thread_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.inherited(_routed(spark, sf_dir), "conv_id", "turn", "route").select("conv_id", "turn", "inherited")


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'more|that') OR length(trim(text)) BETWEEN 1 AND 48 AS followup FROM conversations")
def followup_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.is_followup(F.col("text"), ["more", "that"]).alias("followup"))


@query(f"""WITH {_ROUTE_SQL}, i AS (SELECT *, {_INHERIT_SQL} AS inherited FROM r)
SELECT conv_id, turn, CASE WHEN coalesce(route, inherited) = 'programming' THEN 'programming' WHEN coalesce(route, inherited) = 'domain' OR turn % 2 = 1 THEN 'domain' ELSE 'programming' END AS final FROM i""")
def final_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.inherited(_routed(spark, sf_dir), "conv_id", "turn", "route")
    route = routing.resolved(F.lit(True), F.col("route"), F.col("inherited"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False), F.lit(False))
    return rows.select("conv_id", "turn", routing.final_route(route, F.col("inherited"), F.col("turn") % 2).alias("final"))


@query("""SELECT conv_id, turn, md5(trim(CASE WHEN p2 <> '' THEN p2 || ' ' ELSE '' END || CASE WHEN p1 <> '' THEN p1 || ' ' ELSE '' END || q)) AS digest FROM (
SELECT conv_id, turn, q, coalesce(lag(q, 1) OVER w, '') AS p1, coalesce(lag(q, 2) OVER w, '') AS p2 FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim(text) ELSE '' END AS q FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def retrieve_query_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").withColumn("question", F.when(F.col("role") == "user", F.col("text")))
    return context.retrieval_query(rows, "conv_id", "turn", "question").select("conv_id", "turn", F.md5("query").alias("digest"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_question FROM conversations""")
def last_user_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.last_question(_table(spark, sf_dir, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")))
    return rows.select("conv_id", "turn", "last_question")


@query("""SELECT source, doc_id, length(kept)::BIGINT AS n, md5(kept) AS digest FROM (SELECT source, doc_id, substring(text, 1, rest::INT) AS kept, rest FROM (
SELECT source, doc_id, text, 6000 - coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM documents WHERE trim(text) <> '') WHERE rest > 0)""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.budgeted(_table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")
    return rows.select("source", "doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("""SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN 'Student: ' ELSE 'Tutor: ' END || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.joined_lines(_table(spark, sf_dir, "conversations"), "conv_id", "turn", context.history_line(F.col("role"), F.col("text")))
    return rows.select("conv_id", F.md5("lines").alias("digest"))


@query("SELECT doc_id, md5('- (' || doc_id || ') ' || text || ' [sources: ' || source || ', ' || lang || ']') AS digest FROM documents")
def chunk_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = context.chunk_line(F.col("doc_id"), F.col("text"), F.array("source", "lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(line).alias("digest"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = F.when(t.contains_any(F.col("text"), HINTS["junk"]), 0).otherwise(1)
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").cast("int").alias("gold"), pred.alias("pred"))


_PRED_SQL = "e AS (SELECT l.quality AS gold, CASE WHEN regexp_matches(text, '!!|###| \\| ') THEN 0 ELSE 1 END AS pred FROM documents JOIN labels l USING (doc_id))"


@query(f"WITH {_PRED_SQL} SELECT round(coalesce(avg((gold = pred)::INT), 0), 6) AS accuracy FROM e")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_predicted(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_PRED_SQL}, g AS (SELECT * FROM (VALUES (0), (1), (2)) x(gold), (VALUES (0), (1), (2)) y(pred)) SELECT gold, pred, count(e.gold)::BIGINT AS n FROM g LEFT JOIN e USING (gold, pred) GROUP BY gold, pred")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predicted(spark, sf_dir), [0, 1, 2])


@query(f"""WITH {_PRED_SQL}, c AS (SELECT k, count(*) FILTER (gold = k AND pred = k) AS tp, count(*) FILTER (gold <> k AND pred = k) AS fp, count(*) FILTER (gold = k AND pred <> k) AS fn FROM e, (VALUES (0), (1), (2)) v(k) GROUP BY k)
SELECT round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM c""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_f1(_predicted(spark, sf_dir), [0, 1, 2]).select(F.round("macro_f1", 6).alias("macro_f1"))


_GOLD_SQL = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    found = occurring(docs, asked.select(F.col("query_id").alias("pattern_id"), F.col("question").alias("pattern")), "doc_id", "text", fold_case=False)
    all_ = docs.filter("text is not null").crossJoin(F.broadcast(asked.filter("question = ''").select("query_id")))  # an empty question is in every text
    return found.select(F.col("pattern_id").alias("query_id"), "doc_id").unionByName(all_.select("query_id", "doc_id"))


@query(f"""WITH {_OVERLAP_SQL}, {_GOLD_SQL}, b AS (SELECT query_id, min(n) AS best FROM o JOIN gold USING (query_id, doc_id) WHERE n <= 10 GROUP BY query_id)
SELECT query_id, CASE WHEN best <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall, round(coalesce(1 / best, 0), 6) AS reciprocal FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN b USING (query_id)""")
def recall_and_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.by_tokens(_asked(spark, sf_dir), _table(spark, sf_dir, "documents").select("doc_id", "text"), "query_id", "doc_id", k=10)
    rows = metrics.ranking(_gold(spark, sf_dir), ranked, "query_id", "doc_id")
    return rows.select("query_id", "recall", F.round("reciprocal", 6).alias("reciprocal"))


@query("SELECT item_id, CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'er') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em FROM benchmark")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", metrics.exact_match(F.col("text"), F.array(F.lit("The"), F.lit("ER"))).alias("em"))


_COUNT_SQL = "SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower({x}), '([A-Za-z0-9]+)', 1)) AS w FROM documents) GROUP BY ALL"


@query(f"""WITH a AS ({_COUNT_SQL.format(x='text')}), g AS ({_COUNT_SQL.format(x="replace(text, 'er', 'or')")}),
f AS (SELECT doc_id, sum(least(coalesce(a.n, 0), coalesce(g.n, 0))) AS b, coalesce(sum(a.n), 0) + coalesce(sum(g.n), 0) AS s FROM a FULL JOIN g USING (doc_id, w) GROUP BY doc_id)
SELECT doc_id, round(coalesce(2 * b / s, 0), 6) AS f1 FROM documents LEFT JOIN f USING (doc_id)""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer"), F.replace("text", F.lit("er"), F.lit("or")).alias("gold"))
    return metrics.token_f1(rows, "doc_id", "answer", "gold").select("doc_id", F.round("f1", 6).alias("f1"))


#: A text with code in it, and the same text without: the script is that of accented Latin letters here, as no text has another.
_CODED = "'`an inline' || chr(10) || 'command` ' || text || chr(10) || '```py' || chr(10) || 'printing = 1' || chr(10) || '``` ' || CASE WHEN doc_id % 3 = 0 THEN 'ende! ' ELSE '' END"
_UNCODED = f"regexp_replace(regexp_replace({_CODED}, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g')"


@query(f"""WITH b AS (SELECT doc_id, {_UNCODED} AS t FROM documents), c AS (SELECT *, length(regexp_replace(t, '[^éèêçäöüßñíó]', '', 'g')) AS own, length(regexp_replace(t, '\\s+', '', 'g')) AS size FROM b)
SELECT doc_id, round(own / greatest(size, 1), 4) AS share, CASE WHEN own = 0 THEN 1 ELSE round(least(len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{4,}}'))) / greatest(own / 8, 1), 1), 4) END AS mix,
doc_id % 3 = 0 AS ended FROM c""")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells the language of an answer: a script's share, the mix with Latin words, and how it ends; code aside."""
    lead, code = F.lit("`an inline\ncommand` "), F.lit("\n```py\nprinting = 1\n``` ")
    text = F.concat(lead, "text", code, F.when(F.col("doc_id") % 3 == 0, "ende! ").otherwise(""))
    letters = "éèêçäöüßñíó"
    return _table(spark, sf_dir, "documents").select("doc_id", t.script_share(text, letters).alias("share"), t.mix_penalty(text, letters).alias("mix"), t.ends_with(text, "!").alias("ended"))


@query("""SELECT doc_id, doc_id || '-' || (i + 1) AS chunk_id, md5(substring(body, i * 1500 + 1, 1500)) AS digest FROM (
SELECT doc_id, body, unnest(range(0, ((length(body) - 1) // 1500) + 1)) AS i FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents) WHERE body <> '')""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.chunked(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "chunk_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, sha256(text) AS full_key, substring(sha256(source || chr(10) || lang), 1, 32) AS short_key FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", t.content_key(F.col("text")).alias("full_key"), t.content_key(F.col("source"), F.col("lang"), length=32).alias("short_key"))


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("record_id"), "text")
    old = docs.filter("record_id % 5 <> 0").withColumn("text", F.when(F.col("record_id") % 7 == 0, F.lit("old")).otherwise(F.col("text")))
    return old.withColumn("content_hash", t.content_key(F.col("text"))), docs.filter("record_id % 11 <> 0")


_CDC_SQL = """o AS (SELECT source AS source_file, doc_id AS record_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0),
i AS (SELECT source AS source_file, doc_id AS record_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0)"""


@query(f"WITH {_CDC_SQL} SELECT source_file, record_id, CASE WHEN o.h IS NULL THEN 'insert' WHEN i.h IS NULL THEN 'delete' WHEN o.h = i.h THEN 'noop' ELSE 'update' END AS action, (i.h IS NOT NULL)::BIGINT AS copies FROM o FULL JOIN i USING (source_file, record_id)")
def cdc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.changes(*_store(spark, sf_dir), ["source_file", "record_id"]).drop("content_hash")


@query(f"WITH {_CDC_SQL} SELECT source_file, record_id, h AS content_hash FROM i")
def cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.applied(*_store(spark, sf_dir), ["source_file", "record_id"]).drop("text")


_URLS_SQL = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)https?://\\S+', ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"SELECT page_id, md5({_URLS_SQL.format(x='html')}) AS digest FROM pages")
def url_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(t.without_urls(F.col("html"))).alias("digest"))


_MARKDOWN_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '`([^`]+)`', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#*_>]+', ' ', 'g')"


@query(f"SELECT page_id, md5({_MARKDOWN_SQL.format(x='html')}) AS digest FROM pages")
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(t.without_markdown(F.col("html"))).alias("digest"))


@query("SELECT doc_id, md5(replace(replace(replace(text, 'tion', 'SHUN'), 'the', 'ze'), 'er', 'uh')) AS digest FROM documents")
def dictionary_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(t.replaced(F.col("text"), {"er": "uh", "the": "ze", "tion": "SHUN"})).alias("digest"))


_WORDS_SQL = "SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9]+)', 1)) AS token FROM documents"


@query(f"""SELECT token, count(*)::BIGINT AS n, CASE WHEN upper(token) IN ('I', 'V', 'X') THEN 'word' WHEN regexp_matches(upper(token), '^(X?(IX|IV|V?I{{0,3}})|XX)$') THEN 'roman'
WHEN regexp_matches(token, '^[A-Z][A-Z0-9]$|^[0-9][A-Z]$') THEN 'spell' WHEN regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]') THEN 'spell'
WHEN regexp_matches(token, '[a-z]') AND regexp_matches(token, '[A-Z]') AND length(token) >= 8 THEN 'spell' ELSE 'word' END AS kind FROM ({_WORDS_SQL}) GROUP BY token""")
def token_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).withColumn("kind", t.token_kind(F.col("token")))


@query("""SELECT before, token, count(*)::BIGINT AS n FROM (SELECT token, lag(token) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '([A-Za-z0-9]+)', 1) AS w FROM documents))) GROUP BY ALL""")
def prev_token_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_counted(_table(spark, sf_dir, "documents"), "text", "A-Za-z0-9")


@query("""WITH RECURSIVE c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM benchmark),
k AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(ch, '[a-zA-Z]') THEN 'latin' WHEN regexp_matches(ch, '\\p{L}') THEN 'other' END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY i), 'latin') AS kind FROM c),
n AS (SELECT *, coalesce((lag(kind) OVER (PARTITION BY item_id ORDER BY i) <> kind)::INT, 0) AS new FROM k), r AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY i) AS run FROM n)
SELECT item_id, run::INT AS run, any_value(kind) AS kind, string_agg(ch, '' ORDER BY i) AS text FROM r GROUP BY item_id, run""")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("char").rlike("[a-zA-Z]"), "latin").when(F.col("char").rlike(r"\p{L}"), "other")
    return layout.script_runs(_table(spark, sf_dir, "benchmark"), "item_id", "text", kind, "latin")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM (SELECT doc_id, word, min(i) AS i FROM (
SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '([a-z]+)', 1) AS w FROM documents)) GROUP BY doc_id, word) GROUP BY doc_id""")
def ordered_distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    return _table(spark, sf_dir, "documents").withColumn("_words", words).filter(F.size("_words") > 0).select("doc_id", F.md5(F.array_join("_words", " ")).alias("digest"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("at", "text"))
    return words.select("item_id", "at", F.lit(1).alias("page"), "text", (F.col("at") % 8 * 10.0).alias("x"), (F.floor(F.col("at") / 8) * 12.0).alias("y"), F.lit(9.0).alias("width"), F.lit(10.0).alias("height"))


_BOXES_SQL = """w AS (SELECT item_id, "at", text, ("at" % 8) * 10.0::DOUBLE AS x, ("at" // 8) * 12.0::DOUBLE AS y FROM (SELECT item_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS "at" FROM (SELECT item_id, regexp_extract_all(text, '([A-Za-z]+)', 1) AS l FROM benchmark)))"""


@query(f"""WITH {_BOXES_SQL} SELECT item_id, "at"::INT AS "at", ("at" // 8)::INT AS line FROM w""")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(_words(spark, sf_dir), ["item_id"], "at").select("item_id", "at", "line")


@query(f"""WITH {_BOXES_SQL} SELECT item_id, ("at" // 8)::INT AS line, arg_min(text, "at") AS text, min(x) AS x, min(y) AS y, max(x + 9) - min(x) AS width, max(y + 10) - min(y) AS height FROM w GROUP BY ALL""")
def merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.boxes(layout.lines(_words(spark, sf_dir), ["item_id"], "at"), ["item_id", "line"], "at")


#: Whole texts set in lines of 80 characters, 40 lines a page, a word where the characters before it put it.
_SET_SQL = """t AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS l FROM documents)),
o AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT - length(text) - 1 AS c FROM t),
w AS (SELECT doc_id, pos, text, (c // 3200)::INT AS page, (c % 80)::DOUBLE AS x, (c // 80 % 40 * 12)::DOUBLE AS y, length(text)::DOUBLE AS width, 10 + (doc_id % 3)::DOUBLE AS height FROM o),
d AS (SELECT doc_id, list(text ORDER BY pos) AS l FROM t GROUP BY doc_id),
terms AS (SELECT doc_id, 1 AS ordinal, l[3] || ' ' || l[4] AS term, 'a pair' AS definition FROM d UNION ALL SELECT doc_id, 2, translate(l[3] || '  ' || l[4], 'aeint', 'AEINT'), 'once more' FROM d
UNION ALL SELECT doc_id, 3, substring(l[7], 1, 2), 'a beginning' FROM d UNION ALL SELECT doc_id, 4, ' ' || array_to_string(l[9:9 + doc_id % 50], ' ') || ' ', 'a passage' FROM d UNION ALL SELECT doc_id, 5, substring(l[1], 1, 1), 'short' FROM d),
kept AS (SELECT doc_id, lower(trim(term)) AS id, arg_min(trim(term), ordinal) AS term, arg_min(definition, ordinal) AS definition, string_split_regex(lower(trim(term)), '\\s+') AS parts FROM terms WHERE length(trim(term)) >= 2 GROUP BY doc_id, lower(trim(term))),
p AS (SELECT doc_id, page, list(lower(text) ORDER BY pos) AS l, min(pos) AS first FROM w GROUP BY doc_id, page),
found AS (SELECT k.doc_id, k.id, any_value(k.term) AS term, any_value(k.definition) AS definition, any_value(len(k.parts)) AS n, min(p.first + i) AS start
  FROM kept k JOIN p USING (doc_id), unnest(range(len(p.l))) AS r(i) WHERE starts_with(p.l[i + 1], k.parts[1]) AND i + len(k.parts) <= len(p.l)
  AND len(list_filter(list_zip(p.l[i + 1:i + len(k.parts)], k.parts), lambda z: NOT starts_with(z[1], z[2]))) = 0 GROUP BY k.doc_id, k.id)"""


def _set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of documents in lines and pages, and terms of each document taken from its own text."""
    whole = _table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")  # texts move before they are words
    docs = whole.select("doc_id", F.filter(F.split("text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "").alias("l"))
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    words = docs.select("doc_id", F.posexplode("l").alias("at", "text")).withColumn("at", F.col("at") + 1)
    words = words.withColumn("c", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    words = words.select(
        "doc_id", "at", "text", F.floor(F.col("c") / 3200).cast("int").alias("page"), (F.col("c") % 80).cast("double").alias("x"), (F.floor(F.col("c") / 80) % 40 * 12).cast("double").alias("y"),
        F.length("text").cast("double").alias("width"), (10 + F.col("doc_id") % 3).cast("double").alias("height"),
    )
    word = lambda i: F.get("l", F.lit(i))
    made = [
        (F.concat(word(2), F.lit(" "), word(3)), "a pair"), (F.translate(F.concat(word(2), F.lit("  "), word(3)), "aeint", "AEINT"), "once more"), (F.substring(word(6), 1, 2), "a beginning"),
        (F.concat(F.lit(" "), F.array_join(F.slice("l", F.lit(9), (F.col("doc_id") % 50 + 1).cast("int")), " "), F.lit(" ")), "a passage"), (F.substring(word(0), 1, 1), "short"),
    ]
    each = F.array(*(F.struct(F.lit(k + 1).alias("ordinal"), term.alias("term"), F.lit(definition).alias("definition")) for k, (term, definition) in enumerate(made)))
    return words, docs.select("doc_id", F.explode(each).alias("t")).select("doc_id", "t.*")


@query(f"WITH {_SET_SQL} SELECT doc_id, id AS term, start::INT AS start, n::INT AS n FROM found")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each document's own terms, of 1 to 50 parts, among its words."""
    words, terms = _set(spark, sf_dir)
    kept = layout.distinct_terms(terms, ["doc_id"], "ordinal").select("doc_id", F.col("id").alias("term"), "parts")
    return layout.phrase_matches(words, kept, ["doc_id"], "at")


@query(f"""WITH {_SET_SQL}, m AS (SELECT f.doc_id, f.id, f.term, f.definition, w.* EXCLUDE (doc_id) FROM found f JOIN w ON w.doc_id = f.doc_id AND w.pos BETWEEN f.start AND f.start + f.n - 1),
b AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py, lag(height) OVER v AS ph FROM m WINDOW v AS (PARTITION BY doc_id, id ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN px IS NULL THEN 0 WHEN x + 2 < px OR ((height + ph) / 2 > 0 AND abs(y + height / 2 - py - ph / 2) > 0.35 * (height + ph) / 2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS line FROM b)
SELECT doc_id, term, definition, page, line::INT AS line, arg_min(text, pos) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM g GROUP BY doc_id, id, term, definition, page, line""")
def term_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each document's own terms, as first spelled and defined, a box for each line of the first match."""
    words, terms = _set(spark, sf_dir)
    return layout.annotations(words, terms, ["doc_id"], "at", "ordinal")


@query("SELECT DISTINCT user_id * 7 + event_id % 7 AS job FROM events WHERE event_type = 'click' AND user_id * 7 + event_id % 7 NOT IN (SELECT user_id * 7 + event_id % 7 FROM events WHERE event_type = 'purchase')")
def prefetch_scope_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that were begun and that no conversation in scope asks for."""
    events = _table(spark, sf_dir, "events").withColumn("job", F.col("user_id") * 7 + F.col("event_id") % 7)
    return status.out_of_scope(events.filter("event_type = 'click'").select("job").distinct(), events.filter("event_type = 'purchase'"), "job")


@query("SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type")
def inflight_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.once(_table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")


@query("SELECT user_id, max(ts) AS ts, max_by(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.latest(_table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.windowed(_table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS s FROM embeddings""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("s"))
