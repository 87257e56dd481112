"""Queries on what is stored and read again: notes, indexes, chat files, and what clients are shown of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import replies
from colloquy.functions import text as t
from colloquy.functions.materialize import shared_dir
from colloquy.operators import context, sessions, speech
from colloquy.plans.registry import query, table
from colloquy.sources import ingest

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH d AS (SELECT *, trim(text, {_WHITE}) AS body FROM documents WHERE trim(coalesce(text, ''), {_WHITE}) <> '')
SELECT id, category, md5(text) AS digest, sources FROM (
SELECT 'note-' || doc_id AS id, CASE WHEN lang = 'fr' THEN 'campus' ELSE 'faculty' END AS category, CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) ELSE '' END || body AS text, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source ELSE source || ',b' END AS sources FROM d WHERE lang IN ('fr', 'es') AND doc_id % 5 <> 4
UNION ALL SELECT 'page-' || doc_id || '-' || (i + 1), 'courses', substring(body, i * 1500 + 1, 1500), 'page-' || doc_id FROM d, unnest(range((length(body) + 1499) // 1500)) AS r(i) WHERE lang = 'de')""")
def notes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written as lines of JSON in two folders, some lines no notes, read again with the chunks of handouts."""
    root = _folder(spark, "notes")
    docs = table(spark, sf_dir, "documents")
    one, two = F.to_json(F.array("source")), F.to_json(F.array("source", F.lit("b"), F.lit(" ")))
    listed = F.when(F.col("doc_id") % 3 == 0, F.lit("[]")).when(F.col("doc_id") % 3 == 1, one).otherwise(two)
    plain = F.to_json(F.struct(F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("id"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("name")))
    line = F.concat(F.expr("substring(_plain, 1, length(_plain) - 1)"), F.lit(', "sources": '), listed, F.lit("}"))
    broken = F.when(F.col("doc_id") % 10 == 4, F.lit("[1, 2]")).when(F.col("doc_id") % 10 == 9, F.expr("substring(_plain, 1, length(_plain) - 1)")).otherwise(line)
    lines = docs.withColumn("_plain", plain).select(broken.alias("value"), "lang")
    for name, lang in (("faculty", "es"), ("campus", "fr")):
        lines.filter(F.col("lang") == lang).select("value").write.text(f"{root}/{name}")
        # files of lines are read by their ending
        context_ = spark.sparkContext
        place = context_._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        system = place.getFileSystem(context_._jsc.hadoopConfiguration())
        for status in system.listStatus(place):
            file = status.getPath()
            if file.getName().startswith("part-"):
                system.rename(file, context_._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{file.getName()}.jsonl"))
    handouts = docs.filter("lang = 'de'").select(F.concat(F.lit("page-"), F.col("doc_id").cast("string")).alias("source_file"), "text")
    found = ingest.categories(spark, root, ["faculty", "campus"], handouts)
    return found.select("id", "category", F.md5("text").alias("digest"), F.array_join("sources", ",").alias("sources"))


@query("SELECT vec_id::VARCHAR AS id, md5(text) AS digest, CASE WHEN vec_id % 2 = 0 THEN source ELSE '' END AS sources, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings JOIN documents ON doc_id = vec_id WHERE trim(coalesce(text, '')) <> ''")
def index_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents with their vectors, as it is read after it was written."""
    path = _folder(spark, "index")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    sources = F.when(F.col("doc_id") % 2 == 0, F.array("source"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", sources.alias("sources")).join(vectors.select("id"), "id", "left_semi")
    ingest.index_written(rows, vectors.join(rows.select("id"), "id", "left_semi"), "id", "model", path)
    found = ingest.index(spark, path, lines=True)
    return found.select("id", F.md5("text").alias("digest"), F.array_join("sources", ",").alias("sources"), F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH c AS (SELECT conv_id, max(turn) AS updated, count(*) FILTER (role = 'user' AND trim(text) <> '') AS asked FROM conversations GROUP BY conv_id), s AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE asked END AS turns FROM c WHERE conv_id % 10 <> 7)
SELECT conv_id::VARCHAR AS id, turns::BIGINT AS n FROM s WHERE turns > 0 UNION ALL (SELECT conv_id::VARCHAR, 0 FROM s WHERE turns = 0 ORDER BY updated DESC, conv_id::VARCHAR LIMIT 1)""")
def stores_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without the deleted ones, those that were asked something and one empty one, the latest."""
    turns = F.collect_list(F.when((F.col("role") == "user") & (F.trim("text") != "") & (F.col("conv_id") % 3 != 0), F.col("text")))
    every = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"), turns.alias("turns")).withColumn("id", F.col("conv_id").cast("string"))
    rest = sessions.finalized(every, every.filter("conv_id % 10 = 7").select("id"))
    return rest.select("id", F.size("turns").cast("long").alias("n"))


@query("""WITH m AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS last FROM conversations GROUP BY conv_id) SELECT conv_id AS id, 'Chat ' || conv_id AS title, CASE WHEN conv_id % 4 = 0 THEN 'closed' ELSE 'open' END AS status, conv_id % 5 AS owner_id, last AS last_user_message_at FROM m""")
def sessions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a client reads them."""
    turns = table(spark, sf_dir, "conversations")
    held = turns.select("conv_id").distinct().select(
        F.col("conv_id").alias("session_id"), F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("conv_id") % 4 == 0, "closed").otherwise("open").alias("status"),
        (F.col("conv_id") % 5).alias("owner_id"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    last = turns.filter("role = 'user'").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("last_user_message_at"))
    return sessions.session_read(held, last).drop("created_at")


@query(f"""SELECT conv_id, turn, md5(regexp_replace(trim(CASE turn % 3 WHEN 0 THEN 'ဗျာ၊ ရှင် ' WHEN 1 THEN ' ' || chr(10) ELSE '' END || text, {_WHITE}), '^((ခင်ဗျာ|ရှင်|ဗျာ)[၊, \\t\\n\\r]*)+', '')) AS body, CASE WHEN conv_id % 4 = 0 THEN 'own' WHEN contains(lower(text), 'die ') THEN 'b' WHEN contains(lower(text), 'the ') THEN 'a' ELSE 'base' END AS voice,
CASE WHEN length(t) = 0 THEN 'New chat' ELSE rtrim(substring(t, 1, 80), {_WHITE}) END AS title, CASE WHEN turn % 2 = 0 THEN CASE WHEN contains(lower(CASE WHEN length(t) = 0 THEN 'New chat' ELSE rtrim(substring(t, 1, 80), {_WHITE}) END), 'ing') THEN CASE WHEN length(t) = 0 THEN 'New chat' ELSE rtrim(substring(t, 1, 80), {_WHITE}) END ELSE 'Who is Dr. Ing' END ELSE CASE WHEN length(t) = 0 THEN 'New chat' ELSE rtrim(substring(t, 1, 80), {_WHITE}) END END AS corrected,
regexp_matches(text, '[A-Za-z]') AS latin FROM (SELECT *, trim(CASE WHEN ends_with(s, '.') THEN substring(s, 1, length(s) - 1) ELSE s END, {_WHITE}) AS t FROM (SELECT *, trim(trim(trim('"' || text || '" ', {_WHITE}), '"' || chr(39)), {_WHITE}) AS s FROM conversations))""")
def replies_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each turn: without courtesy before it, by whose voice, and the title that a model might give it."""
    text, turn = F.col("text"), F.col("turn")
    led = F.concat(F.when(turn % 3 == 0, "ဗျာ၊ ရှင် ").when(turn % 3 == 1, " \n").otherwise(""), text)
    own = F.when(F.col("conv_id") % 4 == 0, "own").otherwise("")
    title = t.generated_title(F.concat(F.lit('"'), text, F.lit('" ')))
    right = t.corrected_title(title, F.lit(""), F.when(turn % 2 == 0, F.lit("Dr. Ing")), F.lit(True))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(t.strip(t.leading_particles_off(led))).alias("body"), t.voice(own, text, F.lit("base"), {"b": ["die "], "a": ["the "]}).alias("voice"), title.alias("title"), right.alias("corrected"), t.has_latin(text).alias("latin"))


@query("""WITH p AS (SELECT doc_id, string_split(text, '. ') AS l FROM documents) SELECT doc_id, md5(array_to_string(l, CASE WHEN true THEN chr(31) END)) AS digest FROM (SELECT doc_id, list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i > 1 AND length(l[i]) <= 30 THEN chr(2) || l[i] ELSE l[i] END) AS l0, string_split(replace(array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i > 1 AND length(l[i]) <= 30 THEN chr(2) || l[i] ELSE CASE WHEN i > 1 THEN chr(3) ELSE '' END || l[i] END), ''), chr(2), ' '), chr(3)) AS l FROM p)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sentences joined to the one before, in whole texts."""
    parts = t.orphans_merged(F.split("text", r"\. "), lambda p: F.length(p) <= 30)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(parts, "\u001f")).alias("digest"))


_ENDED = "regexp_replace(text, '[.] ', '။ ရှင် ။ ', 'g') || '? ဗျာ! ခင်ဗျာ ။'"


@query(f"WITH RECURSIVE r AS (SELECT doc_id, 0 AS k, {_ENDED} AS t FROM documents UNION ALL SELECT doc_id, k + 1, regexp_replace(t, '[။?!]\\s+(ခင်ဗျာ|ရှင်|ဗျာ)\\s*([။?!])', ' \\1\\2', 'g') FROM r WHERE regexp_matches(t, '[။?!]\\s+(ခင်ဗျာ|ရှင်|ဗျာ)\\s*([။?!])')) SELECT doc_id, md5(arg_max(t, k)) AS digest FROM r GROUP BY doc_id")
def courtesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of courtesy that stand alone made the ends of the sentences before them, until none is left."""
    ended = F.concat(F.regexp_replace("text", "[.] ", "။ ရှင် ။ "), F.lit("? ဗျာ! ခင်ဗျာ ။"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.courtesy_joined(ended)).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN md5(text || chr(10) || chr(10) || lang) ELSE md5(text) END AS seen, CASE WHEN doc_id % 3 = 0 THEN 'b:3' ELSE 'a:1,b:2' END AS overlay FROM documents""")
def documents_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptions of a document's images, failures left out; and a later map laid over an earlier one."""
    k = F.col("doc_id") % 4
    seen = F.array(F.when(k > 0, F.col("text")), F.lit(None).cast("string"), F.when(k == 1, F.col("lang")))
    third = F.col("doc_id") % 3 == 0
    base = F.when(third, F.create_map(F.lit("b"), F.lit(2))).otherwise(F.create_map(F.lit("a"), F.lit(1)))
    laid = speech.overlaid(base, F.create_map(F.lit("b"), F.when(third, 3).otherwise(2)))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(laid)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(replies.descriptions(seen)).alias("seen"), shown.alias("overlay"))


@query("""WITH e AS (SELECT c_custkey, c_name, CASE c_custkey % 5 WHEN 0 THEN 'honorific' WHEN 1 THEN 'person_name' WHEN 2 THEN 'word' WHEN 3 THEN 'person_name' ELSE 'honorific' END AS kind, CASE c_custkey % 5 WHEN 0 THEN 'Dr.' WHEN 4 THEN 'Sir' ELSE c_name END AS source FROM customer)
SELECT source, max(c_custkey)::VARCHAR AS value FROM e WHERE (kind = 'honorific' AND source = 'Dr.') OR (kind = 'person_name' AND c_custkey % 4 = 1 AND c_custkey % 16 <> 1 AND c_custkey <= 400) GROUP BY source""")
def lexicon_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model says of names and titles, of which the lexicon keeps honorifics and known people that it does not have."""
    people = table(spark, sf_dir, "customer")
    fifth = F.col("c_custkey") % 5
    kind = F.element_at(F.array(*map(F.lit, ("honorific", "person_name", "word", "person_name", "honorific"))), (fifth + 1).cast("int"))
    source = F.when(fifth == 0, " Dr. ").when(fifth == 4, "Sir").otherwise(F.col("c_name"))
    said = people.select(source.alias("source"), F.col("c_custkey").cast("string").alias("spoken"), kind.alias("kind"), "c_custkey")
    known = [f"Customer#{k:09d}" for k in range(1, 401, 4)]
    lexicon = people.filter("c_custkey % 16 = 1").select(F.col("c_name").alias("source"), F.lit("x").alias("value"))
    kept = speech.accepted_entries(said, lexicon, known, ["Dr"], ["Dr", "Dr."])
    return kept.groupBy("source").agg(F.max(F.col("value").cast("long")).cast("string").alias("value"))


@query("SELECT conv_id, count(DISTINCT style)::BIGINT AS n, bool_and(style IN ('calm', 'warm', 'brief')) AS known FROM (SELECT conv_id, 'calm' AS style FROM conversations) GROUP BY conv_id")
def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of a conversation's answers, one of three and always the same."""
    picked = context.picked(F.col("conv_id"), ["calm", "warm", "brief"])
    rows = table(spark, sf_dir, "conversations").select("conv_id", picked.alias("style"))
    return rows.groupBy("conv_id").agg(F.countDistinct("style").alias("n"), F.bool_and(F.col("style").isin("calm", "warm", "brief")).alias("known"))
