"""Queries on text made ready for speech, and on what services reply."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import replies
from colloquy.functions import text as t
from colloquy.functions.materialize import written
from colloquy.functions.vectors import literal
from colloquy.operators import speech
from colloquy.plans.registry import query, table
from colloquy.sources import ingest

_STRIP = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))"
_URLS = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)https?://\\S+', ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_MARKDOWN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '`([^`]+)`', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#*_>]+', ' ', 'g')"
#: Text with nested parentheses, tables and lists: the source's and language's names around the whole text.
_SPOKEN = "'## ' || source || chr(10) || '| ' || lang || ' | a  b |' || chr(10) || '|---|:--|' || chr(10) || '* see (a (b (c)) ' || lang || ') `x y` at [' || source || '](http://x.org/a) now. ' || coalesce(text, '')"
#: The fixpoint of taking out the innermost parentheses, by recursion.
_BARE = """{src} , r AS (SELECT doc_id, 0 AS k, t FROM src UNION ALL SELECT doc_id, k + 1, regexp_replace(t, '\\([^()]*\\)', ' ', 'g') FROM r WHERE regexp_matches(t, '\\([^()]*\\)')),
bare AS (SELECT doc_id, arg_max(t, k) AS t FROM r GROUP BY doc_id)"""


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("## "), "source", F.lit("\n| "), "lang", F.lit(" | a  b |\n|---|:--|\n* see (a (b (c)) "), "lang", F.lit(") `x y` at ["), "source", F.lit("](http://x.org/a) now. "), F.coalesce("text", F.lit(""))
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"WITH RECURSIVE {_BARE.format(src=f'src AS (SELECT doc_id, {_SPOKEN} AS t FROM documents)')} SELECT doc_id, md5(t) AS digest FROM bare")
def nested_parentheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoken(spark, sf_dir).select("doc_id", F.md5(t.without_parentheses(F.col("text"))).alias("digest"))


_SENTENCES = """regexp_replace(regexp_replace(regexp_replace({x}, '([။?!])', '\\1' || chr(1), 'g'), '(^|[^A-Za-z])\\.([\\s\\x1c-\\x1f]|$)', '\\1.' || chr(1) || '\\2', 'g'), '([A-Za-z]{{4}})\\.([\\s\\x1c-\\x1f]|$)', '\\1.' || chr(1) || '\\2', 'g')"""
_SQUEEZED = _STRIP.format(x="regexp_replace({x}, '[ \\t]+', ' ', 'g')")


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({_SENTENCES.format(x="coalesce(text, '')")}, chr(1)), lambda p: {_SQUEEZED.format(x='p')}), lambda p: p <> '') AS parts FROM documents)
SELECT doc_id, len(parts)::BIGINT AS n, md5(array_to_string(parts, chr(10))) AS digest FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.sentences(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n"), F.md5(F.array_join("parts", "\n")).alias("digest"))


_LINE = f"""CASE WHEN contains(p, '-') AND regexp_matches({_STRIP.format(x='p')}, '^\\|?[\\s:|-]+\\|?$') THEN []
WHEN regexp_matches({_STRIP.format(x='p')}, '^\\|.*\\|') THEN list_filter([array_to_string(list_filter(list_transform(string_split(p, '|'), lambda c: {_SQUEEZED.format(x='c')}), lambda c: c <> ''), '၊ ')], lambda c: c <> '')
ELSE list_filter(list_transform(string_split({_SENTENCES.format(x='p')}, chr(1)), lambda c: {_SQUEEZED.format(x='c')}), lambda c: c <> '') END"""


@query(f"""WITH RECURSIVE {_BARE.format(src=f"src AS (SELECT doc_id, {_MARKDOWN.format(x=_SPOKEN)} AS t FROM documents)")},
p AS (SELECT doc_id, flatten(list_transform(string_split(t, chr(10)), lambda p: {_LINE})) AS parts FROM bare) SELECT doc_id, len(parts)::BIGINT AS n, md5(array_to_string(parts, chr(30))) AS digest FROM p""")
def speech_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spoken(spark, sf_dir).select("doc_id", t.phrases(F.col("text")).alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n"), F.md5(F.array_join("parts", t.PAUSE)).alias("digest"))


_ASIDE = "regexp_replace(regexp_replace({x}, '[(（][^()（）]*[)）]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g')"


@query(f"""WITH RECURSIVE {_BARE.format(src=f"src AS (SELECT doc_id, {_MARKDOWN.format(x=_STRIP.format(x='regexp_replace(' + 'regexp_replace(' + _ASIDE.format(x=_URLS.format(x=_SPOKEN)) + ", '(?i)src1', 'source one', 'g')" + ", '[ \\t]{2,}', ' ', 'g')"))} AS t FROM documents)")},
p AS (SELECT doc_id, array_to_string(flatten(list_transform(string_split(t, chr(10)), lambda p: {_LINE})), chr(30)) AS t FROM bare)
SELECT doc_id, md5({_STRIP.format(x="substring(replace(replace(t, 'tion', 'SHUN'), 'the', 'ze'), 1, 4000)")}) AS digest FROM p""")
def speech_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with a fixed name, a lexicon from a table, and the cut."""
    lexicon = spark.createDataFrame([("the", "ze"), ("tion", "SHUN")], "source string, value string")
    rows = speech.answers_prepared(_spoken(spark, sf_dir), "doc_id", names=[("src1", "source one")], lexicon=lexicon)
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query("""WITH w AS (SELECT page_id, html, regexp_extract_all(html, '(?i)https?://\\S+') AS urls FROM pages), n AS (SELECT *, regexp_split_to_array(html, '(?i)https?://\\S+') AS parts FROM w)
SELECT page_id, md5(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: replace(replace(parts[i], 'tion', 'SHUN'), 'the', 'THE') || coalesce(urls[i], '')), '')) AS digest FROM n""")
def outside_url_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = t.outside_urls(F.col("html"), lambda part: t.replaced(part, {"the": "THE", "tion": "SHUN"}))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(changed).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.collapsed(F.col("text"))).alias("digest"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g')) AS digest FROM pages")
def code_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.without_code(F.col("html"))).alias("digest"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(source || ' ' || lang, ''), lambda c: CASE upper(c) WHEN 'S' THEN 'ess' WHEN 'R' THEN 'ar' WHEN 'C' THEN 'see' ELSE c END), ' ') AS spoken,
md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE upper(c) WHEN 'S' THEN 'ess' WHEN 'R' THEN 'ar' WHEN 'C' THEN 'see' ELSE c END), ' ')) AS digest FROM documents""")
def spell_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = {"S": "ess", "R": "ar", "C": "see"}
    return table(spark, sf_dir, "documents").select("doc_id", t.spelled(F.concat_ws(" ", "source", "lang"), letters).alias("spoken"), F.md5(t.spelled(F.col("text"), letters)).alias("digest"))


_SPANS = "regexp_extract_all({x}, '((?:Dr\\.?[ ]+)?[A-Z][a-z]+(?:[ ]+[A-Z][a-z]+){{1,3}})', 1)"


@query(f"""WITH s AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_SPANS.format(x='initcap(text)')} AS l FROM (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: translate(substring(w, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || lower(substring(w, 2))), ' ') AS text FROM documents) d)),
k AS (SELECT doc_id, arg_min(v, i) AS v, min(i) AS i FROM s WHERE NOT list_has_any(string_split(lower(v), ' '), ['the', 'and']) GROUP BY doc_id, lower(v))
SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(v, ',' ORDER BY i)) AS digest FROM k GROUP BY doc_id""".replace("initcap(text)", "text"))
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    capital = F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(F.translate(F.substring(w, 1, 1), ascii_lowercase, ascii_uppercase), F.lower(F.substring(w, 2, 1 << 30)))), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", t.name_candidates(capital, ["the", "and"]).alias("names"))
    return rows.filter(F.size("names") > 0).select("doc_id", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", ",")).alias("digest"))


_UNIT_WORDS = ["that", "une", "wh", *speech.UNITS]
_NUMERAL = "regexp_matches(upper({x}), '^(X?(IX|IV|V?I{{0,3}})|XX)$') AND length({x}) > 1"
#: Texts in which numerals and codes stand after some words.
_NUMBERED = "replace(replace(replace(text, ' that ', ' that I part ii '), ' une ', ' une V ID ID2 '), ' und ', ' x IXa XV3 ')"
_RESOLVED = f"""w AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i, l FROM (SELECT doc_id, regexp_extract_all({_NUMBERED}, '[A-Za-z][A-Za-z0-9]*') AS l FROM documents)),
k AS (SELECT doc_id, token, max(upper(token) IN ('I', 'V', 'X') AND i > 1 AND lower(l[i - 1]) IN ({", ".join(f"'{u}'" for u in _UNIT_WORDS)})) AS numeral FROM w GROUP BY doc_id, token),
c AS (SELECT DISTINCT token, CASE WHEN length(token) % 2 = 0 THEN 'spell' ELSE 'word' END AS kind FROM k WHERE length(token) % 3 = 0 AND upper(token) NOT IN ('I', 'V', 'X')), x AS (SELECT DISTINCT token FROM k WHERE token LIKE 'b%'), m AS (SELECT doc_id, token, 'spell' AS kind FROM k WHERE doc_id % 2 = 0 AND length(token) = 4),
s AS (SELECT DISTINCT doc_id FROM m),
j AS (SELECT k.*, c.kind AS cached, m.kind AS said, s.doc_id IS NOT NULL AS spoke, {_NUMERAL.format(x="k.token")} AS roman, upper(k.token) IN ('I', 'V', 'X') AS unsure, x.token IS NOT NULL AS listed FROM k LEFT JOIN c USING (token) LEFT JOIN x ON k.token = x.token LEFT JOIN m ON k.doc_id = m.doc_id AND k.token = m.token LEFT JOIN s ON k.doc_id = s.doc_id),
n AS (SELECT *, CASE WHEN NOT listed AND NOT roman AND NOT numeral AND (cached IS NULL OR unsure) THEN coalesce(said, CASE WHEN spoke THEN CASE WHEN unsure THEN 'word' WHEN regexp_matches(token, '^[A-Z][A-Z0-9]$|[0-9]') OR (length(token) >= 8 AND token <> lower(token) AND token <> upper(token)) THEN 'spell' ELSE 'word' END END) END AS new FROM j),
kinds AS (SELECT doc_id, token, CASE WHEN numeral OR roman THEN 'roman' ELSE coalesce(new, cached) END AS kind, CASE WHEN roman THEN 'roman' WHEN NOT unsure THEN new END AS stored FROM n)"""


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts; a cache, a lexicon and a model's word on their Latin tokens."""
    numbered = F.col("text")
    for old, new in ((" that ", " that I part ii "), (" une ", " une V ID ID2 "), (" und ", " x IXa XV3 ")):
        numbered = F.replace(numbered, F.lit(old), F.lit(new))
    texts = table(spark, sf_dir, "documents").select("doc_id", numbered.alias("text"))
    # read by all that is made of them
    distinct = written(speech.token_set(texts), "distinct")
    cache = distinct.filter(F.length("token") % 3 == 0).withColumn("kind", F.when(F.length("token") % 2 == 0, "spell").otherwise("word"))
    tokens = speech.latin_tokens(texts.filter(F.col("doc_id") % 2 == 0), "doc_id", units=_UNIT_WORDS)
    said = tokens.filter(F.length("token") == 4).select("doc_id", "token", F.lit("spell").alias("kind"))
    return texts, cache, distinct.filter("token like 'b%'"), said


@query(f"WITH {_RESOLVED} SELECT kind, stored, count(*)::BIGINT AS n FROM kinds GROUP BY ALL")
def spell_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.kinds_of_texts(*_named(spark, sf_dir), "doc_id", units=_UNIT_WORDS).groupBy("kind", "stored").agg(F.count("*").alias("n"))


_SOUND = "CASE upper(r.token) " + " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in t.NUMERALS.items()) + " END"
_LETTER = "CASE upper(ch) " + " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in t.LETTERS.items()) + " ELSE ch END"


@query(f"""WITH {_RESOLVED}, r AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i, g[generate_subscripts(l, 1)] AS gap, g[len(l) + 1] AS last FROM (SELECT doc_id, regexp_extract_all({_NUMBERED}, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+') AS l, regexp_split_to_array({_NUMBERED}, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+') AS g FROM documents)),
v AS (SELECT r.*, coalesce(CASE kind WHEN 'roman' THEN {_SOUND} WHEN 'spell' THEN array_to_string(list_transform(string_split(r.token, ''), lambda ch: {_LETTER}), ' ') END, r.token) AS value FROM r LEFT JOIN kinds USING (doc_id, token))
SELECT doc_id, md5(string_agg(gap || value, '' ORDER BY i) || any_value(last)) AS digest FROM v GROUP BY doc_id""")
def spoken_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their numerals as they sound and their codes spelled out."""
    rows = speech.texts_spoken(*_named(spark, sf_dir), "doc_id", units=_UNIT_WORDS).filter(F.regexp_like("text", F.lit(r"(?U)\w")))
    return rows.select("doc_id", F.md5("text").alias("digest"))


_CAPITAL = "array_to_string(list_transform(string_split(text, ' '), lambda w: translate(substring(w, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || lower(substring(w, 2))), ' ')"


@query(f"""WITH c AS (SELECT doc_id, {_CAPITAL} AS text FROM documents), w AS (SELECT *, string_split(text, ' ') AS l, len(list_filter(regexp_extract_all(text, '((?:Dr\\.?[ ]+)?[A-Z][a-z]+(?:[ ]+[A-Z][a-z]+){{1,3}})', 1), lambda s: NOT list_has_any(string_split(lower(s), ' '), ['the', 'and']))) AS n FROM c),
e AS (SELECT DISTINCT text, {_STRIP.format(x="l[3] || ' ' || l[4]")} AS pair, {_STRIP.format(x="lower(l[4])")} AS single FROM w WHERE doc_id % 3 = 0 AND n > 0),
k AS (SELECT *, length(pair) > length(single) AND NOT list_has_any(list_transform(string_split_regex(lower(pair), '\\s+'), lambda x: trim(x, '.')), ['the', 'and']) AS one,
  single <> '' AND NOT list_has_any(list_transform(string_split_regex(single, '\\s+'), lambda x: trim(x, '.')), ['the', 'and']) AS two FROM e),
p AS (SELECT *, CASE WHEN one THEN regexp_replace(text, '(?i)' || regexp_escape(pair), 'NAME $1', 'g') ELSE text END AS t1 FROM k)
SELECT w.doc_id, md5(coalesce(CASE WHEN two THEN regexp_replace(t1, '(?i)' || regexp_escape(single), 'Zwei', 'g') ELSE t1 END, w.text)) AS digest FROM w LEFT JOIN p USING (text)""")
def names_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found for a third of the texts, stored under the texts' keys, as they sound."""
    capital = F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(F.translate(F.substring(w, 1, 1), ascii_lowercase, ascii_uppercase), F.lower(F.substring(w, 2, 1 << 30)))), " ")
    texts = table(spark, sf_dir, "documents").select("doc_id", capital.alias("text"))
    words = F.split("text", " ")
    entries = F.array(
        F.struct(F.lit(0).alias("at"), F.lower(F.get(words, F.lit(3))).alias("source"), F.lit("Zwei").alias("value")),
        F.struct(F.lit(1).alias("at"), F.concat(F.get(words, F.lit(2)), F.lit(" "), F.get(words, F.lit(3))).alias("source"), F.lit("NAME $1").alias("value")),
    )
    found = texts.filter("doc_id % 3 = 0").select(speech.text_key(F.col("text")).alias("text_key"), F.explode(entries).alias("e")).select("text_key", "e.*").distinct()
    return speech.names_spoken(texts, found, "doc_id", blocked=["the", "and"]).select("doc_id", F.md5("text").alias("digest"))


_POLITE = "replace(replace(text, '. ', ' ရှင် ။ '), ', ', 'ပါဗျာ? ') || 'တယ်ခင်ဗျာ။'"
_FINAL = "'(?:ခင်ဗျာ|ရှင်|ဗျာ)(\\s*)(။|\\?|!)'"


@query(f"""WITH s AS (SELECT doc_id, regexp_split_to_array(t, {_FINAL}) AS b, regexp_extract_all(t, {_FINAL}, 1) AS g, regexp_extract_all(t, {_FINAL}, 2) AS m, regexp_extract_all(t, {_FINAL}, 0) AS w FROM (SELECT doc_id, {_POLITE} AS t FROM documents))
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(w) + 1), lambda i: b[i] || CASE WHEN i = len(w) THEN w[i] ELSE CASE WHEN ends_with(b[i], 'ပါ') OR ends_with(b[i], 'တယ်') THEN '' ELSE 'ပါ' END || g[i] || m[i] END), '') || b[-1]) AS digest FROM s""")
def finals_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a particle at the end of each sentence, of which the last stays."""
    text = F.concat(F.replace(F.replace("text", F.lit(". "), F.lit(" ရှင် ။ ")), F.lit(", "), F.lit("ပါဗျာ? ")), F.lit("တယ်ခင်ဗျာ။"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.finals_thinned(text)).alias("digest"))


@query("""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN '| ' || source || ' | ' || lang || ' |' || chr(10) || '|---|:--|' || chr(10) || '| c | d |' || chr(10) || '| e | f |' || chr(10) || chr(10) || replace(text, '|', '/')
WHEN 1 THEN '| ' || source || ' | b |' || chr(10) || '| ' || lang || ' | d | ' || replace(text, '|', '/') ELSE replace(text, '|', '/') END) AS digest FROM documents""")
def table_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that were collapsed into one line, before whole texts."""
    rest = F.replace("text", F.lit("|"), F.lit("/"))
    flat = F.concat(F.lit("| "), "source", F.lit(" | "), "lang", F.lit(" | |---|:--| | c | d | | e | f |\n\n"), rest)
    glued = F.concat(F.lit("| "), "source", F.lit(" | b |  | "), "lang", F.lit(" | d | "), rest)
    text = F.when(F.col("doc_id") % 3 == 0, flat).when(F.col("doc_id") % 3 == 1, glued).otherwise(rest)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.table_repaired(text)).alias("digest"))


@query("SELECT conv_id, turn, trim(text) <> '' AND NOT starts_with(trim(text), 'Sure') AND trim(text) <> 'Thanks!' AS speakable FROM conversations")
def speakable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", speech.is_speakable(F.col("text"), "Sure", "Thanks!").alias("speakable"))


@query("""WITH n AS (SELECT c_custkey, c_name, array_to_string(list_transform(list_filter(string_split(replace(lower(c_name), '#', '_'), '_'), lambda w: w <> ''), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS name FROM customer)
SELECT c_custkey, name, name IN ('Customer 000000001', 'Customer 000000007') AS known, name AS bare FROM n""")
def known_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = speech.name_of_stem(F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")))
    titled = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("Dr. ")).otherwise(F.lit("")), name)
    known = speech.is_known_person(titled, ["Customer 000000001", "CUSTOMER 000000007"], ["Dr", "Prof"])
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), known.alias("known"), speech.bare_name(titled, ["Dr", "Prof"]).alias("bare"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: round(x * 1000)::BIGINT), ',') || ']' AS literal FROM embeddings")
def embedding_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", literal(F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("long"))).alias("literal"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 AND event_type IN ('view', 'click') THEN event_type END AS route FROM events""")
def json_route_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced objects, bare tokens in marks, JSON strings (no route) and JSON lists (no route)."""
    kind = F.col("event_id") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"route": " '), F.upper("event_type"), F.lit('"}\n```')))
        .when(kind == 1, F.concat(F.lit("{"), "event_type", F.lit(": yes")))
        .when(kind == 2, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .otherwise(F.concat(F.lit('[{"route": "'), "event_type", F.lit('"}]')))
    )
    return table(spark, sf_dir, "events").select("event_id", t.route_of_reply(reply, ["view", "click"]).alias("route"))


@query("""SELECT conv_id, turn, regexp_matches(m, '429|resource_exhausted|resource exhausted|resourceexhausted|quota|rate limit|rate_limit|too many requests') AS quota,
regexp_matches(m, '503|unavailable|high demand|overloaded') OR code BETWEEN 500 AND 599 AND code <> 501 AS overload, regexp_matches(m, '\\(404\\)|not_found|not found') AS missing,
CASE WHEN regexp_matches(m, '429|resource_exhausted|resource exhausted|resourceexhausted|quota|rate limit|rate_limit|too many requests') THEN coalesce(try_cast(nullif(regexp_extract(m, 'retry in ([0-9.]+)s', 1), '') AS DOUBLE) + 1, 50)
WHEN regexp_matches(m, '503|unavailable|high demand|overloaded') OR code BETWEEN 500 AND 599 AND code <> 501 THEN least(5 * pow(2, turn % 9), 30) ELSE least(pow(2, turn % 9), 60) END::DOUBLE AS delay
FROM (SELECT conv_id, turn, lower(CASE conv_id % 7 WHEN 0 THEN 'HTTP 429 Too Many Requests: ' WHEN 1 THEN 'The model is in high demand. ' WHEN 2 THEN 'Error (404) ' WHEN 3 THEN 'Quota met, retry in ' || turn || '.5s: ' ELSE '' END || text) AS m, 400 + (conv_id * 13 + turn) % 150 AS code FROM conversations)""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of several forms before the texts of conversations, with statuses from 400 to 549."""
    lead = F.col("conv_id") % 7
    told = F.when(lead == 0, "HTTP 429 Too Many Requests: ").when(lead == 1, "The model is in high demand. ").when(lead == 2, "Error (404) ").when(lead == 3, F.concat(F.lit("Quota met, retry in "), F.col("turn").cast("string"), F.lit(".5s: "))).otherwise("")
    message, code = F.concat(told, "text"), 400 + (F.col("conv_id") * 13 + F.col("turn")) % 150
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", message.alias("m"), code.alias("code"))
    rows = rows.withColumns({"quota": t.is_quota(F.col("m")), "overload": t.is_overload(F.col("m"), F.col("code")), "missing": t.is_missing(F.col("m"))})
    return rows.select("conv_id", "turn", "quota", "overload", "missing", t.retry_delay(F.col("m"), F.col("turn") % 9, F.col("quota"), F.col("overload")).alias("delay"))


@query("""SELECT vec_id, len(embedding)::BIGINT AS n, round(embedding[1]::DOUBLE, 6) AS first, vec_id % 3 <> 0 AS found FROM embeddings""")
def reply_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through a service's JSON and back; texts of a reply that has blank parts."""
    body = F.to_json(F.struct(F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("values")).alias("embedding")))
    vector = replies.embedding_of(body)
    part = lambda c: F.struct(F.struct(F.array(F.struct(F.lit(" ").alias("text")), F.struct(c.alias("text"))).alias("parts")).alias("content"))
    said = replies.reply_text(F.to_json(F.struct(F.array(part(F.when(F.col("vec_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("yes")))).alias("candidates"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(vector).cast("long").alias("n"), F.round(vector[0], 6).alias("first"), said.isNotNull().alias("found"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_type = 'view' THEN 1 ELSE 2 END::BIGINT AS n, CASE WHEN event_id % 3 <> 0 THEN event_type END AS token FROM events""")
def reply_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of an entries list, what else is in it left out; none of a reply that is not an object."""
    more = F.when(F.col("event_type") == "view", '"text", 5').otherwise('{"token": "b", "kind": "word"}, null')
    listed = F.concat(F.lit('```json\n{"entries": [{"token": "'), "event_type", F.lit('", "kind": "spell"}, '), more, F.lit("]}\n```"))
    found = replies.entries(F.when(F.col("event_id") % 3 == 0, F.lit("[1, 2]")).otherwise(listed), "token string, kind string")
    return table(spark, sf_dir, "events").select("event_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0))["token"].alias("token"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 4 THEN 'other' ELSE 'image' END AS kind, ['.pdf', '.png', '.jpg', '.webp', '.bin'][doc_id % 5 + 1] AS ending FROM documents")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.element_at(F.array(*map(F.lit, (".PDF", ".png", ".JPEG", ".webp", ".txt"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.file_kind(name).alias("kind"), ingest.stored_ending(name).alias("ending"))
