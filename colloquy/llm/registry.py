"""The thin queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import codes, decontaminate, kdtree, licenses, media, mixing, packing, pii, quality, sharding, simhash, toxicity, trie
from colloquy.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_read(spark, sf_dir, "documents"))


@query
def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: The best alignment of each pair, by joining all equal words: what the seeds must find.
ORACLE_SQL["op1_spaced_seed_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) GROUP BY w HAVING len(w) >= 5),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b),
m AS (SELECT doc_id, item_id, n, count(*) AS k FROM dw JOIN bw USING (word) GROUP BY doc_id, item_id, n, i - j HAVING count(*) >= 0.6 * n)
SELECT doc_id, item_id, n::BIGINT AS n_item_words, max(k)::BIGINT AS n_matched, round(max(k) / n, 6) AS overlap FROM m GROUP BY doc_id, item_id, n
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scanned(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op6_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(_read(spark, sf_dir, "documents"))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(pii.BASE))
    return rows.select("doc_id", *counts, F.sha2(pii.described(base), 256).alias("base_sha256"), pii.described(F.col("spans")).alias("spans"))


@query
def op2_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = toxicity.scored(docs, toxicity.fitted(docs, _read(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op7_quality_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.scored(docs, quality.fitted(docs, _read(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"), ids=False)


@query
def op5_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_mjpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digested(_read(spark, sf_dir, "documents"))


@query
def op8_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.scored(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", held_out(parts=7, part=2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op12_annular_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.encoded(_read(spark, sf_dir, "embeddings"), keep=("label",))
    rows = codes.with_label_error(coded)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def _assigned(name: str, books: str) -> str:
    """SQL of the nearest entry of each part: the smallest (distance, entry)."""
    return f"""{name} AS (SELECT vec_id, label, p, part, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT v.vec_id, v.label, v.p, v.part, b.e, list_sum(list_transform(list_zip(v.part, b.entry), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM parts v JOIN {books} b USING (p)
) GROUP BY vec_id, label, p, part)"""


def _refined(name: str, assigned: str, books: str) -> str:
    return f"""{name} AS (SELECT b.p, b.e, coalesce(n.entry, b.entry) AS entry FROM {books} b LEFT JOIN (
  SELECT p, e, list(x ORDER BY i) AS entry FROM (SELECT p, best.e AS e, i, floor(sum(part[i])::DOUBLE / count(*))::BIGINT AS x FROM {assigned}, range(1, 5) AS r(i) GROUP BY ALL) GROUP BY p, e
) n ON b.p = n.p AND b.e = n.e)"""


ORACLE_SQL["op12_annular_vector_codes"] = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS part FROM kept, range(16) AS r(p)),
b0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, part AS entry FROM parts JOIN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{_assigned("a0", "b0")}, {_refined("b1", "a0", "b0")}, {_assigned("a1", "b1")}, {_refined("b2", "a1", "b1")}, {_assigned("a2", "b2")},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM coded
"""


@query
def op13_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op13_kdtree_topk"] = """
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 10
"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("conv_id")
    head = F.crc32(id.cast("string").cast("binary")) % 6
    return trie.trie(_read(spark, sf_dir, "conversations"), head, id - id % 100, most=5)


#: crc32 of a decimal number, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE_SQL["op11_conversation_trie"] = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS j
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h, n FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
r AS (SELECT c.conv_id, t.j AS pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.j <= c.h
  UNION ALL SELECT c.conv_id, t.j - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.j > c.h LEFT JOIN c b ON b.conv_id = c.base),
s AS (SELECT conv_id, coalesce(seq, []) AS seq, len(coalesce(seq, [])) AS n FROM c LEFT JOIN (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS seq FROM r GROUP BY conv_id) USING (conv_id)),
m AS (SELECT conv_id, n, unnest(range(n + 1)) AS depth, seq FROM s),
p AS (SELECT conv_id, n, depth, seq[1:depth] AS path FROM m),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(path[depth].text), 0) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY path, depth),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN children USING (path)),
below AS (SELECT a.path, sum((b.k = 0)::INT) AS n_leaves, sum(b.own) AS saved_tokens FROM nodes a JOIN full_nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.k::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below USING (path) LEFT JOIN nodes u ON n.depth > 0 AND u.path = n.path[1:n.depth - 1]
"""
