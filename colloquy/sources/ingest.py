"""Reading note corpora and keeping a store of them current by content hash."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import content_key, nonblank, quoted, strip, windows

NOTE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "sources")])
INDEX = "embed_model string, built_at string, chunks array<struct<id:string,text:string,sources:array<string>,embedding:array<double>>>"
TURN = "struct<question:string,answer:string,turn_id:string>"
STORE = f"active_id string, conversations array<struct<id:string,title:string,updated:string,turns:array<{TURN}>>>, deleted_ids array<string>"
EVAL_ITEM = "id string, question string, code string, history array<struct<question:string,answer:string>>, gold_route string, gold_chunk_ids array<string>, gold_spans array<string>"


def parsed_sources(raw: Column) -> Column:
    """A JSON list of strings, blank ones dropped, or one bare string; otherwise none."""
    many = F.from_json(raw, "array<string>")
    listed = F.when(F.ltrim(raw).startswith("["), many).otherwise(F.array(raw))
    return F.coalesce(F.filter(listed, nonblank), F.array().cast("array<string>"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of all ``*.jsonl`` files, every line an object; a malformed line fails the read, blank texts go."""
    rows = spark.read.schema(NOTE).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path)
    return rows.filter(nonblank(F.col("text"))).select("id", strip(F.col("text")).alias("text"), parsed_sources(F.col("sources")).alias("sources"))


def tolerant_notes(spark: SparkSession, path: str, extra: Sequence[str] = ("name", "role", "department", "course_code", "title", "teacher", "code")) -> DataFrame:
    """Notes of files that no underscore begins; lines that are not objects with a string id and text are skipped, further
    fields lead the text."""
    lines = spark.read.option("pathGlobFilter", "[!_]*.jsonl").text(path).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    variant = F.try_parse_json("value")
    kind = F.schema_of_variant(variant)
    typed = lambda field: F.try_variant_get(variant, f"$.{field}", "variant")
    is_text = lambda field: F.coalesce(F.schema_of_variant(typed(field)) == "STRING", F.lit(False))
    text = lambda field: F.when(is_text(field), strip(F.get_json_object("value", f"$.{field}")))
    rows = lines.filter(F.coalesce(kind.startswith("OBJECT"), F.lit(False)) & is_text("id") & is_text("text") & nonblank(F.get_json_object("value", "$.text")))
    lead = F.concat_ws(" ", *(F.when(text(f) != "", text(f)) for f in extra))
    return rows.select(
        F.get_json_object("value", "$.id").alias("id"),
        F.when(lead != "", F.concat_ws("\n", lead, text("text"))).otherwise(text("text")).alias("text"),
        parsed_sources(F.get_json_object("value", "$.sources")).alias("sources"),
        "source_file",
    )


def categories(spark: SparkSession, root: str, names: Sequence[str], handouts: DataFrame | None = None, category: str = "courses") -> DataFrame:
    """The tolerant notes of each category's folder, in one table, and the chunks of ``handouts`` (source_file, page texts in
    ``text``) under ``category``: ``{source_file}-{n}``, blank texts left out."""
    parts = [tolerant_notes(spark, f"{root}/{name}").withColumn("category", F.lit(name)) for name in names]
    if handouts is not None:
        cut = chunked(handouts.filter(nonblank(F.col("text"))).select("source_file", "text"), "source_file")
        parts.append(cut.select(F.col("chunk_id").alias("id"), "text", F.array("source_file").alias("sources"), "source_file", F.lit(category).alias("category")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Chunks of a stored index with text and vector, and the index's header on each. The index is one JSON document, or, with
    ``lines``, one in each line, as ``index_written`` writes it."""
    rows = spark.read.schema(INDEX).option("multiLine", not lines).json(path)
    chunks = rows.select("embed_model", "built_at", F.explode("chunks").alias("c")).select("embed_model", "built_at", "c.*")
    return chunks.filter(nonblank(F.col("text")) & (F.size("embedding") > 0))


def indexed(rows: DataFrame, vectors: DataFrame, key: str, model: str) -> DataFrame:
    """Rows with their vectors under a header; a row without one, and a key with several, are errors."""
    one = vectors.groupBy(key).agg(F.first("embedding").alias("embedding"), F.count("*").alias("_n"))
    several = F.raise_error(F.concat(F.lit("several vectors for "), F.col(key).cast("string")))
    none = F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string")))
    checked = F.when(F.col("_n") > 1, several).when(F.col("embedding").isNull(), none).otherwise(F.col("embedding"))
    return rows.join(one, key, "left").withColumn("embedding", checked).drop("_n").withColumn("embed_model", F.lit(model))


def freshness(spark: SparkSession, path: str) -> DataFrame:
    """The latest change of any file below a folder, in seconds; 0 if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.max(F.unix_timestamp("modificationTime")), F.lit(0)).cast("long").alias("stamp"))


def chat_store(spark: SparkSession, path: str) -> DataFrame:
    """A stored chat file; what cannot be parsed is an empty store, an unknown active id the last empty conversation."""
    rows = spark.read.schema(STORE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    known = F.coalesce("conversations", F.from_json(F.lit("[]"), rows.schema["conversations"].dataType.json()))
    empty = F.filter(known, lambda c: F.size(F.coalesce(c["turns"], F.array())) == 0)
    active = F.when(F.exists(known, lambda c: c["id"] == F.col("active_id")), F.col("active_id")).otherwise(F.try_element_at(empty, F.lit(-1))["id"])
    return rows.select(active.alias("active_id"), known.alias("conversations"), F.coalesce("deleted_ids", F.array().cast("array<string>")).alias("deleted_ids"))


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_ITEM).json(path)


def chunked(rows: DataFrame, id_column: str, text: str = "text", size: int = 1500) -> DataFrame:
    """A row for each window of the text, with the id ``{id}-{n}`` counted from 1."""
    kept = [c for c in rows.columns if c != text]
    out = rows.select(*kept, F.posexplode(windows(F.col(text), size)).alias("_at", text))
    return out.withColumn("chunk_id", F.concat(F.col(id_column).cast("string"), F.lit("-"), F.col("_at") + 1)).drop("_at")


def _met(current: DataFrame, incoming: DataFrame, keys: Sequence[str], failed: DataFrame | None) -> DataFrame:
    """Both sides of each key, ``_old`` and ``_new``, with the action; each side is read and hashed once.

    Of a key that comes more than once the first row in the order of the scan counts.
    """
    met = incoming.select(*keys, "text", content_key(F.col("text")).alias("content_hash"), F.monotonically_increasing_id().alias("_at"))
    new = met.groupBy(*keys).agg(F.min_by(F.struct("text", "content_hash"), "_at").alias("_new"), F.count("*").alias("copies"))
    held = [c for c in ("text", "content_hash") if c in current.columns]
    both = current.select(*keys, F.struct(*held).alias("_old")).join(new, list(keys), "full")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old.content_hash") == F.col("_new.content_hash"), "noop").otherwise("update")
    if failed is not None:
        both = both.join(failed.select(*keys).distinct().withColumn("_failed", F.lit(True)), list(keys), "left")
        action = F.when(F.col("_failed") & F.col("_old").isNull(), "skip").when(F.col("_failed"), "noop").otherwise(action)
    return both.withColumn("action", action)


def changes(current: DataFrame, incoming: DataFrame, keys: Sequence[str], failed: DataFrame | None = None) -> DataFrame:
    """Keys and what is to be done with each: insert, update, noop or delete.

    ``current`` has the keys and ``content_hash``, ``incoming`` the keys and ``text``; of a key that comes more than once the
    first row in the order of the scan counts, and ``copies`` says how many there were. Keys in ``failed`` stay as they are:
    neither changed nor deleted.
    """
    both = _met(current, incoming, keys, failed)
    return both.select(*keys, "action", F.coalesce("_new.content_hash", "_old.content_hash").alias("content_hash"), F.coalesce("copies", F.lit(0)).alias("copies"))


def applied(current: DataFrame, incoming: DataFrame, keys: Sequence[str], failed: DataFrame | None = None) -> DataFrame:
    """The store after the changes: keys, text and content_hash."""
    both = _met(current, incoming, keys, failed).filter("action in ('insert', 'update', 'noop')")
    stays = F.col("action") == "noop"
    return both.select(*keys, *(F.when(stays, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c) for c in ("text", "content_hash")))


def synced(keys: Sequence[str], scope: Sequence[str], failed: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """For ``versions.once``: a batch holds all rows of each ``scope`` (such as a file) that it has any of, null texts for none.

    Rows of these scopes are changed by content hash, those that are no longer there go, and those of ``failed(batch)`` stay as
    they are; rows of other scopes stay.
    """

    def change(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.filter("text is not null")
        if before is None:
            before = rows.select(*keys, "text", F.lit("").alias("content_hash")).limit(0)
        touched = F.broadcast(batch.select(*scope).distinct())
        here = before.join(touched, list(scope), "left_semi")
        after = applied(here, rows, keys, failed(batch) if failed else None)
        return before.join(touched, list(scope), "left_anti").select(after.columns).unionByName(after)

    return change


def file_kind(name: Column) -> Column:
    """pdf, image or other, by the ending of a file name."""
    low = F.lower(name)
    return F.when(low.endswith(".pdf"), "pdf").when(low.rlike(r"\.(?:png|jpe?g|webp)\z"), "image").otherwise("other")


def stored_ending(name: Column) -> Column:
    """The ending under which an upload is kept."""
    found = F.regexp_extract(F.lower(name), r"(\.(?:pdf|png|jpe?g|webp))\z", 1)
    return F.when(found == ".jpeg", ".jpg").when(found == "", ".bin").otherwise(found)


def image_kind(content: Column) -> Column:
    """png, jpeg or webp by the first bytes; png for what has none of them."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8"), "jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "webp").otherwise("png")


def relative(path: Column, root: str) -> Column:
    """A file's place below a folder; its name alone where it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(F.contains(path, F.lit(base)), F.element_at(F.split(path, quoted(base), -1), -1)).otherwise(F.element_at(F.split(path, "/"), -1))


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def index_written(rows: DataFrame, vectors: DataFrame, key: str, model: str, path: str) -> int:
    """Writes rows (``key`` as id, text, sources) with their vectors, an index document of one chunk in each line; ``index`` reads it
    with ``lines``. Every row must have one vector and every vector a row. How many were written."""
    many = rows.count(), vectors.count()
    if many[0] != many[1]:
        raise ValueError(f"{many[0]} rows and {many[1]} vectors")
    out = indexed(rows, vectors, key, model)
    sources = F.col("sources") if "sources" in rows.columns else F.array().cast("array<string>")
    chunk = F.struct(F.col(key).cast("string").alias("id"), F.col("text"), F.coalesce(sources, F.array().cast("array<string>")).alias("sources"), F.col("embedding").cast("array<double>").alias("embedding"))
    built = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    out.select("embed_model", built.alias("built_at"), F.array(chunk).alias("chunks")).write.mode("overwrite").json(path)
    return many[0]
