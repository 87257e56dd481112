"""Sessions, messages and documents: pages, latest rows, ownership, upserts, deletes and tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.replies import annotations_of
from colloquy.functions.text import clipped, strip
from colloquy.sources.ingest import file_kind


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order, which the caller gives."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def recent_sessions(sessions: DataFrame, messages: DataFrame, owner: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    """An owner's sessions, those with the latest user message first; one without any stands by its creation.

    Messages are reduced to one row for each session before the join.
    """
    last = messages.filter(F.col("role") == "user").groupBy("session_id").agg(F.max("created_at").alias("last_user_at"))
    rows = sessions.filter(owner).join(last, "session_id", "left")
    return page(rows, [F.coalesce("last_user_at", "created_at").desc_nulls_last(), F.col("session_id")], limit, offset)


def latest(rows: DataFrame, group: Sequence[str], order: Sequence[str], count: int = 1) -> DataFrame:
    """The last rows of each group by a descending order; the planner cuts each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= count).drop("_n")


def owned(rows: DataFrame, owners: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(owners.select(*keys), list(keys), "left_semi")


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return rows.join(lookup.select(key, *columns), key, "left")


def without(rows: DataFrame, tombstones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that were not deleted: also how a delete cascades to each child table."""
    return rows.join(tombstones.select(*keys).distinct(), list(keys), "left_anti")


def nulled(rows: DataFrame, deleted: DataFrame, column: str, key: str) -> DataFrame:
    """References to deleted rows set to null."""
    gone = deleted.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    kept = rows.columns
    marked = rows.join(gone, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
    return marked.select(*kept)


def upserted(base: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version of each key, of equal ones the new."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def patched(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a patch where it has a value, the base's elsewhere."""
    renamed = patch.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def titled(sessions: DataFrame, titles: DataFrame, key: str, default: str = "New chat") -> DataFrame:
    """A title for sessions that still have the default one."""
    named = titles.select(key, F.col("title").alias("_title"))
    joined = sessions.join(named, key, "left")
    title = F.when(F.col("title") == default, F.coalesce("_title", "title")).otherwise(F.col("title"))
    return joined.withColumn("title", title).drop("_title")


def sidebar(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """Conversations that have ``questions``, the latest change first."""
    rows = conversations.filter("questions > 0")
    ordered = rows.orderBy(F.col("updated").desc(), "id")
    return ordered.limit(limit) if limit else ordered


def kept_tombstones(deleted: DataFrame, order: str, key: str, most: int = 200) -> DataFrame:
    """The latest deletions, each key once."""
    return deleted.groupBy(key).agg(F.max(order).alias(order)).orderBy(F.col(order).desc(), key).limit(most)


def finalized(conversations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The chat store's rest state: no deleted conversation, all that have turns, and of the empty ones the latest."""
    live = without(conversations, tombstones, ["id"])
    empty = F.size(F.coalesce("turns", F.array())) == 0
    shell = live.filter(empty).orderBy(F.col("updated").desc(), "id").limit(1)
    return live.filter(~empty).unionByName(shell)


def has_question(turns: Column) -> Column:
    return F.coalesce(F.exists(turns, lambda t: strip(F.coalesce(t["question"], F.lit(""))) != ""), F.lit(False))


def message_read(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """Messages as a client reads them, with the name of their document."""
    named = documents.select(F.col("id").alias("document_id"), F.col("filename").alias("document_filename"))
    return messages.join(named, "document_id", "left").select("id", "session_id", "role", "content", "document_id", "document_filename")


def session_read(sessions: DataFrame, last: DataFrame) -> DataFrame:
    """Sessions as a client reads them, with the time of their last user message."""
    return sessions.join(last.select("session_id", "last_user_message_at"), "session_id", "left").select(F.col("session_id").alias("id"), "title", "status", "owner_id", "created_at", "last_user_message_at")


def document_read(documents: DataFrame) -> DataFrame:
    """Documents as a client reads them: address, kind and annotation boxes."""
    address = F.concat_ws("/", F.lit("/api/chat-sessions"), F.col("session_id").cast("string"), F.lit("documents"), F.col("id").cast("string"), F.lit("file"))
    kind = F.when(file_kind(F.col("filename")) == "image", "image").otherwise("pdf")
    return documents.select("id", "session_id", "filename", address.alias("file_url"), kind.alias("content_type"), annotations_of(F.col("annotations_json")).alias("annotations"))


def refusal(question: Column, code: Column, limit: Column, offset: Column, most_code: int = 16_384, most_rows: int = 200) -> Column:
    """Why a request is refused; null for one that is not."""
    return (
        F.when(strip(F.coalesce(question, F.lit(""))) == "", "question is blank")
        .when(F.length(F.coalesce(code, F.lit(""))) > most_code, "code is too long")
        .when(~F.coalesce(limit, F.lit(1)).between(1, most_rows), "limit is out of range")
        .when(F.coalesce(offset, F.lit(0)) < 0, "offset is negative")
    )


META = ("conversation_id", "turn_id", "tts_id", "tts_voice", "audio_message_id")


def normal_turn(turn: Column) -> Column:
    """A turn with question and answer trimmed and blank marks as null."""
    body = [strip(F.coalesce(turn[c], F.lit(""))).alias(c) for c in ("question", "answer")]
    return F.struct(*body, *(F.nullif(strip(turn[c]), F.lit("")).alias(c) for c in META))


#: The title of a conversation in which nothing was asked; marks that no title ends with.
NEW, TRAILING = "New chat", "။?!.,;:…"


def conversation_title(turns: Column, most: int = 32) -> Column:
    """The first question of normal turns that holds more than marks, without those at its end, cut with an ellipsis."""
    bare = lambda q: strip(F.regexp_replace(strip(F.coalesce(q, F.lit(""))), f"[{TRAILING}]+\\z", ""))
    asked = F.filter(F.transform(turns, lambda t: bare(t["question"])), lambda q: q != "")
    return F.coalesce(clipped(F.get(asked, F.lit(0)), most, "…"), F.lit(NEW))


def normal_conversations(raw: DataFrame, now: Column, key: Column, most: int = 32) -> DataFrame:
    """Conversations as the store keeps them: turns normal, title by the first question, id and time filled in.

    ``raw``: (id, updated, turns); ``key`` is the id of one that has none.
    """
    turns = F.transform(F.coalesce("turns", F.array().cast(raw.schema["turns"].dataType)), normal_turn)
    filled = raw.select(F.coalesce(F.nullif(strip("id"), F.lit("")), key).alias("id"), F.coalesce(F.nullif(strip("updated"), F.lit("")), now).alias("updated"), turns.alias("turns"))
    return filled.withColumn("title", conversation_title(F.col("turns"), most))


def normal_deleted(ids: Column, most: int = 200) -> Column:
    """A list of deleted ids: blank ones out, each once where it came first, the last ones."""
    kept = F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), strip), lambda i: F.coalesce(i != "", F.lit(False))))
    return F.slice(kept, F.greatest(F.size(kept) - most + 1, F.lit(1)), most)


def message_of_answer(asked: DataFrame, turns: DataFrame, thread: str, order: str) -> DataFrame:
    """(thread, text) to the message of the thread's last turn whose answer is the text and that has a message id."""
    body = lambda c: strip(F.coalesce(c, F.lit("")))
    known = turns.withColumn("_id", F.coalesce(F.nullif(body("audio_message_id"), F.lit("")), F.nullif(body("message_id"), F.lit(""))))
    held = known.filter(F.col("_id").isNotNull()).select(thread, body("answer").alias("_text"), order, "_id")
    wanted = asked.withColumn("_text", body("text")).filter("_text <> ''")
    last = held.join(wanted.select(thread, "_text").distinct(), [thread, "_text"], "left_semi").groupBy(thread, "_text").agg(F.max_by("_id", order).alias("message_id"))
    return wanted.join(last, [thread, "_text"], "left").drop("_text")


def appended(threads: DataFrame, new: DataFrame, thread: str, order: str, message: Sequence[str]) -> DataFrame:
    """(thread, messages) with the new rows at the end of each list, in order."""
    added = new.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct(order, *message))).alias("_new"))
    joined = threads.join(added, thread, "full")
    plain = F.transform(F.coalesce("_new", F.array().cast(added.schema["_new"].dataType)), lambda m: F.struct(*(m[c].alias(c) for c in message)))
    return joined.select(thread, F.concat(F.coalesce("messages", F.array().cast(threads.schema["messages"].dataType)), plain).alias("messages"))
