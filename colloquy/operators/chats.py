"""Chat stores changed by a log of commands, in order.

A store is (active_id, conversations, deleted_ids). ``mutated`` folds each store's commands into its state in one aggregate;
as it takes the states that there are, batches of a stream follow one another by ``versions.once``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import let, strip
from colloquy.operators.sessions import META, NEW, conversation_title, has_question, normal_deleted, normal_turn

TURNS = "array<struct<question:string,answer:string,{}>>".format(",".join(f"{c}:string" for c in META))
CONVERSATIONS = f"array<struct<id:string,title:string,updated:string,turns:{TURNS}>>"
STATE = f"struct<active_id:string,conversations:{CONVERSATIONS},deleted_ids:array<string>>"
#: (place in the log, what to do, with which conversation, the turns of an upsert, the id of a conversation that has to be made, when)
COMMAND = f"struct<at:bigint,kind:string,id:string,turns:{TURNS},new_id:string,time:string>"
KINDS = ("start", "select", "upsert", "delete", "finalize")


def _blank(id: Column, time: Column) -> Column:
    fields = (id.alias("id"), F.lit(NEW).alias("title"), time.alias("updated"), F.array().cast(TURNS).alias("turns"))
    return F.array(F.struct(*fields)).cast(CONVERSATIONS)


def _state(active: Column, conversations: Column, deleted: Column) -> Column:
    return F.struct(active.alias("active_id"), conversations.alias("conversations"), deleted.alias("deleted_ids")).cast(STATE)


def _held(conversations: Column, id: Column) -> Column:
    return F.coalesce(F.exists(conversations, lambda c: c["id"] == id), F.lit(False))


def _asked(conversation: Column) -> Column:
    return has_question(conversation["turns"])


def _activated(s: Column, e: Column) -> Column:
    """An active conversation for certain: the one that is, else the first without questions, else a new one."""
    idle = F.filter(s["conversations"], lambda c: ~_asked(c))
    kept = _held(s["conversations"], s["active_id"])
    return (
        F.when(kept, s)
        .when(F.size(idle) > 0, _state(F.get(idle, F.lit(0))["id"], s["conversations"], s["deleted_ids"]))
        .otherwise(_state(e["new_id"], F.concat(s["conversations"], _blank(e["new_id"], e["time"])), s["deleted_ids"]))
    )


def _active(s: Column) -> Column:
    return F.get(F.filter(s["conversations"], lambda c: c["id"] == s["active_id"]), F.lit(0))


def _added(s: Column, e: Column) -> Column:
    """With a new conversation, which is active."""
    return _state(e["new_id"], F.concat(s["conversations"], _blank(e["new_id"], e["time"])), s["deleted_ids"])


def _started(s: Column, e: Column) -> Column:
    return let(_activated(s, e), lambda a: F.when(F.size(_active(a)["turns"]) == 0, a).otherwise(_added(a, e)))


def _selected(s: Column, e: Column) -> Column:
    return F.when(_held(s["conversations"], e["id"]), _state(e["id"], s["conversations"], s["deleted_ids"])).otherwise(s)


def _finalized(s: Column, e: Column) -> Column:
    """All conversations with questions, and one empty one, which is active."""
    def rest(a: Column) -> Column:
        idle = ~_asked(_active(a))
        shell = F.when(idle, F.filter(a["conversations"], lambda c: c["id"] == a["active_id"])).otherwise(_blank(e["new_id"], e["time"]))
        return _state(F.when(idle, a["active_id"]).otherwise(e["new_id"]), F.concat(F.filter(a["conversations"], _asked), shell), a["deleted_ids"])

    return let(_activated(s, e), rest)


def _upserted(s: Column, e: Column) -> Column:
    """The turns of a conversation replaced; a deleted or unknown one does not come back, and without an id the active one is
    meant, or a new one where nothing is asked."""
    id = F.coalesce(strip(e["id"]), F.lit(""))
    turns = F.transform(F.coalesce(e["turns"], F.array().cast(TURNS)), normal_turn)

    def filled(a: Column, target: Column, new: Column) -> Column:
        now = F.struct(target.alias("id"), conversation_title(new).alias("title"), e["time"].alias("updated"), new.alias("turns")).cast(CONVERSATIONS.removeprefix("array<").removesuffix(">"))
        return _state(target, F.transform(a["conversations"], lambda c: F.when(c["id"] == target, now).otherwise(c)), a["deleted_ids"])

    def put(new: Column) -> Column:
        known = F.when(_held(s["conversations"], id) & ~F.array_contains(s["deleted_ids"], id), filled(s, id, new)).otherwise(s)
        unnamed = let(F.when(has_question(new), _activated(s, e)).otherwise(_added(s, e)), lambda a: filled(a, a["active_id"], new))
        return F.when(id != "", known).otherwise(unnamed)

    return let(turns, put)


def _deleted(s: Column, e: Column) -> Column:
    """Without a conversation, whose id is remembered; a deleted active one leaves the rest state."""
    id, gone = e["id"], F.coalesce(strip(e["id"]), F.lit(""))
    marked = F.when((gone == "") | F.array_contains(s["deleted_ids"], gone), s["deleted_ids"]).otherwise(normal_deleted(F.concat(s["deleted_ids"], F.array(gone))))

    def left(rest: Column) -> Column:
        now = _state(s["active_id"], rest, marked)
        newest = F.array_max(F.transform(rest, lambda c: c["updated"]))
        first = F.get(F.filter(rest, lambda c: c["updated"] == newest), F.lit(0))["id"]
        return (
            F.when(F.size(rest) == 0, _state(e["new_id"], _blank(e["new_id"], e["time"]), marked))
            .when(F.coalesce(s["active_id"] == id, F.lit(False)), _finalized(_added(now, e), e))
            .when(_held(rest, s["active_id"]), now)
            .otherwise(_state(first, rest, marked))
        )

    return F.when(F.coalesce(id, F.lit("")) == "", s).otherwise(let(F.filter(s["conversations"], lambda c: c["id"] != id), left))


_STEPS: dict[str, Callable[[Column, Column], Column]] = dict(zip(KINDS, (_started, _selected, _upserted, _deleted, _finalized)))


def mutated(commands: DataFrame, key: str, states: DataFrame | None = None, first: Column | None = None) -> DataFrame:
    """(key, active_id, conversations, deleted_ids) after each store's commands: (key, at, kind, id, turns, new_id, time), in order
    of ``at``; of equal places in that of kind and id. Unknown kinds change nothing.

    ``states``: the stores before, in the same form; one that is not there begins with an empty conversation, whose id is
    ``first`` (the key and "-first", unless said). A store without commands stays as it is.
    """
    listed = F.array_sort(F.collect_list(F.struct("at", "kind", "id", "turns", "new_id", "time").cast(COMMAND)))
    logs = commands.groupBy(key).agg(listed.alias("_log"))
    if states is None:
        states = logs.select(key, F.lit(None).cast("string").alias("active_id"), F.lit(None).cast(CONVERSATIONS).alias("conversations"), F.lit(None).cast("array<string>").alias("deleted_ids")).limit(0)
    both = logs.join(states, key, "full")
    made = F.concat(F.col(key).cast("string"), F.lit("-first")) if first is None else first
    begun = F.get(F.col("_log"), F.lit(0))["time"]
    before = F.when(F.col("conversations").isNull(), _state(made, _blank(made, begun), F.array())).otherwise(_state(F.col("active_id"), F.col("conversations"), normal_deleted(F.col("deleted_ids"))))

    def step(s: Column, e: Column) -> Column:
        out = F.when(F.lit(False), s)
        for kind, change in _STEPS.items():
            out = out.when(e["kind"] == kind, change(s, e))
        return out.otherwise(s).cast(STATE)

    after = F.aggregate(F.coalesce("_log", F.array().cast(f"array<{COMMAND}>")), before, step)
    return both.select(key, after.alias("_s")).select(key, "_s.active_id", "_s.conversations", "_s.deleted_ids")
