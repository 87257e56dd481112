"""Chat stores against a plain fold, in batch and in a stream of batches."""

import random

from pyspark.sql import functions as F

from colloquy.operators import chats, sessions
from colloquy.sources import versions

COMMANDS = "store string, at long, kind string, id string, turns array<struct<question:string,answer:string>>, new_id string, time string"
TRAILING = sessions.TRAILING


class Plain:
    """One store, changed in place as the commands say."""

    def __init__(self, first, time):
        self.convs, self.active, self.deleted = [dict(id=first, title="New chat", updated=time, turns=[])], first, []

    def get(self, id):
        return next((c for c in self.convs if c["id"] == id), None)

    def add(self, new, time):
        self.convs.append(dict(id=new, title="New chat", updated=time, turns=[]))
        self.active = new
        return self.convs[-1]

    @staticmethod
    def asked(turns):
        return any((q or "").strip() for q, _ in turns)

    def activate(self, new, time):
        idle = [c for c in self.convs if not self.asked(c["turns"])]
        if self.get(self.active) is None:
            if idle:
                self.active = idle[0]["id"]
            else:
                self.add(new, time)
        return self.get(self.active)

    def finalize(self, new, time):
        now = self.activate(new, time)
        shell = now if not self.asked(now["turns"]) else self.add(new, time)
        self.convs = [c for c in self.convs if self.asked(c["turns"])] + [shell]
        self.active = shell["id"]

    def do(self, kind, id, turns, new, time):
        if kind == "start":
            if self.activate(new, time)["turns"]:
                self.add(new, time)
        elif kind == "select":
            self.active = id if self.get(id) else self.active
        elif kind == "finalize":
            self.finalize(new, time)
        elif kind == "delete" and id:
            if id.strip() and id.strip() not in self.deleted:
                self.deleted = (self.deleted + [id.strip()])[-200:]
            active, self.convs = self.active == id, [c for c in self.convs if c["id"] != id]
            if not self.convs or active:
                self.add(new, time)
                self.finalize(new, time)
            elif self.get(self.active) is None:
                self.active = max(self.convs, key=lambda c: c["updated"])["id"]
        elif kind == "upsert":
            norm = [((q or "").strip(), (a or "").strip()) for q, a in turns or []]
            cid = (id or "").strip()
            if cid and (cid in self.deleted or self.get(cid) is None):
                return
            conv = self.get(cid) if cid else self.activate(new, time) if self.asked(norm) else self.add(new, time)
            titles = [t for t in (q.rstrip(TRAILING).strip() for q, _ in norm) if t]
            title = (titles or ["New chat"])[0]
            conv.update(turns=norm, updated=time, title=title if len(title) <= 32 else title[:32].rstrip() + "…")
            self.active = conv["id"]

    def shown(self):
        return self.active, [(c["id"], c["title"], c["updated"], c["turns"]) for c in self.convs], self.deleted


def folded(commands):
    stores = {}
    for store, _, kind, id, turns, new, time in sorted(commands, key=lambda c: (c[0], c[1])):
        if store not in stores:
            stores[store] = Plain(f"{store}-first", time)
        stores[store].do(kind, id, turns, new, time)
    return {k: v.shown() for k, v in stores.items()}


def shown(rows):
    return {r.store: (r.active_id, [(c.id, c.title, c.updated, [(t.question, t.answer) for t in c.turns]) for c in r.conversations], r.deleted_ids) for r in rows.collect()}


def wide(rows):
    none = [F.lit(None).cast("string").alias(c) for c in sessions.META]
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["question"].alias("question"), t["answer"].alias("answer"), *none)))


def made(seed, stores, most):
    rng, out = random.Random(seed), []
    for s in range(stores):
        ids = [f"s{s}-first"]
        for at in range(rng.randrange(1, most)):
            ids.append(f"n{s}.{at}")
            kind = rng.choice(["start", "select", "upsert", "upsert", "upsert", "delete", "finalize", "odd"])
            turns = rng.choice([None, [], [("", "x")], [(" why? ", "y"), (None, None)], [("?!", "a"), ("A question that is far too long for a title.", "b")]])
            out.append((f"s{s}", at, kind, rng.choice([*ids, "", " ", None, f" {ids[0]} ", "unknown"]), turns, f"n{s}.{at}", f"t{rng.randrange(5)}"))
    return out


def test_batch_equals_a_plain_fold(spark):
    commands = made(1, 60, 25)
    assert shown(chats.mutated(wide(spark.createDataFrame(commands, COMMANDS).repartition(3)), "store")) == folded(commands)
    assert chats.mutated(wide(spark.createDataFrame([], COMMANDS)), "store").count() == 0


def test_named_cases(spark):
    ask = [("What?", "This.")]
    commands = [
        # two new chats stay one; the title comes from the first question
        ("two", 0, "start", None, None, "a", "1"), ("two", 1, "start", None, None, "b", "2"), ("two", 2, "upsert", "two-first", ask, "c", "3"),
        # the only chat deleted; a late upsert does not bring it back
        ("gone", 0, "upsert", None, ask, "a", "1"), ("gone", 1, "delete", "gone-first", None, "b", "2"), ("gone", 2, "upsert", "gone-first", ask, "c", "3"),
        # the active one stays when another is deleted
        ("other", 0, "upsert", None, ask, "a", "1"), ("other", 1, "start", None, None, "b", "2"), ("other", 2, "upsert", "b", ask, "c", "3"), ("other", 3, "delete", "other-first", None, "d", "4"),
    ]
    got = shown(chats.mutated(wide(spark.createDataFrame(commands, COMMANDS)), "store"))
    assert got == folded(commands)
    assert [c[1] for c in got["two"][1]] == ["What"] and got["gone"][2] == ["gone-first"] and [c[1] for c in got["gone"][1]] == ["New chat"]
    assert got["other"][0] == "b" and len(got["other"][1]) == 1


def test_stream_of_batches_equals_the_whole_and_a_repeat_changes_nothing(spark, tmp_path):
    commands = made(3, 8, 20)
    path = str(tmp_path / "stores")
    apply = versions.once(path, "commands", lambda before, rows: chats.mutated(wide(rows), "store", before))
    for number, (low, high) in enumerate([(0, 5), (5, 6), (6, 100)]):
        batch = spark.createDataFrame([c for c in commands if low <= c[1] < high], COMMANDS)
        apply(batch, number)
        apply(batch, number)
    assert versions.history(spark, path) == [1, 2, 3]
    assert shown(versions.read(spark, path)) == folded(commands)
