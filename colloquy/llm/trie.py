"""A prefix trie of conversations by partition refinement.

All conversations begin in one class, the root. A pass splits the active classes by their next turns, several at a time: members
that share all turns so far share a class, which Spark counts in one aggregate. A conversation that is alone in its class
is retired: its further turns are a unary chain, written out as it is and never grouped again. The rest goes on, with twice as
many turns in the next pass, so passes grow with the logarithm of the longest prefix that two conversations share. Then
the trie is folded back: each node belongs to the smallest of its members, and what a conversation's own nodes hold is summed into
every class on its path.

A prefix is known by its length and two 64-bit lanes, the exclusive-or of hashes of (place, digest of role and text), so no
text moves after it was read. Turns are put in order by ranges, so a conversation may lie in many tasks; its ids and lanes are
carried from part to part, with one small row for each part that begins inside a conversation. Classes and conversations of many
rows are joined by a broadcast.

Defined cases: a null role or text counts as empty, a null turn comes first, equal turns are put in order by the MD5 of role and
text; repeated rows are turns of their own; rows without conv_id belong to no conversation; a conversation without turns is a
member of the root; a childless node is a leaf, the root too; an empty table has no nodes; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.materialize import cut, written
from colloquy.llm.common import looked_up

#: Turns split in the first pass; ids, by their upper bits, that make one piece of a list.
FIRST = 4
PIECE_BITS = 12
NODE = ("pos", "p1", "p2")


def _lane(seed: int, place: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(seed), place, digest)


def _ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, turn, digest, size, j) with places j from 1, and (conv_id, part, n), the parts in order of their ranges."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))
    rows = written(turns.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "turns")
    counts = cut(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a part begins inside at most one conversation: no more rows than parts
    carried = counts.withColumn("carry", F.sum("n").over(before)).filter("carry is not null").drop("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest"))
    joined = rows.withColumn("j", place).join(F.broadcast(carried), ["conv_id", "part"], "left")
    return joined.withColumn("j", (F.col("j") + F.coalesce("carry", F.lit(0))).cast("long")).drop("carry"), counts


def prefixes(conversations: DataFrame, head: Column | None = None, base: Column | None = None, most: int = 0) -> DataFrame:
    """(conv_id, pos, len, p1, p2, size): a row for each conversation's prefix of ``pos`` turns, from 0 to its length.

    With ``head`` and ``base``, expressions over conv_id, each conversation is rebuilt: the first ``head`` turns (``most`` at the
    most) of conversation ``base``, then its own turns after as many.
    """
    turns, counts = _ordered(conversations)
    convs = counts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = convs.withColumn("h", F.lit(0).cast("long") if head is None else head.cast("long"))
    if base is None:
        convs = convs.withColumn("taken", F.array().cast("array<struct<j:bigint,digest:string,size:bigint>>"))
    else:
        wanted = convs.select(base.alias("conv_id")).distinct()
        first = turns.filter(F.col("j") <= most).join(wanted, "conv_id", "left_semi").groupBy("conv_id")
        heads = first.agg(F.array_sort(F.collect_list(F.struct("j", "digest", "size"))).alias("taken")).withColumnRenamed("conv_id", "_base")
        taken = F.filter(F.coalesce("taken", F.array()), lambda t: t["j"] <= F.col("h"))
        convs = convs.join(heads, base == F.col("_base"), "left").withColumn("taken", taken).drop("_base")
    step = lambda at, t, lane: F.element_at(at, -1)[f"p{lane}"].bitwiseXOR(_lane(lane, t["j"], t["digest"]))
    root = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(0).cast("long").alias("size")))
    path = F.aggregate("taken", root, lambda at, t: F.concat(at, F.array(F.struct(t["j"].alias("pos"), step(at, t, 1).alias("p1"), step(at, t, 2).alias("p2"), t["size"].alias("size")))))
    shift = F.size("taken") - F.col("h")
    convs = cut(convs.select("conv_id", "n", "h", shift.cast("long").alias("shift"), (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len"), path.alias("path")))
    heads = convs.select("conv_id", "len", F.explode("path").alias("at")).select("conv_id", "at.pos", "len", "at.p1", "at.p2", "at.size")
    last = F.element_at("path", -1)
    known = convs.select("conv_id", "n", "h", "shift", "len", last["p1"].alias("b1"), last["p2"].alias("b2"))
    own = looked_up(turns, known, "conv_id", "n").filter("j > h").withColumn("pos", F.col("j") + F.col("shift"))
    lanes = own.withColumns({f"t{i}": _lane(i, F.col("pos"), F.col("digest")) for i in (1, 2)})
    # conversations of several parts: the exclusive-or of the parts before, no more rows than parts
    several = F.broadcast(counts.groupBy("conv_id").agg(F.count("*").alias("_parts")).filter("_parts > 1").select("conv_id"))
    sums = lanes.join(several, "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(sums.select("conv_id", "part", *(F.bit_xor(f"t{i}").over(before).alias(f"c{i}") for i in (1, 2))))
    running = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lane = lambda i: F.bit_xor(f"t{i}").over(running).bitwiseXOR(F.col(f"b{i}")).bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long")))
    tails = lanes.join(carried, ["conv_id", "part"], "left").select("conv_id", "pos", "len", lane(1).alias("p1"), lane(2).alias("p2"), "size")
    return heads.unionByName(tails)


def refined(rows: DataFrame, first: int = FIRST) -> tuple[DataFrame, DataFrame | None]:
    """``prefixes`` rows to those of active conversations with their class (n members, owner the smallest, whether it is a leaf),
    and to the chains of retired ones."""
    active, members, chains = written(rows, "prefixes"), None, None
    last = first
    while True:
        here = active.filter(F.col("pos") <= last)
        classes = here.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), (F.max("len") == F.col("pos")).alias("leaf"))
        known = written(looked_up(here, classes, NODE, "n"), "classes")
        members = known if members is None else members.unionByName(known)
        ends = known.filter((F.col("pos") == last) & (F.col("len") > last)).select("conv_id", (F.col("n") == 1).alias("alone"), (F.col("len") - last).alias("_left"))
        deeper = written(looked_up(active.filter(F.col("pos") > last), ends, "conv_id", "_left").drop("_left"), "deeper")
        retired = deeper.filter("alone").drop("alone")
        chains = retired if chains is None else chains.unionByName(retired)
        active = deeper.filter("not alone").drop("alone")
        if active.isEmpty():
            return members, chains
        last = 2 * last + first


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one digest for each node, from one batch to the next."""
    key, state = None, hashlib.sha256()
    out: list[tuple[int, int, int, str]] = []
    for batch in batches:
        for *now, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], [*NODE, "ends"])


def ends(members: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids that end at each node, in order and comma-joined.

    Ids are first joined to pieces of at most 2 ** PIECE_BITS; the digest then runs along a node's pieces as they are read, since it
    can only be computed in order.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ended = members.filter("pos = len").withColumn("_range", F.shiftright("conv_id", PIECE_BITS))
    pieces = ended.groupBy(*NODE, "_range").agg(piece.alias("piece"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "_range")
    return dealt.select(*NODE, "piece").mapInArrow(_digested, "pos long, p1 long, p2 long, ends string")


def trie(conversations: DataFrame, head: Column | None = None, base: Column | None = None, most: int = 0) -> DataFrame:
    """(conv_id, turn, role, text) rows to a row for each node; ``head``, ``base`` and ``most`` as in ``prefixes``.

    conv_id is the node's smallest member, ends_sha256 the digest of the ids of members that end there.
    """
    members, chains = refined(prefixes(conversations, head, base, most))
    along = Window.partitionBy("conv_id").orderBy("pos")
    up = Window.partitionBy("conv_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("owner") == F.col("conv_id")
    # the next node is a conversation's own if it is its smallest member, or if the conversation was retired before it
    child = F.coalesce(F.lead("owner").over(along) == F.col("conv_id"), F.col("len") > F.col("pos"))
    leaf = F.max((F.col("n") == 1) | ((F.col("pos") == F.col("len")) & F.col("leaf") & mine)).over(Window.partitionBy("conv_id"))
    saved = F.sum(F.when(mine, (F.col("n") - 1) * F.col("size")).otherwise(0)).over(up)
    told = members.select("*", F.lag("owner").over(along).alias("parent"), child.cast("long").alias("child"), leaf.cast("long").alias("leaves"), saved.alias("saved"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    alone = F.when(F.col("pos") == F.col("len"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def single(rows: DataFrame, parent: Column, child: Column) -> DataFrame:
        return rows.select("conv_id", F.col("pos").alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), child.alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), alone.alias("ends_sha256"))

    shared = told.filter("n > 1").groupBy(*NODE).agg(
        F.min("owner").alias("conv_id"), F.min("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    shared = shared.join(ends(members.filter("n > 1")), [*NODE], "left")
    nodes = shared.select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256"))
    nodes = nodes.unionByName(single(told.filter("n = 1"), F.col("parent"), F.col("child")))
    return nodes.unionByName(single(chains, F.col("conv_id"), (F.col("pos") < F.col("len")).cast("long")))
