"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group and stay together where they fit. Spark sums each group's rows, bytes and tokens. Groups that weigh
enough to matter for the balance, a bounded number, are placed one by one; all others are dealt by their text's hash into a
fixed number of bundles, which are placed like groups. Tokens are blanks and line feeds plus one, a count that needs no tokenizer. A group larger than a shard's share is first cut into parts by the
hash of its rows. Each is placed, largest first, in the shard where the dot product of its demand with the residual
capacity is highest, among those whose residual bytes leave the sizes nearest to equal. The plan is broadcast: its size
depends on the number of shards only.

Defined cases: a null text has no bytes and groups with empty ones; repeated rows and null ids are placed each; with fewer
groups than shards some shards stay empty; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.materialize import cut
from colloquy.llm.common import ranked

SHARDS = 40
OVERHEAD = 16
#: Bundles of light groups for each shard; a group is heavy from 1 / BUNDLES of a shard's share on in some dimension.
BUNDLES = 256
#: Parts, for each shard's share, of a group that is cut.
PARTS = 64
DIMENSIONS = ("bytes", "tokens", "rows")


def placed(demands: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each demand (rows of bytes, tokens, count): largest first, by the dot product with what is left.

    All numbers are in shares of a shard's capacity. Only shards with the most room in bytes, up to the size of the demand,
    are candidates, so that the sizes in bytes end near equal.
    """
    total = demands.sum(axis=0)
    scaled = demands / np.maximum(total / shards, 1e-12)
    residual = np.ones((shards, demands.shape[1]))
    out = np.zeros(len(demands), np.int64)
    for i in np.lexsort((np.arange(len(demands)), -scaled.sum(axis=1), -scaled.max(axis=1))).tolist():
        need = scaled[i]
        room = residual[:, 0]
        near = room >= room.max() - need[0] if room.max() >= need[0] else room >= room.max() - 1e-12
        score = np.where(near, residual @ need, -np.inf)
        out[i] = int(np.argmax(score))
        residual[out[i]] -= need
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, text) to (doc_id, size, text_crc32, tokens, group, shard, slot)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            (F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("long").alias("tokens"),
            F.xxhash64(text, F.octet_length(text)).alias("group"),
        )
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = cut(rows.groupBy("group").agg(*sums))
    total = groups.agg(*(F.coalesce(F.sum(d), F.lit(0)).cast("double").alias(d) for d in DIMENSIONS)).first()
    share = [max(total[d], 1.0) / shards for d in DIMENSIONS]
    weight = F.greatest(*(F.col(d) / s for d, s in zip(DIMENSIONS, share)))
    heavy = groups.withColumn("_weight", weight).filter(F.col("_weight") >= 1 / BUNDLES)
    # heavy groups are at most three times shards times BUNDLES, those to be cut three times shards
    cuts = heavy.filter(F.col("_weight") > 0.9).select("group", F.ceil(F.col("_weight") * PARTS).cast("int").alias("_parts"))
    cut_up = rows.join(F.broadcast(cuts), "group").withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("_parts")).cast("int"))
    parts = cut_up.groupBy("group", "_part").agg(*sums)
    whole = heavy.filter(F.col("_weight") <= 0.9).select("group", F.lit(-1).alias("_part"), *DIMENSIONS)
    bundle = F.pmod(F.xxhash64("group", F.lit(3)), F.lit(shards * BUNDLES)).cast("long")
    light = groups.filter(weight < 1 / BUNDLES).groupBy(bundle.alias("group")).agg(*(F.sum(d).alias(d) for d in DIMENSIONS))
    table = parts.unionByName(whole).unionByName(light.select("group", F.lit(-2).alias("_part"), *DIMENSIONS)).orderBy("_part", "group").toPandas()
    table["shard"] = placed(table[list(DIMENSIONS)].to_numpy(np.float64), shards) if len(table) else []
    plan = spark.createDataFrame(
        [(int(g), int(p), int(s)) for g, p, s in zip(table["group"], table["_part"], table["shard"])], "_group long, _part int, shard int"
    )
    marked = (
        rows.join(F.broadcast(heavy.select("group", F.when(F.col("_weight") > 0.9, F.ceil(F.col("_weight") * PARTS)).cast("int").alias("_parts"), F.lit(True).alias("_heavy"))), "group", "left")
        .withColumn("_part", F.when(F.col("_heavy").isNull(), -2).when(F.col("_parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("_parts"))).cast("int"))
        .withColumn("_group", F.when(F.col("_heavy").isNull(), bundle).otherwise(F.col("group")))
    )
    joined = marked.join(F.broadcast(plan), ["_group", "_part"]).select("doc_id", "size", "text_crc32", "tokens", "group", "shard")
    return ranked(cut(joined), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
