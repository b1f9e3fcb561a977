"""Balanced label propagation: documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwork.frames import prefix_sum, written

MASK = (1 << 60) - 1
GROUP = ["t1", "t2"]


def _pick(values: list[int], shard: str) -> Column:
    """The entry of a short list for the shard in a column."""
    return F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), F.col(shard) + 1)


def _loads(blocks: DataFrame, shards: int) -> list[int]:
    by = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row for each shard
    return [by.get(s, 0) for s in range(shards)]


def _round(blocks: DataFrame, n_blocks: int, loads: list[int], cap: int, shards: int, seed: int) -> DataFrame:
    """One propagation: every block of a group wants the shard with room where the group has most; each shard takes as many as fit, in hashed order, splitting the last block."""
    room = [max(0, cap - x) for x in loads]
    group = Window.partitionBy(*GROUP)  # as many rows as shards at most
    rank = F.struct(F.col("n"), (-F.col("shard")).alias("s"))
    best = F.max(F.when(_pick(room, "shard") > 0, rank)).over(group)
    wanting = blocks.withColumn("_best", best).withColumn("_own", rank).where(F.col("_best").isNotNull() & (F.col("_own") < F.col("_best")))
    wanting = wanting.select(*GROUP, "shard", "n", (-F.col("_best.s")).alias("goal"), F.xxhash64(F.lit(seed), *GROUP).bitwiseAND(F.lit(MASK)).alias("_h"))
    queued = prefix_sum(wanting, ["goal"], "_h", [*GROUP, "shard"], F.col("n"), "_upto", n_blocks)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), _pick(room, "goal") - (F.col("_upto") - F.col("n"))))
    moves = queued.select(*GROUP, "shard", "goal", taken.alias("k")).where("k > 0")
    left = moves.select(*GROUP, "shard", (-F.col("k")).alias("n"), F.lit(0).cast("long").alias("moved"))
    come = moves.select(*GROUP, F.col("goal").alias("shard"), F.col("k").alias("n"), F.col("k").alias("moved"))
    every = blocks.select(*GROUP, "shard", "n", F.lit(0).cast("long").alias("moved")).union(left).union(come)
    return every.groupBy(*GROUP, "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).where("n > 0 or moved > 0")


def _placed(ranges: list[tuple[int, int, int]], low: Column, high: Column) -> Column:
    """Array of (shard, n): how the numbers from low up to high fall into the ranges (shard, from, to)."""
    parts = [F.struct(F.lit(s).cast("int").alias("shard"), (F.least(high, F.lit(z).cast("long")) - F.greatest(low, F.lit(a).cast("long"))).alias("n")) for s, a, z in ranges]
    return F.filter(F.array(*parts), lambda x: x["n"] > 0)


def shard_documents(docs: DataFrame, shards: int = 16, slack: float = 0.05, rounds: int = 20, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs, by the law `rows`: shard counts differ by one at most.

    Linked documents are those with equal texts. They begin in hashed shards; in each round a group's documents move towards the
    shard where most of their neighbours are, as far as its quota (an even share plus slack) has room. Equal documents are
    interchangeable, so the state holds a group's count in each shard, at most `shards` rows a group, and a group with a third of all
    rows is no longer than any other. It ends when nothing moves, or after `rounds` rounds. Then shards over their even
    share give up blocks in hashed order, and those with the unlinked documents fill the rest. slot numbers a shard's documents
    from 0 without gaps. size is the text's UTF-8 bytes plus 1; a null text is an empty one (size 1, checksum 0) and is linked like
    any other. Null or repeated ids keep their rows; with fewer rows than shards some stay empty; an empty table gives an
    empty one. Further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    items = written(items.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "t1").bitwiseAND(F.lit(MASK))), "shard_items")
    total = items.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    linked = written(items.groupBy(*GROUP).count().where("count > 1"), "shard_groups")
    large = F.broadcast(linked.where(F.col("count") > max(100, total // 100_000)).select(*GROUP))  # 100,000 rows at most
    rest = items.join(large, GROUP, "left_anti")  # joins by text deal no group larger than that into one task
    members = items.join(large, GROUP, "left_semi").unionByName(rest.join(linked, GROUP, "left_semi"))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(shards)).cast("int")
    blocks = written(members.groupBy(*GROUP, start.alias("shard")).agg(F.count("*").alias("n")), "shard_blocks")
    n_blocks, cap = blocks.count(), -(-total // shards) + int(slack * total / shards)
    for i in range(rounds):
        loads = _loads(blocks, shards)
        moved = written(_round(blocks, n_blocks, loads, cap, shards, seed + i), f"shard_round_{i}")
        blocks = moved.where("n > 0").select(*GROUP, "shard", "n")
        if moved.where("moved > 0").isEmpty():
            break
    loads = _loads(blocks, shards)
    queued = prefix_sum(blocks.withColumn("_h", F.xxhash64(F.lit(seed), *GROUP).bitwiseAND(F.lit(MASK))), ["shard"], "_h", GROUP, F.col("n"), "_upto", n_blocks)
    surplus = [max(0, a - q) for a, q in zip(loads, quota, strict=True)]
    out = F.greatest(F.lit(0), F.least(F.col("n"), _pick(surplus, "shard") - (F.col("_upto") - F.col("n"))))
    queued = written(queued.select(*GROUP, "shard", "n", "_h", out.cast("long").alias("out")), "shard_evened")
    free, at = [], 0
    for s in range(shards):
        space = quota[s] - (loads[s] - surplus[s])
        free.append((s, at, at + space))
        at += space
    given = prefix_sum(queued.where("out > 0").withColumn("_k", F.lit(0)), ["_k"], "_h", [*GROUP, "shard"], F.col("out"), "_upto", n_blocks)
    refit = given.select(*GROUP, F.explode(_placed(free, F.col("_upto") - F.col("out"), F.col("_upto"))).alias("x")).select(*GROUP, "x.shard", "x.n")
    final = queued.select(*GROUP, "shard", (F.col("n") - F.col("out")).alias("n")).where("n > 0").union(refit).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = final.withColumn("upto", F.sum("n").over(upto)).groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    ends = written(ends, "shard_ends")
    ranked = prefix_sum(members, GROUP, "h", ["doc_id"], F.lit(1), "_rank", total)
    first = F.get(F.filter("ends", lambda x: x["upto"] >= F.col("_rank")), 0)["shard"]
    ranked = written(ranked, "shard_ranked")
    placed = ranked.join(F.broadcast(ends.join(large, GROUP, "left_semi")), GROUP).unionByName(ranked.join(large, GROUP, "left_anti").join(ends, GROUP))
    placed = placed.select("doc_id", "size", "text_crc32", "h", first.alias("shard"))
    used = sum(surplus)
    alone = prefix_sum(rest.join(linked, GROUP, "left_anti").withColumn("_k", F.lit(0)), ["_k"], "h", ["doc_id", "t1"], F.lit(1), "_rank", total)
    spot = F.col("_rank") - 1 + used
    rest = alone.select("doc_id", "size", "text_crc32", "h", F.get(_placed(free, spot, spot + 1), 0)["shard"].alias("shard"))
    order = F.xxhash64(F.lit(seed + 2), "h").bitwiseAND(F.lit(MASK)).alias("_order")  # unlinked documents fill shards by ranges of h, so slots need a hash of their own
    placed = written(placed.union(rest).select("*", order), "shard_placed")
    slotted = prefix_sum(placed, ["shard"], "_order", ["h", "doc_id"], F.lit(1), "_slot", total)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
