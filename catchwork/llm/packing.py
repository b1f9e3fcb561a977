"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.frames import written

COPIES = 1000  # repeated rows that one task deals


def bin_cost(capacity: int, overhead: int, attention: int) -> int:
    """What a sequence of that length costs: its tokens, padding included, attention that grows with their square, and a fixed overhead."""
    return capacity + capacity * capacity // attention + overhead


def best_fit(sizes: list[int], capacities: list[int], plan: list[int]) -> tuple[list[int], list[int]]:
    """(bin of each size, capacity of each bin) for sizes in descending order, none above the largest capacity.

    A size goes into the open bin with the least room that holds it, the lowest number among equals. If none does, a bin opens: of the
    capacity that plan states for the smallest capacity that holds the size. At the end each bin shrinks to the smallest permitted
    capacity that holds its contents.
    """
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    where = []
    for size in sizes:
        i = bisect.bisect_left(room, (size, -1))
        if i < len(room):
            space, b = room.pop(i)
        else:
            space = plan[bisect.bisect_left(capacities, size)]
            b = len(used)
            used.append(0)
        where.append(b)
        used[b] += size
        if space > size:
            bisect.insort(room, (space - size, b))
    return where, [capacities[bisect.bisect_left(capacities, u)] for u in used]


def planned(sizes: list[int], capacities: list[int], cost: dict[int, int]) -> list[int]:
    """The least-cost capacity to open for each class of sizes (those that a capacity holds and the next smaller one does not), all classes together.

    The cost of a plan is that of all its bins after packing these sizes with it, so padding, shrinking and what small pieces fill
    up in the bins of larger ones count. From every plan that opens each class at one least capacity, one class after the other takes its best
    capacity, until none changes.
    """
    known: dict[tuple[int, ...], int] = {}

    def total(plan: tuple[int, ...]) -> int:
        if plan not in known:
            known[plan] = sum(cost[c] for c in best_fit(sizes, capacities, list(plan))[1])
        return known[plan]

    plan = min((tuple(max(least, c) for c in capacities) for least in capacities), key=lambda p: (total(p), p))
    while True:
        before = plan
        for i in range(len(capacities)):
            plan = min((plan[:i] + (c,) + plan[i + 1 :] for c in capacities[i:]), key=lambda p: (total(p), p))
        if plan == before:
            return list(plan)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), overhead: int = 256, attention: int = 8192, rows_a_pack: int = 4000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, pack, bin, bin_pos, offset, capacity): where each piece of each row of docs lies.

    A token is a run of text without ASCII white space. Documents longer than the largest capacity are cut into pieces of that length
    and a rest, so whole texts are packed. A sequence of length c costs c + c * c / attention + overhead. Pieces are dealt by hash into packs of about
    rows_a_pack rows; for each the capacities to open are planned together for the least cost, and it is packed by itself in bounded
    memory. A bin never mixes packs; pack and bin name it. Equal pieces go in the order of doc_id, text hash, piece; the packs
    depend on the rows alone, not on how files hold them. Rows without tokens (null, empty or blank texts) are not
    packed. Null and repeated ids keep their rows. An empty table gives an empty one. Further columns are not read.
    """
    caps = sorted(set(capacities))
    most = caps[-1]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.xxhash64(text).alias("t"))
    rows = rows.where("tokens > 0")
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / most).cast("int"))).alias("piece")
    pieces = rows.select("doc_id", "t", "tokens", piece).select("doc_id", "t", "piece", (F.col("piece").cast("long") * most).alias("start_token"), F.least(F.lit(most).cast("long"), F.col("tokens") - F.col("piece").cast("long") * most).alias("n_tokens"))
    pieces = written(pieces, "pack_pieces")
    packs = max(1, -(-pieces.count() // rows_a_pack))
    equal = written(pieces.groupBy("doc_id", "t", "piece", "start_token", "n_tokens").agg(F.count("*").alias("copies")), "pack_equal")
    fits = F.col("copies") <= COPIES
    blocks = equal.where(~fits).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))).repartition("doc_id", "t", "piece", "from")
    each = equal.where(fits).withColumn("from", F.lit(0).cast("long")).unionByName(blocks)
    each = each.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("copies"), F.col("from") + COPIES) - 1)))
    pack = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "t", "piece", "copy"), F.lit(packs)).cast("int")  # copies of a row do not all meet in one pack
    pieces = written(each.select("doc_id", "t", "piece", "start_token", "n_tokens", pack.alias("pack")), "pack_dealt")
    cost = {c: bin_cost(c, overhead, attention) for c in caps}

    def run(table: pa.Table) -> pa.Table:
        ids = [(float("-inf") if x is None else x) for x in table.column("doc_id").to_pylist()]
        t, number, size = (table.column(c).to_pylist() for c in ("t", "piece", "n_tokens"))
        order = sorted(range(len(ids)), key=lambda i: (-size[i], ids[i], t[i], number[i]))
        sizes = [size[i] for i in order]
        where, capacity = best_fit(sizes, caps, planned(sizes, caps, cost))
        filled, held = [0] * len(capacity), [0] * len(capacity)
        offsets, places = [], []
        for i, b in zip(order, where, strict=True):
            offsets.append(filled[b])
            places.append(held[b])
            filled[b] += size[i]
            held[b] += 1
        own = table.take(pa.array(order, pa.int64())).combine_chunks()
        columns = [own.column(c) for c in ("doc_id", "piece", "start_token", "n_tokens", "pack")]
        columns += [pa.array(where, pa.int64()), pa.array(places, pa.int32()), pa.array(offsets, pa.int64()), pa.array(np.array(capacity, dtype=np.int64)[where])]
        return pa.table(columns, names=["doc_id", "piece", "start_token", "n_tokens", "pack", "bin", "bin_pos", "offset", "capacity"])

    schema = "doc_id long, piece int, start_token long, n_tokens long, pack int, bin long, bin_pos int, offset long, capacity long"
    return pieces.groupBy("pack").applyInArrow(run, schema)
