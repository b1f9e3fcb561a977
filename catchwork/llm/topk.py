"""Exact top-k search by inner product: blocks of a document range in the order of their bounds, until no bound reaches the k-th score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwork.frames import written
from catchwork.llm.packs import RESULTS, Best, clustered, gathered, in_row, matrix, packed, plain, results, summaries, to_visit, whole_vectors

BLOCK = 64  # vectors whose term maxima are summed together


def extremes(x: np.ndarray) -> np.ndarray:
    """Maxima, then minima of each term."""
    return np.concatenate([x.max(axis=0), x.min(axis=0)]) if len(x) else np.zeros(2 * x.shape[1])


def summed_bounds(queries: np.ndarray, extreme: np.ndarray) -> np.ndarray:
    """For each query and block the sum over terms of the most that the term can add: no score of the block is above it. A weight below 0 takes the minimum."""
    high, low = np.hsplit(extreme, 2)
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def block_at_a_time(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK) -> tuple[list[Best], int]:
    """The k best rows of one document range for each query, its own row left out, and how many blocks were scored.

    A query takes its blocks in the order of their bounds, twice as many each time, and scores their vectors, until the next bound falls below its k-th
    score, or below its floor. An equal bound is still scored, for ties.
    """
    starts = np.arange(0, len(vectors), block)
    extreme = np.stack([extremes(vectors[a : a + block]) for a in starts.tolist()])
    bounds = summed_bounds(queries, extreme)
    order = np.argsort(-bounds, axis=1, kind="stable")
    out, scored = [], 0
    for q in range(len(queries)):
        best, at, step = Best(k, float(floors[q])), 0, 1
        while at < len(starts):
            few = order[q, at : at + step]
            few = few[bounds[q, few] >= best.floor]
            if not len(few):
                break
            docs = (starts[few][:, None] + np.arange(block)).reshape(-1)
            docs = docs[docs < len(vectors)]
            scores = vectors[docs] @ queries[q]
            on = (scores >= best.floor) & (rows[docs] != own[q])
            best.take(scores[on], ids[docs[on]], rows[docs[on]])
            scored, at, step = scored + len(few), at + step, 2 * step
        out.append(best)
    return out, scored


def _walked(met: DataFrame, k: int, block: int) -> DataFrame:
    """(own, part, score, id, row): for each row of met, a cluster of queries and a pack, the best of the pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, floors, vs, rows, ids, flat = in_row(batch, i, "q_rows", "q_floors", "q_vs", "rows", "ids", "vs")
                own = own.to_numpy()
                found, _ = block_at_a_time(matrix(vs, len(own)), own, floors.fill_null(-np.inf).to_numpy(zero_copy_only=False), matrix(flat, len(rows)), plain(ids), rows.to_numpy(), k, block)
                yield results([(q, 0, best) for q, best in zip(own.tolist(), found, strict=True)])

    return met.mapInArrow(run, RESULTS)


def _may(batch: pa.RecordBatch, i: int, facts: np.ndarray) -> np.ndarray:
    floors, vs = in_row(batch, i, "q_floors", "q_vs")
    bounds = summed_bounds(matrix(vs, len(floors)), facts)
    return (bounds >= floors.fill_null(-np.inf).to_numpy(zero_copy_only=False)[:, None]).any(axis=0)


def _queries(rows: DataFrame, key: str) -> DataFrame:
    return gathered(rows, key, "floor").select(key, "dim", F.col("rows").alias("q_rows"), F.col("floors").alias("q_floors"), F.col("vs").alias("q_vs"))


def top_k(vectors: DataFrame, queries: Column | None = None, k: int = 10, scale: float = 1024, pack: int = 512, group: int = 128, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where queries holds (ids divisible by 100), the k other rows of highest integer inner product, all if fewer; ties go to the smaller id.

    Each component x becomes floor(scale * x). Rows are put in the order of bounded-sample centres and cut into document ranges (packs), these into
    blocks of a few rows with the maxima and minima of every term. A query first searches the pack that it stands in; the k-th score there is its
    floor. Then each group of queries meets sheets of the packs' maxima, and only packs in which some query's summed bound reaches
    its floor move to it, to be searched block by block. Results do not depend on order, centres or sizes.

    Vectors that are null or hold null or non-finite components take no part; vectors of unlike length do not meet; components saturate at the
    root of 2**53 / length. Repeated rows and equal ids count as rows of their own; a null id is no query and comes
    last among ties. An empty table gives an empty one; further columns are not read.
    """
    found = written(whole_vectors(vectors, scale, id_col, vector_col), "topk_vectors")
    placed = packed(found, pack)
    packs = written(gathered(placed, "pack", "id"), "topk_packs")
    wanted = placed.where(F.coalesce(queries if queries is not None else F.col("id") % 100 == 0, F.lit(False)))
    asked = clustered(wanted, group)

    own = _queries(asked.withColumn("floor", F.lit(None).cast("double")), "pack").drop("dim").join(packs, "pack")
    floors = _walked(own, k, block).groupBy("own").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).select("own", "floor")
    floors = written(floors, "topk_floors")
    groups = written(_queries(asked.join(floors, asked.row == floors.own, "left"), "cluster"), "topk_groups")
    visits = written(to_visit(groups, summaries(packs, extremes), _may), "topk_visits")
    met = visits.join(groups.drop("dim"), "cluster").join(packs.drop("dim"), "pack")
    near = _walked(met, k, block)
    order = Window.partitionBy("own").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("asker"), F.col("id").alias("query_id"))
    return best.join(names, best.own == names.asker).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
