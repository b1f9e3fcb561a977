"""Hard negatives: clusters of anchors share one list of each pack's candidates, sorted by an angular upper bound, and walk it until nothing behind can count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwork.frames import written
from catchwork.llm.packs import RESULTS, Best, clustered, directions, gathered, in_row, matrix, packed, plain, results, summaries, to_visit, whole_vectors

SLACK = 1e-6  # for rounding of angles and norms
FIRST = 64  # candidates that a walk takes at first, then twice as many each time

Take = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def middle(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean direction of some vectors and their largest angle with it. Zero vectors, whose scores are all 0, have no angle."""
    x = directions(vectors)
    centre = directions(x.sum(axis=0, keepdims=True))[0]
    some = x[np.abs(x).max(axis=1, initial=0) > 0]
    return centre, float(np.arccos(np.clip(some @ centre, -1, 1)).max(initial=0))


def least_angles(centre: np.ndarray, spread: float, others: np.ndarray) -> np.ndarray:
    """Angles that members of a cluster have at least with each of the other directions."""
    return np.maximum(0, np.arccos(np.clip(others @ centre, -1, 1)) - spread - SLACK)


def shared_list(members: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates in descending order of their upper bound, and the bounds: no member's score is above its own length times the bound."""
    centre, spread = middle(members)
    bounds = np.linalg.norm(candidates, axis=1) * (np.cos(least_angles(centre, spread, directions(candidates))) + SLACK)
    order = np.argsort(-bounds, kind="stable")
    return order, bounds[order]


def walk(members: np.ndarray, candidates: np.ndarray, needs: Callable[[], np.ndarray], take: Take) -> int:
    """Every member goes down the shared list until its bound is below what the member needs. take(members, candidates, scores) gets each portion; returns how many scores were taken."""
    order, bounds = shared_list(members, candidates)
    norms = np.linalg.norm(members, axis=1)
    at, step, seen = 0, FIRST, 0
    while at < len(order):
        live = np.flatnonzero(norms * bounds[at] >= needs())
        if not len(live):
            break
        few = order[at : at + step]
        take(live, few, members[live] @ candidates[few].T)
        seen, at, step = seen + len(live) * len(few), at + step, 2 * step
    return seen


def positives_of(members: np.ndarray, own: np.ndarray, labels: np.ndarray, floors: np.ndarray, candidates: np.ndarray, ids: np.ndarray, rows: np.ndarray, of_label: np.ndarray, k: int) -> list[Best]:
    """For each member the k best other candidates of its label, none below its floor."""
    best = [Best(k, f) for f in floors.tolist()]

    def take(live: np.ndarray, few: np.ndarray, scores: np.ndarray) -> None:
        on = (scores >= needs()[live, None]) & (of_label[few] == labels[live, None]) & (rows[few] != own[live, None])
        for i in np.flatnonzero(on.any(axis=1)).tolist():
            at = few[on[i]]
            best[live[i]].take(scores[i, on[i]], ids[at], rows[at])

    def needs() -> np.ndarray:
        return np.array([b.floor for b in best])

    walk(members, candidates, needs, take)
    return best


def negatives_of(members: np.ndarray, labels: np.ndarray, floors: np.ndarray, caps: np.ndarray, candidates: np.ndarray, ids: np.ndarray, rows: np.ndarray, of_label: np.ndarray, k: int) -> list[list[Best]]:
    """For each member and positive the k best candidates of other labels with scores from its floor to its cap. Floors and caps have a column for each positive; a floor above its cap asks for nothing."""
    best = [[Best(k, f) for f in x] for x in np.where(floors <= caps, floors, np.inf).tolist()]

    def take(live: np.ndarray, few: np.ndarray, scores: np.ndarray) -> None:
        other = of_label[few] != labels[live, None]
        for j in range(caps.shape[1]):
            on = other & (scores <= caps[live, j, None]) & (scores >= np.array([best[m][j].floor for m in live.tolist()])[:, None])
            for i in np.flatnonzero(on.any(axis=1)).tolist():
                at = few[on[i]]
                best[live[i]][j].take(scores[i, on[i]], ids[at], rows[at])

    def needs() -> np.ndarray:
        return np.array([min(b.floor for b in x) for x in best])

    walk(members, candidates, needs, take)
    return best


def _numbers(*arrays: pa.Array) -> list[np.ndarray]:
    return [a.to_numpy(zero_copy_only=False) for a in arrays]


def _search_positives(met: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, labels, floors, vs, rows, ids, of_label, flat = in_row(batch, i, "a_rows", "a_labels", "a_floors", "a_vs", "rows", "ids", "labels", "vs")
                own, labels, floors, rows, of_label = _numbers(own, labels, floors, rows, of_label)
                found = positives_of(matrix(vs, len(own)), own, labels, floors, matrix(flat, len(rows)), plain(ids), rows, of_label, k)
                yield results([(a, 0, b) for a, b in zip(own.tolist(), found, strict=True)])

    return met.mapInArrow(run, RESULTS)


def _search_negatives(met: DataFrame, k: int, most: int) -> DataFrame:
    """most: positives of an anchor; floors and caps have as many numbers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, labels, floors, caps, vs, rows, ids, of_label, flat = in_row(batch, i, "a_rows", "a_labels", "a_floors", "a_caps", "a_vs", "rows", "ids", "labels", "vs")
                floors, caps = (x.flatten() for x in (floors, caps))
                own, labels, floors, caps, rows, of_label = _numbers(own, labels, floors, caps, rows, of_label)
                shape = (len(own), most)
                found = negatives_of(matrix(vs, len(own)), labels, floors.reshape(shape), caps.reshape(shape), matrix(flat, len(rows)), plain(ids), rows, of_label, k)
                yield results([(a, j, b) for a, bs in zip(own.tolist(), found, strict=True) for j, b in enumerate(bs)])

    return met.mapInArrow(run, RESULTS)


def pack_facts(vectors: np.ndarray) -> np.ndarray:
    """Mean direction, largest angle with it, and largest length."""
    centre, spread = middle(vectors)
    return np.concatenate([centre, [spread, np.linalg.norm(vectors, axis=1).max(initial=0), float((~vectors.any(axis=1)).any())]])


def _may(batch: pa.RecordBatch, i: int, facts: np.ndarray) -> np.ndarray:
    """Packs in which the bound reaches what some anchor needs. A pack with a zero vector, whose score is 0, is visited by all that need no more."""
    needs, vs = in_row(batch, i, "a_needs", "a_vs")
    members, needs = matrix(vs, len(needs)), needs.to_numpy(zero_copy_only=False)
    centre, spread = middle(members)
    others, wide, longest, zero = facts[:, :-3], facts[:, -3], facts[:, -2], facts[:, -1]
    cosines = np.cos(np.maximum(0, least_angles(centre, spread, others) - wide - SLACK)) + SLACK
    # the largest length stands for all: below a right angle it gives the most, above it the bound is at most 0, which a length of 0 gives
    bounds = np.maximum(longest * cosines, np.where(cosines < 0, 0, -np.inf))
    norms = np.linalg.norm(members, axis=1)
    return (norms[:, None] * bounds >= needs[:, None]).any(axis=0) | ((zero > 0) & (needs <= 0).any())


def _anchors(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Anchors in bounded groups; the columns of a group as a_ arrays."""
    return gathered(rows, key, *columns).select(key, "dim", *(F.col(f"{c}s").alias(f"a_{c}s") for c in ("row", *columns, "v")))


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("own", "part").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column | None = None, label: Column | None = None, n_positives: int = 5, n_negatives: int = 3, share: tuple[int, int] = (50, 95), scale: float = 256, pack: int = 512, group: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (ids divisible by 50) and each of its positives, the best rows of other labels whose score is from share[0] to share[1] hundredths of the positive's.

    Each component x becomes floor(scale * x); the score of two rows is their integer inner product; higher scores come first, then smaller ids.
    Positives are the first n_positives other rows of the anchor's label, all if fewer. label gives the label of a row (where the id is divisible by
    7, the next of ten).

    Candidates lie in packs of near vectors. Anchors are clustered, at most `group` of one centre together. In each pack that a cluster visits, the
    candidates are sorted once by length times the cosine of their angle to the cluster's mean direction less the cluster's spread, an
    upper bound for every member; each member walks that list until the bound certifies that nothing behind reaches what it still needs. That is
    at first the k-th score in the anchor's own pack, which also tells which packs a cluster has to visit at all. Positives
    come first, since they set the limits of the negatives. Results do not depend on centres, packs or clusters.

    Rows with a null label, a null vector or null or non-finite components take no part; vectors of unlike length do not meet; components saturate at
    the root of 2**53 / length. Repeated rows and equal ids count as rows of their own; a row with a null id is no anchor and comes last among
    ties. Where a positive's score is below 0, no score lies in the range. An empty table gives an empty one; further columns are not read.
    """
    own_label, i = F.col(label_col).cast("long"), F.col(id_col).cast("long")
    label = label if label is not None else F.when(i % 7 == 0, (own_label + 1) % 10).otherwise(own_label)
    found = written(whole_vectors(vectors.where(F.col(label_col).isNotNull()), scale, id_col, vector_col, label=label), "negatives_vectors")
    placed = packed(found, pack)
    packs = written(gathered(placed, "pack", "id", "label"), "negatives_packs")
    sheets = summaries(packs, pack_facts)
    asked = clustered(placed.where(F.coalesce(anchors if anchors is not None else F.col("id") % 50 == 0, F.lit(False))), group)
    bare = packs.drop("dim")
    none = F.lit(float("-inf"))

    own = _anchors(asked.withColumn("floor", none), "pack", "label", "floor").drop("dim").join(bare, "pack")
    floors = _search_positives(own, n_positives).groupBy("own").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor"))
    floors = written(floors.where(F.col("n") == n_positives).select("own", "floor"), "negatives_floors")
    rows = asked.join(floors, asked.row == floors.own, "left").withColumn("floor", F.coalesce("floor", none))
    groups = written(_anchors(rows, "cluster", "label", "floor").withColumn("a_needs", F.col("a_floors")), "negatives_groups")
    visits = written(to_visit(groups, sheets, _may), "negatives_visits")
    positives = written(_first(_search_positives(visits.join(groups.drop("dim"), "cluster").join(bare, "pack"), n_positives), n_positives), "negatives_positives")

    limits = positives.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))  # n_positives at most
    score = F.transform("p", lambda x: x["score"])
    low, cap = F.transform(score, lambda s: F.ceil(s * share[0] / 100).cast("double")), F.transform(score, lambda s: F.floor(s * share[1] / 100).cast("double"))
    wide = lambda x, fill: F.slice(F.concat(x, F.array_repeat(F.lit(fill), n_positives)), 1, n_positives)  # noqa: E731  a floor above its cap for positives that are not there
    limits = written(limits.select("own", wide(low, 1.0).alias("low"), wide(cap, 0.0).alias("cap")), "negatives_limits")
    rows = asked.join(limits, asked.row == limits.own).drop("own")
    own = _anchors(rows.withColumn("floor", F.col("low")), "pack", "label", "floor", "cap").drop("dim").join(bare, "pack")
    full = _search_negatives(own, n_negatives, n_positives).groupBy("own", "part").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("score")).where(F.col("n") == n_negatives)
    full = written(full.groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct("part", "score"))).alias("seen")), "negatives_full")
    rows = rows.join(full, rows.row == full.own, "left").drop("own")
    floor = F.transform("low", lambda x, j: F.coalesce(F.col("seen")[j], x))
    needs = F.array_min(F.transform(F.arrays_zip(floor.alias("low"), F.col("cap").alias("cap")), lambda x: F.when(x["low"] <= x["cap"], x["low"]).otherwise(F.lit(float("inf")))))
    rows = rows.withColumn("floor", floor).withColumn("need", needs).where(F.col("need") < float("inf"))
    groups = written(_anchors(rows, "cluster", "label", "floor", "cap", "need"), "negatives_ranges")
    visits = written(to_visit(groups, sheets, _may), "negatives_range_visits")
    near = _first(_search_negatives(visits.join(groups.drop("dim"), "cluster").join(bare, "pack"), n_negatives, n_positives), n_negatives)

    of = positives.select("own", (F.col("rank") - 1).alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asked.select(F.col("row").alias("own"), F.col("id").alias("anchor_id"))
    out = near.select("own", "part", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(of, ["own", "part"]).join(names, "own").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
