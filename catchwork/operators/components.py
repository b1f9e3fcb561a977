"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.frames import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node that links reach.

    Each round takes the least label among the neighbours, gives it to the whole group that shares the old label and then
    shortens label chains by one jump, so rounds grow with the logarithm of a component's width. Every round is a written
    table. Edges with a null end are ignored; self-loops give a component of their own. Raises when max_rounds do not do.
    """
    both = edges.select(F.col(a).alias("s"), F.col(b).alias("d")).where("s is not null and d is not null")
    both = written(both.union(both.select("d", "s")).distinct(), "cc_edges")
    state = written(both.groupBy(F.col("s").alias("node")).agg(F.min(F.least("s", "d")).alias("label")), "cc_0")
    last = state
    for i in range(max_rounds):
        seen = both.join(state, both.d == state.node).groupBy(F.col("s").alias("n")).agg(F.min("label").alias("m"))
        near = state.join(seen, state.node == seen.n, "left").select("node", "label", F.least("label", "m").alias("best"))
        near = written(near, f"cc_{i}_near")
        hook = near.groupBy(F.col("label").alias("h")).agg(F.min("best").alias("hooked"))
        moved = near.join(hook, near.label == hook.h).select("node", F.col("label").alias("old"), F.col("hooked").alias("goal"))
        moved = written(moved, f"cc_{i}_moved")
        up = moved.select(F.col("node").alias("p"), F.col("goal").alias("over"))
        done = written(moved.join(up, moved.goal == up.p, "left").select("node", "old", F.coalesce("over", "goal").alias("label")), f"cc_{i}")
        discard(last, near, moved)
        state, last = done.select("node", "label"), done
        if done.where("label <> old").isEmpty():
            discard(both)
            return state.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
