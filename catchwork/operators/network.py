"""Network operators: joins per round, never a walk in one task. Every round is a written table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import discard, ranked, written
from catchwork.operators.components import connected_components


def snapped(pipes: DataFrame, decimals: int = 6) -> DataFrame:
    """Pipes with keys of their rounded ends and a reason to drop: self_loop, zero_length or none. pipes has a_lon, a_lat, b_lon, b_lat, length_m."""
    key = lambda s: F.concat_ws(" ", F.round(f"{s}_lon", decimals).cast("string"), F.round(f"{s}_lat", decimals).cast("string"))
    x = pipes.withColumn("a_key", key("a")).withColumn("b_key", key("b"))
    return x.withColumn("dropped", F.when(F.col("a_key") == F.col("b_key"), "self_loop").when(F.col("length_m") <= 0, "zero_length"))


def node_table(ends: DataFrame, grounds: DataFrame) -> DataFrame:
    """(node_key, lon, lat, ground_m): the first seen place and the last written ground of each node, both by file_seq."""
    at = ends.groupBy("node_key").agg(F.min_by(F.struct("lon", "lat"), F.struct("file_seq", "side")).alias("p"))
    ground = grounds.where("ground_m is not null").groupBy("node_key").agg(F.max_by("ground_m", "file_seq").alias("ground_m"))
    return at.join(ground, "node_key", "left").select("node_key", "p.lon", "p.lat", "ground_m")


def filled_inverts(nodes: DataFrame, edges: DataFrame, rounds: int = 1) -> DataFrame:
    """(node_key, invert_m, source, ground_m): published inverts, then tiers: neighbours' least, own ground less 2.5 m, neighbours, terrain less 2.5 m, neighbours, the least of all.

    nodes: (node_key, invert_m, ground_m, dem_m); edges: (a, b). A neighbour sweep is synchronous: values found in a round reach
    further nodes in the next one, for `rounds` rounds or until none is found, so the result depends on no order. Terrain that gives an invert is the node's
    ground too, where it has none.

    A node that had no known neighbour can only meet one that got its value since, so each value is sent once, over the edges to nodes without one, and only these nodes are written again.
    """
    state = written(nodes.select("node_key", "invert_m", "ground_m", "dem_m"), "fill_nodes")
    known, rest = state.where("invert_m is not null"), state.where("invert_m is null")
    done = [known.withColumn("source", F.lit("data"))]
    fresh = known.select(F.col("node_key").alias("o"), F.col("invert_m").alias("i"))
    steps = edges.select("a", "b").union(edges.select("b", "a")).toDF("n", "o")

    def give(found: DataFrame, name: str) -> DataFrame:
        done.append(found.select("node_key", "invert_m", "ground_m", "dem_m", F.lit(name).alias("source")))
        return found.select(F.col("node_key").alias("o"), F.col("invert_m").alias("i"))

    for ground, name in (("ground_m", "rim"), ("dem_m", "dem"), (None, None)):
        last, steps = steps, written(steps.join(rest.select(F.col("node_key").alias("n")), "n", "left_semi"), "fill_edges")
        discard(last)
        for _ in range(rounds):
            near = steps.join(fresh, "o").groupBy(F.col("n").alias("node_key")).agg(F.min("i").alias("near"))
            met = written(rest.drop("invert_m").join(near, "node_key", "left").withColumnRenamed("near", "invert_m"), "fill_round")
            fresh, rest = give(met.where("invert_m is not null"), "neighbour"), met.where("invert_m is null")
            if fresh.isEmpty():
                break
        if ground:
            given = rest.where(f"{ground} is not null").withColumn("invert_m", F.col(ground) - k.FALLBACK_NODE_DEPTH_M)
            given = given.withColumn("ground_m", F.coalesce("ground_m", "dem_m")) if name == "dem" else given
            fresh, rest = fresh.union(give(given, name)), rest.where(f"{ground} is null")
    discard(steps)
    none = F.lit(None).cast("double")
    state = reduce(DataFrame.unionByName, [*done, rest.withColumn("invert_m", none).withColumn("source", F.lit(None).cast("string"))])
    lowest = state.agg(F.coalesce(F.min("invert_m"), F.lit(0.0)).alias("lowest"))
    state = state.join(F.broadcast(lowest))  # one row
    return state.select("node_key", F.coalesce("invert_m", "lowest").alias("invert_m"), F.coalesce("source", F.lit("global_min")).alias("source"), "ground_m")


def refilled_errors(nodes: DataFrame, edges: DataFrame, folds: int = 5, rounds: int = 1, fold: Column | None = None) -> DataFrame:
    """(node_key, fold, truth_m, refilled_m, source): each known invert as the tiers of filled_inverts fill it when it and the others of its fold are hidden.

    A fold, from 0 to folds - 1, is a hash of the node where none is given; folds are few. There is a copy of the network for each, but a node stays one row with a level for each copy, and an edge is
    walked once for all of them, so rows do not grow with the folds. A known node lacks a level in its own copy alone; levels of one copy only meet levels of the same.

    As in filled_inverts each level is sent once, and only nodes that lack one in some copy are written again. Edges are not written anew: as nearly every node lacks one in the first rounds, few would fall out.
    """
    fold = fold if fold is not None else F.pmod(F.xxhash64("node_key"), F.lit(folds)).cast("int")
    copies = range(folds)
    own, v, near, new = ["node_key", "fold", "truth_m", "ground_m", "dem_m"], *([f"{c}{x}" for x in copies] for c in ("v", "near", "new"))
    shown = [F.when(F.col("fold") != x, F.col("truth_m")) for x in copies]
    lacks = [shown[x].isNull() & F.col(v[x]).isNull() for x in copies]
    state = written(nodes.select("node_key", fold.alias("fold"), F.col("invert_m").alias("truth_m"), "ground_m", "dem_m"), "refill_nodes")
    rest = state.select(*own, *(F.lit(None).cast("double").alias(c) for c in v))
    steps = edges.select("a", "b").union(edges.select("b", "a")).toDF("n", "o")
    # what goes over the edges, and what of it counts in each copy
    sent, levels = state.where("truth_m is not null").select(F.col("node_key").alias("o"), "fold", "truth_m"), shown
    lowest, done = [state.select(*(shown[x].alias(v[x]) for x in copies))], []  # neighbours' levels are never below these

    def give(found: DataFrame, name: str) -> None:
        done.append(found.where("truth_m is not null").select(*own, *v, F.lit(name).alias("source")))

    for ground, name in (("ground_m", "rim"), ("dem_m", "dem"), (None, None)):
        for _ in range(rounds):
            least = steps.join(sent, "o").groupBy(F.col("n").alias("node_key")).agg(*(F.min(levels[x]).alias(near[x]) for x in copies))
            found = [lacks[x] & F.col(near[x]).isNotNull() for x in copies]
            met = rest.join(least, "node_key", "left").select(*own, *(F.when(lacks[x], F.col(near[x])).otherwise(F.col(v[x])).alias(v[x]) for x in copies), *(found[x].alias(new[x]) for x in copies))
            met = written(met.withColumn("open", reduce(Column.__or__, lacks)), "refill_round")
            give(met.where("not open"), "neighbour")
            rest = met.where("open").select(*own, *v)
            sent, levels = met.where(" or ".join(new)).select(F.col("node_key").alias("o"), *(F.when(F.col(new[x]), F.col(v[x])).alias(v[x]) for x in copies)), [F.col(c) for c in v]
            if sent.isEmpty():
                break
        if ground:
            level = F.col(ground) - k.FALLBACK_NODE_DEPTH_M
            given = rest.where(f"{ground} is not null").select(*own, *(F.when(lacks[x], level).alias(v[x]) for x in copies))
            give(given, name)
            lowest.append(given.select(*v))
            more = given.select(F.col("node_key").alias("o"), *v)
            sent, rest = sent.union(more) if rounds else more, rest.where(f"{ground} is null")
    left = rest.where("truth_m is not null").withColumn("source", F.lit("global_min"))
    least = reduce(DataFrame.union, lowest).agg(*(F.coalesce(F.min(v[x]), F.lit(0.0)).alias(near[x]) for x in copies))
    left = left.join(F.broadcast(least)).withColumns({v[x]: F.coalesce(v[x], F.when(F.col("fold") == x, F.col(near[x]))) for x in copies})  # one row
    every = reduce(DataFrame.unionByName, [*done, left.select(*own, *v, "source")]).where(F.col("fold").isin(*copies))
    return every.select("node_key", "fold", "truth_m", F.coalesce(*v).alias("refilled_m"), "source")


def fill_counts(filled: DataFrame) -> DataFrame:
    """(source, n): how many inverts each tier gave, with a row for every tier."""
    tiers = filled.sparkSession.createDataFrame([(s,) for s in ("data", "neighbour", "rim", "dem", "global_min")], "source string")
    return tiers.join(filled.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def inlet_side(pipes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node_key, inlet_side): whether a candidate outfall is the high end of every pipe with both inverts at it. pipes: (a, b, inv_a, inv_b)."""
    p = pipes.where("inv_a is not null and inv_b is not null")
    e = p.select(F.col("a").alias("node_key"), (F.col("inv_a") >= F.col("inv_b")).alias("high")).union(p.select("b", F.col("inv_b") >= F.col("inv_a")))
    return e.join(candidates.select("node_key").distinct(), "node_key", "left_semi").groupBy("node_key").agg(F.bool_and("high").alias("inlet_side"))


def parents(edges: DataFrame, child: str = "from_key", parent: str = "to_key", order: str = "name") -> DataFrame:
    """One outgoing edge of each node, the last by order."""
    return edges.groupBy(F.col(child).alias("node")).agg(F.max_by(F.struct("*"), order).alias("e")).select("node", F.col(f"e.{parent}").alias("up"), "e.*")


def terminals(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, terminal, hops): where a walk along single outgoing edges ends; null in a cycle. Pointer doubling: rounds grow with the logarithm of the depth."""
    step = edges.select(F.col("node"), F.col("up").alias("at"), F.lit(1).cast("long").alias("hops"))
    ends = edges.select(F.col("up").alias("node")).join(edges.select("node"), "node", "left_anti").distinct()
    state = written(step.union(ends.select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("hops"))), "terminals_0")
    for i in range(max_rounds):
        ahead = state.select(F.col("node").alias("m"), F.col("at").alias("next"), F.col("hops").alias("more"))
        new = state.join(ahead, state["at"] == ahead["m"]).select("node", F.col("next").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("next") != F.col("at")).alias("moved"))
        new = written(new, f"terminals_{i + 1}")
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return state.join(ends.withColumn("ok", F.lit(True)), state["at"] == ends["node"], "left").select(state["node"], F.when(F.col("ok"), F.col("at")).alias("terminal"), F.when(F.col("ok"), F.col("hops")).alias("hops"))


def from_upstream(nodes: DataFrame, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, total, longest, largest): over a node and all that drain to it: the sum of `own`, the longest path by `length`, the largest `size`.

    nodes: (node, own); edges: one outgoing edge a node (node, up, length, size). In round r a node takes what stands exactly 2**r
    edges above it, with all that this already holds. Cycles raise after max_rounds.
    """
    state = nodes.join(edges, "node", "left").select("node", F.coalesce("own", F.lit(0.0)).alias("total"), F.lit(0.0).alias("longest"), F.coalesce("size", F.lit(0.0)).alias("largest"), F.col("up").alias("jump"), F.col("length").alias("dist"))
    state = written(state, "upstream_0")
    for i in range(max_rounds):
        if state.where("jump is not null").isEmpty():
            return state.select("node", "total", "longest", "largest")
        sent = state.where("jump is not null").groupBy(F.col("jump").alias("n")).agg(F.sum("total").alias("t"), F.max(F.col("dist") + F.col("longest")).alias("l"), F.max("largest").alias("s"))
        ahead = state.select(F.col("node").alias("m"), F.col("jump").alias("j2"), F.col("dist").alias("d2"))
        x = state.join(sent, state.node == sent.n, "left").join(ahead, state.jump == ahead.m, "left")
        state = written(x.select("node", (F.col("total") + F.coalesce("t", F.lit(0.0))).alias("total"), F.greatest("longest", F.coalesce("l", F.lit(0.0))).alias("longest"), F.greatest("largest", F.coalesce("s", F.lit(0.0))).alias("largest"), F.col("j2").alias("jump"), (F.col("dist") + F.col("d2")).alias("dist")), f"upstream_{i + 1}")
    raise RuntimeError("the edges hold a cycle")


def lowest_of_components(groups: DataFrame, inverts: DataFrame) -> DataFrame:
    """(component, node_key, invert_m): the lowest node of each component, ties by key."""
    x = groups.join(inverts.withColumnRenamed("node_key", "node"), "node")
    return x.groupBy("component").agg(F.min(F.struct("invert_m", "node")).alias("s")).select("component", F.col("s.node").alias("node_key"), "s.invert_m")


def outfalls(edges: DataFrame, inverts: DataFrame, known: DataFrame) -> DataFrame:
    """(node_key, kind, component): known outfall nodes with one link are `direct`, other known ones `dedicated`; a component without any gets a `synthetic` one at its lowest node."""
    degree = edges.select("a").union(edges.select("b")).toDF("node_key").groupBy("node_key").agg(F.count("*").alias("links"))
    groups = connected_components(edges)
    have = known.join(degree, "node_key").join(groups.withColumnRenamed("node", "node_key"), "node_key")
    have = have.select("node_key", F.when(F.col("links") == 1, "direct").otherwise("dedicated").alias("kind"), "component")
    bare = groups.join(have.select("component").distinct(), "component", "left_anti")
    return have.unionByName(lowest_of_components(bare, inverts).select("node_key", F.lit("synthetic").alias("kind"), "component"))


def oriented(pipes: DataFrame, inverts: DataFrame, direct: DataFrame) -> DataFrame:
    """Conduits from the higher to the lower flow line, always towards a direct outfall, with end offsets above the node bottoms.

    pipes: (name, a, b, inv_a, inv_b). An end more than 10 m above its node's bottom is not believed: the node's bottom counts and
    the offset is 0 and `rejected` counts it.
    """
    ends = inverts.join(direct.select("node_key", F.lit(True).alias("out")), "node_key", "left")
    ia, ib = (ends.select(F.col("node_key").alias(s), F.col("invert_m").alias(f"n{s}"), F.col("out").alias(f"o{s}")) for s in "ab")
    x = pipes.join(ia, "a").join(ib, "b")
    line = lambda e, n: F.when(F.col(e).isNull() | (F.col(e) - F.col(n) > k.MAX_OFFSET_M), F.col(n)).otherwise(F.col(e))
    down = F.coalesce(F.col("ob"), F.when(F.col("oa"), F.lit(False)), line("inv_a", "na") >= line("inv_b", "nb"))
    x = x.withColumn("down", down)
    off = lambda e, n: F.coalesce(F.greatest(F.lit(0.0), F.col(e) - F.col(n)), F.lit(0.0))
    pick = lambda p, q: F.when(F.col("down"), p).otherwise(q)
    x = x.select("name", pick(F.col("a"), F.col("b")).alias("from_key"), pick(F.col("b"), F.col("a")).alias("to_key"), pick(off("inv_a", "na"), off("inv_b", "nb")).alias("i"), pick(off("inv_b", "nb"), off("inv_a", "na")).alias("o"))
    kept = lambda c: F.round(F.when(F.col(c) > k.MAX_OFFSET_M, 0.0).otherwise(F.col(c)), 3)
    return x.select("name", "from_key", "to_key", kept("i").alias("inlet_offset_m"), kept("o").alias("outlet_offset_m"), ((F.col("i") > k.MAX_OFFSET_M).cast("int") + (F.col("o") > k.MAX_OFFSET_M).cast("int")).alias("rejected"))


def runoff_area(catchments: DataFrame) -> DataFrame:
    """(node, own, area_ha, n): C·A in ha, drained area and number of catchments by outlet node."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pct_imperv") / 100))
    c = k.C_IMPERVIOUS * share + k.C_PERVIOUS * (1 - share)
    return catchments.groupBy(F.col("outlet_key").alias("node")).agg(F.sum(c * F.col("area_ha")).alias("own"), F.sum("area_ha").alias("area_ha"), F.count("*").alias("n"))


def sized(edges: DataFrame, catchments: DataFrame, mm_h: float = 30.0) -> DataFrame:
    """(name, ca_ha, tc_min, flow_m3s, needed_m, diameter_m, over_ladder): the rational method and Manning's formula for a tree of conduits, then no conduit smaller than those above it.

    edges: (name, from_key, to_key, length_m, inv_from, inv_to, roughness_n).
    """
    one = parents(edges)
    flow = one.select("node", "up", F.col("length_m").alias("length"), F.lit(0.0).alias("size"))
    nodes = written(one.select("node").union(one.select("up")).distinct().join(runoff_area(catchments).select("node", "own"), "node", "left"), "sizing_nodes")
    upstream = from_upstream(nodes, flow)
    x = one.join(upstream.select("node", "total", "longest"), "node")
    tc = k.INLET_TIME_MIN + (F.col("longest") + F.col("length_m")) / k.TRAVEL_VELOCITY_MS / 60
    slope = F.greatest(F.lit(k.MIN_SLOPE), (F.col("inv_from") - F.col("inv_to")) / F.col("length_m"))
    q = F.col("total") * mm_h / 360
    need = F.pow(q * F.col("roughness_n") / (0.3117 * F.sqrt(slope)), 0.375)
    ladder = F.array(*map(F.lit, k.DIAMETERS_M))
    step = F.coalesce(F.get(F.filter(ladder, lambda d: d >= F.col("needed_m")), 0), F.lit(k.DIAMETERS_M[-1]))
    x = x.select("name", "node", "up", "length_m", F.col("total").alias("ca_ha"), tc.alias("tc_min"), q.alias("flow_m3s"), need.alias("needed_m"))
    x = written(x.withColumn("size", F.when(F.col("ca_ha") > 0, step).otherwise(k.DIAMETERS_M[0])), "sizing_first")
    grown = from_upstream(nodes, x.select("node", "up", F.col("length_m").alias("length"), "size"))
    done = x.join(grown.select("node", "largest"), "node")
    return done.select("name", "ca_ha", "tc_min", "flow_m3s", "needed_m", F.col("largest").alias("diameter_m"), (F.col("needed_m") > k.DIAMETERS_M[-1]).alias("over_ladder"))


def system_view(nodes: DataFrame, conduits: DataFrame, systems: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the wanted systems, and conduits whose own system and both ends are in the view."""
    kept = nodes.where(F.col("system").isin(systems))
    ends = kept.select("node_key")
    c = conduits.where(F.col("system").isin(systems))
    c = c.join(ends.withColumnRenamed("node_key", "from_key"), "from_key", "left_semi").join(ends.withColumnRenamed("node_key", "to_key"), "to_key", "left_semi")
    return kept, c


def numbered(nodes: DataFrame, label: str) -> DataFrame:
    """Names for all nodes: the label, or `N1`, `N2` ... by place for those without one, numbered within an area."""
    x = ranked(nodes, [F.col("aoi_id"), F.col(label).isNull()], ["lon", "lat", "node_key"], "_number")
    return x.withColumn("name", F.coalesce(F.col(label), F.concat(F.lit("N"), F.col("_number").cast("string")))).drop("_number")
