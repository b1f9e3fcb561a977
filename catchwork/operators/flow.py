"""Walks along pointers in few rounds: basins of pour points, inverts along a forest, shortest paths, outfalls of branching networks. Every round is a written table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.frames import discard, written
from catchwork.operators.grid import PIXEL, pixel_id
from catchwork.operators.network import from_upstream


def doubled(state: DataFrame) -> DataFrame:
    """state with every row's pointer followed to its end: (node, at, dist, open).

    A row that goes on has open = true, at = the next node and dist = the way to it; an end points at itself with open = false, and its dist is added
    once to all that reach it. Rounds double the reach, so they grow with the logarithm of the longest walk. Rows that stay open
    lead into a cycle. A pointer to a node without a row ends there.
    """
    state = written(state.select("node", "at", "dist", "open"), "doubled")
    most = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(most):
        if state.where("open").isEmpty():
            break
        ahead = state.select(F.col("node").alias("m"), F.col("at").alias("next"), F.col("dist").alias("more"), F.col("open").alias("on"))
        going = state.where("open")
        moved = going.join(ahead, going["at"] == ahead["m"], "left").select("node", F.coalesce("next", "at").alias("at"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.coalesce("on", F.lit(False)).alias("open"))
        last, state = state, written(state.where("not open").unionByName(moved), "doubled")
        discard(last)
    return state


def basins(px: DataFrame, pours: DataFrame, cell: float = 1.0) -> DataFrame:
    """(aoi_id, ix, iy, label, length) for every pixel: the first pour point on its way down, and the way there; null where it reaches none.

    px: (aoi_id, ix, iy, d_ix, d_iy), directions as of flow_directions; pours: (aoi_id, ix, iy, label), one a pixel. The way ends at the first pour
    point, so basins do not overlap; a pour point has length 0 in its own. A low that is no pour point has no label.
    """
    own = pixel_id(F.col("ix"), F.col("iy"), F.col("aoi_id"))
    x = px.select(*PIXEL, "d_ix", "d_iy").join(pours.select(*PIXEL, "label"), PIXEL, "left").withColumn("node", own)
    on = F.col("label").isNull() & F.col("d_ix").isNotNull()
    step = F.when((F.col("d_ix") != F.col("ix")) & (F.col("d_iy") != F.col("iy")), cell * math.sqrt(2)).otherwise(cell)
    x = written(x.withColumn("on", on), "basins_pixels")
    to = pixel_id(F.col("d_ix"), F.col("d_iy"), F.col("aoi_id"))
    ends = doubled(x.select("node", F.when(F.col("on"), to).otherwise(F.col("node")).alias("at"), F.when(F.col("on"), step).otherwise(0.0).alias("dist"), F.col("on").alias("open")))
    named = x.where("label is not null").select(F.col("node").alias("at"), F.col("label").alias("found"))
    labels = ends.where("not open").join(named, "at").select("node", F.col("found").alias("label"), F.col("dist").alias("length"))
    return x.select(*PIXEL, "node").join(labels, "node", "left").select(*PIXEL, "label", "length")


def flow_lengths(found: DataFrame, cell: float = 1.0) -> DataFrame:
    """(aoi_id, label, pixels, flow_m): a basin's size and its longest way to the pour point, null where that is not over a pixel."""
    x = found.where("label is not null").groupBy("aoi_id", "label").agg(F.count("*").alias("pixels"), F.max("length").alias("m"))
    return x.select("aoi_id", "label", "pixels", F.when(F.col("m") > cell, F.col("m")).alias("flow_m"))


def propagated_inverts(forest: DataFrame, nodes: DataFrame, slope: float = 0.005, depth: float = 1.5, least_slope: float = 1e-4) -> DataFrame:
    """(node, invert_m, violated, level): outwards along parents: the lesser of parent + length * slope and ground - depth, but at least parent + length * least_slope (then it is violated).

    nodes: (node, ground, outfall_invert); forest: (node, parent, length), parent null at an outfall. Nodes of a cycle are left out.

    The rule's compositions have ever more pieces, so pointers can't double over composed functions. Instead a node whose level is a multiple
    of 2**t, and which has nodes 2**t levels below it, holds the steps from 2**t levels above: such ways do not share nodes, so a tier holds
    no more steps than there are nodes. From the top tier down, each known invert is carried over one held way. Rounds grow with the
    logarithm of the depth; a row holds at most as many steps as the deepest branch has.
    """
    rows = forest.join(nodes, "node").select("node", "parent", "length", "ground", "outfall_invert")
    rows = written(rows, "inverts_rows")
    inner = F.col("parent").isNotNull()
    levels = doubled(rows.select("node", F.coalesce("parent", "node").alias("at"), F.when(inner, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("dist"), inner.alias("open"))).where("not open")
    tree = written(rows.join(levels.select("node", F.col("dist").alias("level")), "node"), "inverts_levels")
    edges = tree.where(inner).select("node", F.col("parent").alias("up"), F.lit(1.0).alias("length"), F.lit(0.0).alias("size"))
    heights = from_upstream(tree.select("node", F.lit(0.0).alias("own")), edges).select("node", F.col("longest").cast("long").alias("height"))
    tree = written(tree.join(heights, "node"), "inverts_tree")
    top = tree.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]

    step = F.struct((F.col("length") * least_slope).alias("e"), (F.col("length") * slope).alias("s"), (F.col("ground") - depth).alias("cap"))
    ways = [tree.where(inner).select("node", F.col("parent").alias("top"), "level", "height", F.array(step).alias("steps"))]
    for t in range(1, max(0, top).bit_length()):
        below = ways[-1]
        above = below.select(F.col("node").alias("mid"), F.col("top").alias("over"), F.col("steps").alias("before"))
        both = below.where(f"level % {1 << t} = 0 and height >= {1 << t}").join(above, F.col("top") == F.col("mid"))
        ways.append(written(both.select("node", F.col("over").alias("top"), "level", "height", F.concat("before", "steps").alias("steps")), "inverts_ways"))

    known = written(tree.where(~inner).select("node", F.col("outfall_invert").alias("invert_m")), "inverts_known")
    carried = F.aggregate("steps", F.col("p"), lambda p, x: F.greatest(p + x["e"], F.least(p + x["s"], x["cap"])))
    # in each tier first the odd multiples of 2**t, then those even ones that no way of the tier above reached; nodes without any below come last
    turns = [(t, part) for t in reversed(range(len(ways))) for part in (f"level % {2 << t} = {1 << t} and height > 0", f"level % {2 << t} = 0 and height > 0 and height < {2 << t}")]
    for t, part in [*turns, (0, "height = 0")]:
        given = known.select(F.col("node").alias("top"), F.col("invert_m").alias("p"))
        found = ways[t].where(part).join(given, "top").select("node", carried.alias("invert_m"))
        last, known = known, written(known.unionByName(found), "inverts_known")
        discard(last)
    up = known.select(F.col("node").alias("parent"), F.col("invert_m").alias("p"))
    x = tree.join(known, "node").join(up, "parent", "left")
    want = F.least(F.col("p") + F.col("length") * slope, F.col("ground") - depth)
    violated = F.coalesce(inner & (want < F.col("p") + F.col("length") * least_slope), F.lit(False))
    return x.select("node", "invert_m", violated.alias("violated"), F.col("level").cast("int").alias("level"))


def measured_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (a, b, length) with the straight distance of their ends where a length is missing or 0. nodes: (node, x, y)."""
    a, b = (nodes.select(F.col("node").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}")) for s in "ab")
    straight = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return edges.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce(F.when(F.col("length") > 0, F.col("length")), straight).alias("length"))


def _relaxed(steps: DataFrame, sources: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, dist, source, parent) over steps (node, to, length, first), from sources (node): the least way that ends in a source, ties to the lesser source, then first step. A round relaxes the steps to nodes that changed."""
    none = F.lit(None).cast(sources.schema["node"].dataType)
    state = written(sources.select("node", F.lit(0.0).alias("dist"), F.col("node").alias("source"), none.alias("parent"), F.lit(True).alias("new")), "relaxed")
    for _ in range(max_rounds):
        front = state.where("new").select(F.col("node").alias("at"), F.col("dist").alias("d"), "source")
        reach = steps.join(front, steps["to"] == front["at"]).select("node", (F.col("d") + F.col("length")).alias("dist"), "source", F.col("first").alias("parent"), F.lit(True).alias("new"))
        best = F.min(F.struct("dist", "source", F.coalesce("parent", "node").alias("p"), "parent", "new")).alias("s")
        every = state.withColumn("new", F.lit(False)).unionByName(reach)
        last, state = state, written(every.groupBy("node").agg(best).select("node", "s.dist", "s.source", "s.parent", "s.new"), "relaxed")
        discard(last)
        if state.where("new").isEmpty():
            return state.drop("new")
    raise RuntimeError("paths did not settle")


def shortest_forest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, dist, source, parent): shortest paths from several sources (node) over undirected edges (a, b, length); ties go to the lesser source, then parent.

    Runs of nodes with two neighbours are contracted by pointer doubling along arcs, in both directions, so a long street costs the logarithm of
    its nodes; only where three or more streets meet are edges relaxed, round by round. Nodes of a run then take the better of its ends. Of parallel
    edges the shortest counts; self-loops don't; nodes that reach no source have no row.
    """
    arcs = edges.select("a", "b", "length").union(edges.select("b", "a", "length")).where("a <> b").groupBy("a", "b").agg(F.min("length").alias("length"))
    arcs = written(arcs, "forest_arcs")
    sources = written(sources.select("node").distinct(), "forest_sources")
    inner = arcs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("b").alias("one"), F.max("b").alias("two")).where("n = 2").join(sources, "node", "left_anti")
    inner = written(inner.select("node", "one", "two"), "forest_inner")
    x = arcs.join(inner, arcs.b == inner.node, "left")
    on = F.col("node").isNotNull()
    arc = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    after = arc(F.col("b"), F.when(F.col("one") == F.col("a"), F.col("two")).otherwise(F.col("one")))
    here = arc(F.col("a"), F.col("b"))
    runs = doubled(x.select(here.alias("node"), F.when(on, after).otherwise(here).alias("at"), F.col("length").alias("dist"), on.alias("open"))).where("not open")
    ways = runs.select(F.col("node.a").alias("node"), F.col("node.b").alias("first"), F.col("at.b").alias("to"), F.col("dist").alias("length"))
    met = written(ways.join(inner.select("node"), "node", "left_anti").where("node <> to"), "forest_steps")
    fixed = _relaxed(met, sources)
    ends = fixed.select(F.col("node").alias("to"), F.col("dist").alias("d"), "source")
    along = ways.join(inner.select("node"), "node", "left_semi").join(ends, "to")
    best = F.min(F.struct((F.col("d") + F.col("length")).alias("dist"), "source", F.col("first").alias("parent"))).alias("s")
    return fixed.unionByName(along.groupBy("node").agg(best).select("node", "s.dist", "s.source", "s.parent"))


def reached_outfalls(edges: DataFrame, outfalls: DataFrame) -> DataFrame:
    """(node, outfall, hops) for every node of edges (from_key, to_key) and outfalls (node): the outfall that fewest conduits downstream lead to, ties to the lesser; null where none is reached.

    Nodes may have several outgoing conduits, and these may run in cycles. Nodes with one outgoing conduit jump by pointer doubling to the
    next branch, outfall or dead end; only branches are relaxed, round by round. A walk ends at the first outfall.
    """
    e = written(edges.select("from_key", "to_key").where("from_key <> to_key").distinct(), "outfalls_edges")
    ends = written(outfalls.select("node").distinct(), "outfalls_ends")
    nodes = e.select(F.col("from_key").alias("node")).union(e.select("to_key")).union(ends).distinct()
    out = e.groupBy(F.col("from_key").alias("f")).agg(F.count("*").alias("n"), F.min("to_key").alias("to"))
    kind = nodes.join(ends.withColumn("is_end", F.lit(True)), "node", "left").join(out, F.col("node") == F.col("f"), "left")
    on = F.col("is_end").isNull() & F.coalesce(F.col("n") == 1, F.lit(False))
    one = F.lit(1.0)
    jumps = doubled(kind.select("node", F.when(on, F.col("to")).otherwise(F.col("node")).alias("at"), F.when(on, one).otherwise(0.0).alias("dist"), on.alias("open"))).where("not open")
    branch = e.join(ends, e.from_key == ends.node, "left_anti").join(out.where("n > 1").select(F.col("f").alias("from_key")), "from_key")
    hop = jumps.select(F.col("node").alias("to_key"), F.col("at").alias("to"), F.col("dist").alias("more"))
    steps = written(branch.join(hop, "to_key").select(F.col("from_key").alias("node"), "to", (F.col("more") + one).alias("length"), F.col("to_key").alias("first")), "outfalls_steps")
    fixed = _relaxed(steps, ends).select(F.col("node").alias("at"), F.col("source").alias("outfall"), F.col("dist").alias("more"))
    found = jumps.join(fixed, "at").select("node", "outfall", (F.col("dist") + F.col("more")).cast("long").alias("hops"))
    return nodes.join(found, "node", "left")
