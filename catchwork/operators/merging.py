"""Cells that change hands: slivers merged in their stated order, and land moved to the cell that serves its official basin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.frames import discard, written
from catchwork.operators.grid import PIXEL, nearest, neighbours, parts, pixel_id


def borders(px: DataFrame, label: str) -> DataFrame:
    """(aoi_id, a, b, edges): pixel sides that two labels share, for each ordered pair; 0 where they meet in corners only."""
    other = px.select("aoi_id", F.col("ix").alias("n_ix"), F.col("iy").alias("n_iy"), F.col(label).alias("b"))
    met = neighbours(px, diagonal=True).join(other, ["aoi_id", "n_ix", "n_iy"]).where(F.col(label) != F.col("b"))
    side = (F.col("n_ix") == F.col("ix")) | (F.col("n_iy") == F.col("iy"))
    return met.groupBy("aoi_id", F.col(label).alias("a"), "b").agg(F.count_if(side).alias("edges"))


def merged_in_order(cells: DataFrame, touching: DataFrame, least_edges: int = 0, far: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(aoi_id, cell, into, joined): where each sliver of an area goes when they are merged one after another, in the order of their keys.

    cells: (aoi_id, cell, big); touching: (aoi_id, a, b, edges). A sliver goes to the big cell, with all that this has taken in before, that it shares the
    longest border with, the lesser of equals; joined tells whether it shares a side, since land that only meets in a corner makes no
    single cell. A sliver waits for earlier ones that touch it; those that touch none of the unsettled ones are settled together, as no other sliver's
    fate changes their borders. So the rounds, each a written table, are the longest chain of touching slivers, and the result is that of the sequential rule.
    far(slivers, settled) names the cell (aoi_id, cell, into) of slivers that touch none; they wait for all earlier ones of their area. Without it
    they stay, with into null. Areas without a big cell have no rows of slivers.
    """
    areas = cells.where("big").select("aoi_id").distinct()
    touching = written(touching, "merge_borders")
    settled = written(cells.where("big").select("aoi_id", "cell", F.col("cell").alias("into"), F.lit(True).alias("joined")), "merge_settled")
    rest = written(cells.where("not big").join(areas, "aoi_id", "left_semi").select("aoi_id", "cell"), "merge_rest")
    while not rest.isEmpty():
        earlier = rest.select("aoi_id", F.col("cell").alias("b"))
        waits = touching.join(earlier, ["aoi_id", "b"], "left_semi").where("b < a").select("aoi_id", F.col("a").alias("cell")).distinct()
        ready = written(rest.join(waits, ["aoi_id", "cell"], "left_anti"), "merge_ready")
        owners = settled.where("joined").select("aoi_id", F.col("cell").alias("b"), "into")
        sums = touching.join(ready.select("aoi_id", F.col("cell").alias("a")), ["aoi_id", "a"], "left_semi").join(owners, ["aoi_id", "b"]).groupBy("aoi_id", F.col("a").alias("cell"), "into").agg(F.sum("edges").alias("edges")).where(F.col("edges") >= least_edges)
        best = sums.groupBy("aoi_id", "cell").agg(F.max(F.struct("edges", (-F.col("into")).alias("t"))).alias("m"))
        done = written(best.select("aoi_id", "cell", (-F.col("m.t")).alias("into"), (F.col("m.edges") > 0).alias("joined")), "merge_done")
        lone = ready.join(done, ["aoi_id", "cell"], "left_anti")
        if far is None:
            found = lone.select("aoi_id", "cell", F.lit(None).cast(cells.schema["cell"].dataType).alias("into"), F.lit(False).alias("joined"))
        else:
            first = rest.groupBy("aoi_id").agg(F.min("cell").alias("cell"))
            lone = written(lone.join(first, ["aoi_id", "cell"], "left_semi"), "merge_lone")
            found = done.limit(0) if lone.isEmpty() else far(lone, settled).select("aoi_id", "cell", "into", F.lit(False).alias("joined"))
        new = written(done.unionByName(found), "merge_new")
        old = settled, rest, ready, done
        settled = written(settled.unionByName(new), "merge_settled")
        rest = written(rest.join(new, ["aoi_id", "cell"], "left_anti"), "merge_rest")
        discard(*old, new)
    return settled


def slivers_in_order(px: DataFrame, label: str, least: int) -> DataFrame:
    """(aoi_id, ix, iy, label, area): px with every cell under `least` pixels merged, in the order of their keys, into the larger cell of the longest shared border, else the nearest one; areas without a larger cell stay.

    A cell grows by each sliver before the next one is judged. Land that does not touch the cell it goes to is lost to it, since a cell is one piece: its
    label becomes null, but it counts in the cell's area, the pixels of all that it took in.
    """
    px = written(px.select(*PIXEL, label), "slivers_pixels")
    sizes = written(px.groupBy("aoi_id", F.col(label).alias("cell")).agg(F.count("*").alias("n")), "slivers_sizes")

    def far(lone: DataFrame, settled: DataFrame) -> DataFrame:
        at = [F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y")]
        points = px.join(lone.withColumnRenamed("cell", label), ["aoi_id", label]).select("aoi_id", F.col(label).alias("cell"), pixel_id(F.col("ix"), F.col("iy"), F.lit(0)).alias("point_key"), *at)
        seeds = px.join(settled.where("joined").withColumnRenamed("cell", label), ["aoi_id", label]).select("aoi_id", F.col("into").alias("seed_key"), F.col("ix").cast("double").alias("sx"), F.col("iy").cast("double").alias("sy"))
        near = points.join(nearest(points.drop("cell"), seeds, 8.0, area=("aoi_id",)), ["aoi_id", "point_key"])
        return near.groupBy("aoi_id", "cell").agg(F.min(F.struct("distance", "seed_key")).alias("m")).select("aoi_id", "cell", F.col("m.seed_key").alias("into"))

    goes = merged_in_order(sizes.select("aoi_id", "cell", (F.col("n") >= least).alias("big")), borders(px, label), far=far)
    area = goes.join(sizes, ["aoi_id", "cell"]).groupBy("aoi_id", F.col("into").alias("whole")).agg(F.sum("n").alias("grown"))
    x = px.join(goes.withColumnRenamed("cell", label), ["aoi_id", label], "left")
    x = x.withColumn("to", F.when(F.col("into").isNull(), F.col(label)).when(F.col("joined"), F.col("into")))
    x = x.join(area.withColumnRenamed("whole", "to"), ["aoi_id", "to"], "left").join(sizes.select("aoi_id", F.col("cell").alias("to"), "n"), ["aoi_id", "to"], "left")
    return x.select(*PIXEL, F.col("to").alias(label), F.coalesce("grown", "n").alias("area"))


def scraps_attached(px: DataFrame, label: str, least: int) -> DataFrame:
    """(aoi_id, ix, iy, label): each cell keeps its largest part (the lesser of equals); other parts of `least` pixels or more go, one after another, to the cell of the longest shared border, and lose their label where they touch none. Smaller parts lose it at once."""
    piece = written(parts(px.where(F.col(label).isNotNull()).select(*PIXEL, label), label), "scraps_parts")
    sizes = piece.groupBy("aoi_id", label, "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("aoi_id", label).agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).select("aoi_id", label, (-F.col("m.p")).alias("part"), F.lit(True).alias("main"))
    kept = written(sizes.join(main, ["aoi_id", label, "part"], "left").select("aoi_id", label, "part", "n", F.coalesce("main", F.lit(False)).alias("big")).where((F.col("n") >= least) | F.col("big")), "scraps_sizes")
    near = piece.join(kept.select("aoi_id", "part"), ["aoi_id", "part"], "left_semi")
    goes = merged_in_order(kept.select("aoi_id", F.col("part").alias("cell"), "big"), borders(near.select(*PIXEL, "part"), "part"), least_edges=1)
    names = kept.where("big").select("aoi_id", F.col("part").alias("into"), F.col(label).alias("to"))
    to = goes.where("joined").join(names, ["aoi_id", "into"]).select("aoi_id", F.col("cell").alias("part"), "to")
    return px.select(*PIXEL).join(piece.join(to, ["aoi_id", "part"]).select(*PIXEL, F.col("to").alias(label)), PIXEL, "left")


def official_edges(px: DataFrame, seeds: DataFrame, least_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Pixels and counts after each cell has given the land outside its seed's basin to cells that serve it: (aoi_id, ix, iy, cell) and (aoi_id, n_clipped, n_outside, n_too_small, n_nowhere, n_unmergeable, n_moved).

    px: (aoi_id, ix, iy, cell, basin), basin null outside the official layer; seeds: (aoi_id, cell, ix, iy). A cell whose seed lies in no basin is left alone
    (n_outside). A cut is refused where less than least_share of the cell, nothing, or more than one piece would stay (n_too_small). What is cut falls into
    pieces, connected and of one basin; each goes to the cell seeded in that basin with the longest shared border, the lesser of equals. A cell with a
    piece that none can take keeps all (n_nowhere), as does one whose receiver gives land itself, for its shape would change meanwhile, or whose receiver
    is not one piece (n_unmergeable). No pixel is lost: all of a cell's pieces move, or none.
    """
    px = written(px.select(*PIXEL, "cell", "basin"), "edges_pixels")
    cell = ["aoi_id", "cell"]
    home = seeds.join(px.select(*PIXEL, "basin"), PIXEL, "left").select(*cell, F.col("basin").alias("home"))
    homes = written(px.select(*cell).distinct().join(home, cell, "left"), "edges_homes")
    x = px.join(homes, cell)
    inside = written(x.where("basin = home").select(*PIXEL, "cell"), "edges_inside")
    pieces_left = parts(inside, "cell").groupBy(*cell).agg(F.count_distinct("part").alias("pieces"), F.count("*").alias("stay"))
    sizes = px.groupBy(*cell).agg(F.count("*").alias("n"))
    state = homes.join(sizes, cell).join(pieces_left, cell, "left").withColumn("stay", F.coalesce("stay", F.lit(0)))
    small = (F.coalesce("pieces", F.lit(0)) != 1) | (F.col("stay") < least_share * F.col("n"))
    kind = F.when(F.col("home").isNull(), "outside").when(small, "too_small").when(F.col("stay") == F.col("n"), "whole").otherwise("giver")
    state = written(state.withColumn("kind", kind), "edges_state")

    givers = state.where("kind = 'giver'").select(*cell, "home")
    cut = px.join(givers, cell).where(~F.col("basin").eqNullSafe(F.col("home"))).withColumn("both", F.struct("cell", F.coalesce(F.col("basin").cast("string"), F.lit("none"))))
    cut = written(parts(cut.select(*PIXEL, "cell", "basin", "both"), "both").select(*PIXEL, "cell", "basin", "part"), "edges_cut")
    beside = neighbours(cut).join(px.select("aoi_id", F.col("ix").alias("n_ix"), F.col("iy").alias("n_iy"), F.col("cell").alias("other")), ["aoi_id", "n_ix", "n_iy"])
    servers = homes.select("aoi_id", F.col("cell").alias("other"), F.col("home").alias("serves"))
    takers = beside.where("other <> cell").join(servers, ["aoi_id", "other"]).where("serves = basin").groupBy("aoi_id", "cell", "part", "other").agg(F.count("*").alias("edges"))
    taker = takers.groupBy("aoi_id", "cell", "part").agg(F.max(F.struct("edges", (-F.col("other")).alias("t"))).alias("m")).select("aoi_id", "cell", "part", (-F.col("m.t")).alias("taker"))
    placed = written(cut.select("aoi_id", "cell", "part").distinct().join(taker, ["aoi_id", "cell", "part"], "left"), "edges_placed")
    nowhere = placed.where("taker is null").select(*cell).distinct()
    offers = written(placed.join(nowhere, cell, "left_anti"), "edges_offers")
    giving = offers.select("aoi_id", F.col("cell").alias("taker")).distinct()
    whole = parts(px.select(*PIXEL, "cell"), "cell").groupBy(*cell).agg(F.count_distinct("part").alias("pieces")).where("pieces > 1").select("aoi_id", F.col("cell").alias("taker"))
    refused = offers.join(giving.unionByName(whole), ["aoi_id", "taker"], "left_semi").select(*cell).distinct()
    moves = written(offers.join(refused, cell, "left_anti"), "edges_moves")

    moved = cut.join(moves, ["aoi_id", "cell", "part"]).select(*PIXEL, "taker")
    out = written(px.join(moved, PIXEL, "left").select(*PIXEL, F.coalesce("taker", "cell").alias("cell"), F.col("taker").isNotNull().alias("moved")), "edges_out")
    label = state.join(nowhere.withColumn("why", F.lit("nowhere")).unionByName(refused.withColumn("why", F.lit("unmergeable"))), cell, "left").withColumn("kind", F.coalesce("why", "kind"))
    n = lambda k: F.count_if(F.col("kind") == k)
    counts = label.groupBy("aoi_id").agg(n("giver").alias("n_clipped"), n("outside").alias("n_outside"), n("too_small").alias("n_too_small"), n("nowhere").alias("n_nowhere"), n("unmergeable").alias("n_unmergeable"))
    return out.select(*PIXEL, "cell"), counts.join(out.groupBy("aoi_id").agg(F.count_if("moved").alias("n_moved")), "aoi_id")
