"""Queries over networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import written
from catchwork.functions import values as v
from catchwork.operators import flow, ingest
from catchwork.operators import network as op
from catchwork.operators.components import connected_components
from catchwork.plans.registry import query

WALK = """WITH RECURSIVE walk(node, reached, hops) AS (
    SELECT from_key, from_key, 0 FROM v_tree UNION SELECT to_key, to_key, 0 FROM v_tree
    UNION ALL SELECT w.node, t.to_key, w.hops + 1 FROM walk w JOIN v_tree t ON t.from_key = w.reached)"""
CLEAN = """pp AS (SELECT file_seq, name, up_key AS a, dn_key AS b, nullif(inv_up, 0) AS inv_a, CASE WHEN inv_dn > -90 THEN inv_dn END AS inv_b, rim_m, dem_m FROM v_reach WHERE up_key <> dn_key)"""
SWEEPS = 2  # rounds of a neighbour sweep that the SQL spells out


def _clean(pipes: DataFrame) -> DataFrame:
    """Pipes between two different nodes with their levels, sentinels as null."""
    x = pipes.where("up_key <> dn_key")
    return x.select("file_seq", "name", F.col("up_key").alias("a"), F.col("dn_key").alias("b"), v.number(F.col("inv_up"), True).alias("inv_a"), v.without_sentinel(F.col("inv_dn"), F.lit("below:-90")).alias("inv_b"), "rim_m", "dem_m")


def _nodes_of(p: DataFrame) -> DataFrame:
    """Ends of the pipes with their least level, and ground and terrain where the pipe that begins there has them."""
    e = p.select(F.col("a").alias("node_key"), F.col("inv_a").alias("i"), "rim_m", "dem_m").unionByName(p.select(F.col("b").alias("node_key"), F.col("inv_b").alias("i")), allowMissingColumns=True)
    return e.groupBy("node_key").agg(F.min("i").alias("invert_m"), F.max("rim_m").alias("ground_m"), F.max("dem_m").alias("dem_m"))


def _fill_sql(folds: int = 0) -> str:
    """The tiers as SQL, a step a table: neighbour rounds, rim, rounds, terrain, rounds. With folds there is a copy of the network for each, in which its inverts (keys by remainder) are hidden; a copy's keys are key * folds + fold."""
    steps, at = [], 0

    def sweeps() -> None:
        nonlocal at
        for _ in range(SWEEPS):
            steps.append(f"""t{at + 1} AS (SELECT t.n, any_value(t.g) AS g, any_value(t.d) AS d, coalesce(any_value(t.i), min(x.i)) AS i,
              CASE WHEN any_value(t.i) IS NOT NULL THEN any_value(t.s) WHEN min(x.i) IS NOT NULL THEN 'neighbour' END AS s FROM t{at} t LEFT JOIN e ON e.n = t.n LEFT JOIN t{at} x ON x.n = e.o GROUP BY t.n)""")
            at += 1

    def tier(column: str, name: str) -> None:
        nonlocal at
        ground = "CASE WHEN i IS NULL THEN coalesce(g, d) ELSE g END" if name == "dem" else "g"
        steps.append(f"t{at + 1} AS (SELECT n, {ground} AS g, d, coalesce(i, {column} - 2.5) AS i, coalesce(s, CASE WHEN {column} IS NOT NULL THEN '{name}' END) AS s FROM t{at})")
        at += 1

    sweeps()
    tier("g", "rim")
    sweeps()
    tier("d", "dem")
    sweeps()
    plain = f"""WITH {CLEAN}, h AS (SELECT a AS n, b AS o, inv_a AS i, rim_m, dem_m FROM pp UNION ALL SELECT b, a, inv_b, NULL, NULL FROM pp), {"e1" if folds else "e"} AS (SELECT DISTINCT n, o FROM h),
{"truth" if folds else "t0"} AS (SELECT n, max(rim_m) AS g, max(dem_m) AS d, min(i) AS i, CASE WHEN min(i) IS NOT NULL THEN 'data' END AS s FROM h GROUP BY n), """
    copies = f"""f AS (SELECT unnest(range(0, {folds})) AS f), e AS (SELECT n * {folds} + f AS n, o * {folds} + f AS o FROM e1, f),
t0 AS (SELECT n * {folds} + f AS n, g, d, CASE WHEN n % {folds} <> f THEN i END AS i, CASE WHEN n % {folds} <> f THEN s END AS s FROM truth, f), """
    least = f"SELECT min(x.i) FROM t{at} x" + (f" WHERE x.n % {folds} = t.n % {folds}" if folds else "")
    return plain + (copies if folds else "") + f"""{", ".join(steps)}, filled AS (SELECT n AS node_key, coalesce(i, ({least}), 0) AS invert_m, coalesce(s, 'global_min') AS source, g AS ground_m FROM t{at} t) """


def _snap(c: str) -> str:
    """A number to 2 places by its decimal digits, half away from zero, as Spark rounds. DuckDB rounds a product with 100, which leaves ties to the noise of that product."""
    return f"round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 20)), 2)"


@query("n01_snap_ends", "v_raw_pipe", "v_node", sql=f"""
WITH x AS (SELECT p.file_seq, u.lon AS ax, u.lat AS ay, d.lon AS bx, d.lat AS b_y, CAST(p.diameter_mm AS DOUBLE) - 100 AS length_m
           FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key)
SELECT file_seq, CASE WHEN {_snap("ax")} = {_snap("bx")} AND {_snap("ay")} = {_snap("b_y")} THEN 'self_loop' WHEN length_m <= 0 THEN 'zero_length' END AS dropped FROM x""")
def n01(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    x = ingest.resolved_ends(pipes, nodes).where("n_dangling = 0").join(pipes.select("file_seq", (F.col("diameter_mm").cast("double") - 100).alias("length_m")), "file_seq")
    return op.snapped(x, 2).select("file_seq", "dropped")


@query("n02_node_table", "v_raw_pipe", "v_node", sql="""
WITH e AS (SELECT p.file_seq, p.up_key AS node_key, n.lon, n.lat, 'up' AS side, n.rim_m + p.file_seq % 3 AS g FROM v_raw_pipe p JOIN v_node n ON n.node_key = p.up_key
           UNION ALL SELECT p.file_seq, p.dn_key, n.lon, n.lat, 'dn', n.rim_m + p.file_seq % 3 FROM v_raw_pipe p JOIN v_node n ON n.node_key = p.dn_key)
SELECT node_key, min(lon) AS lon, min(lat) AS lat, max_by(g, file_seq) AS ground_m FROM e GROUP BY node_key""")
def n02(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    e = ingest.ends(pipes).join(nodes.select("node_key", "lon", "lat", "rim_m"), "node_key")
    return op.node_table(e, e.select("node_key", "file_seq", (F.col("rim_m") + F.col("file_seq") % 3).alias("ground_m")))


@query("n03_invert_gap_fill", "v_reach", sql=_fill_sql() + "SELECT * FROM filled")
def n03(pipes: DataFrame) -> DataFrame:
    p = _clean(pipes)
    return op.filled_inverts(_nodes_of(p), p, SWEEPS)


@query("n03_fill_counts", "v_reach", sql=_fill_sql() + "SELECT s.source, count(f.source) AS n FROM (VALUES ('data'), ('neighbour'), ('rim'), ('dem'), ('global_min')) s(source) LEFT JOIN filled f USING (source) GROUP BY 1")
def n03_counts(pipes: DataFrame) -> DataFrame:
    p = _clean(pipes)
    return op.fill_counts(op.filled_inverts(_nodes_of(p), p, SWEEPS))


@query("a37_refilled_errors", "v_reach", sql=_fill_sql(5) + """SELECT CAST(t.n // 10 % 5 AS BIGINT) AS aoi_id, f.source, count(*) AS n_hidden, round(avg(abs(f.invert_m - t.i)), 4) AS mae_m
FROM truth t JOIN filled f ON f.node_key = t.n * 5 + t.n % 5 WHERE t.i IS NOT NULL GROUP BY ALL""")
def a37_refilled(pipes: DataFrame) -> DataFrame:
    """The typical error of filled inverts by area and tier: a fifth of the known ones at a time is hidden, and the tiers fill it again."""
    p = written(_clean(pipes).drop("file_seq", "name"), "refill_pipes")
    x = op.refilled_errors(_nodes_of(p), p, 5, SWEEPS, (F.col("node_key") % 5).cast("int"))
    return x.groupBy((F.floor(F.col("node_key") / 10) % 5).alias("aoi_id"), "source").agg(F.count("*").alias("n_hidden"), F.round(F.avg(F.abs(F.col("refilled_m") - F.col("truth_m"))), 4).alias("mae_m"))


@query("n04_components", "v_tree", sql=WALK + " SELECT node, min(reached) AS component FROM walk GROUP BY node")
def n04(tree: DataFrame) -> DataFrame:
    return connected_components(tree, "from_key", "to_key")


@query("n05_outfall_assignment", "v_tree", sql=WALK + """,
c AS (SELECT node AS node_key, min(reached) AS component FROM walk GROUP BY node),
deg AS (SELECT n, count(*) AS links FROM (SELECT from_key AS n FROM v_tree UNION ALL SELECT to_key FROM v_tree) GROUP BY n),
known AS (SELECT c.node_key, CASE WHEN links = 1 THEN 'direct' ELSE 'dedicated' END AS kind, c.component FROM c JOIN deg ON deg.n = c.node_key WHERE c.node_key % 40 = 0),
bare AS (SELECT component, min(node_key) AS node_key FROM c WHERE component NOT IN (SELECT component FROM known) GROUP BY component)
SELECT node_key, kind, component FROM known UNION ALL SELECT node_key, 'synthetic', component FROM bare""")
def n05(tree: DataFrame) -> DataFrame:
    edges = tree.select(F.col("from_key").alias("a"), F.col("to_key").alias("b"))
    inverts = edges.select("a").union(edges.select("b")).distinct().toDF("node_key").withColumn("invert_m", 200 + F.col("node_key") * 0.01)
    return op.outfalls(edges, inverts, inverts.where("node_key % 40 = 0").select("node_key"))


@query("n06_conduit_orientation", "v_reach", sql=f"""
WITH {CLEAN}, n AS (SELECT a AS node_key, coalesce(dem_m, 40) - 12.5 AS i FROM pp), x AS (SELECT p.*, u.i AS na, coalesce(d.i, 20) AS nb, p.a % 25 = 0 AS oa, p.b % 25 = 0 AS ob FROM pp p JOIN n u ON u.node_key = p.a LEFT JOIN n d ON d.node_key = p.b),
y AS (SELECT *, CASE WHEN ob THEN true WHEN oa THEN false ELSE
   CASE WHEN inv_a IS NULL OR inv_a - na > 10 THEN na ELSE inv_a END >= CASE WHEN inv_b IS NULL OR inv_b - nb > 10 THEN nb ELSE inv_b END END AS down,
   coalesce(greatest(0, inv_a - na), 0) AS fa, coalesce(greatest(0, inv_b - nb), 0) AS fb FROM x),
z AS (SELECT name, file_seq, CASE WHEN down THEN a ELSE b END AS from_key, CASE WHEN down THEN b ELSE a END AS to_key, CASE WHEN down THEN fa ELSE fb END AS i, CASE WHEN down THEN fb ELSE fa END AS o FROM y)
SELECT name, from_key, to_key, round(CASE WHEN i > 10 THEN 0 ELSE i END, 3) AS inlet_offset_m, round(CASE WHEN o > 10 THEN 0 ELSE o END, 3) AS outlet_offset_m, CAST(i > 10 AS INT) + CAST(o > 10 AS INT) AS rejected FROM z""")
def n06(pipes: DataFrame) -> DataFrame:
    p = _clean(pipes)
    begins = p.select(F.col("a").alias("node_key"), (F.coalesce("dem_m", F.lit(40.0)) - 12.5).alias("invert_m"))
    ends = p.select(F.col("b").alias("node_key")).join(begins.select("node_key"), "node_key", "left_anti").select("node_key", F.lit(20.0).alias("invert_m"))
    inverts = begins.unionByName(ends)
    return op.oriented(p, inverts, inverts.where("node_key % 25 = 0").select("node_key"))


@query("n07_assembly_invariants", "v_tree", "v_node", sql="""
WITH n AS (SELECT from_key AS k FROM v_tree UNION SELECT to_key FROM v_tree), known AS (SELECT node_key FROM v_node)
SELECT 'names_not_empty' AS rule, count(*) FILTER (WHERE name = '') AS n_bad FROM v_tree
UNION ALL SELECT 'names_unique', count(*) - count(DISTINCT name) FROM v_tree
UNION ALL SELECT 'ends_known', count(*) FROM n WHERE k NOT IN (SELECT node_key FROM known)
UNION ALL SELECT 'outfall_one_link', count(*) FROM (SELECT to_key FROM v_tree WHERE to_key NOT IN (SELECT from_key FROM v_tree) GROUP BY to_key HAVING count(*) <> 1)""")
def n07(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    names = tree.agg(F.count_if(F.col("name") == "").alias("names_not_empty"), (F.count("*") - F.count_distinct("name")).alias("names_unique"))
    ends = tree.select(F.col("from_key").alias("node_key")).union(tree.select("to_key")).distinct().join(nodes, "node_key", "left_anti").agg(F.count("*").alias("n_bad"))
    last = tree.join(tree.select(F.col("from_key").alias("to_key")).distinct(), "to_key", "left_anti").groupBy("to_key").count().where("count <> 1").agg(F.count("*").alias("n_bad"))
    rows = names.unpivot([], ["names_not_empty", "names_unique"], "rule", "n_bad")
    return rows.unionByName(ends.withColumn("rule", F.lit("ends_known"))).unionByName(last.withColumn("rule", F.lit("outfall_one_link")))


@query("n08_inlet_side_outfalls", "v_reach", sql=f"""
WITH {CLEAN}, e AS (SELECT a AS node_key, inv_a >= inv_b AS high FROM pp WHERE inv_a IS NOT NULL AND inv_b IS NOT NULL UNION ALL SELECT b, inv_b >= inv_a FROM pp WHERE inv_a IS NOT NULL AND inv_b IS NOT NULL)
SELECT node_key, bool_and(high) AS inlet_side FROM e WHERE node_key % 4 = 0 GROUP BY node_key""")
def n08(pipes: DataFrame) -> DataFrame:
    p = _clean(pipes)
    return op.inlet_side(p, p.select(F.col("a").alias("node_key")).union(p.select("b")).where("node_key % 4 = 0"))


@query("n09_view_damage", "v_tree", sql="""
WITH RECURSIVE s AS (SELECT * FROM v_tree WHERE system = 'storm_minor'), nodes AS (SELECT from_key AS n FROM s UNION SELECT to_key FROM s),
walk(node, reached) AS (SELECT n, n FROM nodes UNION ALL SELECT w.node, t.to_key FROM walk w JOIN s t ON t.from_key = w.reached),
c AS (SELECT node, min(reached) AS component FROM walk GROUP BY node)
SELECT node AS node_key, component FROM c WHERE component NOT IN (SELECT component FROM c WHERE node % 13 = 0)""")
def n09(tree: DataFrame) -> DataFrame:
    """Nodes of one system's view that reach no outfall (here: keys divisible by 13) by any path."""
    groups = connected_components(tree.where("system = 'storm_minor'"), "from_key", "to_key")
    drained = groups.where("node % 13 = 0").select("component").distinct()
    return groups.join(drained, "component", "left_anti").select(F.col("node").alias("node_key"), "component")


@query("n10_terminal_outfall", "v_tree", sql=WALK + " SELECT node, min(reached) AS terminal, max(hops)::BIGINT AS hops FROM walk GROUP BY node")
def n10(tree: DataFrame) -> DataFrame:
    return op.terminals(op.parents(tree))


@query("n10_branching_outfalls", "v_web", sql="""
WITH RECURSIVE nodes AS (SELECT from_key AS n FROM v_web UNION SELECT to_key FROM v_web),
walk(node, reached, hops) AS (SELECT n, n, 0 FROM nodes UNION SELECT w.node, e.to_key, w.hops + 1 FROM walk w JOIN v_web e ON e.from_key = w.reached WHERE w.reached >= 3 AND w.reached % 13 <> 0 AND w.hops < 60),
ends AS (SELECT node, min_by(reached, (hops, reached)) AS outfall, min(hops)::BIGINT AS hops FROM walk WHERE reached < 3 OR reached % 13 = 0 GROUP BY node)
SELECT n AS node, outfall, hops FROM nodes LEFT JOIN ends ON node = n""")
def n10_branching(web: DataFrame) -> DataFrame:
    """The nearest outfall downstream (keys under 3 or divisible by 13) where conduits branch and some run in circles."""
    nodes = web.select(F.col("from_key").alias("node")).union(web.select("to_key")).distinct()
    return flow.reached_outfalls(web, nodes.where("node < 3 or node % 13 = 0"))


@query("n11_components_without_outfall", "v_tree", sql=WALK + """, c AS (SELECT node, min(reached) AS component FROM walk GROUP BY node)
SELECT component, count(*) AS n_nodes FROM c GROUP BY component HAVING NOT bool_or(node % 13 = 0)""")
def n11(tree: DataFrame) -> DataFrame:
    groups = connected_components(tree, "from_key", "to_key")
    return groups.groupBy("component").agg(F.count("*").alias("n_nodes"), F.bool_or(F.col("node") % 13 == 0).alias("ok")).where("not ok").drop("ok")


@query("n12_largest_component", "v_tree", sql=WALK + """, c AS (SELECT node, min(reached) AS component FROM walk GROUP BY node), s AS (SELECT component, count(*) AS n FROM c GROUP BY component)
SELECT component, n AS n_nodes, (SELECT sum(n) FROM s)::BIGINT - n AS n_dropped FROM s WHERE n >= 2 ORDER BY n DESC, component LIMIT 1""")
def n12(tree: DataFrame) -> DataFrame:
    sizes = connected_components(tree, "from_key", "to_key").groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.when(F.col("n") >= 2, F.struct("n", (-F.col("component")).alias("c")))).alias("b"), F.sum("n").alias("total"))
    return best.where("b is not null").select((-F.col("b.c")).alias("component"), F.col("b.n").alias("n_nodes"), (F.col("total") - F.col("b.n")).alias("n_dropped"))


@query("n14_shortest_path_forest", "v_tree", sql="""
WITH RECURSIVE src AS (SELECT DISTINCT to_key AS n FROM v_tree WHERE to_key NOT IN (SELECT from_key FROM v_tree)),
walk(node, dist, source, parent) AS (SELECT n, 0::DOUBLE, n, NULL::BIGINT FROM src UNION ALL SELECT t.from_key, w.dist + t.length_m, w.source, w.node FROM walk w JOIN v_tree t ON t.to_key = w.node)
SELECT node, dist, source, parent FROM walk""")
def n14(tree: DataFrame) -> DataFrame:
    sources = tree.join(tree.select(F.col("from_key").alias("to_key")), "to_key", "left_anti").select(F.col("to_key").alias("node")).distinct()
    return flow.shortest_forest(tree.select(F.col("from_key").alias("a"), F.col("to_key").alias("b"), F.col("length_m").alias("length")), sources)


@query("n15_invert_propagation", "v_tree", sql="""
WITH RECURSIVE src AS (SELECT DISTINCT to_key AS n FROM v_tree WHERE to_key NOT IN (SELECT from_key FROM v_tree)),
walk(node, invert_m, violated, level) AS (SELECT n, 100 + n % 7 - 1::DOUBLE, false, 0 FROM src UNION ALL
  SELECT t.from_key, greatest(w.invert_m + t.length_m * 1e-4, least(w.invert_m + t.length_m * 0.005::DOUBLE, 100 + t.from_key % 7 - 1.5::DOUBLE)),
         least(w.invert_m + t.length_m * 0.005::DOUBLE, 100 + t.from_key % 7 - 1.5::DOUBLE) < w.invert_m + t.length_m * 1e-4, w.level + 1
  FROM walk w JOIN v_tree t ON t.to_key = w.node)
SELECT node, round(invert_m, 6) AS invert_m, violated, level FROM walk""")
def n15(tree: DataFrame) -> DataFrame:
    roots = tree.join(tree.select(F.col("from_key").alias("to_key")), "to_key", "left_anti").select(F.col("to_key").alias("node")).distinct()
    forest = tree.select(F.col("from_key").alias("node"), F.col("to_key").alias("parent"), F.col("length_m").alias("length")).unionByName(roots.withColumn("parent", F.lit(None).cast("long")).withColumn("length", F.lit(0.0)))
    ground = F.lit(100.0) + F.col("node") % 7
    nodes = forest.select("node").withColumn("ground", ground).withColumn("outfall_invert", ground - 1.0)
    return flow.propagated_inverts(forest, nodes).withColumn("invert_m", F.round("invert_m", 6))


@query("n16_synthesised_tables", "v_tree", sql="""
WITH s AS (SELECT DISTINCT to_key AS n FROM v_tree WHERE to_key NOT IN (SELECT from_key FROM v_tree))
SELECT 'outfall' AS kind, 'OUT_' || n AS name, CAST(n AS VARCHAR) AS at_node, NULL::DOUBLE AS depth_m FROM s
UNION ALL SELECT 'junction', 'J' || from_key, CAST(from_key AS VARCHAR), greatest(0.1, 202 + from_key % 3 - inv_from) FROM v_tree
UNION ALL SELECT 'conduit', name, CAST(from_key AS VARCHAR), NULL FROM v_tree""")
def n16(tree: DataFrame) -> DataFrame:
    """Rows of a synthesised model: an outfall at each sink, junctions with a depth of 0.1 m at least, conduits."""
    sinks = tree.join(tree.select(F.col("from_key").alias("to_key")), "to_key", "left_anti").select("to_key").distinct()
    key = F.col("from_key").cast("string")
    no_depth = F.lit(None).cast("double")
    a = sinks.select(F.lit("outfall").alias("kind"), F.concat(F.lit("OUT_"), F.col("to_key").cast("string")).alias("name"), F.col("to_key").cast("string").alias("at_node"), no_depth.alias("depth_m"))
    b = tree.select(F.lit("junction").alias("kind"), F.concat(F.lit("J"), key).alias("name"), key.alias("at_node"), F.greatest(F.lit(0.1), 202 + F.col("from_key") % 3 - F.col("inv_from")).alias("depth_m"))
    return a.unionByName(b).unionByName(tree.select(F.lit("conduit").alias("kind"), "name", key.alias("at_node"), no_depth.alias("depth_m")))


UPSTREAM = WALK + """, own AS (SELECT outlet_key AS n, sum((0.9 * least(1, greatest(0, pct_imperv / 100)) + 0.2 * (1 - least(1, greatest(0, pct_imperv / 100)))) * area_ha) AS ca FROM v_catchment GROUP BY 1)"""


@query("n17_upstream_accumulation", "v_tree", "v_catchment", sql=UPSTREAM + """,
d AS (SELECT node, reached, (SELECT 0) AS z FROM walk)
SELECT w.reached AS node, round(sum(coalesce(o.ca, 0)), 6) AS ca_ha, count(*) AS n_nodes FROM d w LEFT JOIN own o ON o.n = w.node GROUP BY w.reached""")
def n17(tree: DataFrame, catchments: DataFrame) -> DataFrame:
    one = op.parents(tree)
    own = op.runoff_area(catchments).select("node", "own")
    nodes = one.select("node").union(one.select("up")).distinct()
    flow = one.select("node", "up", F.col("length_m").alias("length"), F.lit(0.0).alias("size"))
    sums = op.from_upstream(nodes.join(own, "node", "left"), flow)
    counts = op.from_upstream(nodes.withColumn("own", F.lit(1.0)), flow)
    return sums.select("node", F.round("total", 6).alias("ca_ha")).join(counts.select("node", F.col("total").cast("long").alias("n_nodes")), "node")


SIZING = WALK + """, len AS (SELECT from_key, max(length_m) AS l FROM v_tree GROUP BY 1),
path(node, reached, dist) AS (SELECT n, n, 0::DOUBLE FROM (SELECT from_key AS n FROM v_tree UNION SELECT to_key FROM v_tree) UNION ALL SELECT p.node, t.to_key, p.dist + t.length_m FROM path p JOIN v_tree t ON t.from_key = p.reached),
own AS (SELECT outlet_key AS n, sum((0.9 * least(1, greatest(0, pct_imperv / 100)) + 0.2 * (1 - least(1, greatest(0, pct_imperv / 100)))) * area_ha)::DOUBLE AS ca FROM v_catchment GROUP BY 1),
acc AS (SELECT reached AS n, sum(coalesce(o.ca, 0)) AS ca, max(dist) AS longest FROM path LEFT JOIN own o ON o.n = path.node GROUP BY 1),
q AS (SELECT t.*, a.ca, 10 + (a.longest + t.length_m) / 60 AS tc, a.ca * 30 / 360 AS flow,
      pow(a.ca * 30 / 360 * 0.013 / (0.3117 * sqrt(greatest(0.001, (t.inv_from - t.inv_to) / t.length_m))), 0.375) AS need FROM v_tree t JOIN acc a ON a.n = t.from_key),
st AS (SELECT *, CASE WHEN ca > 0 THEN coalesce(list_min(list_filter([0.3,0.375,0.45,0.525,0.6,0.675,0.75,0.9,1.05,1.2,1.35,1.5,1.8,2.1,2.4,3.0], lambda x: x >= need)), 3.0) ELSE 0.3 END::DOUBLE AS d FROM q)"""


@query("n18_no_shrinkage", "v_tree", sql=WALK + """, z AS (SELECT from_key, 1 + (from_key * 7) % 10 AS d FROM v_tree)
SELECT w.reached AS node, max(coalesce(z.d, 0))::DOUBLE AS largest FROM walk w LEFT JOIN z ON z.from_key = w.node GROUP BY 1""")
def n18(tree: DataFrame) -> DataFrame:
    one = op.parents(tree)
    nodes = one.select("node").union(one.select("up")).distinct().withColumn("own", F.lit(0.0))
    sizes = (1 + (F.col("node") * 7) % 10).cast("double")
    return op.from_upstream(nodes, one.select("node", "up", F.col("length_m").alias("length"), sizes.alias("size"))).select("node", "largest")


@query("n19_pipe_sizing", "v_tree", "v_catchment", sql=SIZING + """
SELECT s.name, round(s.ca, 6) AS ca_ha, round(s.tc, 6) AS tc_min, round(s.flow, 6) AS flow_m3s, round(s.need, 6) AS needed_m, max(u.d) AS diameter_m, s.need > 3 AS over_ladder
FROM st s JOIN path p ON p.reached = s.from_key JOIN st u ON u.from_key = p.node GROUP BY ALL""")
def n19(tree: DataFrame, catchments: DataFrame) -> DataFrame:
    out = op.sized(tree.withColumn("roughness_n", F.lit(k.DEFAULT_N)), catchments)
    return out.select("name", *(F.round(c, 6).alias(c) for c in ("ca_ha", "tc_min", "flow_m3s", "needed_m")), "diameter_m", "over_ladder")


@query("t03_lowest_of_component", "v_tree", sql=WALK + " SELECT min(reached) AS node_key, component, 200 + component * 1e-2 AS invert_m FROM (SELECT node, min(reached) AS component, min(reached) AS reached FROM walk GROUP BY node) GROUP BY component")
def t03(tree: DataFrame) -> DataFrame:
    groups = connected_components(tree, "from_key", "to_key")
    return op.lowest_of_components(groups, groups.select(F.col("node").alias("node_key"), (200 + F.col("node") * 0.01).alias("invert_m")))


@query("t08_commercial_ladder", "part", sql="""
WITH x AS (SELECT p_partkey, p_size / 12::DOUBLE AS need FROM part)
SELECT p_partkey, coalesce(list_min(list_filter([0.3,0.375,0.45,0.525,0.6,0.675,0.75,0.9,1.05,1.2,1.35,1.5,1.8,2.1,2.4,3.0], lambda d: d >= need)), 3.0)::DOUBLE AS diameter_m, need > 3 AS over_ladder FROM x""")
def t08(part: DataFrame) -> DataFrame:
    need = F.col("p_size") / 12
    ladder = F.array(*map(F.lit, k.DIAMETERS_M))
    x = part.withColumn("need", need)
    return x.select("p_partkey", F.coalesce(F.get(F.filter(ladder, lambda d: d >= F.col("need")), 0), F.lit(3.0)).alias("diameter_m"), (F.col("need") > 3).alias("over_ladder"))


@query("a14_runoff_per_node", "v_catchment", sql="""
SELECT outlet_key AS node, round(sum((0.9 * least(1, greatest(0, pct_imperv / 100)) + 0.2 * (1 - least(1, greatest(0, pct_imperv / 100)))) * area_ha), 6)::DOUBLE AS own, round(sum(area_ha), 6) AS area_ha, count(*) AS n
FROM v_catchment GROUP BY 1""")
def a14(catchments: DataFrame) -> DataFrame:
    x = op.runoff_area(catchments)
    return x.select("node", F.round("own", 6).alias("own"), F.round("area_ha", 6).alias("area_ha"), "n")


@query("m08_rational_manning", "v_tree", sql="""
SELECT name, round(pow(length_m / 1000 * 30 / 360 * 0.013 / (0.3117 * sqrt(greatest(0.001, (inv_from - inv_to) / length_m))), 0.375), 8) AS needed_m FROM v_tree""")
def m08(tree: DataFrame) -> DataFrame:
    slope = F.greatest(F.lit(k.MIN_SLOPE), (F.col("inv_from") - F.col("inv_to")) / F.col("length_m"))
    q = F.col("length_m") / 1000 * 30 / 360
    return tree.select("name", F.round(F.pow(q * k.DEFAULT_N / (0.3117 * F.sqrt(slope)), 0.375), 8).alias("needed_m"))


@query("m21_depth_bands", "v_node", sql="""
SELECT node_key, CASE WHEN d > 0 AND d <= 15 THEN d ELSE 2.0 END AS max_depth_m, d > 15 AS rejected FROM (SELECT node_key, rim_m - 60 AS d FROM v_node)""")
def m21(nodes: DataFrame) -> DataFrame:
    d = F.col("rim_m") - 60
    return nodes.select("node_key", F.when((d > 0) & (d <= k.MAX_NODE_DEPTH_M), d).otherwise(k.DEFAULT_DEPTH_M).alias("max_depth_m"), (d > k.MAX_NODE_DEPTH_M).alias("rejected"))


@query("j24_system_view", "v_tree", sql="""
WITH n AS (SELECT from_key AS k, min(system) AS system FROM v_tree GROUP BY 1), keep AS (SELECT k FROM n WHERE system = 'storm_minor')
SELECT name, from_key, to_key FROM v_tree WHERE system = 'storm_minor' AND from_key IN (SELECT k FROM keep) AND to_key IN (SELECT k FROM keep)""")
def j24(tree: DataFrame) -> DataFrame:
    nodes = tree.groupBy(F.col("from_key").alias("node_key")).agg(F.min("system").alias("system"))
    return op.system_view(nodes, tree, ["storm_minor"])[1].select("name", "from_key", "to_key")


@query("j25_view_of_catchments", "v_tree", "v_catchment", sql="""
SELECT cell_key, name, outlet_key FROM v_catchment WHERE outlet_key IN (SELECT from_key FROM v_tree WHERE system = 'storm_minor')""")
def j25(tree: DataFrame, catchments: DataFrame) -> DataFrame:
    kept = tree.where("system = 'storm_minor'").select(F.col("from_key").alias("outlet_key"))
    return catchments.join(kept, "outlet_key", "left_semi").select("cell_key", "name", "outlet_key")


@query("w10_generated_names", "v_node", sql="""
SELECT node_key, coalesce(lab, 'N' || row_number() OVER (PARTITION BY aoi_id, lab IS NULL ORDER BY lon, lat, node_key)) AS name
FROM (SELECT *, CASE WHEN node_key % 3 = 0 THEN node END AS lab FROM v_node)""")
def w10(nodes: DataFrame) -> DataFrame:
    return op.numbered(nodes.withColumn("lab", F.when(F.col("node_key") % 3 == 0, F.col("node"))), "lab").select("node_key", "name")


@query("u06_wastewater_outlets", "v_tree", sql="""
WITH RECURSIVE s AS (SELECT * FROM v_tree WHERE system = 'sanitary'), nodes AS (SELECT from_key AS n FROM s UNION SELECT to_key FROM s),
walk(node, reached) AS (SELECT n, n FROM nodes UNION ALL SELECT w.node, t.to_key FROM walk w JOIN s t ON t.from_key = w.reached),
c AS (SELECT node, min(reached) AS component FROM walk GROUP BY node), o AS (SELECT DISTINCT component AS n FROM c)
SELECT 'node' AS kind, 'WW_OUT_' || n AS name, CAST(NULL AS BIGINT) AS from_key, round(200 + n * 1e-2 - 0.5, 6)::DOUBLE AS invert_m FROM o UNION ALL SELECT 'link', 'WW_C_' || n, n, NULL FROM o""")
def u06(tree: DataFrame) -> DataFrame:
    """Every wastewater component gets a marked outlet 0.5 m below its lowest node, and a link to it."""
    groups = connected_components(tree.where("system = 'sanitary'"), "from_key", "to_key")
    low = op.lowest_of_components(groups, groups.select(F.col("node").alias("node_key"), (200 + F.col("node") * 0.01).alias("invert_m")))
    key = F.col("node_key").cast("string")
    a = low.select(F.lit("node").alias("kind"), F.concat(F.lit("WW_OUT_"), key).alias("name"), F.lit(None).cast("long").alias("from_key"), F.round(F.col("invert_m") - 0.5, 6).alias("invert_m"))
    return a.unionByName(low.select(F.lit("link").alias("kind"), F.concat(F.lit("WW_C_"), key).alias("name"), F.col("node_key").alias("from_key"), F.lit(None).cast("double").alias("invert_m")))
