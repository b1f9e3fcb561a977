"""Land that changes hands between cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.operators import merging as op
from catchwork.operators.grid import PIXEL
from catchwork.plans.registry import query

EXCHANGE = """WITH RECURSIVE seed AS (SELECT aoi_id, cell, min((ix * 31 + iy * 17) % 23 * 1000000 + iy * 1000 + ix) % 1000000 AS s FROM v_offer GROUP BY ALL),
home AS (SELECT s.aoi_id, s.cell, p.basin AS home FROM seed s JOIN v_offer p ON p.aoi_id = s.aoi_id AND p.ix = s.s % 1000 AND p.iy = s.s // 1000),
x AS (SELECT p.*, home FROM v_offer p JOIN home USING (aoi_id, cell)),
g AS (SELECT 'stay' AS kind, aoi_id, cell, 0 AS basin, ix, iy FROM x WHERE basin = home UNION ALL SELECT 'whole', aoi_id, cell, 0, ix, iy FROM x UNION ALL SELECT 'cut', aoi_id, cell, coalesce(basin, -1), ix, iy FROM x WHERE home IS NOT NULL AND basin IS DISTINCT FROM home),
w(kind, aoi_id, cell, basin, ix, iy, ox, oy) AS (SELECT *, ix, iy FROM g UNION SELECT w.kind, w.aoi_id, w.cell, w.basin, w.ix, w.iy, g.ix, g.iy FROM w JOIN g ON g.kind = w.kind AND g.aoi_id = w.aoi_id AND g.cell = w.cell AND g.basin = w.basin AND abs(g.ix - w.ox) + abs(g.iy - w.oy) = 1),
part AS (SELECT kind, aoi_id, cell, basin, ix, iy, min(oy * 1000 + ox) AS part FROM w GROUP BY ALL),
stay AS (SELECT aoi_id, cell, count(DISTINCT part) AS pieces, count(*) AS stay FROM part WHERE kind = 'stay' GROUP BY ALL),
state AS (SELECT aoi_id, cell, CASE WHEN home IS NULL THEN 'outside' WHEN coalesce(pieces, 0) <> 1 OR coalesce(stay, 0) < 0.2 * n THEN 'too_small' WHEN stay = n THEN 'whole' ELSE 'giver' END AS kind
          FROM home JOIN (SELECT aoi_id, cell, count(*) AS n FROM v_offer GROUP BY ALL) USING (aoi_id, cell) LEFT JOIN stay USING (aoi_id, cell)),
cut AS (SELECT p.* FROM part p JOIN state s ON s.aoi_id = p.aoi_id AND s.cell = p.cell AND p.kind = 'cut' AND s.kind = 'giver'),
edge AS (SELECT c.aoi_id, c.cell, c.part, c.basin, q.cell AS other, count(*) AS n FROM cut c JOIN v_offer q ON q.aoi_id = c.aoi_id AND abs(q.ix - c.ix) + abs(q.iy - c.iy) = 1 AND q.cell <> c.cell JOIN home h ON h.aoi_id = q.aoi_id AND h.cell = q.cell AND h.home = c.basin GROUP BY ALL),
taker AS (SELECT * FROM edge QUALIFY row_number() OVER (PARTITION BY aoi_id, cell, part, basin ORDER BY n DESC, other) = 1),
placed AS (SELECT DISTINCT c.aoi_id, c.cell, c.part, c.basin, t.other AS taker FROM cut c LEFT JOIN taker t ON t.aoi_id = c.aoi_id AND t.cell = c.cell AND t.part = c.part AND t.basin = c.basin),
nowhere AS (SELECT DISTINCT aoi_id, cell FROM placed WHERE taker IS NULL),
offer AS (SELECT * FROM placed ANTI JOIN nowhere USING (aoi_id, cell)),
broken AS (SELECT aoi_id, cell FROM offer UNION SELECT aoi_id, cell FROM part WHERE kind = 'whole' GROUP BY ALL HAVING count(DISTINCT part) > 1),
refused AS (SELECT DISTINCT o.aoi_id, o.cell FROM offer o JOIN broken b ON b.aoi_id = o.aoi_id AND b.cell = o.taker),
move AS (SELECT * FROM offer ANTI JOIN refused USING (aoi_id, cell)),
done AS (SELECT p.aoi_id, p.ix, p.iy, coalesce(m.taker, p.cell) AS cell, m.taker IS NOT NULL AS moved FROM v_offer p LEFT JOIN cut c USING (aoi_id, ix, iy) LEFT JOIN move m ON m.aoi_id = c.aoi_id AND m.cell = c.cell AND m.part = c.part AND m.basin = c.basin)"""


def _exchanged(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    seeds = px.groupBy("aoi_id", "cell").agg(F.min_by(F.struct("ix", "iy"), F.struct((F.col("ix") * 31 + F.col("iy") * 17) % 23, "iy", "ix")).alias("s"))
    return op.official_edges(px, seeds.select("aoi_id", "cell", "s.ix", "s.iy"))


@query("u08_exchanged_cells", "v_offer", sql=EXCHANGE + " SELECT aoi_id, cell, count(*) AS pixels, sum(ix * 7 + iy)::BIGINT AS places FROM done GROUP BY ALL")
def exchanged_cells(px: DataFrame) -> DataFrame:
    """Cells after land beyond an official edge has gone to the cells that serve it."""
    return _exchanged(px)[0].groupBy("aoi_id", "cell").agg(F.count("*").alias("pixels"), F.sum(F.col("ix") * 7 + F.col("iy")).alias("places"))


@query("u08_exchange_counts", "v_offer", sql=EXCHANGE + """, why AS (SELECT s.aoi_id, CASE WHEN n.cell IS NOT NULL THEN 'nowhere' WHEN r.cell IS NOT NULL THEN 'unmergeable' ELSE s.kind END AS kind FROM state s LEFT JOIN nowhere n USING (aoi_id, cell) LEFT JOIN refused r USING (aoi_id, cell))
SELECT aoi_id, count(*) FILTER (WHERE kind = 'giver') AS n_clipped, count(*) FILTER (WHERE kind = 'outside') AS n_outside, count(*) FILTER (WHERE kind = 'too_small') AS n_too_small, count(*) FILTER (WHERE kind = 'nowhere') AS n_nowhere,
       count(*) FILTER (WHERE kind = 'unmergeable') AS n_unmergeable, (SELECT count(*) FROM done d WHERE d.aoi_id = why.aoi_id AND moved) AS n_moved FROM why GROUP BY 1""")
def exchange_counts(px: DataFrame) -> DataFrame:
    """How many cells gave land, were left alone or refused, and how many pixels moved, by area."""
    return _exchanged(px)[1]


@query("t06_slivers_in_order", "v_offer")
def slivers(px: DataFrame) -> DataFrame:
    """Slivers merged one after another, which SQL can't express: pixels and area of each cell. A test holds the operator against the sequential rule."""
    ragged = px.select(*PIXEL, F.when((F.col("ix") * 5 + F.col("iy") * 3) % 37 < 9, F.col("cell") + 1000 * (F.col("ix") % 5)).otherwise(F.col("cell")).alias("cell"))
    found = op.slivers_in_order(ragged, "cell", 12)
    return found.groupBy("aoi_id", "cell").agg(F.count("*").alias("pixels"), F.max("area").alias("area"))


@query("g11_scraps_attached", "v_offer")
def scraps(px: DataFrame) -> DataFrame:
    """Parts that do not hang together with their cell go to the neighbour that they share most with, one after another, which SQL can't express. A test holds the operator against the sequential rule."""
    return op.scraps_attached(px, "cell", 2).groupBy("aoi_id", "cell").agg(F.count("*").alias("pixels"))
