"""Near-duplicate vectors by Euclidean p-stable hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwork.frames import written
from catchwork.operators.components import connected_components

STEPS = (0, 3, 6, 9, 12)  # further projections tried when buckets are fuller than random vectors would make them
LEAD_TABLES, LEAD_BITS = 6, 12  # tables that find cells, and differing sketch bits up to which a vector is compared with its bucket's first
CLOSE, WIDE = 17, 4  # differing sketch bits up to which two vectors are compared, and how many more for each cell with several members


def collision(distance: float, width: float) -> float:
    """Chance that a Gaussian projection, cut into cells of that width, puts two points at that distance into one cell."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def key_length(n: int, width: float, partners: float) -> int:
    """Projections in a key that leave each of n unrelated vectors about `partners` strangers in its bucket, at any n."""
    return max(4, math.ceil(math.log(max(1.0, n / partners)) / -math.log(collision(math.sqrt(2), width))))


def table_count(keys: int, threshold: float, width: float, recall: float) -> int:
    """Tables in which a pair exactly at the threshold shares a bucket at least once with chance recall."""
    near = collision(math.sqrt(2 - 2 * threshold), width)
    return math.ceil(math.log(1 - recall) / math.log1p(-(near**keys)))


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    """Rows of length 1 in double precision; the largest part goes first, so that no square over- or underflows."""
    x = flat.astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    values = batch.column(column)
    return _unit(values.flatten().to_numpy(zero_copy_only=False), len(values))


def _by_dimension(batches: Iterator[pa.RecordBatch], column: str = "v") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of the batches whose vectors have one length."""
    for batch in batches:
        dims = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            yield d, batch.filter(pa.array(dims == d))


def _sketched(nodes: DataFrame, seed: int) -> DataFrame:
    """nodes with `sketch`: the signs of 64 projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for d, part in _by_dimension(batches):
            if d not in planes:
                planes[d] = np.random.default_rng([seed, d, 1]).standard_normal((d, 64))
            signs = np.packbits(_units(part) @ planes[d] > 0, axis=1).view(np.int64).reshape(-1)
            yield part.append_column("sketch", pa.array(signs))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"{fields}, sketch long")


def _mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashed(nodes: DataFrame, keys: int, tables: int, width: float, seed: int, levels: tuple[int, ...] = ()) -> DataFrame:
    """(bucket, cell, sketch, wide): a 64-bit key for each table from the cell numbers of its projections; nodes has cell, sketch, wide and v.

    A batch gives each (bucket, cell) once, so a cell with a third of all vectors reaches the shuffle as a few rows. With levels, the
    keys of one table are cut to these lengths instead, one row for each, and wide is the number of the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for d, part in _by_dimension(batches):
            if d not in planes:
                r = np.random.default_rng([seed, d])
                planes[d] = r.standard_normal((d, keys * tables)), r.random(keys * tables) * width, r.integers(1, 1 << 63, (tables, keys), dtype=np.uint64) | np.uint64(1)
            a, b, mix = planes[d]
            found = []
            for at in range(0, part.num_rows, 2000):
                numbers = np.floor((_units(part.slice(at, 2000)) @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(-1, tables, keys)
                with np.errstate(over="ignore"):
                    terms = numbers * mix
                    sums = np.stack([terms[:, 0, :n].sum(axis=1, dtype=np.uint64) + np.uint64(n) for n in levels], axis=1) if levels else terms.sum(axis=2, dtype=np.uint64)
                    found.append(_mixed_bits(sums + np.arange(sums.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d)).view(np.int64))
            bucket = np.concatenate(found)
            cell, sketch, wide = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "sketch", "wide"))
            row = np.repeat(np.arange(len(cell)), bucket.shape[1])
            wide = np.tile(np.arange(len(levels), dtype=np.int32), len(cell)) if levels else wide[row]
            bucket = bucket.reshape(-1)
            if not levels and len(np.unique(cell)) < len(cell):
                order = np.lexsort((cell[row], bucket))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (cell[row][order][1:] != cell[row][order][:-1])
                bucket, row, wide = bucket[order[new]], row[order[new]], wide[order[new]]
            for at in range(0, len(row), 100_000):
                own = row[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at : at + 100_000]), pa.array(cell[own]), pa.array(sketch[own]), pa.array(wide[at : at + 100_000])], names=["bucket", "cell", "sketch", "wide"])

    return nodes.select("cell", "sketch", "wide", "v").mapInArrow(run, "bucket long, cell long, sketch long, wide int")


def _cosines(pairs: DataFrame) -> DataFrame:
    """pairs with the cosine of va and vb, vectors of equal length, instead of these."""
    kept = [f for f in pairs.schema if f.name not in ("va", "vb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _by_dimension(batches, "va"):
            cos = (_units(part, "va") * _units(part, "vb")).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(cos)], names=[*(f.name for f in kept), "cosine"])

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", cosine double")


def _between(blocks: DataFrame, threshold: float) -> DataFrame:
    """(cell_a, cell_b, node, links): exact cosines between two blocks of different cells; links are weighted by copies."""
    schema = "cell_a long, cell_b long, node long, links long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int, int], int] = {}
            sides = [[batch.column(f"{x}_{s}") for x in ("nodes", "copies", "vs")] for s in "ab"]
            cells = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("cell_a", "cell_b")]
            for i, (ca, cb) in enumerate(zip(*cells, strict=True)):
                (na, wa, va), (nb, wb, vb) = ([np.asarray(x[i].values.to_numpy(zero_copy_only=False)) for x in s] for s in sides)
                va, vb = _unit(va, len(na)), _unit(vb, len(nb))
                if va.shape[1] != vb.shape[1]:
                    continue
                on = va @ vb.T >= threshold
                for nodes, links in ((na, on @ wb), (nb, wa @ on)):
                    for j in np.flatnonzero(links).tolist():
                        key = (ca, cb, int(nodes[j]))
                        out[key] = out.get(key, 0) + int(links[j])
            rows = list(zip(*((*k, v) for k, v in out.items()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["cell_a", "cell_b", "node", "links"])

    return blocks.mapInArrow(run, schema)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fitted_keys(centres: DataFrame, n: int, width: float, partners: float, seed: int) -> int:
    """The key length for these vectors: that for unrelated ones, or a longer one where buckets would hold over 4 * partners others on average, counted over all centres in one table."""
    least = key_length(n, width, partners)
    tried = _hashed(centres, least + STEPS[-1], 1, width, seed, tuple(least + s for s in STEPS)).groupBy("wide", "bucket").count()
    others = tried.groupBy("wide").agg(F.sum(F.col("count") * (F.col("count") - 1)).alias("pairs")).collect()  # one row for each step
    fuller = {r["wide"]: r["pairs"] / max(1, n) for r in others}
    return least + next((s for i, s in enumerate(STEPS) if fuller.get(i, 0) <= 4 * partners), STEPS[-1])


def candidate_cells(cells: DataFrame, keys: int, tables: int, width: float, seed: int) -> DataFrame:
    """(cell_a, cell_b) of cells that share a bucket and whose centres' sketches are near enough for a link between their members."""
    spread = _hashed(cells, keys, tables, width, seed).repartition("bucket").dropDuplicates(["bucket", "cell"])
    l, r = (spread.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("cell", "sketch", "wide"))) for s in "ab")
    near = (F.col("cell_a") < F.col("cell_b")) & (_apart("sketch_a", "sketch_b") <= F.lit(CLOSE) + F.col("wide_a") + F.col("wide_b"))
    return l.join(r, "bucket").where(near).select("cell_a", "cell_b").distinct()


def _of_cell(rows: DataFrame, info: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with the columns of info, one row for each cell c. hot holds the numbers of cells with very many members: these have a broadcast join, so no task gets all rows of one."""
    keyed = F.broadcast(hot)
    few = rows.join(F.broadcast(info.join(keyed, "c")), F.col("cell") == F.col("c"))
    rest = rows.join(keyed, F.col("cell") == F.col("c"), "left_anti").join(info, F.col("cell") == F.col("c"))
    return few.unionByName(rest)


def vector_groups(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.997, width: float = 2.0, partners: float = 4.0, seed: int = 11, block: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Two rows link if the cosine of their vectors, in double precision, is at least threshold. Equal vectors are collapsed
    first. Buckets of several tables of quantised random projections give candidates. A key has as many projections as leave a vector
    about `partners` strangers in a bucket, whatever the number of vectors; the number of tables follows from recall, the chance for a pair exactly at
    the threshold to share a bucket (closer pairs share more). To keep large groups linear, each vector joins a cell: in a few
    tables of its own, the first member of one of its buckets whose cosine with it is at least sqrt((1 + threshold) / 2). Any two
    members of a cell are above the threshold by the triangle inequality on angles and need no comparison. Cells that share a
    bucket, and whose centres differ in few bits of a 64-bit sketch, are compared by exact cosines, block by block; only their vectors move. Vectors
    that are null, empty, zero or hold null or non-finite parts link with nothing; vectors of unlike length never link. Rows with a null or
    repeated id keep their own row; the ids of a group decide component_id. An empty table gives an empty one; further columns are not read.
    """
    v = F.col(vector_col)
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = slim.select("vec_id", "v", finite.alias("good"), F.xxhash64("v").alias("t1"), F.xxhash64(F.lit(7), "v").alias("t2"))
    nodes = rows.where("good").groupBy("t1", "t2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = written(_sketched(nodes.withColumn("node", F.monotonically_increasing_id()), seed), "vector_nodes")
    n = nodes.count()

    own = _hashed(nodes.select(F.col("node").alias("cell"), "sketch", F.lit(0).alias("wide"), "v"), key_length(n, width, partners), LEAD_TABLES, width, seed + 1)
    first = own.groupBy("bucket").agg(F.min(F.struct("cell", "sketch")).alias("lead"), F.max("cell").alias("last")).where("lead.cell < last")
    star = own.join(first, "bucket").where((F.col("cell") != F.col("lead.cell")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("lead.sketch"))) <= LEAD_BITS))
    star = star.select(F.col("cell").alias("a"), F.col("lead.cell").alias("b"), F.col("lead.sketch").alias("centre")).distinct()
    va, vb = nodes.select(F.col("node").alias("a"), F.col("v").alias("va")), nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"))
    tight = math.sqrt((1 + threshold) / 2) + 1e-6
    led = _cosines(star.join(va, "a").join(vb, "b")).where(F.col("cosine") >= tight)
    led = written(led.groupBy("a").agg(F.min(F.struct("b", "centre")).alias("of")), "vector_led")
    cells = nodes.join(led, nodes.node == led.a, "left").select("node", "copies", "least_id", "t1", "t2", "v", F.coalesce("of.b", "node").alias("cell"), F.coalesce("of.centre", "sketch").alias("sketch"))
    cells = written(cells, "vector_cells")
    size = cells.groupBy(F.col("cell").alias("c")).agg(F.sum("copies").alias("in_cell"), F.count("*").alias("members"), F.min("least_id").alias("cell_least"))
    size = written(size, "vector_sizes")

    hot = size.where(F.col("members") > max(100, n // 100_000)).select("c")  # 100,000 rows at most
    sized = _of_cell(cells, size.select("c", "members"), hot).select("cell", "sketch", F.when(F.col("members") > 1, WIDE).otherwise(0).alias("wide"), "v")
    keys = fitted_keys(cells.where("node = cell").select("cell", "sketch", F.lit(0).alias("wide"), "v"), n, width, partners, seed + 2)
    pairs = written(candidate_cells(sized, keys, table_count(keys, threshold, width, recall), width, seed), "vector_pairs")
    met = pairs.select(F.col("cell_a").alias("c")).union(pairs.select("cell_b")).distinct()
    few = _of_cell(cells.select("node", "copies", "cell", "v"), size.select("c", "members").join(met, "c"), hot).withColumn("piece", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block)))
    packed = few.groupBy("cell", "piece").agg(F.collect_list(F.struct("node", "copies", "v")).alias("m"))
    packed = written(packed.select("cell", F.col("m.node").alias("nodes"), F.col("m.copies").alias("copies"), F.flatten("m.v").alias("vs")), "vector_blocks")
    pa_, pb = (packed.select(F.col("cell").alias(f"cell_{s}"), *(F.col(x).alias(f"{x}_{s}") for x in ("nodes", "copies", "vs"))) for s in "ab")
    cross = written(_between(pairs.join(pa_, "cell_a").join(pb, "cell_b"), threshold), "vector_cross")

    groups = connected_components(cross.select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b")).distinct())
    rooted = size.join(groups, size.c == groups.node, "left").select("c", "in_cell", "cell_least", F.coalesce("component", "c").alias("root"))
    rooted = written(rooted, "vector_roots")
    least = rooted.groupBy(F.col("root").alias("g")).agg(F.min("cell_least").alias("component_id"))
    by_cell = rooted.join(least, rooted.root == least.g).select("c", "in_cell", "component_id")
    extra = cross.groupBy(F.col("node").alias("e")).agg(F.sum("links").alias("extra"))
    by_node = _of_cell(cells.select("node", "cell", "t1", "t2"), by_cell, hot)
    by_node = by_node.join(extra, by_node.node == extra.e, "left").select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), (F.col("in_cell") - 1 + F.coalesce("extra", F.lit(0))).alias("n_links"), "component_id")
    keyed = written(by_node, "vector_result")
    flat = rows.drop("v")
    done = flat.join(keyed, flat.good & (flat.t1 == keyed.k1) & (flat.t2 == keyed.k2), "left")
    found = F.col("n_links").isNotNull()
    component = F.when(found, F.col("component_id")).otherwise(F.col("vec_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNotNull() & F.col("vec_id").eqNullSafe(component)).alias("kept"))
