"""Exact searches among vectors of whole numbers: packs of near vectors, groups of near queries, and the packs that a group has to visit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwork.frames import ranked, written

SAMPLE, MOST_CENTRES = 4096, 256  # vectors that centres are fitted on, and centres at most; they only set an order
PACKS_A_SHEET = 256
NO_ID = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """(row, id, dim, v, and more) for vectors that are not null and hold no null or non-finite component, each x as floor(scale * x).

    Components saturate at the root of 2**53 / dim (11 million for 64), so that inner products are exact in double precision.
    """
    x = F.col(vector_col)
    good = F.coalesce(F.forall(x, lambda y: y.isNotNull() & (F.abs(y.cast("double")) < float("inf"))), F.lit(False))
    cap = F.floor(F.sqrt(F.lit(2.0**53) / F.greatest(F.size(x), F.lit(1))))
    v = F.transform(x, lambda y: F.least(cap, F.greatest(-cap, F.floor(F.lit(float(scale)) * y.cast("double")))).cast("int"))
    return vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), v.alias("v"), *(c.alias(n) for n, c in more.items()))


def matrix(flat: pa.Array, rows: int) -> np.ndarray:
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(rows, len(x) // rows if rows else 0)


def centres(rows: DataFrame, size: int) -> dict[int, np.ndarray]:
    """For each length of vectors: directions, one for about `size` rows, fitted on SAMPLE rows in hash order."""
    wanted = max(1, min(MOST_CENTRES, rows.count() // size))
    found: dict[int, list[list[int]]] = {}
    for r in rows.select("row", "dim", "v").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect():  # SAMPLE rows
        found.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for dim, vs in found.items():
        x = directions(np.array(vs, dtype=np.float64).reshape(len(vs), dim))
        c = x[:wanted]
        for _ in range(5):
            own = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            c = directions(sums)
        out[dim] = c
    return out


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero stays."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def celled(rows: DataFrame, size: int) -> DataFrame:
    """rows with the number of the nearest centre as `cell` and the cosine with it as `near`."""
    sent = rows.sparkSession.sparkContext.broadcast(centres(rows, size))  # MOST_CENTRES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, near = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in sent.value:
                    cos = directions(matrix(batch.column("v").take(pa.array(at)).flatten(), len(at))) @ sent.value[d].T
                    cell[at] = np.argmax(cos, axis=1)
                    near[at] = cos.max(axis=1)
            yield batch.append_column("cell", pa.array(cell)).append_column("near", pa.array(near))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, cell int, near double")


def gathered(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each key, a bounded group: the columns as arrays in the order of row; vectors one after another as `vs`."""
    lists = F.array_sort(F.collect_list(F.struct("row", *columns, "v")))
    one = rows.groupBy(key, "dim").agg(lists.alias("m"))
    return one.select(key, "dim", *(F.col(f"m.{c}").alias(f"{c}s") for c in ("row", *columns)), F.flatten("m.v").alias("vs"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """rows with `pack`: ranges of about `size` rows of one length in the order of cells, so a pack's vectors are near each other."""
    placed = ranked(celled(rows, size), [F.col("dim")], ["cell", "near", "row"], "place")
    return written(placed.withColumn("pack", F.col("dim") * F.lit(1 << 40) + F.floor((F.col("place") - 1) / size)).drop("place", "cell", "near"), "packs_rows")


def clustered(rows: DataFrame, size: int) -> DataFrame:
    """rows with `cluster`: at most `size` rows of one cell. Cells with many rows have many clusters."""
    placed = ranked(celled(rows, size), [F.col("dim"), F.col("cell")], ["near", "row"], "place")
    name = F.concat_ws("-", "dim", "cell", F.floor((F.col("place") - 1) / size))
    return written(placed.withColumn("cluster", name).drop("place", "cell", "near"), "packs_clusters")


def in_row(batch: pa.RecordBatch, i: int, *names: str) -> Iterator[pa.Array]:
    return (batch.column(n)[i].values for n in names)


def plain(ids: pa.Array) -> np.ndarray:
    """Ids as numbers, a null one as the largest."""
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def summaries(packs: DataFrame, summary: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(dim, sheet, packs, facts): what summary says of each pack, PACKS_A_SHEET of them in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [summary(matrix(vs, len(rows))) for i in range(batch.num_rows) for rows, vs in [in_row(batch, i, "rows", "vs")]]
            yield pa.RecordBatch.from_arrays([batch.column("pack"), batch.column("dim"), pa.array(facts, pa.list_(pa.float64()))], names=["pack", "dim", "facts"])

    each = packs.select("pack", "dim", "rows", "vs").mapInArrow(run, "pack long, dim int, facts array<double>")
    sheets = each.groupBy("dim", F.floor(F.col("pack") / PACKS_A_SHEET).alias("sheet")).agg(F.array_sort(F.collect_list(F.struct("pack", "facts"))).alias("m"))
    return written(sheets.select("dim", "sheet", F.col("m.pack").alias("packs"), F.flatten("m.facts").alias("facts")), "packs_sheets")


def to_visit(clusters: DataFrame, sheets: DataFrame, may: Callable[[pa.RecordBatch, int, np.ndarray], np.ndarray]) -> DataFrame:
    """(cluster, pack) where may(batch, row, facts) holds: some member can still gain something from the pack. Clusters meet sheets, not packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packs, facts = in_row(batch, i, "packs", "facts")
                on = np.flatnonzero(may(batch, i, matrix(facts, len(packs))))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("cluster")[i].as_py()] * len(on), pa.string()), packs.take(pa.array(on))], names=["cluster", "pack"])

    known = sheets.select(F.col("dim").alias("of"), "sheet")
    keyed = clusters.select("dim", "cluster").join(known, F.col("dim") == F.col("of")).select("cluster", "sheet")
    met = keyed.join(clusters, "cluster").join(sheets.drop("dim"), "sheet")
    return met.mapInArrow(run, "cluster string, pack long")


class Best:
    """The k best of (score, id, row) so far: higher scores, then smaller ids (null last), then rows. Nothing below floor is kept."""

    def __init__(self, k: int, floor: float) -> None:
        self.k, self.floor, self.kept = k, floor, []

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > self.k:
            on = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids, rows = scores[on], ids[on], rows[on]
        self.kept = sorted([*self.kept, *zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True)])[: self.k]
        if len(self.kept) == self.k:
            self.floor = max(self.floor, -self.kept[-1][0])


def results(found: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    """(own, part, score, id, row) of what the lists of (own, part, best) hold."""
    flat = [(own, part, int(-s), i, r) for own, part, best in found for s, i, r in best.kept]
    columns = list(zip(*flat, strict=True)) or [()] * 5
    ids = np.array(columns[3], dtype=np.int64)
    arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(columns[4], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["own", "part", "score", "id", "row"])


RESULTS = "own long, part int, score long, id long, row long"
