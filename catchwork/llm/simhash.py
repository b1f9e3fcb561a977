"""SimHash near-duplicates found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.frames import written
from catchwork.llm.keeping import one_of_each
from catchwork.llm.words import slices, texts
from catchwork.operators.components import connected_components

# Fixed value: generator polynomial of the perfect binary Golay code [23, 12, 7], x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENT = 23


def _fingerprint(words: list[bytes], width: int, seed: int) -> int:
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(n)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 4096):  # a very long text is unpacked piece by piece
        ones += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp long) for every row: bit set where over half of the shingles' XXH64 have it; text_key is xxhash64 of the text.

    Words are maximal runs without ASCII white space after A-Z become a-z; shingles count with repeats; fewer words than
    width make one shingle; no words (also a null or empty text) give 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([_fingerprint(t.lower().split(), width, seed) for t in texts(part, "text")], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_key long, fp long")


def _remainders(top: np.ndarray) -> np.ndarray:
    """The top 12 bits of a word, shifted up by 11, modulo the generator."""
    x = top.astype(np.int64) << 11
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ GENERATOR << bit - 11, x)
    return x


class Golay:
    """Keys of 23-bit words: the indices of all codewords at most 4 bits away, 1 to 6 of them.

    The code is perfect, so some codeword is at most 3 bits from a word. If it is exactly 3 away, 5 more are 4 away, one
    for each set of 4 further places. Two words at most 2 bits apart always share a codeword within 4 bits of both.
    """

    def __init__(self) -> None:
        self.remainder = _remainders(np.arange(4096))
        code = np.arange(4096, dtype=np.int64) << 11 | self.remainder
        blocks = code[np.bitwise_count(code) == 7]
        places = [1 << i for i in range(SEGMENT)]
        errors = [0, *places, *(a | b for a in places for b in places if a < b), *(a | b | c for a in places for b in places for c in places if a < b < c)]
        self.steps = np.full((2048, 6), -1, dtype=np.int64)
        for e in errors:
            s = int(self.syndrome(np.array([e]))[0])
            self.steps[s, 0] = e
            if e.bit_count() == 3:
                self.steps[s, 1:] = blocks[(blocks & e) == e] ^ e

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.remainder[words >> 11] ^ (words & 0x7FF)

    def keys(self, words: np.ndarray) -> np.ndarray:
        """One row of 6 codeword indices for each word, -1 where there are fewer."""
        steps = self.steps[self.syndrome(words)]
        return np.where(steps < 0, -1, (words[:, None] ^ steps) >> 11)


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, fp): for each of the three segments taken as free of errors, its bits with each Golay index of the next segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            segments = [(bits >> np.uint64(SEGMENT * i) & np.uint64(0x7FFFFF)).astype(np.int64) for i in range(3)]
            out_k, out_f = [], []
            for i in range(3):
                index = golay.keys(segments[(i + 1) % 3])
                key = (np.int64(i) << 35 | segments[i] << 12)[:, None] | index
                out_k.append(key[index >= 0])
                out_f.append(np.broadcast_to(fp[:, None], index.shape)[index >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_f))], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def near_fingerprints(prints: DataFrame, hot_key: int = 2048) -> DataFrame:
    """(a, b) with a < b: all pairs of different values of prints.fp that differ in 1 or 2 bits.

    With 2 errors over 3 segments one segment is clean, and the next one has at most 2, which Golay keys bridge, so no pair
    is lost. Keys with over hot_key fingerprints would be quadratic; their fingerprints instead look up each of their 2080
    neighbours by an equi-join, which is as exact.
    """
    keyed = written(_keyed(prints), "simhash_keys")
    heavy = written(keyed.groupBy("key").count().where(F.col("count") > hot_key).select(F.col("key").alias("hot")), "simhash_hot")
    differ = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= 2
    light = keyed.join(heavy, keyed.key == heavy.hot, "left_anti")
    pairs = light.alias("l").join(light.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & differ)
    out = pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    hot = keyed.join(heavy, keyed.key == heavy.hot, "left_semi").select("fp").distinct()
    flips = "explode(transform(sequence(0, 63), i -> shiftleft(1L, i))) as one"
    around = hot.selectExpr("fp", flips).selectExpr("fp", "one", "explode(transform(sequence(0, 63), i -> shiftleft(1L, i))) as two")
    around = around.where("one <= two").selectExpr("fp", "case when one = two then fp ^ one else fp ^ one ^ two end as other")
    # in signed order the top bit sorts first, so one <= two still keeps each pair of places once
    known = prints.select(F.col("fp").alias("known")).distinct()
    near = around.join(known, around.other == known.known).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    return out.union(near).distinct()


def simhash_groups(docs: DataFrame, width: int = 3, seed: int = 42, hot_key: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp long, fingerprint hex, component_id, group_key) for every row of docs; group_key numbers the groups, also those without any id.

    Rows link when their fingerprints differ in at most 2 bits; component_id is the smallest doc_id reachable. Equal
    fingerprints are collapsed first, so a large group of copies costs one key. Rows with a null doc_id stay and get the
    component of their group (null if no row of it has an id). Repeated rows link like any copies. An empty table gives
    an empty one; further columns of docs are not read.
    """
    prints = written(fingerprints(docs, width, seed, id_col, text_col), "simhash_prints")
    unique = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash_unique")
    links = connected_components(near_fingerprints(unique, hot_key))
    group = unique.join(links, unique.fp == links.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("g"))
    group = written(group, "simhash_groups")
    least = group.groupBy(F.col("g").alias("gg")).agg(F.min("least_id").alias("component_id"))
    by_fp = written(group.join(least, group.g == least.gg).select(F.col("fp").alias("of"), "component_id", F.col("g").alias("group_key")), "simhash_components")
    return prints.join(by_fp, prints.fp == by_fp.of).select("doc_id", "text_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_key")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of simhash_groups: that with the least doc_id (rows without id come last), then the least text key. All columns stay, whatever they are called."""
    return one_of_each(docs, simhash_groups(docs, **options))
