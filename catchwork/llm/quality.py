"""Quality rules: fixed measures of a text and a trained, calibrated classifier of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.frames import written
from catchwork.llm.words import Words, rolling, slices, spread, texts

BITS = 15
SIZE = 1 << BITS
PAIR_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
SCALE = 60.0


class Model(NamedTuple):
    """weights: words, word pairs and 4-byte runs, SIZE each; slope and shift are the calibration from score to probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    report: dict


class _Grams:
    """Hashed features of some documents: for each kind, feature numbers in one row, with each document's range."""

    def __init__(self, bodies: list[bytes]) -> None:
        self.words = [t.split() for t in bodies]
        table = Words()
        ids = [table.ids(w) for w in self.words]
        lo, hi = table.hashes()
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        self.all_ids = np.concatenate([np.zeros(0, dtype=np.int64), *ids])
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        h = lo[self.all_ids]
        data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        chars = np.array([len(t) for t in bodies], dtype=np.int64)
        runs = np.zeros(0, dtype=np.uint32)
        if len(data) >= 4:
            x = data.astype(np.uint32)
            runs = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
        with np.errstate(over="ignore"):
            run_bits = (runs * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        top = np.uint64(64 - BITS)
        self.kinds = [(h >> top, sizes, 1), (spread(rolling(h, 2, PAIR_BASE)) >> top, sizes, 2), (run_bits, chars, 4)]
        self.windows = rolling(hi[self.all_ids], 5, WINDOW_BASE)

    def ranges(self, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each document's features of that width."""
        begin = np.cumsum(lengths) - lengths
        return begin, np.maximum(begin, begin + lengths - width + 1)

    def means(self, weights: np.ndarray) -> np.ndarray:
        """Sum over the kinds of a document's mean weight."""
        out = 0.0
        for k, (features, lengths, width) in enumerate(self.kinds):
            begin, end = self.ranges(lengths, width)
            sums = np.concatenate([[0.0], np.cumsum(weights[k * SIZE + features.astype(np.int64)], dtype=np.float64)])
            out = out + (sums[np.minimum(end, len(sums) - 1)] - sums[np.minimum(begin, len(sums) - 1)]) / np.maximum(1, end - begin)
        return out

    def counts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and frequencies of document i."""
        at, value = [], []
        for k, (features, lengths, width) in enumerate(self.kinds):
            begin, end = (x[i] for x in self.ranges(lengths, width))
            u, n = np.unique(features[begin:end].astype(np.int64), return_counts=True)
            at.append(k * SIZE + u)
            value.append(n / max(1, end - begin))
        return np.concatenate(at), np.concatenate(value)


def _repeats(grams: _Grams) -> np.ndarray:
    """For each document, how many words lie in 5-word windows that occur twice or more in it."""
    out = np.zeros(len(grams.sizes), dtype=np.int64)
    for i, (end, n) in enumerate(zip(grams.ends.tolist(), grams.sizes.tolist(), strict=True)):
        if n < 6:
            continue
        _, which, times = np.unique(grams.windows[end - n : end - 4], return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        if len(at):
            edge = np.zeros(n + 1, dtype=np.int64)
            edge[at] += 1
            edge[at + 5] -= 1
            out[i] = (np.cumsum(edge) > 0).sum()
    return out


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, seed: int) -> DataFrame:
    """Features of at most `most` labelled documents, one row an id: those whose ids have the least hash. Labels that are neither 0 nor 1, and null ids, don't count; of several labels of an id the least holds, of several texts the least."""
    picked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = picked.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).orderBy("order", "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams = _Grams(texts(part, "text"))
                pairs = [grams.counts(i) for i in range(part.num_rows)]
                columns = [part.column("order"), part.column("quality"), pa.array([len(p[0]) for p in pairs], pa.int32()), pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["order", "quality", "n", "at", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # `most` rows bound the broadcast
    rows = rows.groupBy("doc_id", "order", "quality").agg(F.min("text").alias("text"))  # each task sends one text an id at most
    return rows.select("order", "quality", "text").mapInArrow(run, "order long, quality int, n int, at array<int>, value array<float>")


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, most_features: int = 8_000_000, seed: int = 7, rounds: int = 160, l2: float = 1e-4) -> Model | None:
    """Logistic regression on a bounded sample: labelled documents in hashed order, `most` rows and most_features features (8 bytes each) at most.

    A fifth of them, never trained on, is held out: one half calibrates, the other one measures. None when the sample lacks either class.
    """
    rows = written(training_rows(docs, labels, most, seed).where("n > 0"), "quality_sample")
    sizes = rows.select("order", "n").toArrow().sort_by("order")  # `most` pairs of numbers
    fits = np.flatnonzero(np.cumsum(sizes.column("n").to_numpy().astype(np.int64)) <= most_features)
    if len(fits) < 10:
        return None
    table = rows.where(F.col("order") <= sizes.column("order")[int(fits[-1])].as_py()).toArrow()  # most_features bounds it
    table = table.sort_by([("order", "ascending"), ("quality", "ascending"), ("n", "ascending")])
    table = table.combine_chunks()
    y = 1.0 - table.column("quality").to_numpy()
    if y.min() == y.max():
        return None
    held = np.arange(len(y)) % 5 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    n = table.column("n").to_numpy().astype(np.int64)
    at = pc.list_flatten(table.column("at")).to_numpy().astype(np.int32)
    value = pc.list_flatten(table.column("value")).to_numpy().astype(np.float32) * np.float32(SCALE)
    del table
    pa.default_memory_pool().release_unused()  # copies that sorting left
    begins = np.cumsum(n) - n
    by_feature = np.argsort(at, kind="stable").astype(np.int32)
    ordered = at[by_feature]
    starts = np.flatnonzero(np.diff(ordered, prepend=np.int32(-1)))
    features = ordered[starts]
    del ordered
    row_of = np.repeat(np.arange(len(y), dtype=np.int32), n)[by_feature]
    value_of = value[by_feature]
    del by_feature
    share = y[~held].mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * ~held  # held-out rows weigh nothing

    def scores() -> np.ndarray:
        part = w.astype(np.float32)[at]
        part *= value
        return np.add.reduceat(part, begins).astype(np.float64) + bias

    w, bias = np.zeros(3 * SIZE), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for i in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(scores(), -30, 30))) - y) * cost / cost.sum()
        g, gb = l2 * w, error.sum()
        part = error.astype(np.float32)[row_of]
        part *= value_of
        g[features] += np.add.reduceat(part, starts)
        del part
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.05 * np.sqrt(1 - 0.999**i) / (1 - 0.9**i)
        w -= step * m / (np.sqrt(v) + 1e-8)
        bias -= step * mb / (np.sqrt(vb) + 1e-8)
    z = scores()
    first = held & (np.arange(len(y)) % 10 == 0)
    apart = held.any() and all(y[x].min() < y[x].max() for x in (first, held & ~first))
    by, on = (first, held & ~first) if apart else (~held, ~held) if not held.any() else (held, held)
    slope, shift = _calibrated(z[by], y[by])
    bad = 1 / (1 + np.exp(-np.clip(slope * z[on] + shift, -30, 30))) >= 0.5
    report = {"rows": len(y), "measured": int(on.sum()), "apart": bool(apart), "accuracy": float((bad == (y[on] == 1)).mean()), "low_found": float(bad[y[on] == 1].mean()), "high_lost": float(bad[y[on] == 0].mean())}
    return Model((w * SCALE).astype(np.float32), float(bias), slope, shift, report)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with its smoothed targets."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def quality_rules(docs: DataFrame, model: Model | None, reject_at: float = 0.9, keep_columns: bool = False) -> DataFrame:
    """One row for each row of docs: the fixed measures, base_failed, p_low (calibrated probability of low quality) and kept.

    Words are maximal runs without ASCII white space. base_failed: under 10 words, or over a fifth of the words in 5-word
    windows that occur twice in the text. kept is false if base_failed, else p_low < reject_at; without a model (no labels of
    both classes) p_low is null and the rules alone decide. A null text is an empty one and fails; ids may be null or
    repeat; an empty table gives an empty one. With keep_columns the columns of docs come first, ours follow with a leading `q_`; a
    column of docs that has such a name, in any case, gives way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_low", "kept"]
    types = ["long"] * 5 + ["boolean", "double", "boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                bodies = texts(part, "text")
                grams = _Grams(bodies)
                n, repeats = grams.sizes, _repeats(grams)
                chars = np.array([len(t) - _continued(t) - sum(map(t.count, SPACES)) for t in bodies], dtype=np.int64)
                symbols = np.array([sum(map(t.count, SYMBOLS)) for t in bodies], dtype=np.int64)
                dups = np.array([_dup_lines(t) for t in bodies], dtype=np.int64)
                failed = (n < 10) | (100 * repeats > 20 * n)
                if model is None:
                    p, good = pa.nulls(len(n), pa.float64()), ~failed
                else:
                    z = model.slope * (grams.means(model.weights) + model.bias) + model.shift
                    chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    p, good = pa.array(chance), ~failed & (chance < reject_at)
                own = [part.column(i) for i in range(part.num_columns)] if keep_columns else [part.column("doc_id")]
                columns = own + [pa.array(x) for x in (n, chars, symbols, dups, repeats, failed)] + [p, pa.array(good)]
                head = part.schema.names if keep_columns else ["doc_id"]
                yield pa.RecordBatch.from_arrays(columns, names=head + [("q_" if keep_columns else "") + x for x in names])

    ours = {f"q_{x}" for x in names}
    rows = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in ours)) if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) if keep_columns else "doc_id long"
    return rows.mapInArrow(run, f"{head}, " + ", ".join(("q_" if keep_columns else "") + f"{a} {b}" for a, b in zip(names, types, strict=True)))


def kept_documents(docs: DataFrame, model: Model | None, **options) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever these are called."""
    names = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    kept = quality_rules(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in names.items())), model, keep_columns=True, **options).where("q_kept")
    return kept.select(*(F.col(x).alias(c) for c, x in names.items()))


def _continued(text: bytes) -> int:
    """Bytes that continue a code point."""
    return int((np.frombuffer(text, dtype=np.uint8) & 0xC0 == 0x80).sum())
