"""Repeated passages removed: counts confirm which passages recur, then Aho-Corasick automata of their texts locate every occurrence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwork.frames import discard, written
from catchwork.llm.words import Words, rolling, slices, spread, texts

PHRASE = 8
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PLACE_BITS = np.uint64(26)
SHARD = 1_000_000  # words of the passages in one automaton
LONGEST = 1024  # consecutive windows in one passage, about
BUSY = 32  # passages of one phrase that a block takes unseen
MODULUS = (1 << 31) - 1


class _Words:
    """Some documents' words in one row of numbers."""

    def __init__(self, bodies: list[bytes]) -> None:
        self.words = [t.split() for t in bodies]
        self.table = Words()
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.ids = np.concatenate([np.zeros(0, dtype=np.int64), *(self.table.ids(w) for w in self.words)])

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each word's 128-bit hash."""
        lo, hi = self.table.hashes()
        return lo[self.ids], hi[self.ids]


class _Block(_Words):
    """Words with each window's rarest phrase: the least hash, the first of equals."""

    def __init__(self, bodies: list[bytes], window: int) -> None:
        super().__init__(bodies)
        lo, self.hi = self.hashes()
        self.phrases = spread(rolling(lo, PHRASE, BASES[0]))
        at = np.arange(max(0, len(self.ids) - window + 1))
        doc_end = np.repeat(self.ends, self.sizes)
        self.starts = at[at + window <= doc_end[: len(at)]]
        if len(self.starts):
            span, have, best = window - PHRASE + 1, 1, self.phrases >> PLACE_BITS << PLACE_BITS | np.arange(len(self.phrases), dtype=np.uint64) & np.uint64((1 << 26) - 1)
            while 2 * have <= span:
                best = np.minimum(best[:-have], best[have:])
                have *= 2
            if span > have:
                best = np.minimum(best[: len(best) - span + have], best[span - have :])
            low = best[self.starts] & np.uint64((1 << 26) - 1)
            self.rarest = self.starts + ((low.astype(np.int64) - self.starts) & (1 << 26) - 1)
        else:
            self.rarest = self.starts

    def runs(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, number of windows, phrase, key) of each run of windows that select the same place; phrase and key together are a 128-bit hash of the run's words."""
        new = np.ones(len(self.rarest), dtype=bool)
        new[1:] = self.rarest[1:] != self.rarest[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(self.rarest)))
        start = self.starts[first]
        with np.errstate(over="ignore"):
            base = np.uint64(BASES[1])
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.hi), base)]), dtype=np.uint64)
            inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.hi), np.uint64(pow(BASES[1], -1, 1 << 64)))]), dtype=np.uint64)
            before = np.concatenate([[np.uint64(0)], np.cumsum(self.hi * power[:-1], dtype=np.uint64)])
            key = spread((before[start + n - 1 + window] - before[start]) * inverse[start] + n.astype(np.uint64))
        return start, n, self.phrases[self.rarest[first]], key

    def lists(self, at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        """values, which lie at the ascending places at, as one list for each document."""
        cuts = np.searchsorted(at, np.concatenate([self.begins, self.ends[-1:]]))
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """For each row: its text, number of words, and the runs of windows that select one phrase."""
    schema = "doc_id long, t1 long, t2 long, text string, n_words long, starts array<int>, counts array<int>, phrases array<long>, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b = _Block(texts(part, "text"), window)
                start, n, phrase, key = b.runs(window)
                doc = np.searchsorted(b.ends, start, side="right")
                columns = [part.column(c) for c in ("doc_id", "t1", "t2", "text")] + [pa.array(b.sizes)]
                columns += [b.lists(start, start - b.begins[doc], pa.int32()), b.lists(start, n, pa.int32()), b.lists(start, phrase.view(np.int64), pa.int64()), b.lists(start, key.view(np.int64), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t1", "t2", "text", "n_words", "starts", "counts", "phrases", "keys"])

    return docs.mapInArrow(run, schema)


def _windows(spans: DataFrame, window: int) -> DataFrame:
    """(num, start, phrase, hash, times): every window of the runs in spans (num, text, starts, counts, phrases, times). Phrase and hash together are 128 bits of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b = _Words(texts(part, "text"))
                start, n, phrase, times = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("starts", "counts", "phrases", "times"))
                row = np.repeat(np.arange(part.num_rows), part.column("starts").value_lengths().to_numpy(zero_copy_only=False))
                own = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row, phrase, times = np.repeat(row, n), np.repeat(phrase, n), np.repeat(times, n)
                h = rolling(b.hashes()[1], window, BASES[1])[own + b.begins[row]]
                columns = [part.column("num").to_numpy(zero_copy_only=False)[row], own.astype(np.int32), phrase, h.view(np.int64), times]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["num", "start", "phrase", "hash", "times"])

    return spans.select("num", "text", "starts", "counts", "phrases", "times").mapInArrow(run, "num long, start int, phrase long, hash long, times long")


def _recurring(rows: DataFrame, key: str, n: Column, *more: Column) -> DataFrame:
    """Each (phrase, key) of rows (num, start, count, phrase, key): how often it stands, one place (num, start) of it, and where it stands relative to that place, hashed.

    docs and mix are sums over the places, so two neighbours in one document that have equal ones, and stand as often, stand side by side everywhere.
    """
    doc, start = F.pmod(F.xxhash64("num"), F.lit(MODULUS)), F.col("start").cast("long")
    x = rows.groupBy("phrase", F.col(key).alias("fine")).agg(
        F.sum(n).alias("times"), F.min("num").alias("num"), F.min_by(start, "num").alias("start"), F.min("count").alias("count"),
        F.sum(doc).alias("docs"), F.sum(F.pmod(doc * start, F.lit(MODULUS))).alias("mix"), *more,
    )
    return x.withColumn("mix", F.pmod(F.col("mix") - F.col("start") * (F.col("docs") % MODULUS), F.lit(MODULUS)))


def _joined(samples: DataFrame, window: int) -> DataFrame:
    """(num, start, size, phrase, fine): neighbouring samples that stand side by side everywhere as one passage of about LONGEST windows at most."""
    order = Window.partitionBy("num", "kind").orderBy("start")  # of one document
    where = F.struct("times", "docs", "mix")
    follows = (F.lag(F.col("start") + F.col("count")).over(order) == F.col("start")) & (F.lag(where).over(order) == where)
    x = samples.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("piece", F.sum("new").over(order))
    size = F.max(F.col("start") + F.col("count")) - F.min("start") + window - 1
    x = x.groupBy("num", "kind", "piece", F.floor(F.col("start") / LONGEST).alias("part")).agg(F.min("start").alias("start"), size.alias("size"), F.min_by("fine", "phrase").alias("fine"), F.min("phrase").alias("phrase"))
    return x.select("num", "start", "size", "phrase", "fine")


def _bodies(places: DataFrame) -> DataFrame:
    """(phrase, fine, body): the words of each passage in places (num, text, starts, sizes, phrases, fines), joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                of = [part.column(c).to_pylist() for c in ("starts", "sizes")]
                words = [t.split() for t in texts(part, "text")]
                body = [b" ".join(w[a : a + n]) for w, starts, sizes in zip(words, *of, strict=True) for a, n in zip(starts, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("phrases").flatten(), part.column("fines").flatten(), pa.array(body, pa.binary())], names=["phrase", "fine", "body"])

    return places.select("text", "starts", "sizes", "phrases", "fines").mapInArrow(run, "phrase long, fine long, body binary")


def _fine_calls(runs: DataFrame, windows: DataFrame, passages: DataFrame) -> DataFrame:
    """(block, id): the passages (id, phrase, fine) that are a run or window (block, phrase, fine) of the block. A run meets its passage once a block, not once for each document that holds it; windows stand once for each run."""
    met = (x.join(passages, ["phrase", "fine"]).select("block", "id") for x in (runs.distinct(), windows))
    return next(met).union(next(met)).distinct()


def _located(docs: DataFrame, passages: DataFrame, with_text: bool) -> DataFrame:
    """(num, n_removed, kept_sha256[, kept_text]): each document without the words that passages cover. docs and passages are dealt by block.

    passages holds the texts of the passages that a block's phrases call for, and by num, without a text, the documents of it that are copies to
    leave out. Passages of words that the block knows are sorted by their first word and become automata of about SHARD words each;
    a document is streamed through those automata whose first words it has.
    """

    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        nums = docs.column("num").to_pylist()
        b = _Words(texts(docs.combine_chunks().to_batches()[0], "text")) if nums else _Words([])
        radix = int(len(b.table) ** 0.5) + 1  # a word is two signs of small alphabets, the first one's its own: nodes stay narrow, and matches begin with a word
        signs = lambda ids: np.stack([0x10000 + ids // radix, 0x20000 + ids % radix], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        begin, end = b.begins.tolist(), b.ends.tolist()
        out = pc.is_null(passages.column("body"))
        copies = set(passages.filter(out).column("num").to_pylist())
        both = signs(np.arange(len(b.table)))
        pair = {w: both[2 * i : 2 * i + 2] for w, i in b.table.items()}
        bodies = (body.split() for body in passages.filter(pc.invert(out)).column("body").to_pylist())
        known = ((body[0], pairs) for body in bodies if None not in (pairs := list(map(pair.get, body))))
        called = sorted((b.table[word], "".join(pairs)) for word, pairs in known)
        shards = np.cumsum([len(pattern) // 2 for _, pattern in called]) // SHARD
        edge = np.zeros(len(b.ids) + 1, dtype=np.int64)
        streams = [(a, z, signs(b.ids[a:z])) for i, (a, z) in enumerate(zip(begin, end, strict=True)) if nums[i] not in copies] if called else []
        for shard in np.unique(shards):
            automaton, first = ahocorasick.Automaton(ahocorasick.STORE_INTS), np.zeros(len(b.table), dtype=bool)
            for i in np.flatnonzero(shards == shard):
                word, pattern = called[i]
                automaton.add_word(pattern, len(pattern) // 2)
                first[word] = True
            automaton.make_automaton()
            begins = first[b.ids]
            for a, z, stream in streams:
                if begins[a:z].any():
                    for last, size in automaton.iter(stream):
                        at = a + last // 2 + 1
                        edge[at - size] += 1
                        edge[at] -= 1
        covered = (np.cumsum(edge)[:-1] > 0).tolist()
        rows = []
        for i, words in enumerate(b.words):
            if nums[i] not in copies:
                gone = covered[begin[i] : end[i]]
                kept = b" ".join([w for w, c in zip(words, gone, strict=True) if not c] if any(gone) else words)
                rows.append((nums[i], sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=False)], names=["num", "n_removed", "kept_sha256", "kept_text"][: 3 + with_text])

    schema = "num long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(run, schema)


def repeated_passages(docs: DataFrame, window: int = 35, with_text: bool = False, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row of docs.

    A word goes if a window of that many consecutive words covers it whose word sequence starts anywhere else too, in
    another row or in the same one. Words are maximal runs without ASCII white space, compared as bytes. Passages are confirmed
    first. Each window selects its phrase of 8 words with the least hash, equal windows the same one, so consecutive windows that select
    one place form a run. Runs are counted by a 128-bit hash of their words; one that stands twice recurs. Where a
    phrase heads several different runs, the windows of these are counted too; those of runs that stand once recur if they stand twice.
    Counts keep one sample place of what recurs and no other; neighbouring samples whose places are the same everywhere, by sums of hashes
    over them, are one passage, of which only the text is kept. Documents are dealt into blocks of about block_bytes. A block calls for the
    passages whose phrase one of its windows selects (of a phrase with over 32 passages, those with a run or window of the block);
    automata of these locate all occurrences in its documents, and the words that they cover go. Of rows with equal texts one is searched,
    counting for all, and all of them get its result.

    A null or empty text has no words; a text under window words loses none; repeated rows are copies of each other; a null
    doc_id stays. An empty table gives an empty one. Needs window >= 8. Further columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    scan = written(_scan(slim, window).withColumn("num", F.monotonically_increasing_id()), "phrase_scan")  # num, once written, stands for a row
    total, size = scan.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    copies = scan.groupBy(F.col("t1").alias("c1"), F.col("t2").alias("c2")).agg(F.count("*").alias("n"), F.min("num").alias("lead")).where("n > 1")
    copies = written(copies, "phrase_copies")
    hot = copies.where(F.col("n") > max(100, total // 100_000))  # 100,000 rows at most
    same = (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2"))
    keyed = scan.select("num", "doc_id", "t1", "t2", "n_words")
    cold = copies.join(F.broadcast(hot.select("c1", "c2")), ["c1", "c2"], "left_anti")
    rest = keyed.join(F.broadcast(hot.select("c1", "c2")), same, "left_anti")
    roles = keyed.join(F.broadcast(hot), same).unionByName(rest.join(cold, same)).select("num", "lead", "n")
    roles = written(roles, "phrase_roles")

    runs = scan.join(roles, "num", "left").where("lead is null or lead = num")
    runs = runs.select("num", F.coalesce("n", F.lit(1)).alias("n"), F.explode(F.arrays_zip("starts", "counts", "phrases", "keys")).alias("r"))
    runs = runs.select("num", "n", F.col("r.starts").alias("start"), F.col("r.counts").alias("count"), F.col("r.phrases").alias("phrase"), F.col("r.keys").alias("key"))
    known = _recurring(runs, "key", F.col("n"))
    several = known.groupBy("phrase").agg(F.count("*").alias("d")).where("d > 1").select("phrase", F.lit(True).alias("several"))
    known = written(known.join(several, "phrase", "left").where("times > 1 or several"), "phrase_known")

    texts_of = scan.select("num", "text")
    spans = known.where("several").groupBy("num").agg(F.collect_list(F.struct("start", "count", "phrase", "times")).alias("r"))
    spans = texts_of.join(spans, "num").select("num", "text", *(F.col(f"r.{c}").alias(a) for c, a in (("start", "starts"), ("count", "counts"), ("phrase", "phrases"), ("times", "times"))))
    windows = written(_windows(spans, window), "phrase_windows")
    single = _recurring(windows.withColumn("count", F.lit(1)), "hash", F.col("times"), F.min("times").alias("least")).where("times > 1 and least = 1")
    sample = ["num", "start", "count", "phrase", "fine", "times", "docs", "mix"]
    samples = known.where("times > 1").select(F.lit("run").alias("kind"), *sample).unionByName(single.select(F.lit("window").alias("kind"), *sample))
    places = _joined(samples, window).groupBy("num").agg(F.collect_list(F.struct("start", "size", "phrase", "fine")).alias("r"))
    places = texts_of.join(places, "num").select("text", *(F.col(f"r.{c}").alias(f"{c}s") for c in ("start", "size", "phrase", "fine")))
    bodies = written(_bodies(places).withColumn("id", F.monotonically_increasing_id()), "phrase_bodies")
    discard(known)

    blocks = max(1, -(-(size or 0) // block_bytes))
    block = F.pmod(F.xxhash64("num"), F.lit(blocks)).cast("int").alias("block")
    heads = bodies.select("id", "phrase", "fine")
    busy = written(heads.groupBy("phrase").agg(F.count("*").alias("d")).where(F.col("d") > BUSY).select("phrase"), "phrase_busy")
    calls = runs.select(block, "phrase").distinct().join(heads.join(busy, "phrase", "left_anti"), "phrase")
    calls = written(calls.select("block", "id"), "phrase_calls")  # in jobs of their own, so that their shuffles go before texts move
    finely = written(heads.join(busy, "phrase", "left_semi"), "phrase_finely")
    fine = written(_fine_calls(runs.select(block, "phrase", F.col("key").alias("fine")), windows.select(block, "phrase", F.col("hash").alias("fine")), finely), "phrase_fine_calls")
    discard(windows)
    out = roles.where("num <> lead").select(block, "num", F.lit(None).cast("binary").alias("body"))
    passages = calls.union(fine).join(bodies, "id").select("block", F.lit(None).cast("long").alias("num"), "body").union(out)
    cut = written(_located(scan.select("num", "text", block), passages, with_text), "phrase_cut")

    results = ["n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    of_copies = copies.join(cut, copies.lead == cut.num).select("c1", "c2", *results)
    far = keyed.join(F.broadcast(of_copies.join(F.broadcast(hot.select("c1", "c2")), ["c1", "c2"])), same).select("doc_id", "n_words", *results)
    rest = rest.join(of_copies.select("c1", "c2", *(F.col(x).alias(f"_{x}") for x in results)), same, "left").join(cut, "num", "left")
    return far.unionByName(rest.select("doc_id", "n_words", *(F.coalesce(f"_{x}", x).alias(x) for x in results)))
