"""Token pairs of two tokenizers, aligned by bytes and counted over the corpus through inverted document bitmaps."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catchwork.frames import written
from catchwork.llm.words import slices

FOLDER = "/opt/tokenizers"
ID_BITS, SLOT_BITS = 20, 16  # of a token id, and of a document's place in its block
BLOCK_DOCS, BLOCK_BYTES = 1 << 12, 8 << 20
KNOWN_PIECES, KNOWN_BYTES = 300_000, 32 << 20  # pieces that a task remembers
PAIRS_AT_ONCE = 1 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece of the second vocabulary."""
    one = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()


def ragged(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places begins[i], begins[i] + 1 ... of each i, lengths[i] of them, one after another."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


class Aligner:
    """Aligns pieces of texts once each: both tokenizers, and what is known of the pieces seen.

    A piece begins at a single space between two characters that are not white space, or at the text's start. Both tokenizers begin a token
    there whatever stands around it, so the tokens of a text are those of its pieces, and no group spans two pieces.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        plain = {t["id"]: t["content"].encode() for t in json.loads(self.a.to_str())["added_tokens"]}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = plain[i] if i in plain else bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [piece_bytes(p) for p in pieces]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError(f"token ids must be below 2**{ID_BITS}")
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)  # a token could then span two pieces of a text
        self.text_a = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
        self.text_b = [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_bytes = 0
        self.texts: list[str] = []
        none = np.zeros(0, dtype=np.int64)
        self.facts = np.zeros((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, n_links, and whether the bytes differ
        self.begin, self.length, self.pairs, self.times = none, none, none, none

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text, each without the space before it."""
        return [text] if self.whole else CUT.split(text)

    def number(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the pieces of each text; new ones are aligned first."""
        if len(self.known) > KNOWN_PIECES or self.known_bytes > KNOWN_BYTES:
            self.forget()
        fresh = [p for p in dict.fromkeys(itertools.chain.from_iterable(texts)) if p not in self.known]
        if fresh:
            for p in fresh:
                self.known[p] = len(self.known)
            self.known_bytes += sum(map(len, fresh))
            self._align(fresh)
        return [np.fromiter(map(self.known.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]

    def _align(self, pieces: list[str]) -> None:
        spaced = [" " + p for p in pieces]
        ids = [[e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)], self.b.encode(pieces, num_threads=1)]
        bad = self._differ([p.encode() for p in spaced], ids)
        ends, flat = [], []
        for side, sizes in zip(ids, (self.size_a, self.size_b), strict=True):
            if bad.any():
                side[:] = [[] if b else s for b, s in zip(bad.tolist(), side, strict=True)]
            flat.append(_flat(side))
            ends.append(np.cumsum(sizes[flat[-1]]))
        common = np.intersect1d(*ends)  # a token without bytes would be the end of no group of its own
        group = [np.searchsorted(common, e) for e in ends]
        n = [np.bincount(g, minlength=len(common)) for g in group]
        counts = [np.array([len(s) for s in side], dtype=np.int64) for side in ids]
        upto = np.concatenate([[0], np.cumsum(counts[0])])
        last = np.concatenate([[-1], group[0]])[upto]  # the group at the end of each piece
        n_groups = np.diff(last)
        links = np.concatenate([[0], np.cumsum(n[0] * n[1])])
        n_links = np.diff(links[last + 1])
        self.facts = np.concatenate([self.facts, np.stack([*counts, n_groups, n_links, bad.astype(np.int64)], axis=1)])
        self.texts += self._texts(flat, group, n, counts)
        pairs, times, lengths = self._pairs(flat, group, last[1:], len(pieces))
        self.begin = np.concatenate([self.begin, len(self.pairs) + np.cumsum(lengths) - lengths])
        self.length, self.pairs, self.times = (np.concatenate(x) for x in ((self.length, lengths), (self.pairs, pairs), (self.times, times)))

    def _differ(self, bodies: list[bytes], ids: list[list[list[int]]]) -> np.ndarray:
        """Whether the tokens of each piece join to other bytes than the piece has. All pieces are compared at once, and one by one only where that tells of a difference."""
        lengths, whole = np.array([len(b) for b in bodies], dtype=np.int64), b"".join(bodies)
        alike = True
        for side, tokens, sizes in zip(ids, (self.bytes_a, self.bytes_b), (self.size_a, self.size_b), strict=True):
            flat = _flat(side)
            upto = np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum([len(s) for s in side])])]
            alike = alike and np.array_equal(np.diff(upto), lengths) and b"".join(map(tokens.__getitem__, flat.tolist())) == whole
        if alike:
            return np.zeros(len(bodies), dtype=bool)
        joined = ([b"".join([tokens[i] for i in s]) for s in side] for side, tokens in zip(ids, (self.bytes_a, self.bytes_b), strict=True))
        return np.array([x != body or y != body for body, x, y in zip(bodies, *joined, strict=True)])

    def _texts(self, flat: list[np.ndarray], group: list[np.ndarray], n: list[np.ndarray], counts: list[np.ndarray]) -> list[str]:
        """Each piece's groups as text, with a semicolon at the end."""
        upto = [np.cumsum(x) for x in n]
        words = np.empty(len(flat[0]) + len(flat[1]), dtype=object)
        for side, names in ((0, self.text_a), (1, self.text_b)):
            at = np.arange(len(flat[side]))
            ends = (at + 1 == upto[side][group[side]]).astype(np.int64)
            other = upto[1][group[0]] - n[1][group[0]] if side == 0 else upto[0][group[1]]
            words[at + other] = list(map(names.__getitem__, (2 * flat[side] + ends).tolist()))
        cuts = np.concatenate([[0], np.cumsum(counts[0] + counts[1])]).tolist()
        words = words.tolist()
        return ["".join(words[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def _pairs(self, flat: list[np.ndarray], group: list[np.ndarray], last: np.ndarray, n_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, links) of each piece, one piece after another, and how many pairs each has. Equal tokens of a group are counted before they are paired."""
        sides = []
        for f, g in zip(flat, group, strict=True):
            keys, times = summed(g << ID_BITS | f, np.ones(len(f), dtype=np.int64))
            own = keys >> ID_BITS
            sides.append((own, keys & (1 << ID_BITS) - 1, times))
        (ga, ida, ta), (gb, idb, tb) = sides
        first, width = np.searchsorted(gb, ga), np.searchsorted(gb, ga, side="right") - np.searchsorted(gb, ga)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        portion = np.cumsum(width) // PAIRS_AT_ONCE
        for start, stop in itertools.pairwise([0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(ga)]):
            w, at = width[start:stop], ragged(first[start:stop], width[start:stop])
            piece = np.searchsorted(last, np.repeat(ga[start:stop], w))
            pair = np.repeat(ida[start:stop], w) << ID_BITS | idb[at]
            out += _by_piece(piece, pair, np.repeat(ta[start:stop], w) * tb[at])
        piece, pair, times = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in range(3))
        joined = _by_piece(piece, pair, times)
        piece, pair, times = joined[0] if joined else (piece, pair, times)
        return pair, times, np.bincount(piece, minlength=n_pieces)


def _flat(side: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(side), dtype=np.int64, count=sum(map(len, side)))


def _by_piece(piece: np.ndarray, pair: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links added up for each piece and pair, in this order."""
    if not len(piece):
        return []
    order = np.lexsort((pair, piece))
    piece, pair, times = piece[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (pair[1:] != pair[:-1])]))
    return [(piece[first], pair[first], np.add.reduceat(times, first))]


def bitmaps(keys: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """The different pairs of ascending keys pair << SLOT_BITS | slot, each with its document bitmap: the 64-bit words that are not zero, by number."""
    words = keys >> 6
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (keys & 63).astype(np.uint64), first)
    words = words[first]
    pairs = words >> SLOT_BITS - 6
    new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    cuts = pa.array(np.append(new, len(pairs)), pa.int32())
    number = (words & (1 << SLOT_BITS - 6) - 1).astype(np.int16)
    return pairs[new], pa.ListArray.from_arrays(cuts, pa.array(number)), pa.ListArray.from_arrays(cuts, pa.array(bits.view(np.int64)))


DOC_FIELDS = [("slot", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
PAIR_FIELDS = [("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("words", pa.list_(pa.int16())), ("bits", pa.list_(pa.int64()))]
FIELDS = pa.schema([("is_doc", pa.bool_()), ("block", pa.int64()), *DOC_FIELDS, *PAIR_FIELDS])
DDL = "is_doc boolean, block long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, plane int, words array<smallint>, bits array<long>"


def _batch(is_doc: bool, block: int, columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
    given = {"is_doc": pa.array(np.full(rows, is_doc)), "block": pa.array(np.full(rows, block))} | columns
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(rows, f.type) for f in FIELDS], schema=FIELDS)


class _Postings:
    """The postings of one block of documents."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.bytes, self.parts = number, 0, 0, []

    def batches(self) -> Iterator[pa.RecordBatch]:
        """For each pair the bitmap of its documents (plane -1), and as plane p the documents whose links less one have bit p set."""
        keys, times = summed(*(np.concatenate([x[i] for x in self.parts]) for i in (0, 1))) if self.parts else (np.zeros(0, dtype=np.int64),) * 2
        for plane in range(-1, int(times.max(initial=1) - 1).bit_length()):
            on = keys if plane < 0 else keys[times - 1 >> plane & 1 == 1]
            if len(on):
                pairs, words, bits = bitmaps(on)
                columns = {"a": pa.array(pairs >> ID_BITS, pa.int32()), "b": pa.array(pairs & (1 << ID_BITS) - 1, pa.int32()), "plane": pa.array(np.full(len(pairs), plane), pa.int32()), "words": words, "bits": bits}
                yield _batch(False, self.number, columns, len(pairs))

    def add(self, aligner: Aligner, part: pa.RecordBatch) -> pa.RecordBatch:
        """Takes a slice of documents in and gives their rows."""
        texts = part.column("text").to_pylist()
        numbers = aligner.number([aligner.pieces(t) if t else [] for t in texts])
        sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *numbers])
        doc = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(doc[aligner.facts[flat, 4] > 0], minlength=len(texts)) > 0
        flat, doc = flat[~bad[doc]], doc[~bad[doc]]
        upto = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(aligner.facts[flat, :4], axis=0)])
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        facts = np.diff(upto[ends], axis=0)
        own = [(aligner.texts[i] for i in flat[x:y].tolist()) for x, y in itertools.pairwise(ends.tolist())]
        hashes = [hashlib.sha256("".join(x)[:-1].encode()).hexdigest() if n else "" for n, x in zip(facts[:, 2].tolist(), own, strict=True)]
        length = aligner.length[flat]
        at = ragged(aligner.begin[flat], length)
        self.parts.append(summed(aligner.pairs[at] << SLOT_BITS | np.repeat(doc + self.docs, length), aligner.times[at]))
        columns = {"slot": pa.array(self.docs + np.arange(len(texts)), pa.int32()), "doc_id": part.column("doc_id"), "groups_sha256": pa.array(hashes)}
        columns |= {c: pa.array(facts[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        self.docs += len(texts)
        self.bytes += part.column("text").nbytes
        return _batch(True, self.number, columns, len(texts))


def swept(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents and of postings, from one sweep over (doc_id, text). A block is at most BLOCK_DOCS documents, or BLOCK_BYTES and one more slice, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        blocks = itertools.count(TaskContext.get().partitionId() << 32)
        block = _Postings(next(blocks))
        for batch in batches:
            for part in slices(batch, "text"):
                for start in range(0, part.num_rows, BLOCK_DOCS):
                    few = part.slice(start, BLOCK_DOCS)
                    if block.docs + few.num_rows > BLOCK_DOCS or block.bytes > BLOCK_BYTES:
                        yield from block.batches()
                        block = _Postings(next(blocks))
                    yield block.add(aligner, few)
        yield from block.batches()

    return docs.mapInArrow(run, DDL)


def _returned(docs: pa.Table, postings: pa.Table) -> pa.Table:
    """The rows of one block's documents with what its postings return: links times documents, and links of a best pair."""
    n = 1 + max(docs.column("slot").to_pylist(), default=-1)
    total, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for batch in postings.to_batches(max_chunksize=4096):
        words, bits = batch.column("words"), batch.column("bits")
        row = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
        on = np.unpackbits(bits.flatten().to_numpy(zero_copy_only=False).view(np.uint8), bitorder="little").reshape(-1, 64)
        at, bit = np.nonzero(on)
        slot = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[at] * 64 + bit
        links = np.int64(1) << np.maximum(batch.column("plane").to_numpy(zero_copy_only=False).astype(np.int64), 0)
        weight = links * batch.column("n_docs").to_numpy(zero_copy_only=False)
        np.add.at(total, slot, weight[row[at]])
        np.add.at(best, slot, (links * batch.column("is_best").to_numpy(zero_copy_only=False).astype(np.int64))[row[at]])
    slots = docs.column("slot").to_numpy()
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(best[slots])).append_column("count_sum", pa.array(total[slots]))


def token_alignment(docs: DataFrame, path_a: str = f"{FOLDER}/byte_bpe_50k.json", path_b: str = f"{FOLDER}/piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row of docs.

    A space and the text are encoded by a byte-level vocabulary (A, a file of tokenizers) and a piece vocabulary (B, a file of sentencepiece,
    which adds the space). Byte offsets at which tokens of both end cut them into groups; each A token is linked with each B token of its group,
    occurrence by occurrence. A pair's count is the number of rows that hold it linked, n_best the links whose count is the highest of their A id
    in the whole table (ties included), count_sum the sum of counts over links, groups_sha256 the hash of the groups as `a1,a2|b1;a3|b2,b3`.

    One sweep aligns every text and inverts it: blocks of documents get a compressed bitmap for each pair, slices OR-merged, and bit planes of the
    number of links beyond one. Blocks hold different documents, so popcounts of a pair's bitmaps add up to its count. Each
    posting then takes its pair's count back to the documents of its block. Pairs with postings in very many blocks get it by a broadcast join.

    Texts that are null, empty, or whose joined token bytes differ from space and text (the vocabulary normalises them) have no tokens: zeros and ''. Equal or
    repeated rows count each; a null doc_id stays. An empty table gives an empty one. Further columns of docs are not read. Very long texts are
    encoded by pieces between single spaces; a text is held whole in its task.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(swept(slim, path_a, path_b), "alignment_sweep")
    postings = found.where("not is_doc").select("block", "a", "b", "plane", "words", "bits")
    popcount = F.aggregate("bits", F.lit(0), lambda n, w: n + F.bit_count(w))
    counts = postings.where("plane = -1").groupBy("a", "b").agg(F.sum(popcount).alias("n_docs"), F.count("*").alias("n_blocks"))
    counts = written(counts, "alignment_counts")
    top = counts.groupBy(F.col("a").alias("of")).agg(F.max("n_docs").alias("most"))
    scores = counts.join(top, counts.a == top.of).select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best"), "n_blocks")
    scores = written(scores, "alignment_scores")
    total = scores.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    hot = F.col("n_blocks") > max(100, total // 100_000)  # 100,000 rows at most
    few, rest = F.broadcast(scores.where(hot).drop("n_blocks")), scores.where(~hot).drop("n_blocks")
    scored = postings.join(few, ["a", "b"]).unionByName(postings.join(rest, ["a", "b"])).select("block", "plane", "words", "bits", "n_docs", "is_best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    rows = found.where("is_doc").select(F.col("block").alias("own"), *(name for name, _ in DOC_FIELDS))
    return rows.groupBy("own").cogroup(scored.groupBy("block")).applyInArrow(_returned, schema)
