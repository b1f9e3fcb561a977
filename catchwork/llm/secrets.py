"""Secrets: fixed patterns, and strings in sensitive contexts that do not compress against known identifiers."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from catchwork.frames import written
from catchwork.llm.words import slices

# The patterns of the base kinds with the least length of what they must hold, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more, as [0-9a-f]+ with a length test
KINDS = ("assign", "access", "hex", "novel")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# What makes a place sensitive for the novelty test.
SENSITIVE = re.compile(r"(?:passw|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer|credential|session)", re.IGNORECASE | re.ASCII)
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "session")
SHORT = 16
STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END ", re.ASCII)
PIECE = 512  # the longest pattern of an automaton
PAD = b"\n" * 64
LONG = 40  # from this length on, zstandard's entropy coding reaches random strings, so their own entropy bounds what they can cost
ALPHABETS = ((re.compile(r"[0-9A-F]+|[0-9a-f]+"), 4.0), (re.compile(r"[0-9A-Z]+|[0-9a-z]+"), 5.17), (re.compile(r".+", re.DOTALL), 6.0))  # bits a character


def _base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans."""
    low = text.lower()
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _candidates(text: str, base: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int]]:
    """Strings with letters and digits that begin within reach of a sensitive word, and bodies of private key blocks, that touch no base span.

    One sweep: a run of string characters gives one string at most. It begins at the run's start if a sensitive word ends shortly
    before, else behind the first sensitive word within the run that leaves a string.
    """
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    held = _union([(a, z) for a, _, z in base])
    blocks = []
    for m in PEM.finditer(text):
        a, z = m.start(1) + len(m[1]) - len(m[1].lstrip()), m.start(1) + len(m[1].rstrip())
        if z - a >= SHORT and _held_before(held, z) <= a:
            blocks.append((a, z))
    ends = [m.end() for m in SENSITIVE.finditer(text)]
    held = _union(held + blocks)
    out = list(blocks)
    for run in STRING.finditer(text) if ends else ():
        first, z = run.span()
        at = bisect.bisect_left(ends, first - reach)
        if at == len(ends) or ends[at] > z - SHORT:
            continue
        least = max(first, _held_before(held, z))
        a = first if ends[at] <= first and least == first else ends[i] if (i := bisect.bisect_left(ends, max(least, first + 1))) < len(ends) else z
        if z - a >= SHORT:
            s = text[a:z]
            if re.search("[0-9]", s) and re.search("[A-Za-z]", s):
                out.append((a, z))
    return sorted(out)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union as ascending spans apart from each other."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], z)
        else:
            out.append((a, z))
    return out


def _held_before(held: list[tuple[int, int]], z: int) -> int:
    """Where the last of the spans that begin before z ends."""
    i = bisect.bisect_left(held, (z, -1))
    return held[i - 1][1] if i else 0


def _blanked(text: str, spans: Iterable[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, z in spans:
        parts += [text[at:a], " " * (z - a)]
        at = z
    return "".join(parts) + text[at:]


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spaces for the spans and for every other copy of what they hold, so that no string is measured against itself. One automaton finds the copies; long spans go into it in even pieces, which keeps it flat."""
    if not spans:
        return text
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for a, z in spans:
        pieces = -(-(z - a) // PIECE)
        for i in range(pieces):
            piece = text[a + (z - a) * i // pieces : a + (z - a) * (i + 1) // pieces]
            automaton.add_word(piece, len(piece))
    automaton.make_automaton()
    text = _blanked(text, _union(spans))
    return _blanked(text, ((end - n + 1, end + 1) for end, n in automaton.iter_long(text)))


def _scan(docs: DataFrame, reach: int, beside: int) -> DataFrame:
    """Base spans of every row, and its candidates with the text around them."""
    schema = "doc_id long, text_key long, starts array<int>, kinds array<int>, ends array<int>, c_start array<int>, c_end array<int>, c_text array<string>, c_around array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans, cands, values, around = [], [], [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    base = _base(text)
                    cand = _candidates(text, base, reach)
                    spans.append(base)
                    cands.append(cand)
                    values.append([text[a:z] for a, z in cand])
                    rest = _masked(text, cand + [(a, z) for a, _, z in base]) if cand else text
                    around.append([re.sub(" +", " ", rest[max(0, a - beside) : a] + "\n" + rest[z : z + beside]) for a, z in cand])
                columns = [part.column("doc_id"), part.column("text_key")]
                columns += [pa.array([[s[i] for s in x] for x in spans], pa.list_(pa.int32())) for i in (0, 1, 2)]
                columns += [pa.array([[c[i] for c in x] for x in cands], pa.list_(pa.int32())) for i in (0, 1)]
                columns += [pa.array(x, pa.list_(pa.string())) for x in (values, around)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "starts", "kinds", "ends", "c_start", "c_end", "c_text", "c_around"])

    return docs.mapInArrow(run, schema)


def identifier_dictionary(scan: DataFrame, most_bytes: int = 32_768, longest: int = 256) -> bytes:
    """Identifier parts next to and in candidates by number of sources: the most frequent last, where zstandard finds them cheapest, as many as most_bytes hold.

    A part is a run of 3 to `longest` letters. A source is a different text, or a different candidate; a part in a mixed run of
    letters and digits counts once for each different run, and a part of one source only is not known yet. So copies of a text or of a token,
    also behind another name, never make its own parts known.
    """
    parts = lambda c: F.explode(F.array_distinct(F.expr(f"regexp_extract_all({c}, '[A-Za-z]{{3,}}', 0)"))).alias("part")
    near = scan.where("size(c_around) > 0").select(F.concat_ws(" ", "c_around").alias("around"), F.lit("text").alias("kind"), F.col("text_key").cast("string").alias("source"))
    near = near.select(parts("around"), "kind", "source")
    runs = scan.select(F.explode("c_text").alias("value")).distinct().select("value", F.explode(F.expr("regexp_extract_all(value, '[A-Za-z0-9+/]+', 0)")).alias("run"))
    runs = runs.select(parts("run"), F.lit("run").alias("kind"), F.expr("md5(if(run rlike '^[A-Za-z]+$', value, run))").alias("source"))
    every = near.union(runs).where(F.length("part") <= longest).distinct().groupBy("part").count().where("count > 1")
    top = every.orderBy(F.desc("count"), "part").limit(most_bytes // 4).collect()  # a part and a space are 4 bytes or more
    kept, size = [], 0
    for r in top:
        size += len(r.part) + 1
        if size <= most_bytes:
            kept.append(r.part.encode())
    return b" ".join(reversed(kept))


def _marginal(around: bytes, value: bytes, squeeze: zstandard.ZstdCompressor) -> int:
    """Compressed bytes that value adds to what surrounds it. zstandard matches nothing in the last 8 bytes of a block and stores one that hardly shrinks, so both texts begin and end in PAD."""
    return len(squeeze.compress(PAD + around + b"\n" + value + PAD)) - len(squeeze.compress(PAD + around + b"\n" + PAD))


def _needed(value: str, novelty: float) -> float:
    """Marginal bytes that make value novel: novelty bytes a character, but for hex and long ones no more than 0.9 of what random characters of its alphabet hold."""
    bits = next(b for kind, b in ALPHABETS if kind.fullmatch(value))
    return len(value) * (min(novelty, 0.9 * bits / 8) if bits == 4 or len(value) >= LONG else novelty)


def find_secrets(docs: DataFrame, novelty: float = 0.8, reach: int = 48, beside: int = 96, dictionary_bytes: int = 32_768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_assign, n_access, n_hex, n_novel, base_sha256, spans, cut array<struct<start, end>>) for every row of docs.

    Base spans are the leftmost matches of each kind that do not overlap others of the kind. The method adds `novel` ones: a
    string of 16 or more characters with letters and digits, within `reach` characters after a sensitive word, whose marginal
    zstandard size, primed with the identifier dictionary (dictionary_bytes at most) and the `beside` characters on either side of it, is at least `novelty` bytes a character, or
    0.9 of its alphabet's entropy for hex and for strings of 40 or more. Other strings and copies of it are blanked in that text. The
    body of a private key block is one string.
    spans lists kind:start:end by start, then kind, comma-joined, in code points; cut is their union. text_key is
    xxhash64 of the text. A null text is an empty one; ids may be null or repeat; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scan = written(_scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")), reach, beside), "secret_scan")
    primer = scan.sparkSession.sparkContext.broadcast(identifier_dictionary(scan, dictionary_bytes))  # dictionary_bytes bounds it
    schema = "doc_id long, text_key long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, cut array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(primer.value, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer.value) >= 8 else None
        squeeze = zstandard.ZstdCompressor(level=19, dict_data=known, write_checksum=False, write_content_size=False)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                base = list(zip(r["starts"], r["kinds"], r["ends"], strict=True))
                every = list(base)
                for a, z, value, around in zip(r["c_start"], r["c_end"], r["c_text"], r["c_around"], strict=True):
                    if _marginal(around.encode(), value.encode(), squeeze) >= _needed(value, novelty):
                        every.append((a, 3, z))
                every.sort()
                cut = _union([(a, z) for a, _, z in every])
                listed = [",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in x) for x in (base, every)]
                n = [sum(k == i for _, k, _ in every) for i in range(4)]
                out.append((r["doc_id"], r["text_key"], *n, hashlib.sha256(listed[0].encode()).hexdigest(), listed[1], [{"start": a, "end": z} for a, z in cut]))
            types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            names = ["doc_id", "text_key", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "cut"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    return scan.mapInArrow(run, schema)


@F.arrow_udf(StringType())
def _replaced(text: pa.Array, cut: pa.Array, mark: pa.Array) -> pa.Array:
    """Each text with mark for its cuts, assembled in one pass; null where there is no cut."""
    out = []
    for t, spans, m in zip(text.to_pylist(), cut.to_pylist(), mark.to_pylist(), strict=True):
        if t is None or spans is None:
            out.append(None)
            continue
        parts, at = [], 0
        for s in spans:
            parts += [t[at : s["start"]], m]
            at = s["end"]
        out.append("".join(parts) + t[at:])
    return pa.array(out, pa.string())


def redacted(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every found span replaced by mark; n_chars, where there is such a column, follows the new text. All rows and columns stay; other columns may have any name but those that begin with `_secret_`."""
    found = find_secrets(docs, **options).where("size(cut) > 0").select(F.col("doc_id").alias("_secret_id"), F.col("text_key").alias("_secret_key"), "cut")
    found = written(found.dropDuplicates(["_secret_id", "_secret_key"]).withColumnRenamed("cut", "_secret_cut"), "secret_cuts")
    keyed = docs.withColumn("_secret_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = keyed.join(found, keyed.doc_id.cast("long").eqNullSafe(found._secret_id) & (keyed._secret_text == found._secret_key), "left")
    cut = F.col("_secret_cut").isNotNull()
    out = both.withColumn("_secret_new", _replaced(F.when(cut, F.col("text")), "_secret_cut", F.lit(mark))).withColumn("text", F.coalesce("_secret_new", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
