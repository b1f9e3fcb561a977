"""WARC archives written and read by tasks, and an external merge of their capture indexes."""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwork.frames import new_path, prefix_sum, written

INDEX = "url_key string, captured long, page_id long, archive string, record int, byte_at long, byte_len long, run_pos int"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then the path and query: sorts captures of a site together. Null gives an empty host."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest)


START, LAST = 1704067200, 253402300799  # 2024-01-01, and the last second of the year 9999


def _date(seconds: int) -> str:
    """Capture times that no four-digit year since 1970 can state are folded into the 2**32 seconds after 2024-01-01; the order of captures keeps the full number."""
    if not 0 <= seconds <= LAST:
        seconds = START + seconds % (1 << 32)
    return dt.datetime.fromtimestamp(seconds, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record(row: dict[str, Any]) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, whose Content-Length is that of the full payload, and not the payload."""
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    payload = (row["html"] or "").encode()
    revisit = row["revisit"]
    block = HTTP % len(payload) + (b"" if revisit else payload)
    page = "" if row["page_id"] is None else row["page_id"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_date(row['captured'])}"]
    head += [f"WARC-Target-URI: {''.join((row['url'] or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {page}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes archives of about archive_bytes to folder and returns their index, one sorted run for each archive.

    pages has page_id, url, html, sha1, revisit, refers_to, captured, url_key. A task that is run again writes new files; the
    index, committed by Spark, names only those of the attempt that counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        number, out, at, rows = 0, None, 0, []

        def closed() -> pa.RecordBatch:
            out.close()
            rows.sort(key=lambda r: (r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"], r["record"]))
            for i, r in enumerate(rows):
                r["run_pos"] = i
            schema = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("record", pa.int32()), ("byte_at", pa.int64()), ("byte_len", pa.int64()), ("run_pos", pa.int32())])
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if out is None:
                    name, at, rows = f"{stem}-{number:05d}.warc.gz", 0, []
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = _record(row)
                out.write(member)
                rows.append({k: row[k] for k in ("url_key", "captured", "page_id")} | {"archive": name, "record": len(rows), "byte_at": at, "byte_len": len(member)})
                at += len(member)
                if at >= archive_bytes:
                    yield closed()
                    number, out = number + 1, None
        if out is not None:
            yield closed()

    return written(pages.mapInArrow(run, INDEX), "warc_runs")


def _records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive, one at a time."""
    reader = gzip.GzipFile(fileobj=stream)
    while line := reader.readline():
        if line == b"\r\n":
            continue
        header = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            header[name.lower()] = value.strip()
        yield header, reader.read(int(header["content-length"]))


def read_archives(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One written row for each record of the archives that index names, dealt by their names over as many tasks: archive, record, what its headers say and, if wanted, its payload. The payload of each response must have the digest that its header states."""
    schema = "archive string, record int, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        names = ["archive", "record", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for n, (header, block) in enumerate(_records(stream)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
                        digest = header["warc-payload-digest"].removeprefix("sha1:")
                        kind = header["warc-type"]
                        if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{archive}, record {n}: the payload isn't what its header states")
                        refers = header.get("x-refers-to-page-id")
                        page = header["x-page-id"]
                        rows.append((archive, n, int(page) if page else None, length, digest, kind, int(refers) if refers else None, header["warc-target-uri"], payload.decode() if with_payload else None))
                        held += len(payload) if with_payload else 256
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    archives = index.select("archive").distinct()
    read = archives.repartition(max(1, archives.count()), "archive").mapInArrow(run, schema)
    return written(read if with_payload else read.drop("payload"), "warc_read")


class LoserTree:
    """Merges sorted runs of (key, row): each inner node keeps the loser of its match, so the next winner costs one walk to the root."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, i: int) -> None:
        """Run i meets the losers on its way up; at the first empty node it waits."""
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] == -1:
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while (head := self.heads[i := self.losers[0]]) is not None:
            yield head[1]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


KEYS = ["url_key", "captured", "page", "archive", "record"]
_MERGED = pa.schema([("run", pa.int64()), *((f, pa.string() if f in ("url_key", "archive") else pa.int32() if f == "record" else pa.int64()) for f in KEYS), ("part", pa.int32()), ("pos", pa.int64())])


def _merged_pass(runs: DataFrame, groups: int, parts: int) -> DataFrame:
    """One pass: the runs of each of so many groups become one run, whose order is part, pos. A task merges the slices that a range of keys cuts from a group's runs."""

    def merged(slices: dict[int, pa.Table], group: int, part: int) -> pa.RecordBatch:
        columns = {r: [t.column(c).to_pylist() for c in KEYS] for r, t in slices.items()}
        order = list(LoserTree([zip(zip(*columns[r], strict=True), zip(repeat(r), range(slices[r].num_rows)), strict=False) for r in sorted(columns)]))
        picked = [[columns[r][k][i] for r, i in order] for k in range(len(KEYS))]
        values = [[group] * len(order), *picked, [part] * len(order), range(len(order))]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _MERGED, strict=True)], schema=_MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            of = table.column("run").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            return merged({int(of[a]): table.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)}, table.column("grp")[0].as_py(), part)

        for batch in batches:  # by group, run and order in the run
            group = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(a, z - a)
                if held and held[0].column("grp")[0] != piece.column("grp")[0]:
                    yield closed()
                    held = []
                if z > a:
                    held.append(piece)
        if held:
            yield closed()

    dealt = runs.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups))).repartitionByRange(parts, "grp", *KEYS).sortWithinPartitions("grp", "run", "part", "pos")
    return dealt.mapInArrow(run, "run long, url_key string, captured long, page long, archive string, record int, part int, pos long")


def merge_index(index: DataFrame, rows_a_part: int = 100_000, width: int = 64) -> DataFrame:
    """(archive, record, url_key, captured, merge_part, merge_pos) of index; merge_pos is the place in the order of url_key, captured, page_id, archive, record over all runs.

    Passes merge about `width` runs into one, from files to files, until one run is left: each archive's sorted index is a run of the first
    pass. In a pass the runs of a group are cut at common keys into ranges of about rows_a_part rows, and a task merges its slices of
    these runs with a loser tree, so tasks stay bounded and slices have many rows however many runs there are. The range keys
    include the archive and record, so a URL with a third of all captures spans many tasks. A null page_id is below all others.
    """
    n = index.count()
    parts = max(8, n // rows_a_part + 1)
    page = F.coalesce("page_id", F.lit(-(1 << 63)).cast("long")).alias("page")
    runs = index.select(F.xxhash64("archive").alias("run"), "url_key", "captured", page, "archive", "record", F.lit(0).alias("part"), F.col("run_pos").cast("long").alias("pos"))
    left = index.select("archive").distinct().count()
    while True:
        groups = -(-left // width) or 1
        runs = written(_merged_pass(runs, groups, parts), "warc_merged")
        if groups == 1:
            break
        left = groups
    step = (1 << 60) // (runs.agg(F.max("part")).first()[0] + 1) if n else 1  # parts, spread over the range that prefix_sum cuts
    counts = runs.groupBy(F.col("part").alias("merge_part")).agg(F.count("*").alias("rows")).withColumn("all", F.lit(0)).withColumn("at", F.col("merge_part").cast("long") * step)
    ends = prefix_sum(counts, ["all"], "at", [], F.col("rows"), "upto", parts)
    base = written(ends.select("merge_part", (F.col("upto") - F.col("rows")).alias("before")), "warc_bases")
    return runs.withColumnRenamed("part", "merge_part").join(base, "merge_part").select("archive", "record", "url_key", "captured", "merge_part", (F.col("before") + F.col("pos")).alias("merge_pos"))


def archived_pages(pages: DataFrame, least_bytes: int = 0, captured: Column | None = None, folder: str | None = None) -> DataFrame:
    """Writes every row of pages (page_id, url, html) as a WARC record, reads the archives back and merges their indexes.

    Of records with equal payloads of least_bytes or more, that with the largest page_id is the response and the others revisit it
    (further rows with that same page_id are responses too); smaller ones are all responses. A null html is an empty payload;
    a null url is an empty one; a null page_id is below all others. captured is the capture time in epoch seconds, by default page_id
    seconds after 2024-01-01 (page_id itself where that sum leaves 64 bits, 2024-01-01 where it is null); a null captured is 0. An empty table gives an empty one. Gives page_id, payload_bytes, payload_digest, record_type,
    refers_to, url_key, captured, archive, record and merge_pos, the place of the capture in the merged index.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    own = F.col("page_id").cast("long")
    when = F.coalesce(captured.cast("long"), F.lit(0)) if captured is not None else F.coalesce(F.try_add(F.lit(START).cast("long"), own), own, F.lit(START).cast("long"))
    body = F.coalesce("html", F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("sha1"), F.octet_length(body).alias("size"), when.alias("captured"), url_key(F.col("url")).alias("url_key"))
    same = slim.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("newest")).where("n > 1")
    same = written(same.select(F.col("sha1").alias("same_sha1"), F.col("size").alias("same_size"), "newest"), "warc_same")
    revisit = F.coalesce(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.lit(False))
    rows = slim.join(same, (slim.sha1 == same.same_sha1) & (slim.size == same.same_size), "left")
    rows = rows.select("page_id", "url", "html", "sha1", "captured", "url_key", revisit.alias("revisit"), F.when(revisit, F.col("newest")).alias("refers_to"))
    index = write_archives(rows, folder)
    read = read_archives(index, folder, with_payload=False).drop("url")
    merged = merge_index(index)
    return read.join(merged, ["archive", "record"])
