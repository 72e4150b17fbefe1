"""WARC archives of web pages, and their capture index by an external merge.

Pages are written as WARC/1.1 records, each a gzip member of its own, to one file per task. Of pages with equal
payloads of at least LEAST_REVISIT bytes the one with the largest page_id is a response and the others are revisits
that refer to it, which carry no payload; smaller payloads are always responses.

Captures go to index runs of at most RUN_ROWS, each sorted by URL key and timestamp and written to a file of its own
in blocks of BLOCK captures; a table of the blocks has the place, first and last key of each. The runs are merged
externally: blocks are dealt to ranges of the key, and in each range a loser tree merges the runs' parts, of which it
reads one block at a time, into one ordered list; ranges follow each other, so the capture histories are ordered as a
whole. Of more than FAN_IN runs, groups are first merged into longer runs, in as many passes as it takes. A task holds
a block of each of its runs and never a range. Archives are written under a name of the attempt and renamed when
complete, and run files have names of their attempt, so that a repeated task leaves whole files.

Paths are URIs that pyarrow's file systems open, or plain paths. Defined results: null html is an empty payload; a
null URL has an empty URL key; pages with one page_id are records of their own, and if it is the largest of those with
an equal payload, all of them are responses; a null page_id is written as ``none`` and read as null; an empty table gives no files and an empty
index; other columns are not read.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace
from .hot_keys import join_aggregate
from .words import slices

LEAST_REVISIT, LEVEL, READ_BLOCK, SLICE_BYTES, EPOCH = 1000, 1, 32 << 20, 4 << 20, datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
BLOCK, RUN_ROWS, FAN_IN, SAMPLE = 256, 200_000, 512, 20
CAPTURE = "url_key string, timestamp string, url string, page_id long, record_type string, file string, offset long, length long"
CAPTURES = pa.schema([(f.split(" ")[0], pa.int64() if f.endswith("long") else pa.string()) for f in CAPTURE.split(", ")])
BLOCKS = "path string, offset long, size long, first binary, last binary"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str) -> str:
    """The sort-friendly form of a URL: host parts reversed, then path and query, lower-cased, without fragment."""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


def _record(page: dict) -> tuple[bytes, str]:
    """One record, and its timestamp: the page's id in seconds from a fixed day, as pages have no time of their own."""
    body = (page["html"] or "").encode()
    stamp = EPOCH + datetime.timedelta(seconds=(page["page_id"] or 0) % (1 << 31))
    revisit = page["refers_to"] is not None
    digest = base64.b32encode(bytes.fromhex(page["digest"])).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if revisit else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page['page_id'] is None else page['page_id']}>",
        f"WARC-Date: {stamp:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {''.join((page['url'] or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{page['refers_to']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", f"{stamp:%Y%m%d%H%M%S}"


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record; the payload's length and digest, checked where the payload is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def number(name: str) -> int | None:
        text = fields.get(name, "<urn:page:none>")[len("<urn:page:") : -1]
        return None if text == "none" else int(text)

    return {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "url": fields["WARC-Target-URI"]}


def with_decisions(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which pages revisit which.

    Pages with equal large payloads are counted by partial aggregates; the join brings each page its digest's winner,
    and can split the pages of a payload that a great many have.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).alias("_size"))
    large = rows.filter(F.col("_size") >= LEAST_REVISIT)
    winners = large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").select("digest", "winner")
    joined = join_aggregate(rows, winners, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("winner")), F.col("winner")).alias("refers_to"))


def _order(capture: tuple) -> bytes:
    """The order of captures as bytes: URL key by UTF-8, timestamp, page_id with null first, place."""
    page = b"\0" if capture[3] is None else b"\1" + (capture[3] + (1 << 63)).to_bytes(8)
    return capture[0].encode().replace(b"\0", b"\0\xff") + b"\0\0" + capture[1].encode() + page + capture[5].encode() + b"\0" + capture[6].to_bytes(8)


def _write_run(folder: str, captures: Iterable[tuple[bytes, tuple]], size: int) -> Iterator[tuple]:
    """Write ordered captures to a run file of its own; its blocks, as rows of BLOCKS."""
    files, base = _open_folder(folder)
    files.create_dir(base, recursive=True)
    name, offset, captures = f"{uuid.uuid4().hex}.run", 0, iter(captures)
    with files.open_output_stream(f"{base}/{name}") as file:
        while block := list(islice(captures, size)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, CAPTURES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(x for _, x in block), strict=True), CAPTURES, strict=True)], schema=CAPTURES))
            content = sink.getvalue()
            file.write(content)
            yield f"{folder}/{name}", offset, content.size, block[0][0], block[-1][0]
            offset += content.size


def _read_run(path: str, blocks: list[tuple[int, int]]) -> Iterator[tuple[bytes, tuple]]:
    """The captures of some blocks of a run, each with its key, a block in memory at a time."""
    files, name = _open_folder(path)
    with files.open_input_file(name) as file:
        for offset, size in blocks:
            batch = pa.ipc.open_stream(file.read_at(size, offset)).read_next_batch()
            for capture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _order(capture), capture


def _tables(rows: Iterable[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


_BLOCKS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])


def runs_folder(folder: str) -> str:
    """Where the index runs of the archives in ``folder`` are; they are of no use once they are merged."""
    return folder.rstrip("/") + ".runs"


def write_archives(pages: DataFrame, folder: str, run_rows: int = RUN_ROWS, block: int = BLOCK) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder`` and their index runs beside it; the runs' BLOCKS are the result.

    The write happens when the result is computed, once for each attempt at a task: save it before it is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        files, base = _open_folder(folder)
        files.create_dir(base, recursive=True)
        name, draft = f"pages-{number:06d}.warc.gz", f"{base}/.draft-{number:06d}-{uuid.uuid4().hex}"

        def captures() -> Iterator[tuple[bytes, tuple]]:
            offset, sink = 0, None
            for page in (page for batch in batches for part in slices(batch, "html", SLICE_BYTES) for page in part.to_pylist()):
                raw, stamp = _record(page)
                member = gzip.compress(raw, LEVEL, mtime=0)
                sink = sink or files.open_output_stream(draft)
                sink.write(member)
                url = page["url"] or ""
                capture = (url_key(url), stamp, url, page["page_id"], "response" if page["refers_to"] is None else "revisit", name, offset, len(member))
                yield _order(capture), capture
                offset += len(member)
            if sink:
                sink.close()
                files.move(draft, f"{base}/{name}")

        written = captures()
        while some := sorted(islice(written, run_rows)):
            yield from _tables(_write_run(runs_folder(folder), some, block), _BLOCKS)

    # in a fixed order, so that a repeated attempt writes the same file
    return with_decisions(pages).sortWithinPartitions("page_id", "digest", "url").mapInArrow(run, BLOCKS)


class LoserTree:
    """Merges sorted iterables: each inner node keeps the loser of its match, the winner of all goes out next."""

    def __init__(self, runs: list[Iterable], key) -> None:
        self.runs, self.key = [iter(r) for r in runs], key
        self.many = max(1, len(self.runs))
        self.heads: list = [None] * self.many
        for k in range(len(self.runs)):
            self._advance(k)
        self.losers = [-1] * self.many
        self.winner = self._play(1) if self.many > 1 else 0

    def _advance(self, k: int) -> None:
        item = next(self.runs[k], None)
        self.heads[k] = None if item is None else (self.key(item), k, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, node: int) -> int:
        if node >= self.many:
            return node - self.many
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return winner

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner][2]
            if self.runs:
                self._advance(self.winner)
            node, winner = (self.winner + self.many) // 2, self.winner
            while node >= 1 and self.many > 1:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.winner = winner


def _merged(blocks: Iterable[tuple[str, int, int]]) -> Iterator[tuple[bytes, tuple]]:
    """The captures of blocks (path, offset, size), dealt in order of path and offset: one ordered list of all runs."""
    runs = [_read_run(path, [row[1:] for row in rows]) for path, rows in groupby(blocks, itemgetter(0))]
    return iter(LoserTree(runs, itemgetter(0)))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Blocks by the unit of work that is their first column."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for unit, some in groupby(rows, itemgetter(0)):
        yield unit, (row[1:] for row in some)


def _longer_runs(runs: DataFrame, groups: int, block: int) -> DataFrame:
    """The runs of each of some groups merged into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _dealt(batches):
            blocks = list(some)
            yield from _tables(_write_run(blocks[0][0].rpartition("/")[0], _merged(blocks), block), _BLOCKS)

    dealt = runs.select(F.pmod(F.xxhash64("path"), F.lit(groups)).alias("unit"), "path", "offset", "size")
    return dealt.repartition(groups, "unit").sortWithinPartitions("unit", "path", "offset").mapInArrow(run, BLOCKS)


def merged_index(runs: DataFrame, ranges: int, fan_in: int = FAN_IN, block: int = BLOCK) -> DataFrame:
    """The captures of all runs in order of URL key, timestamp, page_id.

    ``part`` is the range and ``place`` the place in it, which together are the order, however the table is read back.
    The bounds of the ranges are quantiles of SAMPLE block starts for each range; a URL that very many captures have is
    divided by time.
    """
    while (many := runs.select("path").distinct().count()) > fan_in:
        runs = workspace.saved(_longer_runs(runs, -(-many // fan_in), block), "warc-longer-runs")
    starts = sorted(bytes(r[0]) for r in runs.orderBy(F.xxhash64("path", "offset")).limit(SAMPLE * ranges).select("first").collect())
    bounds = sorted({starts[len(starts) * k // ranges] for k in range(1, ranges)}) if starts else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), *list(_BLOCKS)[:3]])
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield from _tables(((k, *row[:3]) for row in rows for k in range(bisect_right(bounds, row[3]), bisect_right(bounds, row[4]) + 1)), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*CAPTURES, ("part", pa.int32()), ("place", pa.int64())])
        for part, blocks in _dealt(batches):
            inside = (capture for key, capture in _merged(blocks) if bisect_right(bounds, key) == part)
            yield from _tables(((*capture, part, place) for place, capture in enumerate(inside)), schema)

    dealt = runs.mapInArrow(deal, "part int, path string, offset long, size long")
    return dealt.repartition(ranges, "part").sortWithinPartitions("part", "path", "offset").mapInArrow(run, f"{CAPTURE}, part int, place long")


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` points to, read from the archives: the RECORD columns.

    Captures are dealt by blocks of a file, so that a task opens few files; each record is one ranged read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open_folder(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        opened, source = "", None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if name != opened:
                    if source:
                        source.close()
                    opened, source = name, files.open_input_file(f"{base}/{name}")
                rows.append(parse_record(zlib.decompress(source.read_at(length, offset), 31)))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    places, parts = index.select("file", "offset", "length"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(parts, "file", F.floor(F.col("offset") / READ_BLOCK)).sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def read_whole_file(content: bytes) -> list[dict]:
    """All records of one archive file, without an index."""
    found, source = [], gzip.GzipFile(fileobj=io.BytesIO(content))
    data = source.read()
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        size = int(next(x for x in data[at:head].split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        end = head + 4 + size + 4
        found.append(parse_record(data[at:end]))
        at = end
    return found


def capture_histories(index: DataFrame) -> DataFrame:
    """Number of captures and first and last timestamp of every URL key."""
    return index.groupBy("url_key").agg(F.count("*").alias("captures"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
