"""WARC archives with revisit records, and their index by external merge.

Writing: one record per page. Of equal payloads the page with the largest id
is the response, the others revisit it. Records are text to Spark's writer,
which ends each with the two empty lines that end a WARC record, so the files
are plain WARC/1.1 and land where every executor can reach them.

Reading: whole files, record by record by their ``Content-Length``; payloads
are digested again and held against the header. Each file gives a run of its
captures, sorted by URL key and time.

Index: runs are cut into ranges of the key (Spark's range partitioner; ranges
include time and id, so one URL with a third of the captures spreads over many
ranges), and in each range the pieces of the runs meet in a k-way merge by a
loser tree. Pieces beyond ``SPOOL_ROWS`` wait in the task's own temporary
files, so a task's memory is bounded. The result is globally ordered: by
partition, then by row. ``histories`` numbers the captures of each URL.

Null html counts as empty; empty payloads are payloads. Null URLs have an
empty key. Pages without id are smaller than any other. Rows that repeat with
the same largest id are all responses. Extra columns are not read. An empty
table gives an empty archive and result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocklens.session import materialize, scratch_path

#: Payloads up to so many bytes are written so many to a file: 64 MB at most, but for single records beyond.
FILE_SIZES = ((1 << 14, 4000), (1 << 17, 512), (1 << 20, 64), (1 << 23, 8), (None, 1))
SPOOL_ROWS = 200_000
FAN_IN = 64  # files that a merge holds open
FIRST_CAPTURE, CAPTURE_SECONDS = "2024-01-01 00:00:00", 365 * 24 * 3600  # pages have no time: id seconds later, within a year
_END = "\r\n\r\n"
# Fixed values of RFC 4648.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CAPTURE = "url_key string, captured string, page_id long, run string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SCHEMA = pa.schema(
    [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("run", pa.string()), ("offset", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _base32(hex40: Column) -> Column:
    """Base32 of 40 hex digits: four letters from every five."""
    letters = []
    for k in range(8):
        v = F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _records(pages: DataFrame) -> DataFrame:
    """``value``: the records without their end, in the order they are written."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    largest = p.groupBy("sha", "size").agg(F.max("page_id").alias("keep"))
    p = p.join(largest, ["sha", "size"])
    first = F.col("page_id").eqNullSafe(F.col("keep"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    time = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit(FIRST_CAPTURE).cast("timestamp")) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CAPTURE_SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record_id = lambda c: F.concat(F.lit("<urn:page:"), text(c), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(first, F.col("html")).otherwise(""))
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("keep")), F.lit("\r\n")
    )
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(first, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), time,
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(text(F.col("url")), "[\\x00-\\x20]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), _base32(F.col("sha")), F.lit("\r\n"),
        F.when(first, "").otherwise(revisit),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    return p.select(F.concat(header, block).alias("value"), "size")


def write_archives(pages: DataFrame, path: str) -> None:
    """Files of bounded size: pages of like size are written together, as many to a file as fit. One pass for each kind of size that there is."""
    kind = F.coalesce(*[F.when(F.octet_length(F.coalesce("html", F.lit(""))) <= most, k) for k, (most, _) in enumerate(FILE_SIZES) if most], F.lit(len(FILE_SIZES) - 1))
    there = sorted(r["kind"] for r in pages.select(kind.alias("kind")).distinct().collect())
    records = _records(pages)
    for k in there or [0]:
        above, most = FILE_SIZES[k - 1][0] if k else -1, FILE_SIZES[k][0]
        some = records.filter(F.col("size") > above) if most is None else records.filter((F.col("size") > above) & (F.col("size") <= most))
        some.select("value").write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", FILE_SIZES[k][1]).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels from the right, then path and query, lower case, without scheme and fragment."""
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0].lower()
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def _id_of(value: bytes) -> int | None:
    text = value[len(b"<urn:page:") : -1]
    return int(text) if text else None


def parse(archive: bytes, run: str) -> Iterator[tuple]:
    """The captures of an archive, in its order. Raises where a record is broken or a payload isn't what its digest says."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"{run}: no record at byte {at}")
        head = dict(line.split(b": ", 1) for line in lines[1:])
        block_at = end + 4
        after = block_at + int(head[b"Content-Length"])
        body_at = archive.index(b"\r\n\r\n", block_at, after) + 4
        size = next(int(x.split(b":")[1]) for x in archive[block_at:body_at].split(b"\r\n") if x.startswith(b"Content-Length:"))
        digest, kind = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), head[b"WARC-Type"].decode()
        if kind == "response" and (after - body_at != size or base64.b32encode(hashlib.sha1(memoryview(archive)[body_at:after]).digest()).decode() != digest):
            raise ValueError(f"{run}: the payload of the record at byte {at} does not fit its digest")
        refers = _id_of(head[b"WARC-Refers-To"]) if kind == "revisit" else None
        yield url_key(head[b"WARC-Target-URI"].decode()), head[b"WARC-Date"].decode(), _id_of(head[b"WARC-Record-ID"]), run, at, size, digest, kind, refers
        if archive[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"{run}: the record at byte {at} does not end")
        at = after + 4


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``; those of one file come together, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                if rows := sorted(parse(content.as_py(), name.as_py().rpartition("/")[2]), key=_order):
                    yield _batches(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURE)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, so the next winner costs log2 k comparisons."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return self.keys[a] < self.keys[b] or self.keys[a] == self.keys[b] and a < b

    def _play(self, i: int) -> None:
        """Run i goes up from its leaf; the first to come to an empty node waits there."""
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])
            self._play(i)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


class _Spool:
    """Pieces of runs. ``SPOOL_ROWS`` rows are held; then the runs so far are merged into one file of the task's own.

    The files live in the task's temporary folder and are made anew if the task is. More than ``FAN_IN`` files are merged
    in passes, so few are ever open.
    """

    def __init__(self, folder: str):
        self.folder, self.held, self.n, self.files, self.written = folder, {}, 0, [], 0

    def _write(self, rows: Iterator[tuple]) -> None:
        name = f"{self.folder}/{self.written}"
        with pa.OSFile(name, "wb") as f, pa.ipc.new_stream(f, _SCHEMA) as out:
            while some := list(itertools.islice(rows, 1000)):
                out.write_batch(_batches(some))
        self.files.append(name)
        self.written += 1

    def _held_runs(self) -> list[Iterator[tuple]]:
        return [iter(sorted(rows, key=_order)) for rows in self.held.values()]

    def add(self, batch: pa.RecordBatch) -> None:
        for row in _rows(batch):
            self.held.setdefault(row[3], []).append(row)
        self.n += batch.num_rows
        if self.n >= SPOOL_ROWS:
            self._write(iter(LoserTree(self._held_runs(), _order)))
            self.held, self.n = {}, 0

    @staticmethod
    def _read(name: str) -> Iterator[tuple]:
        with pa.OSFile(name) as f:
            for batch in pa.ipc.open_stream(f):
                yield from _rows(batch)

    def runs(self) -> list[Iterator[tuple]]:
        while len(self.files) > FAN_IN:
            some, self.files = self.files[:FAN_IN], self.files[FAN_IN:]
            self._write(iter(LoserTree([self._read(x) for x in some], _order)))
            for x in some:
                os.unlink(x)
        return [self._read(x) for x in self.files] + self._held_runs()


def merge_runs(captures: DataFrame) -> DataFrame:
    """The captures in global order of URL key, time and id, with ``part``, the partition that a row is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        with tempfile.TemporaryDirectory() as folder:
            spool = _Spool(folder)
            for b in batches:
                spool.add(b)
            merged = iter(LoserTree(spool.runs(), _order))
            while some := list(itertools.islice(merged, 4000)):
                yield _batches(some).append_column("part", pa.array([part] * len(some), pa.int32()))

    return captures.repartitionByRange("url_key", "captured", F.col("page_id").asc_nulls_first()).mapInArrow(run, f"{CAPTURE}, part int")


def histories(index: DataFrame) -> DataFrame:
    """The index with ``place``, from 1: each capture's place in its URL's history.

    A URL's captures follow each other, over several partitions if they are many; each partition numbers its own and adds
    what the ones before it hold. A row is sent for every URL and partition, not for every capture.
    """
    rows = materialize(index.withColumn("at", F.monotonically_increasing_id()), "capture-index")
    stretches = rows.groupBy("url_key", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("url_key").orderBy("part")) - F.col("n")
    stretches = stretches.select("url_key", "part", (before - F.col("first") + 1).alias("shift"))
    return rows.join(stretches, ["url_key", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "shift")


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives to ``path``, read them back and index them: one row per capture, in global order."""
    spark = pages.sparkSession
    write_archives(pages, path)
    return merge_runs(materialize(read_runs(spark, path), "capture-runs"))


def query(pages: DataFrame) -> DataFrame:
    """op5: one row per page, as the merged index has it."""
    index = histories(archive(pages, scratch_path(pages.sparkSession, "warc")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")


ORACLE_SQL = r"""
WITH u AS (SELECT *, regexp_replace(coalesce(url, ''), '[\x00-\x20]', '%20', 'g') AS uri FROM pages),
     r AS (SELECT *, lower(split_part(coalesce(nullif(substr(uri, nullif(strpos(uri, '://'), 0) + 3), ''), uri), '#', 1)) AS rest FROM u),
     h AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM r),
     p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha,
                  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(rest, length(host) + 1) AS url_key,
                  strftime(TIMESTAMP '2024-01-01' + to_seconds(((coalesce(page_id, 0) % 31536000) + 31536000) % 31536000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM h),
     d AS (SELECT page_id, html, url_key, captured, max(page_id) OVER (PARTITION BY html) AS keep,
                  array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      ((('0x' || substr(sha, 5 * k + 1, 5))::BIGINT >> s) & 31)::BIGINT + 1, 1)
                      FOR s IN [15, 10, 5, 0]] FOR k IN range(8)]), '') AS payload_digest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to, url_key, captured,
       row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id NULLS FIRST) AS place
FROM d
"""
