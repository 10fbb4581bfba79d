"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record (``response``, or
``revisit`` where an equal payload is already held) and returns where each
record lies.  ``build_index`` sorts the reversed-host URL keys into compressed
blocks of lines, writes them to index files, and returns the sparse directory:
the first key of each block and its byte range, within range partitions whose
own first keys are a short list.  ``lookup`` sends a query to its partition by
binary search in that list and meets the directory there in key order; a block
that is hit is read by its range and searched by binary search.  So a lookup
moves queries and directory rows, never the index.  ``read_records`` then reads
byte ranges of the archives.

Archives lie in the shared folder and are opened through ``pyarrow.fs``, so
local mounts and object stores both work.  A file's name belongs to one task
attempt and index rows name the file of their own attempt, so a retried task
cannot mix up offsets.

Defined cases: a null payload is empty; a null URL has an empty key; payloads
under ``min_bytes`` are never revisits; a null ``page_id`` sorts last and is
chosen only when the group has no other; rows that share the smallest page_id of
their payload are all responses; an empty table gives no archive and no rows.
Only ``page_id``, ``url`` and ``html`` are read; further columns, whatever their
names, take no part.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodia.llm.shared import folder, stored
from episodia.llm.textkernel import slices

MIN_BYTES = 100
BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACES = "url_key string, page_id long, file string, offset long, length long"
DIRECTORY = "part int, block int, first_key string, first_id long, file string, offset long, length long"
LEVEL = 3


def url_key(url: Column) -> Column:
    """Reversed host labels, then the rest: ``com,example,www)/path?query``; tabs and line ends are escaped."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(url)
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, "^[^/?#]*", ""))
    return F.coalesce(F.replace(F.replace(F.replace(key, F.lit("\t"), F.lit("%09")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))


def captures(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Payload, digest and record type of each page; ``refers`` names the response of a revisit."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2("html", 256).alias("digest")
    )
    twins = (
        own.where(F.col("payload_bytes") >= min_bytes).groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("held"), F.count("*").alias("copies"))
        .where("copies > 1").select("digest", F.col("held.page_id").alias("held_id"), F.col("held.url").alias("held_url"))
    )
    again = F.col("held_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("held_id"))
    return own.join(twins, "digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "digest", url_key(F.col("url")).alias("url_key"),
        F.when(again, F.col("held_id")).alias("refers_to"), F.when(again, F.col("held_url")).alias("refers_url"),
    )


def _safe(url: str | None) -> str:
    return "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    head += [] if page_id is None else [f"Page-Id: {page_id}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Refers-To-Target-URI: {_safe(refers_url)}", f"Refers-To-Page-Id: {refers_to}"]
    body = http + (payload if refers_to is None else b"")
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(caps: DataFrame, into: str, max_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records to WARC files below ``into``; the (stored) table of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(into)
        fs.create_dir(base, recursive=True)
        out, name, at, n = None, "", 0, 0
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        for b in slices(batches, "html", 4 << 20):
            rows = []
            for x in b.to_pylist():
                if out is None or at >= max_bytes:
                    if out is not None:
                        out.close()
                    name, at, n = f"part-{part:05d}-{n:03d}-{uuid.uuid4().hex}.warc.gz", 0, n + 1
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                z = gzip.compress(record(x["page_id"], x["url"], x["html"].encode("utf-8", "surrogatepass"), x["digest"], x["refers_to"], x["refers_url"]), LEVEL, mtime=0)
                out.write(z)
                rows.append((x["url_key"], x["page_id"], name, at, len(z)))
                at += len(z)
            out.flush()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["url_key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(caps.select("page_id", "url", "html", "digest", "url_key", "refers_to", "refers_url").mapInArrow(run, PLACES))


def _order(key: str, page_id: int | None) -> tuple:
    return (key.encode(), page_id is not None, page_id or 0)


def build_index(places: DataFrame, into: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index below ``into``; its directory as a stored table: ``part, block, first_key, first_id, file, offset, length``.

    Partitions are ranges of (key, page_id): a key with very many captures is
    spread over several of them.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        lines: list[tuple] = []
        block, at, out = 0, 0, None
        name = f"index-{part:05d}-{uuid.uuid4().hex}.gz"

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal at, out
            if out is None:
                fs, base = pafs.FileSystem.from_uri(into)
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            data = zlib.compress("\n".join(f"{k}\t{'' if p is None else p}\t{f}\t{o}\t{n}" for k, p, f, o, n in rows).encode(), 6)
            out.write(data)
            at += len(data)
            row = [part, block, rows[0][0], rows[0][1], name, at - len(data), len(data)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], [x.split()[0] for x in DIRECTORY.split(", ")])

        for b in frames:
            lines += zip(*(b.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length")))
            while len(lines) >= block_lines:
                yield flush(lines[:block_lines])
                lines, block = lines[block_lines:], block + 1
        if lines:
            yield flush(lines)
        if out is not None:
            out.close()

    ranged = places.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return stored(ranged.mapInArrow(run, DIRECTORY))


def lookup(index: DataFrame, asked: DataFrame, root: str) -> DataFrame:
    """Places of the captures with the (url_key, page_id) pairs in ``asked``, from the index files below ``root``.

    The list of the partitions' first keys (one row a partition) is all that
    the driver sees of the index.
    """
    tops = sorted((_order(r["k"]["first_key"], r["k"]["first_id"]), r["part"]) for r in index.groupBy("part").agg(F.min(F.struct("first_key", "first_id")).alias("k")).collect())
    keys, parts = [x[0] for x in tops], [x[1] for x in tops]

    def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            to: dict[str, list] = {"url_key": [], "page_id": [], "part": []}
            for a, c in zip(b.column("url_key").to_pylist(), b.column("page_id").to_pylist()):
                # equal captures may lie in several partitions: from the one before the first that begins with them
                own = _order(a, c)
                for k in range(max(bisect_left(keys, own) - 1, 0), bisect_right(keys, own)):
                    for x, v in zip(to.values(), (a, c, parts[k])):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(to["url_key"], pa.string()), pa.array(to["page_id"], pa.int64()), pa.array(to["part"], pa.int32())], list(to))

    def find(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        open_files: dict = {}
        loaded: dict[tuple, tuple[list, list]] = {}
        near: list[tuple] = []  # blocks that may hold the next query: the last ones with one first key, and the one before
        key, part, last = None, None, None

        def lines_of(block: tuple) -> tuple[list, list]:
            if block not in loaded:
                file, offset, length = block
                if file not in open_files:
                    for f in open_files.values():
                        f.close()
                    open_files.clear()
                    open_files[file] = fs.open_input_file(f"{base}/{file}")
                rows = [x.split("\t") for x in zlib.decompress(open_files[file].read_at(length, offset)).decode().split("\n")]
                for x in [x for x in loaded if x not in near]:
                    del loaded[x]
                loaded[block] = [_order(r[0], int(r[1]) if r[1] else None) for r in rows], rows
            return loaded[block]

        for b in frames:
            out: list[tuple] = []
            for to, k, p, file, offset, length in zip(*(b.column(c).to_pylist() for c in ("part", "url_key", "page_id", "file", "offset", "length"))):
                own = _order(k, p)
                if to != part:
                    near, key, part, last = [], None, to, None
                if file is not None:
                    near = [*near, (file, offset, length)] if own == key else [*near[-1:], (file, offset, length)]
                    key = own
                elif own != last:
                    last = own
                    for block in near:
                        order, rows = lines_of(block)
                        out += [(r[0], int(r[1]) if r[1] else None, r[2], int(r[3]), int(r[4])) for r in rows[bisect_left(order, own) : bisect_right(order, own)]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["url_key", "page_id", "file", "offset", "length"])
        for f in open_files.values():
            f.close()

    sent = asked.select("url_key", "page_id").mapInArrow(route, "url_key string, page_id long, part int")
    none = F.lit(None)
    rows = sent.select("part", "url_key", "page_id", F.lit(1).alias("kind"), F.lit(0).alias("block"), none.cast("string").alias("file"), none.cast("long").alias("offset"), none.cast("long").alias("length"))
    both = rows.unionByName(index.select("part", F.col("first_key").alias("url_key"), F.col("first_id").alias("page_id"), F.lit(0).alias("kind"), "block", "file", "offset", "length"))
    return both.repartition("part").sortWithinPartitions("part", "url_key", "page_id", "kind", "block").mapInArrow(find, PLACES)


def read_records(places: DataFrame, root: str) -> DataFrame:
    """The records at ``places``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length come from its payload and must agree with
    its header; a revisit's come from its headers.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        name, f = None, None
        for b in frames:
            out: list[tuple] = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{base}/{file}")
                fields, http, payload = parse(zlib.decompress(f.read_at(length, offset), 31))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"damaged record in {file} at {offset}")
                out.append((int(fields["Page-Id"]) if "Page-Id" in fields else None, size, digest, fields["WARC-Type"], int(fields["Refers-To-Page-Id"]) if "Refers-To-Page-Id" in fields else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f is not None:
            f.close()

    near = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    root = folder(spark)
    places = write_archives(captures(pages), root)
    index = build_index(places, root)
    asked = pages.select(url_key(F.col("url")).alias("url_key"), "page_id")
    return read_records(lookup(index, asked, root), root)


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS held FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> held THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> held THEN held END AS refers_to FROM w
"""
