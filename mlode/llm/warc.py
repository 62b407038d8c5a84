"""Operator 1: WARC archives with a two-level capture index.

Archives: each task writes one WARC/1.1 file, a gzip member for each record, and
reports its captures (key, page, file, offset, length). Of records with equal
payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest page_id is
the response and the others are revisits that refer to it; shorter payloads are
always responses.

Index, level one: captures sorted by reversed-host URL key, in compressed blocks
of ``BLOCK_LINES`` lines, one file for each key range. Level two: a sparse
directory for each range (first key, offset and length of each block), and a list
with the first key of each range. ``CaptureIndex.lookup`` binary-searches list,
directory and block, then reads only the bytes of the matching records;
``find_captures`` does that for a table of urls, each block read once by one task.

Nulls: a null html is an empty payload; a null url has no target and the empty
key; a null page_id can't be the response of a group that has another id. Repeated
rows with the smallest id of their group are all responses. White space and
controls are percent-encoded in keys and in the record's target; a url that can't
be split is its own key. Record ids are unique: they come from page_id and digest,
or from the place in the archive in groups with repeated rows, whose revisits name
the response by X-Refers-To-Page-Id alone. page_id must cast to long. Empty tables
make no files and give no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlode.llm import common as C
from mlode.llm import shared_files as S

LEAST_REVISIT = 100
BLOCK_LINES = 1024
#: Digests of several rows that are sent to every task (about 100 bytes each); more are joined in so many salts.
MOST_SENT, SALTS = 200_000, 16
GZIP_LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.example.com:8080/a?b -> com,example,www:8080)/a?b, lower-cased host, no scheme, fragment, white space or controls."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return _safe(url)
    path = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return _safe(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path)


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, place: str = "") -> bytes:
    """An uncompressed WARC record; place: where it stands, if its page_id and digest can repeat. A revisit carries the HTTP header, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, place)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Length", str(len(block))), ("X-Payload-Length", str(len(payload))), ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _safe(url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), *([] if place else [("WARC-Refers-To", record_id(first, digest))]), ("X-Refers-To-Page-Id", str(first))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (what follows the HTTP header) of a record."""
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first, revisit and repeats for each page; first: the smallest page_id with an equal payload.

    The html isn't shuffled if the digests that several rows have are few; else they meet it in salted partitions."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long_enough = F.octet_length("html") >= LEAST_REVISIT
    rows = keyed.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("_n").alias("_n"), (F.max("_n") > 1).alias("repeats")).filter("_n > 1").drop("_n")
    groups = C.written(groups, "digests")
    if groups.count() <= MOST_SENT:
        joined = keyed.join(F.broadcast(groups), "digest", "left")
    else:
        salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "_salt"], "left").drop("_salt")
    again = long_enough & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.withColumn("revisit", F.coalesce(again, F.lit(False))).withColumn("repeats", F.coalesce("repeats", F.lit(False)))


CAPTURE = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each page; the captures, kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, sink, at = "", None, 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            # a row at a time: pages can be long
            for i in range(batch.num_rows):
                page_id, url, html, digest, first, revisit, repeats = (batch.column(k)[i].as_py() for k in range(7))
                if sink is None:
                    uri = S.unique(folder, "pages", ".warc.gz")
                    sink = S.create(uri)
                    info = b"software: mlode\r\nformat: WARC File Format 1.1\r\n"
                    packed = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, uri)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", GZIP_LEVEL, mtime=0)
                    sink.write(packed)
                    at = len(packed)
                packed = gzip.compress(record(page_id, url, html.encode(), digest, first, revisit, f":{uri}:{at}" if repeats else ""), GZIP_LEVEL, mtime=0)
                sink.write(packed)
                for to, x in zip(out, (url_key(url), page_id, uri, at, len(packed)), strict=True):
                    to.append(x)
                at += len(packed)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        if sink is not None:
            sink.close()

    rows = plan_records(pages).select(F.col("page_id").cast("long"), "url", "html", "digest", F.col("first").cast("long"), "revisit", "repeats")
    return C.written(rows.mapInArrow(run, CAPTURE), "captures")


def _line(key: str, page_id: int | None, file: str, offset: int, length: int) -> str:
    return f"{key} {json.dumps([page_id, file, offset, length])}"


def write_index(captures: DataFrame, folder: str) -> list[dict]:
    """One entry for each key range, in order: first key, block file, directory file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, sink, at, first, lines, sparse = "", None, 0, "", [], []

        def flush() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(lines).encode(), 6)
            sink.write(packed)
            sparse.append([lines[0].split(" ", 1)[0], at, len(packed), len(lines)])
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    uri, first = S.unique(folder, "index", ".cdx.z"), row[0]
                    sink = S.create(uri)
                lines.append(_line(*row))
                if len(lines) == BLOCK_LINES:
                    flush()
        if sink is None:
            return
        if lines:
            flush()
        sink.close()
        with S.create(uri + ".dir") as d:
            d.write(json.dumps(sparse).encode())
        yield pa.RecordBatch.from_pydict({"first": [first], "blocks": [uri], "directory": [uri + ".dir"]})

    order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
    ranged = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    # one row for each key range
    found = ranged.mapInArrow(run, "first string, blocks string, directory string").withColumn("part", F.spark_partition_id()).collect()
    return [{"first": r["first"], "blocks": r["blocks"], "directory": r["directory"]} for r in sorted(found, key=lambda r: r["part"])]


def _block(file, offset: int, length: int) -> list[str]:
    return zlib.decompress(S.read_range(file, offset, length)).decode().split("\n")


class CaptureIndex:
    """Point lookups; holds the list of ranges, and reads one directory and the blocks that can hold the key."""

    def __init__(self, ranges: list[dict]):
        self.ranges, self.firsts, self._at, self._sparse = ranges, [r["first"] for r in ranges], None, []

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that can hold the key."""
        # captures of one key can begin at the end of the range, or block, before the first that starts with it
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            if k != self._at:
                with S.open_random(self.ranges[k]["directory"]) as d:
                    self._at, self._sparse = k, json.loads(d.read())
            heads = [b[0] for b in self._sparse]
            for b in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
                yield self.ranges[k]["blocks"], self._sparse[b][1], self._sparse[b][2]

    def lookup(self, url: str) -> list[dict]:
        """Header fields and payload (None for a revisit) of every capture of the url's key."""
        key, out = url_key(url), []
        for uri, offset, length in self.blocks(key):
            with S.open_random(uri) as f:
                lines = _block(f, offset, length)
            for file, at, size in captures_of(lines, key):
                with S.open_random(file) as w:
                    head, payload = parse(gzip.decompress(S.read_range(w, at, size)))
                out.append(head | {"payload": None if head["WARC-Type"] == "revisit" else payload})
        return out


def captures_of(lines: list[str], key: str) -> list[tuple[str, int, int]]:
    """(file, offset, length) of a key's captures in a block."""
    begin = bisect.bisect_left(lines, key, key=lambda x: x.split(" ", 1)[0])
    end = bisect.bisect_right(lines, key, lo=begin, key=lambda x: x.split(" ", 1)[0])
    return [tuple(json.loads(x.split(" ", 1)[1])[1:]) for x in lines[begin:end]]


def find_captures(urls: DataFrame, ranges: list[dict]) -> DataFrame:
    """file, offset and length of every capture of the urls' keys (a table with a column url), by the list, the directories and the blocks.

    Keys are searched in the directories first; then each block that can hold some goes to one task with them, so that a key of many captures is split by its blocks."""
    spark = urls.sparkSession
    schema = "file string, offset long, length long"
    if not ranges:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(ranges)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in batch.column(0).to_pylist()}), pa.string())], ["key"])

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(sent.value)
        for batch in batches:
            rows = [(key, *block) for key in batch.column(0).to_pylist() for block in index.blocks(key)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "blocks", "at", "size"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines = None, []
        for batch in batches:
            rows = []
            for key, uri, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (uri, at) != held:
                    with S.open_random(uri) as f:
                        held, lines = (uri, at), _block(f, at, size)
                rows += captures_of(lines, key)
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "offset", "length"])

    once = urls.select("url").mapInArrow(keys, "key string").distinct()
    sought = once.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(directory, "key string, blocks string, at long, size long")
    return sought.repartition("blocks", "at").sortWithinPartitions("blocks", "at", "key").mapInArrow(block, schema)


def read_archives(urls: DataFrame, ranges: list[dict]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the urls (a table with a column url), found in the index and read from the archives.

    The digest of a response is computed from the payload read and checked against its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != name:
                    name, file = uri, S.open_random(uri)
                head, payload = parse(gzip.decompress(S.read_range(file, offset, length)))
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{uri} at {offset}: payload and header differ")
                first = head.get("X-Refers-To-Page-Id")
                for to, x in zip(out, (int(head["X-Page-Id"]) if head["X-Page-Id"] else None, size, digest, head["WARC-Type"], int(first) if first else None), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # dealt by file and megabyte, so that a task reads neighbouring records and a large file is split; a row here stands for a record, so partitions must not be put together by their size
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = find_captures(urls, ranges).withColumn("mb", F.shiftright("offset", 20)).repartition(parts, "file", "mb").sortWithinPartitions("file", "offset").drop("mb")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str) -> list[dict]:
    """Writes archives and index; the index's ranges."""
    return write_index(write_archives(pages, folder), folder)


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(pages, archive(pages, C.shared_path(spark, "warc")))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest)
"""
