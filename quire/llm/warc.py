"""WARC archives with a two-level capture index.

Writing: a map over pages gives payload digests; of equal payloads the page with the largest
page_id is the response and the others are revisits that refer to it. Pages are dealt by
(page_id, digest), so one payload on a third of all pages is spread evenly, and every task
writes one archive of gzip members, one record each.

Index: captures (one line per record, with the archive, offset and length) are sorted by
reversed-host URL key into range partitions. Each writes one index file: compressed blocks
of BLOCK lines, then a sparse directory with the first and last key and the place of each
block. Looking up finds the index files by their key ranges, binary-searches the directory,
range-reads the blocks and then the records.

Files get names of their own and count only once their task has succeeded and its rows
stand in the staged tables.

Defined results: a null html is the empty payload; a null url has the empty key and no
target header; a null page_id has a record with no number, is never referred to and, if
no page with a number shares its payload, is a response; rows that repeat a page_id and
payload get a record each; an empty table gives no files and no rows. Of the input only
page_id, url and html are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokenbin import opened
from quire.llm.util import new_path, stage

#: Captures in one compressed block of the index.
BLOCK = 256
#: Neighbouring records are read together up to this many bytes, and across gaps up to GAP.
READ_AHEAD, GAP = 4 << 20, 64 << 10
#: Shards of the index up to which their key ranges are broadcast (under 10 kB each).
MAX_BROADCAST_SHARDS = 5_000
DATE = "2000-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, path string, offset long, length long"
SHARD = "path string, low string, high string, n long"


def url_key(url: str | None) -> str:
    """The URL with its host reversed: com,example,blog)/path?query, without scheme and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    shown = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "")
    return f"{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the length of the full payload, and no body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~|")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record that was read; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} fails its digest")
    number = lambda name: int(x[10:-1]) if (x := fields.get(name, "<urn:page:none>")) != "<urn:page:none>" else None
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
            "payload_bytes": size, "payload_digest": stated, "payload": payload if fields["WARC-Type"] == "response" else None}


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages whose payload of at least min_bytes a page with a larger page_id holds."""
    html = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    held = slim.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND refers_to IS NOT NULL")
    return slim.join(held.drop("copies"), "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write all pages; the captures: key, page_id, path, offset, length."""
    folder = folder or new_path(pages.sparkSession, "warc")
    typed = pages.select(F.col("page_id").cast("long"), "url", "html")
    again = revisits(typed, min_bytes).select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to")
    keyed = typed.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    joined = keyed.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha") == F.col("again_sha")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    system, name = opened(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name, compression=None)
                    out.write(first := gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), mtime=0))
                    at = len(first)
                page_id, url = page_id.as_py(), url.as_py()
                member = record(page_id, url, (html.as_py() or "").encode(), refers_to.as_py())
                out.write(member)
                rows.append((url_key(url), page_id, path, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "path", "offset", "length"])
        if out is not None:
            out.close()

    return stage(joined.select("page_id", "url", "html", "refers_to").mapInArrow(run, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Sort the captures into index files; one row per file: path, low and high key, n."""
    spark = captures.sparkSession
    folder = folder or new_path(spark, "index")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "page_id", "path", "offset"]
    ordered = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at, directory, held, n = f"{folder}/{uuid.uuid4().hex}.cdxz", None, 0, [], [], 0

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
            out.write(block)
            directory.append((held[0][0], held[-1][0], at, len(block)))
            at += len(block)
            held.clear()

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "page_id", "path", "offset", "length"))):
                if out is None:
                    system, name = opened(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name, compression=None)
                held.append(row)
                n += 1
                if len(held) == BLOCK:
                    flush()
        if out is not None:
            if held:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([directory[0][0]]), pa.array([directory[-1][1]]), pa.array([n], pa.int64())], ["path", "low", "high", "n"])

    return stage(ordered.mapInArrow(run, SHARD), "index-shards")


class IndexReader:
    """One index file: its directory is in memory, its blocks are read on demand."""

    def __init__(self, path: str):
        system, name = opened(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        (n,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.lasts = [d[1] for d in self.directory]
        self.kept: tuple[int, list] = (-1, [])

    def block(self, i: int) -> list:
        if self.kept[0] != i:
            _, _, at, n = self.directory[i]
            self.kept = i, [json.loads(x) for x in zlib.decompress(self.file.read_at(n, at)).split(b"\n")]
        return self.kept[1]

    def find(self, key: str) -> Iterator[list]:
        """The captures of the key: the first block that may hold it by binary search, then on while keys are equal."""
        i = bisect.bisect_left(self.lasts, key)
        while i < len(self.directory) and self.directory[i][0] <= key:
            lines = self.block(i)
            for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]):]:
                if line[0] != key:
                    return
                yield line
            i += 1


def find_captures(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of the wanted keys (column key), through the index."""
    n = shards.count()
    if n == 0:
        return keys.sparkSession.createDataFrame([], CAPTURE)
    ranges = shards.select(F.col("path").alias("shard"), "low", "high")
    ranges = F.broadcast(ranges) if n <= MAX_BROADCAST_SHARDS else ranges
    asked = keys.select("key").distinct().join(ranges, F.col("key").between(F.col("low"), F.col("high"))).select("shard", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, reader = None, None
        for batch in batches:
            found = []
            for shard, key in zip(batch["shard"], batch["key"]):
                if shard != path:
                    path, reader = shard, IndexReader(shard)
                for line in reader.find(key):
                    found.append(line)
                    if len(found) == 4096:
                        yield frame(found)
                        found = []
            yield frame(found)

    def frame(found: list) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["key", "page_id", "path", "offset", "length"]).astype({"page_id": "Int64"})

    return asked.repartitionByRange(n, "shard", "key").sortWithinPartitions("shard", "key").mapInPandas(run, CAPTURE)


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_records(captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records of captures by range reads, neighbours together."""
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file = None, None
        for batch in batches:
            rows, i, places = [], 0, list(zip(batch["path"], batch["offset"], batch["length"]))
            while i < len(places):
                j, (at_path, start, length) = i + 1, places[i]
                end = start + length
                while j < len(places) and places[j][0] == at_path and places[j][1] - end <= GAP and places[j][1] + places[j][2] - start <= READ_AHEAD:
                    end = places[j][1] + places[j][2]
                    j += 1
                if at_path != path:
                    system, name = opened(at_path)
                    path, file = at_path, system.open_input_file(name)
                held = memoryview(file.read_at(int(end - start), int(start)))
                for _, at, n in places[i:j]:
                    found = parse(held[at - start : at - start + n])
                    rows.append(found if payload else found | {"payload": None})
                if len(rows) >= 256 or j == len(places):
                    yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})
                    rows = []
                i = j

    slim = captures.select("path", "offset", "length")
    return slim.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInPandas(run, RECORD)


def lookup(shards: DataFrame, urls: DataFrame) -> DataFrame:
    """All records of the wanted urls (column url)."""
    keyed = urls.select("url").distinct().mapInPandas(lambda it: (pd.DataFrame({"key": [url_key(u) for u in b["url"]]}) for b in it), "key string")
    return read_records(find_captures(shards, keyed))


def op5_warc_archives(pages: DataFrame) -> DataFrame:
    """Write archives and index, then look every key up again and read the records."""
    captures = write_archives(pages)
    found = find_captures(write_index(captures), captures.select("key"))
    return read_records(found, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
