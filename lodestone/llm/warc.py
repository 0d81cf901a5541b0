"""WARC archives with revisit records and a two-level capture index.

Writing. Payload digests are grouped first (only digest and page_id move), then each page learns what it revisits in one
join on its own id, and each task writes one archive of gzip members. A task's archive counts only if its index lines are
committed, so a retried task leaves at most a file that nothing names.

Index. Lines are range-sorted by reversed-host url key and cut into gzip blocks, in one index file for each range; the
sparse directory keeps a block's first and last key, file, offset and length. Lookups are batches of keys: a binary search
over the ranges' bounds (a row for each index file, at most as many as partitions) sends a key to its file, where keys and
that file's part of the directory meet; a second one finds its blocks, which are range-read, and a third its lines in them.
Then the records are range-read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import host_of, new_folder, partitions, path_of, reversed_host, stored

BLOCK_LINES = 3000
#: Bytes that a task buffers before it writes.
BUFFER = 8 << 20
_ENTRY = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string())])
_ENTRY_SQL = "url_key string, page_id long, url string, file string, offset long, length long, record_type string"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ_SQL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Spark's names of stores by Arrow's.
_STORES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "hdfs": "hdfs", "viewfs": "viewfs", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _uri(folder: str) -> str:
    """``folder`` as tasks open it: file: and plain paths are a mount that all machines share, others a store that Arrow knows."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    scheme, there, rest = folder.partition("://")
    if not there:
        return folder
    if scheme not in _STORES:
        raise ValueError(f"archives can't be written to {scheme}: only to a shared mount or {', '.join(sorted(_STORES))}")
    return f"{_STORES[scheme]}://{rest}"


def _open_folder(folder: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    folder = _uri(folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _record(page: int | None, url: str | None, payload: bytes, refers: int | None, digest: str) -> bytes:
    """One gzip member. A revisit has the response's HTTP header, with its Content-Length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
        f"X-Page-ID: {'' if page is None else page}",
    ]
    if url is not None:
        # A header ends at its line; what isn't printable ASCII is escaped as JSON does.
        head.insert(3, f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers}')}>", f"X-Refers-To-Page-ID: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + deflate.flush()


def _parse(raw: bytes) -> dict:
    """The fields of one record; for a revisit, length and digest are those of the response's payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if not revisit and (len(payload) != length or digest != fields["WARC-Payload-Digest"].removeprefix("sha1:")):
        raise ValueError(f"damaged record of page {fields['X-Page-ID']}")
    return {
        "page_id": int(x) if (x := fields["X-Page-ID"].strip()) else None,
        "url": json.loads(f'"{u}"') if (u := fields.get("WARC-Target-URI")) is not None else None,
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if revisit else None,
    }


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_folder(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at, buffer = None, 0, bytearray()
        for batch in batches:
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            htmls = batch.column("html")
            for i, (key, page, url, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "url", "refers_to")))):
                payload = (htmls[i].as_py() or "").encode()
                raw = _record(page, url, payload, refers, base64.b32encode(hashlib.sha1(payload).digest()).decode())
                rows.append((key, page, url, name, at + len(buffer), len(raw), "response" if refers is None else "revisit"))
                buffer += raw
                if len(buffer) >= BUFFER:
                    out.write(bytes(buffer))
                    at += len(buffer)
                    buffer.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)
        if out is not None:
            out.write(bytes(buffer))
            out.close()

    return write


def _indexer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_folder(folder)
        name, out, at, lines = f"{uuid.uuid4().hex}.cdx.gz", None, 0, []
        found = []

        def flush() -> None:
            nonlocal at, out
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            raw = gzip.compress("".join(x[1] for x in lines).encode(), 6, mtime=0)
            out.write(raw)
            found.append((lines[0][0], lines[-1][0], name, at, len(raw), len(lines)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                lines.append((row["url_key"], json.dumps([row[c] for c in _ENTRY.names], separators=(",", ":")) + "\n"))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["first_key", "last_key", "file", "offset", "length", "n"])

    return write


def write_archives(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``: (index entries, block directory).

    Null html is an empty payload. Of rows with equal payloads (SHA-1 and length), those with the smallest page_id are
    responses, so repeated rows of that page are responses each; all others revisit it. A null page_id is no smallest one:
    such a row revisits its payload's smallest page, and is a response if there is none. Extra columns are left out.
    """
    spark = pages.sparkSession
    _uri(folder)  # raises before anything runs
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # SHA-1 and length: four bytes more.
    rows = rows.withColumn("digest", F.concat(F.unhex(F.sha1("html")), F.unhex(F.lpad(F.hex(F.octet_length("html").cast("long")), 8, "0"))))
    thin = stored(rows.select("page_id", "digest").distinct(), "digests")
    first = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    # Only pages that revisit another one. Nothing after the join groups by the digest, so AQE can split a hot one.
    later = thin.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    later = stored(later.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")), "later")
    tagged = rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    tagged = tagged.select(_key(F.col("url")).alias("url_key"), "page_id", "url", "html", "refers_to")
    entries = stored(tagged.mapInArrow(_writer(f"{folder}/records"), _ENTRY_SQL), "captures")
    n = max(1, min(partitions(spark), -(-entries.count() // BLOCK_LINES)))
    sorted_lines = entries.repartitionByRange(n, "url_key", "file", "offset").sortWithinPartitions("url_key", "file", "offset")
    directory = stored(sorted_lines.mapInArrow(_indexer(f"{folder}/index"), "first_key string, last_key string, file string, offset long, length long, n long"), "directory")
    return entries, directory


def _block_reader(folder: str):
    """The index lines of blocks; of a block with ``keys`` only theirs, by binary search."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_folder(folder)
        for batch in batches:
            for block in batch.to_pylist():
                with files.open_input_file(f"{root}/{block['file']}") as f:
                    text = gzip.decompress(f.read_at(block["length"], block["offset"])).decode()
                rows = [json.loads(x) for x in text.splitlines()]
                if "keys" in block:
                    keys = [r[0] for r in rows]
                    rows = [r for k in block["keys"] for r in rows[bisect_left(keys, k) : bisect_right(keys, k)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)

    return read


_FOUND = "file string, offset long, length long, keys array<string>"


def _blocks_of(asked: pa.Table, directory: pa.Table) -> pa.Table:
    """The blocks of one index file that may hold each asked key, with their keys."""
    blocks = directory.sort_by("offset").to_pylist()
    first, last = [b["first_key"] for b in blocks], [b["last_key"] for b in blocks]
    keys: dict[int, list[str]] = {}
    for key in sorted(asked.column("url_key").to_pylist()):
        for i in range(bisect_left(last, key), bisect_right(first, key)):
            keys.setdefault(i, []).append(key)
    rows = [{"file": blocks[i]["file"], "offset": blocks[i]["offset"], "length": blocks[i]["length"], "keys": k} for i, k in keys.items()]
    return pa.Table.from_pylist(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("keys", pa.list_(pa.string()))]))


def _record_reader(folder: str, payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_folder(folder)
        for batch in batches:
            name, f, have, start, rows, size = None, None, b"", 0, [], 0
            for entry in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if entry[0] != name:
                    if f is not None:
                        f.close()
                    name, have = entry[0], b""
                    f = files.open_input_file(f"{root}/{name}")
                at = entry[1] - start
                if not have or at < 0 or at + entry[2] > len(have):  # neighbours are read in one range
                    start, at = entry[1], 0
                    have = f.read_at(max(entry[2], 1 << 20), start)
                row = _parse(gzip.GzipFile(fileobj=io.BytesIO(have[at : at + entry[2]])).read())
                if not payload:
                    row["payload"] = None
                rows.append(row)
                size += len(row["payload"] or b"")
                if size >= BUFFER:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                    rows, size = [], 0
            if f is not None:
                f.close()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return read


def read_archives(directory: DataFrame, folder: str, *, payload: bool = True) -> DataFrame:
    """Every record, through the index's blocks: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from the payload that was read, and must agree with its headers.
    """
    n = partitions(directory.sparkSession)
    entries = directory.repartition(n, "file", "offset").mapInArrow(_block_reader(f"{folder}/index"), _ENTRY_SQL)
    spread = entries.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(_record_reader(f"{folder}/records", payload), _READ_SQL)


def _key(url: Column) -> Column:
    return F.concat(reversed_host(host_of(url)), F.lit(")"), path_of(url))


def lookup_all(directory: DataFrame, folder: str, urls: DataFrame, *, payload: bool = True) -> DataFrame:
    """The captures whose key is that of one of ``urls`` (url), each once: by binary searches, as described above."""
    n = partitions(directory.sparkSession)
    ranges = directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    bounds = sorted((r["first"], r["last"], r["file"]) for r in ranges.collect())  # a row for each index file
    first, last, names = ([b[i] for b in bounds] for i in range(3))

    @F.pandas_udf("array<string>")
    def files_of(keys):
        import pandas as pd

        return pd.Series([names[bisect_left(last, k) : bisect_right(first, k)] for k in keys])

    asked = urls.select(_key(F.col("url")).alias("url_key")).distinct().select("url_key", F.explode(files_of("url_key")).alias("file"))
    blocks = asked.groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(_blocks_of, _FOUND)
    entries = blocks.repartition(n, "file", "offset").mapInArrow(_block_reader(f"{folder}/index"), _ENTRY_SQL)
    spread = entries.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(_record_reader(f"{folder}/records", payload), _READ_SQL)


def lookup(directory: DataFrame, folder: str, url: str) -> DataFrame:
    """The captures of one url."""
    return lookup_all(directory, folder, directory.sparkSession.range(1).select(F.lit(url).alias("url")))


#: Pages whose id this divides are also looked up by their url in the registered query.
LOOKED_UP = 50


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page read back; ``found_by_url`` says of the pages that are looked up whether that gave the same record."""
    folder = new_folder(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    _, directory = write_archives(pages, folder)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = read_archives(directory, folder, payload=False).select(*columns)
    chosen = F.col("page_id") % LOOKED_UP == 0
    found = lookup_all(directory, folder, pages.where(chosen).select("url"), payload=False).where(chosen).select(*columns).distinct()
    found = found.select(*[F.col(c).alias(f"f_{c}") for c in columns])
    same = (F.col("page_id") == F.col("f_page_id")) & F.struct(*columns[1:]).eqNullSafe(F.struct(*[F.col(f"f_{c}").alias(c) for c in columns[1:]]))
    return whole.join(found, same, "left").select(*columns, F.when(chosen, F.col("f_page_id").isNotNull()).alias("found_by_url"))


SQL = {
    "op7_warc": """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h from p),
f as (select h, payload_bytes, min(page_id) as first from d group by all)
select page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, 5 * (j // 4) + 1, 5) as integer) >> cast(15 - 5 * (j % 4) as integer)) & 31), 1) for j in range(32)], '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to, case when page_id % 50 = 0 then true end as found_by_url
from d join f using (h, payload_bytes)
"""
}
