"""WARC archives with a two-level capture index (operator 2).

Every page becomes a gzip member of its own in an archive file, a response or, when another page with the same payload
is the response, a revisit. The capture index has a line per record, sorted by reversed-host URL key, in compressed
blocks; a sparse directory has the first key of each block. A look-up searches the directory, reads one block, searches
that, and reads the record's bytes alone.

Files are written under the shared folder, by any file system that pyarrow opens; a task writes to names of its own and
returns them, so what a lost task left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from functools import cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.session import durable, scratch_path

#: Bytes of an archive file before the next one is begun, and records of an index block.
FILE = 256 << 20
BLOCK = 1000
#: Bytes of an archive that go to one task when it is read.
STRETCH = 1 << 20
DATE = "2024-01-01T00:00:00Z"
#: What a record's URI keeps as it is; blanks, control characters and non-ASCII are percent-encoded.
SAFE = "!#$%&'()*+,-./:;=?@[]_~"


@cache
def file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
    return fs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def write_record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit has no payload; its own length and digest stay in its header."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, SAFE)}"]), f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Page-Id: {json.dumps(page_id)}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {json.dumps(refers_to)}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record. The block is taken by its length, whatever it contains."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    return fields, rest[:size]


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def url_key(url: str | None) -> str:
    """Reversed host, then the path and query: ``http://www.a.org/x`` gives ``org,a,www)/x``. Null gives ``)``."""
    try:
        p = urlsplit(url or "")
        host = (p.hostname or "").lower()
    except ValueError:
        return f"){url}"
    return f"{','.join(reversed(host.split('.')))}){p.path or '/'}{'?' + p.query if p.query else ''}"


WRITTEN = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages (page_id, url, html, revisit, refers_to) to archive files; returns key, page_id, file, offset, length."""

    def run(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        out = name = None
        at = 0
        try:
            for b in batches:
                rows = []
                cols = [c.to_pylist() for c in b.columns]
                for page_id, url, html, revisit, refers_to in zip(*cols):
                    if out is None or at > FILE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    data = member(write_record(page_id, url, (html or "").encode(), refers_to, revisit))
                    out.write(data)
                    rows.append((url_key(url), page_id, name, at, len(data)))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                        names=["key", "page_id", "file", "offset", "length"],
                    )
        finally:
            if out is not None:
                out.close()

    return pages.select(F.col("page_id").cast("long"), "url", "html", "revisit", "refers_to").mapInArrow(run, WRITTEN)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Blocks of the capture index in files; returns the directory: first_key, last_key, records, file, offset, length.

    Captures are range-partitioned by key (repeated keys apart by page_id), so the blocks are sorted across files.
    """

    def run(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        name, at, out, held, done = f"{uuid.uuid4().hex}.cdx.gz", 0, None, [], []

        def block():
            nonlocal at
            data = member("".join(json.dumps(r) + "\n" for r in held).encode())
            out.write(data)
            done.append((held[0][0], held[-1][0], len(held), name, at, len(data)))
            at += len(data)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                held.append(row)
                if len(held) == BLOCK:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
        if done:
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["first_key", "last_key", "records", "file", "offset", "length"])

    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.repartitionByRange(tasks, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return dealt.mapInArrow(run, "first_key string, last_key string, records long, file string, offset long, length long")


def read_range(folder: str, name: str, offset: int, length: int, open_files: dict | None = None) -> bytes:
    fs, top = file_system(folder)
    held = open_files if open_files is not None else {}
    if name not in held:
        for f in held.values():
            f.close()
        held.clear()
        held[name] = fs.open_input_file(f"{top}/{name}")
    return zlib.decompress(held[name].read_at(length, offset), 31)


def index_block(folder: str, name: str, offset: int, length: int) -> list[list]:
    return [json.loads(line) for line in read_range(folder, name, offset, length).splitlines()]


def look_up(directory: list[tuple], keys: list[str], index: str, archive: str) -> dict[str, list[tuple[dict, bytes]]]:
    """Records of each key. directory: sorted rows of :func:`write_index`.

    Two binary searches (in the directory, in a block) and range reads only; a key may run over several blocks.
    """
    firsts, lasts = [d[0] for d in directory], [d[1] for d in directory]
    out = {}
    for key in keys:
        found = []
        for d in directory[bisect_left(lasts, key) : bisect_right(firsts, key)]:
            rows = index_block(index, *d[3:6])
            own = [r[0] for r in rows]
            for _, _, name, at, size in rows[bisect_left(own, key) : bisect_right(own, key)]:
                found.append(read_record(read_range(archive, name, at, size)))
        out[key] = found
    return out


def read_index(directory: DataFrame, index: str) -> DataFrame:
    """All captures from the blocks of the index: page_id, file, offset, length."""

    def run(batches):
        for b in batches:
            for place in zip(*(c.to_pylist() for c in b.columns)):
                rows = [r[1:] for r in index_block(index, *place)]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "file", "offset", "length"])

    tasks = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = directory.select("file", "offset", "length").repartition(tasks, "file", "offset")
    return places.mapInArrow(run, "page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, archive: str) -> DataFrame:
    """captures (file, offset, length) to page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each payload is checked against its digest. A task reads stretches of files forward, a file's stretches apart.
    """

    def run(batches):
        files: dict = {}
        for b in batches:
            rows = []
            for name, at, size in zip(*(c.to_pylist() for c in b.columns[:3])):
                fields, body = read_record(read_range(archive, name, at, size, files))
                revisit = fields["WARC-Type"] == "revisit"
                told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and (digest(body) != told or len(body) != int(fields["X-Payload-Length"])):
                    raise ValueError("a payload differs from its digest")
                rows.append((json.loads(fields["X-Page-Id"]), int(fields["X-Payload-Length"]), told, fields["WARC-Type"], json.loads(fields["X-Refers-To-Page"]) if revisit else None))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for f in files.values():
            f.close()

    stretch = F.floor(F.col("offset") / STRETCH)
    # the places are small beside what they stand for, so the number of tasks goes by that
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 * STRETCH)))
    dealt = captures.select("file", "offset", "length", stretch.alias("stretch")).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, least: int = 0) -> tuple[DataFrame, str, str]:
    """Write pages (page_id, url, html) as archives and index. Returns the directory, the index's and archives' folders.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the response, the
    others revisit it. A null html is an empty payload. Rows that repeat a page_id and payload are all of the same type;
    a null page_id is the response only where its group has no other.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("size"))
    groups = durable(keyed.groupBy("sha").agg(F.count("*").alias("copies"), F.max("page_id").alias("last")).filter("copies > 1"), "payloads")
    told = keyed.join(groups, "sha", "left")
    revisit = F.coalesce((F.col("size") >= least) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.lit(False))
    rows = told.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))
    spark = pages.sparkSession
    archive, index = scratch_path(spark, "warc"), scratch_path(spark, "cdx")
    captures = durable(write_archives(rows, archive), "captures")
    return durable(write_index(captures, index), "directory"), index, archive


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory, index, archive = archived(table(spark, sf_dir, "pages"))
    return read_records(durable(read_index(directory, index), "places"), archive)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex FROM p GROUP BY h),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(hex, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN d USING (h)
"""
