"""WARC archives: writing, and the normalising of gzip files that are one single stream.

An archive compressed as a whole can't be entered in the middle. The normaliser inflates
it once, rewrites every record as a gzip member of its own, and lists each member's place
in a sidecar index, by which records are then read one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, shared_dir, table
from textloom.llm.files import open_file, writer

#: Smallest payload that a revisit record can stand for.
REVISIT_BYTES = 1000
#: Uncompressed bytes of an archive before the next one begins; compression level; bytes inflated at a time.
ARCHIVE_BYTES, LEVEL, STEP = 1 << 30, 4, 1 << 20
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _urn(number: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=1 << 64 if number is None else number % (1 << 64))}>"


def _number(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    return None if value >> 64 else value - (1 << 64) * (value >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the response of page ``refers_to``, which keeps the HTTP header only."""
    revisit = refers_to is not None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) of each record of an uncompressed archive; holds one record and one chunk."""
    held = bytearray()
    ended = False
    while True:
        at = held.find(b"\r\n\r\n")
        if at >= 0:
            fields = headers(bytes(held[:at]))
            size = at + 4 + int(fields["content-length"]) + 4
            if len(held) >= size:
                yield fields, bytes(held[:size])
                del held[:size]
                continue
        if ended:
            if held.strip():
                raise ValueError("the archive ends inside a record")
            return
        chunk = next(chunks, None)
        ended = chunk is None
        held += chunk or b""


def inflate(source: pa.NativeFile, step: int = STEP) -> Iterator[bytes]:
    """The contents of a gzip file of one member or many, inflated in one pass.

    Zeros behind a member are padding. A file that ends inside a member, or holds anything else
    than gzip, is an error, also where the cut lies at a record's end.
    """
    unzip, raw, begun = zlib.decompressobj(31), b"", False
    while True:
        raw = raw or source.read(step)
        if not raw:
            break
        if not begun:
            raw = raw.lstrip(b"\0")
            if not raw:
                continue
        begun = True
        try:
            data = unzip.decompress(raw, step)
        except zlib.error as error:
            raise ValueError(f"no gzip member: {error}") from error
        if data:
            yield data
        raw = unzip.unconsumed_tail
        if unzip.eof:
            raw, unzip, begun = unzip.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``page_id``, ``url``, ``payload``, ``refers_to`` rows as gzip files of a single stream each; returns their ``path``s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4))))
        part, number = TaskContext.get().partitionId(), 0
        row = next(rows, None)
        while row is not None:
            path = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
            size, n = 0, 0
            with writer(path) as out:
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                while row is not None and size < archive_bytes:
                    data = record(*row)
                    out.write(pack.compress(data))
                    size, n = size + len(data), n + 1
                    row = next(rows, None)
                out.write(pack.flush())
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "n": pa.array([n])})
            number += 1

    return cut(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, n long"))


def _a_task_each(files: DataFrame) -> DataFrame:
    """A table of files with every row in a partition of its own."""
    number = (F.row_number().over(Window.orderBy("path")) - 1).alias("number")
    return files.select("*", number).repartitionById(max(1, files.count()), "number").drop("number")


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """Rewrite archives (``path``) with a gzip member for each record; returns ``path``, ``index_path``, ``n``.

    Each archive is inflated once, in steps, by one task; it may have one member or many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = path.removesuffix(".warc.gz") + ".members.warc.gz"
                index_path = target.removesuffix(".gz") + ".idx.arrow"
                offset, rows, n = 0, [], 0
                with writer(target) as out, writer(index_path) as side, pa.ipc.new_stream(side, INDEX) as index:
                    for fields, whole in records(inflate(open_file(path))):
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        rows.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), offset, len(member)))
                        offset, n = offset + len(member), n + 1
                        if len(rows) == 10_000:
                            index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types)], schema=INDEX))
                            rows = []
                    if rows:
                        index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types)], schema=INDEX))
                yield pa.RecordBatch.from_pydict({"path": pa.array([target]), "index_path": pa.array([index_path]), "n": pa.array([n])})

    return cut(_a_task_each(archives).mapInArrow(run, "path string, index_path string, n long"))


def read_member(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record's gzip member."""
    raw = zlib.decompress(data, 31)
    at = raw.index(b"\r\n\r\n")
    fields = headers(raw[:at])
    block = raw[at + 4 : at + 4 + int(fields["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return fields, headers(head), payload


def read_archives(files: DataFrame) -> DataFrame:
    """Read every record by its place in the index: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A response whose payload has another digest or length than its header says is an error.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index_path in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist()):
                source = open_file(path)
                for entries in pa.ipc.open_stream(open_file(index_path)):
                    rows = []
                    for offset, length in zip(entries.column("offset").to_pylist(), entries.column("length").to_pylist()):
                        fields, http, payload = read_member(source.read_at(length, offset))
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(http["content-length"])
                        refers = fields.get("warc-refers-to")
                        if refers is None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{path} at {offset}: the payload doesn't match its header")
                        rows.append((_number(fields["warc-record-id"]), size, digest, fields["warc-type"], None if refers is None else _number(refers)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return _a_task_each(files).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``refers_to``: of equal payloads of ``least`` bytes or more all but the largest id refer to that.

    Payloads are not shuffled by digest: only ids and digests are, salted, as one payload may be a third of all.
    A null page is empty. Rows that share the largest id stay responses.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    marked = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")).filter(F.col("bytes") >= least).select("page_id", "digest")
    latest = marked.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("other")).filter("refers_to != other").drop("other")
    spread = latest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    revisits = salted.join(spread, ["digest", "salt"]).filter("page_id != refers_to").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    return rows.join(revisits, (rows["page_id"] == revisits["_id"]) & (F.sha1("payload") == revisits["_digest"]), "left").select("page_id", "url", "payload", "refers_to")


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages to single-stream archives below ``folder`` and normalise those."""
    return normalise(write_archives(with_revisits(pages), folder))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(archive(table(spark, sf_dir, "pages"), shared_dir(spark, "warc")))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS latest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN latest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest > page_id THEN latest END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
