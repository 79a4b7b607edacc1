"""WARC archives: written as whole-file gzip, normalised to one gzip member a record, read back by offset.

1. `write_archives` builds records with SQL functions and lets Spark's text writer store them: one gzip stream a file.
   Among records with equal payloads (by SHA-1, of at least `min_bytes`) that with the least id is the response; the
   others are revisits that refer to it and carry no payload.
2. `normalise` inflates each file's stream once, in pieces, cuts it at record bounds, deflates every record as a member
   of its own into a new archive, and returns the index of offsets, which is stored beside the archives.
3. `read_records` opens members by offset and reports what is in them.

Archives live in a folder that all executors share. A file is written under another name and moved into place, so a
task that runs again replaces it whole. Memory is one record.

Defined results: a null html is an empty payload; line ends in a url become blanks; rows that repeat a page_id are
records of their own, and those that carry the least id of their payload are all responses; a null page_id is written
empty, read back as null, and refers to the least id of its payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import shared_dir

_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHUNK = 1 << 20


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are four times 40, and base 32 digits map one to one."""
    h = F.sha1(payload.cast("binary"))
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0"), _HEX, _BASE32) for i in range(4)])


def records(pages: DataFrame, *, page_id="page_id", url="url", html="html", min_bytes=0) -> DataFrame:
    """Column `record`: one WARC record as text, without its last line end."""
    p = pages.select(F.col(page_id).alias("id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\r\n]", " ").alias("uri"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", sha1_base32(F.col("payload")))
    firsts = pages.select(F.col(page_id).alias("first"), sha1_base32(F.coalesce(F.col(html).cast("string"), F.lit(""))).alias("digest")).groupBy("digest").agg(F.min("first").alias("first"))
    p = p.join(firsts, "digest")
    size = F.octet_length("payload")
    again = (size >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    crlf = F.lit("\r\n")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    p = p.withColumn("block", block).withColumn("again", again)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), crlf,
        F.lit("WARC-Record-ID: "), name(F.col("id")), crlf, F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("uri"), crlf,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), crlf,
        F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), F.col("block"), crlf,
    )
    return p.select(record.alias("record"))


def write_archives(found: DataFrame, folder: str, records_per_file=50_000) -> None:
    """Whole-file gzip archives; the writer's line end closes each record."""
    found.write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(folder)


class Inflated:
    """A gzip stream of one or more members, as an inflated buffer that is read piece by piece."""

    def __init__(self, source):
        self.source, self.z, self.held = source, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.z.eof:  # the next member
            data, self.z = self.z.unused_data or self.source.read(_CHUNK), zlib.decompressobj(31)
        else:
            data = self.z.unconsumed_tail or self.source.read(_CHUNK)
        made = self.z.decompress(data, 4 * _CHUNK)
        self.held += made
        if not data and not made:
            return False
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (k := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends inside a header")
                return None
        out = bytes(self.held[: k + len(mark)])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int):
        """n bytes, in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError("archive ends inside a record")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]) if k}


def rewrite(source, target, level=6):
    """Writes one member a record; yields (offset, length, headers) of each."""
    stream, offset = Inflated(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = headers(head)
        z, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for part in (head, *stream.take(int(fields["content-length"])), *stream.take(4)):
            size += target.write(z.compress(part)) or 0
        size += target.write(z.flush()) or 0
        yield offset, size, fields
        offset += size


def normalise(spark, source: str, target: str) -> DataFrame:
    """Rewrites every archive of a folder; returns the index archive, number, offset, length, record_id, record_type (lazily)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "length")
    n = max(1, files.count())

    def run(batches):
        from pyarrow import fs

        out_fs, root = fs.FileSystem.from_uri(target)
        for b in batches:
            for path in b.column(0).to_pylist():
                in_fs, place = fs.FileSystem.from_uri(path)
                final = f"{root}/{place.rsplit('/', 1)[1].removesuffix('.txt.gz')}.warc.gz"
                out_fs.create_dir(root, recursive=True)
                part = f"{final}.{uuid.uuid4().hex}.tmp"
                rows = []
                with in_fs.open_input_stream(place, compression=None) as src, out_fs.open_output_stream(part, compression=None) as dst:
                    for k, (offset, size, fields) in enumerate(rewrite(src, dst)):
                        rows.append((final, k, offset, size, fields["warc-record-id"], fields["warc-type"]))
                out_fs.move(part, final)
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 10_000], strict=True)], names=["archive", "number", "offset", "length", "record_id", "record_type"])

    return files.select("path").repartition(n, "path").mapInArrow(run, "archive string, number long, offset long, length long, record_id string, record_type string")


def read_records(index: DataFrame, root: str) -> DataFrame:
    """What the members at the index's offsets hold: page_id text, payload_bytes, payload_digest, record_type, refers_to text."""

    def run(batches):
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(root)
        opened: tuple[str, object] | None = None
        for b in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if opened is None or opened[0] != archive:
                    opened = (archive, files.open_input_file(archive))
                record = zlib.decompress(opened[1].read_at(length, offset), 31)
                head, _, rest = record.partition(b"\r\n\r\n")
                fields = headers(head)
                block = rest[: int(fields["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                name = lambda k: (fields.get(k, "")[len("<urn:page:") : -1]) or None
                rows.append((name("warc-record-id"), size, digest, fields["warc-type"], name("warc-refers-to")))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("archive", "offset", "length").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archive_and_read(pages: DataFrame, *, page_id="page_id", url="url", html="html", min_bytes=0) -> DataFrame:
    """Write, normalise with a sidecar index, and read back: one row per page."""
    spark = pages.sparkSession
    root = shared_dir(spark, "warc")
    write_archives(records(pages, page_id=page_id, url=url, html=html, min_bytes=min_bytes), f"{root}/whole")
    normalise(spark, f"{root}/whole", f"{root}/archives").write.parquet(f"{root}/index")
    kind = pages.schema[page_id].dataType
    got = read_records(spark.read.parquet(f"{root}/index"), root)
    return got.select(F.col("page_id").cast(kind).alias(page_id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
