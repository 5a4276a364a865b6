"""WARC archives as a chunked record table.

Writing: each task writes one archive (a gzip member per record) under a name of its own and renames it when
it is whole, so a repeated attempt leaves one archive. Payloads of ``min_dedup`` bytes or more that are equal
(SHA-1 and length) are stored once: the record with the largest page_id is the response, others revisit it.
Only digests are compared, by a partial aggregate, so a payload that a third of all pages share is one row.

Reading: an archive is a stream. A payload comes as rows (archive, record, chunk_no, chunk) of at most
``chunk`` bytes, each with the bytes and the SHA-1 so far; whole records are never held. The last chunk of a
record carries the digest of its payload.

Null html is an empty payload; null url leaves the field out; null page_ids are responses; repeated rows are
written each, as responses where they are the largest of their payload; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

CHUNK = 1 << 20
_PIECE = 1 << 16
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _head(page: int | None, url: str | None, digest: str, size: int, lead: int | None, date: str) -> bytes:
    """WARC and HTTP header; a revisit has the HTTP header alone for a block."""
    http = _HTTP % size
    lines = ["WARC/1.1", f"WARC-Type: {'response' if lead is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if lead is not None:
        lines += [f"WARC-Refers-To: {record_id(lead)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if lead is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def lead_pages(pages: DataFrame, min_dedup: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a larger page_id has too."""
    body = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    seen = materialize(pages.filter("page_id is not null").select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n")).filter(F.col("n") >= min_dedup), "warc-digests")
    leads = seen.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to").drop("least")
    return seen.join(leads, ["digest", "n"]).filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, min_dedup: int = 1000, date: str = _DATE) -> DataFrame:
    """Writes the archives and returns (archive, records), one row each, already executed."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    leads = lead_pages(rows, min_dedup).select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to")
    body = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    records = rows.withColumn("body", body).withColumn("digest", F.sha1("body"))
    records = records.join(leads, (F.col("page_id") == F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").select("page_id", "url", "digest", "refers_to", "body")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.gz"
        open_name = f"{base}/.{name}.{task.taskAttemptId()}"
        count = 0
        with store.open_output_stream(open_name, compression=None) as out:
            for batch in batches:
                bodies = batch.column("body")
                for i, (page, url, digest, lead) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")), strict=True)):
                    payload = bodies[i].as_buffer()
                    zipper = zlib.compressobj(3, wbits=31)
                    out.write(zipper.compress(_head(page, url, digest, payload.size, lead, date)))
                    if lead is None:
                        for at in range(0, payload.size, CHUNK):
                            out.write(zipper.compress(payload[at : at + CHUNK]))
                    out.write(zipper.compress(b"\r\n\r\n") + zipper.flush())
                    count += 1
        store.move(open_name, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "records"])

    done = records.mapInArrow(run, "archive string, records long")
    return materialize(done, "warc-written")


class _Stream:
    """Bytes of an archive in pieces, gzip members joined (or plain bytes)."""

    def __init__(self, source, zipped: bool):
        self.source, self.zipped, self.held, self.left = source, zipped, bytearray(), b""
        self.unzip = zlib.decompressobj(wbits=31)

    def _more(self) -> bool:
        if not self.zipped:
            piece = self.source.read(_PIECE)
            self.held += piece
            return bool(piece)
        while True:
            raw = self.left or self.source.read(_PIECE)
            if not raw:
                return False
            piece = self.unzip.decompress(raw, _PIECE)
            if self.unzip.eof:
                self.left = self.unzip.unused_data
                self.unzip = zlib.decompressobj(wbits=31)
            else:
                self.left = self.unzip.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end of the archive."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends in a header")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends in a record")
            piece = bytes(self.held[:n])
            del self.held[: len(piece)]
            n -= len(piece)
            yield piece


def chunks_of(source, zipped: bool = True, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of the chunked record table of one archive stream."""
    stream, number = _Stream(source, zipped), 0
    while (head := stream.head()) is not None:
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields["content-length"])
        http = b""
        if "application/http" in fields.get("content-type", ""):
            before = len(stream.held)
            http = stream.head() or b""
            size -= len(http) + 4
            del before
        row = {"record": number, "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "header_digest": fields.get("warc-payload-digest"), "http_length": int(m[1]) if (m := re.search(rb"(?i)content-length: *(\d+)", http)) else None}
        digest, seen, no, held = hashlib.sha1(), 0, 0, bytearray()
        for piece in stream.take(size):
            held += piece
            while len(held) > chunk:  # the last chunk is kept back, to be marked
                part = bytes(held[:chunk])
                del held[:chunk]
                digest.update(part)
                seen += len(part)
                yield row | {"chunk_no": no, "last": False, "bytes_so_far": seen, "sha1_so_far": digest.hexdigest(), "chunk": part}
                no += 1
        digest.update(held)
        yield row | {"chunk_no": no, "last": True, "bytes_so_far": seen + len(held), "sha1_so_far": digest.hexdigest(), "chunk": bytes(held)}
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError(f"record {number} doesn't end where it should")
        number += 1


_KINDS = {"archive": "string", "record": "long", "record_id": "string", "record_type": "string", "refers_to": "string", "uri": "string", "header_digest": "string", "http_length": "long", "chunk_no": "long", "last": "boolean", "bytes_so_far": "long", "sha1_so_far": "string", "chunk": "binary"}


def read(spark: SparkSession, folder: str, archives: list[str], with_payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in ``folder``; one task for each archive."""
    if not archives:
        return spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in _KINDS.items()))
    names = spark.sparkContext.broadcast(sorted(archives))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        store, base = fs.FileSystem.from_uri(folder)

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, t in _KINDS.items()], names=list(_KINDS))

        for batch in batches:
            for i in batch.column("id").to_pylist():
                name = names.value[i]
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    rows, much = [], 0
                    for r in chunks_of(source, name.endswith(".gz"), chunk):
                        rows.append(r | {"archive": name} | ({} if with_payload else {"chunk": None}))
                        much += 200 + (len(r["chunk"]) if with_payload else 0)
                        if much > 4 * CHUNK:
                            yield batch_of(rows)
                            rows, much = [], 0
                    if rows:
                        yield batch_of(rows)

    n = len(archives)
    return spark.range(0, n, 1, n).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in _KINDS.items()))


def _hex(digest: str | None) -> str | None:
    return None if digest is None else base64.b32decode(digest.partition(":")[2]).hex()


def round_trip(pages: DataFrame, min_dedup: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives, reads them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. A response's bytes and digest are those of its chunks, and its header must agree with them; a
    revisit's are its header's."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    archives = [r["archive"] for r in write(pages, folder, min_dedup).filter("records > 0").collect()]  # one name a task

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                whole, said = r["record_type"] == "response", _hex(r["header_digest"])
                if whole and (said, r["http_length"]) != (r["sha1_so_far"], r["bytes_so_far"]):
                    raise ValueError(f"{r['archive']}, record {r['record']}: digest or length differ from the header's")
                page = lambda urn: int(m[1]) if urn and (m := re.search(r"urn:x-page:(-?\d+)", urn)) else None
                rows.append((page(r["record_id"]), r["http_length"], said, r["record_type"], page(r["refers_to"])))
            cols = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    last = read(spark, folder, archives, with_payload=False).filter("last").drop("chunk")
    return last.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
