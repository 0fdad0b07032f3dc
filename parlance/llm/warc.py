"""Web archives with large records handled in chunks.

`write_archives` writes one WARC record per page, each a gzip member of its own. Of pages with equal payloads the one with the
least id is a ``response``; the others are ``revisit`` records that name it and carry its digest but no payload.
`read_chunks` streams archives as a table of (record, chunk number) rows: payload bytes are inflated a little at a
time, and each row carries the digest of all payload up to its end, so neither a record nor an archive is ever held whole
and a consumer can check or resume at any chunk. `chunk_records` folds the rows into one per record without joining
payloads; records are told apart by file and place, not by the page's id.

Tasks write under names no other attempt uses and report them in a manifest stored by Spark; leftovers of lost executors are
in no manifest.

Cases: a null payload is empty, and an empty one is a payload like others unless `least_bytes` excludes it; a null id
sorts after all others and never names a response if another id can; every page row is a record of its own: rows that
repeat an id with other payloads stay apart, and rows that share both the id and the payload of a response are responses
too, since a revisit could only name itself (likewise null ids if no page with an id has the payload); an empty table
writes nothing and reads back empty. Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.tables import file_system, output_folder, stored, unique_name

CHUNK_BYTES = 1 << 16
PAGES_PER_FILE = 4096
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def record_id(page: object) -> str:
    return f"<urn:page:{page}>"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, built from five hexadecimal digits at a time."""
    digest = F.sha1(payload)

    def letters(piece: int) -> Column:
        number = F.conv(F.substring(digest, 5 * piece + 1, 5), 16, 10).cast("bigint")
        return F.concat(*[
            F.substring(F.lit(BASE32), (F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
            for shift in (15, 10, 5, 0)
        ])

    return F.concat(*[letters(piece) for piece in range(8)])


def plan_records(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url",
                 least_bytes: int = 0) -> DataFrame:
    """Pages with digest, record_type and refers_to. Only digests and ids are grouped; payloads are not moved for it."""
    payload = F.coalesce(pages[payload_column].cast("string"), F.lit("")).cast("binary")
    flat = pages.select(
        pages[id_column].alias("page"), pages[url_column].cast("string").alias("url"), payload.alias("payload"),
    ).withColumn("digest", sha1_base32(F.col("payload")))
    firsts = (
        flat.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("page").alias("leader"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "leader")
    )
    again = F.col("leader").isNotNull() & ~F.col("leader").eqNullSafe(F.col("page"))
    return flat.join(firsts, "digest", "left").select(
        "page", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("leader")).alias("refers_to"),
    )


def _header(page, url, payload_bytes: int, digest: str, kind: str, refers_to, block_bytes: int) -> bytes:
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page)), ("WARC-Target-URI", (url or "").replace("\n", " ").replace("\r", " ")),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(payload_bytes)), ("Content-Type", "text/html"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(block_bytes)))
    return VERSION + b"\r\n" + b"".join(f"{name}: {value}\r\n".encode() for name, value in fields) + b"\r\n"


def _write_record(sink, header: bytes, payload: pa.Buffer, chunk: int) -> None:
    """A gzip member, deflated chunk by chunk."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    sink.write(press.compress(header))
    for begin in range(0, payload.size, chunk):
        sink.write(press.compress(payload.slice(begin, min(chunk, payload.size - begin))))
    sink.write(press.compress(b"\r\n\r\n"))
    sink.write(press.flush())


def write_archives(planned: DataFrame, folder: str | None = None, chunk: int = CHUNK_BYTES) -> tuple[str, DataFrame]:
    """Write planned records; returns the folder and the manifest (file, n_records)."""
    folder = folder or output_folder(planned.sparkSession, "warc")
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        sink, name, count, done = None, "", 0, []
        for batch in batches:
            columns = {field: batch.column(field) for field in batch.schema.names}
            for row in range(batch.num_rows):
                if sink is not None and count >= PAGES_PER_FILE:
                    sink.close()
                    done.append((name, count))
                    sink = None
                if sink is None:
                    name, count = unique_name("pages", ".warc.gz"), 0
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                page, url, digest, kind, refers = (
                    columns[c][row].as_py() for c in ("page", "url", "digest", "record_type", "refers_to"))
                payload = columns["payload"][row].as_buffer()
                block = payload if kind == "response" else pa.py_buffer(b"")
                _write_record(sink, _header(page, url, payload.size, digest, kind, refers, block.size), block, chunk)
                count += 1
        if sink is not None:
            sink.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "n_records"])

    return folder, stored(planned.mapInArrow(write, "file string, n_records bigint"), "warc-manifest")


class RecordStream:
    """Headers and payload pieces of a gzip archive, inflated a bounded piece at a time."""

    def __init__(self, source, chunk: int):
        self.source, self.chunk = source, chunk
        self.press = zlib.decompressobj(31)
        self.rest = b""
        self.held = bytearray()
        self.over = False

    def _more(self) -> bool:
        while not self.over:
            if not self.rest:
                self.rest = self.source.read(self.chunk)
            if not self.rest:
                self.over = True
                break
            piece = self.press.decompress(self.rest, self.chunk)
            self.rest = self.press.unconsumed_tail
            if self.press.eof:
                self.rest = self.press.unused_data
                self.press = zlib.decompressobj(31)
            if piece:
                self.held += piece
                return True
        return False

    def header(self) -> dict[str, str] | None:
        """The next record's fields, or None at the end."""
        while True:
            end = self.held.find(b"\r\n\r\n")
            if end >= 0:
                lines = self.held[:end].decode().split("\r\n")
                del self.held[: end + 4]
                if lines[0] != VERSION.decode():
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                return dict(line.split(": ", 1) for line in lines[1:])
            if not self._more():
                if self.held:
                    raise ValueError("an archive ends inside a header")
                return None

    def payload(self, size: int) -> Iterator[bytes]:
        """Payload pieces of `chunk` bytes, the last one shorter; then the record's end is skipped."""
        while size > 0:
            want = min(self.chunk, size)
            while len(self.held) < want:
                if not self._more():
                    raise ValueError("an archive ends inside a payload")
            yield bytes(self.held[:want])
            del self.held[:want]
            size -= want
        while len(self.held) < 4:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        del self.held[:4]


_CHUNK_SCHEMA = pa.schema([
    ("file", pa.string()), ("record", pa.int64()),
    ("record_id", pa.string()), ("chunk", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string()),
    ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()),
    ("digest", pa.string()), ("last", pa.bool_()),
])


def read_chunks(spark: SparkSession, folder: str, manifest: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Rows (file, record, record_id, chunk, ..., offset, payload, digest, last): payload pieces with the digest so far."""

    def base32(state) -> str:
        return base64.b32encode(state.digest()).decode()

    def records(name: str, stream: RecordStream):
        place = -1
        while (fields := stream.header()) is not None:
            place += 1
            size = int(fields["Content-Length"])
            state, number, offset = hashlib.sha1(), 0, 0
            shared = (fields["WARC-Type"], fields.get("WARC-Refers-To"), int(fields["X-Payload-Length"]),
                      fields["WARC-Payload-Digest"].removeprefix("sha1:"))
            if not size:
                yield (name, place, fields["WARC-Record-ID"], 0, *shared, 0, b"", base32(state), True)
            for piece in stream.payload(size):
                state.update(piece)
                yield (name, place, fields["WARC-Record-ID"], number, *shared, offset, piece, base32(state), offset + len(piece) == size)
                number, offset = number + 1, offset + len(piece)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for row in records(name, RecordStream(source, chunk)):
                        rows.append(row)
                        held += len(row[9])
                        if held >= 64 * chunk or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    schema = (
        "file string, record bigint, record_id string, chunk bigint, record_type string, refers_to string, declared_bytes bigint, "
        "declared_digest string, offset bigint, payload binary, digest string, last boolean"
    )
    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, field.type) for c, field in zip(columns, _CHUNK_SCHEMA, strict=True)], schema=_CHUNK_SCHEMA)


def chunk_records(chunks: DataFrame) -> DataFrame:
    """One row per record: its type and reference, payload size and digest, from its chunk rows.

    A response's size and digest are those of its chunks; a revisit, which has no payload, declares those of the record it
    names. `whole` tells whether a response's chunks agree with what its header declares.
    """
    folded = chunks.withColumn("size", F.octet_length("payload").cast("bigint")).groupBy("file", "record").agg(
        F.first("record_id").alias("record_id"), F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"),
        F.first("declared_bytes").alias("declared_bytes"), F.first("declared_digest").alias("declared_digest"),
        F.sum("size").alias("read_bytes"), F.max(F.when(F.col("last"), F.col("digest"))).alias("read_digest"),
    )
    response = F.col("record_type") == "response"
    return folded.select(
        "record_id", "record_type", "refers_to",
        F.when(response, F.col("read_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("read_digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        (~response | ((F.col("read_bytes") == F.col("declared_bytes")) & (F.col("read_digest") == F.col("declared_digest")))).alias("whole"),
    )
