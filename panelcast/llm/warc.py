"""Web archives with Zstandard: writer and reader.

An archive is a byte string: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
Zstandard frame for each WARC record.  Archives are rows (archive, content) of a table in the shared
folder, each of bounded size, so they need no file system but Spark's own and a retried task writes
its archives again as a whole.  The reader takes any table of that shape, also what
``spark.read.format("binaryFile")`` gives.

Reading: the dictionary is loaded from the leading frame, then frame after frame is decoded, each to
one record, and checked: version line, required headers, declared length against the real one, the
closing empty lines, the digest of a response's payload.  A broken archive is an error that names its
place; nothing is skipped.

Of records with equal payloads of LEAST_REVISIT bytes at least, the one with the largest page_id is
the response and the others revisit it, also those without page_id; if none of them has a page_id, all
are responses, as there is nothing to refer by.  Nulls: a null html is an empty payload, a null url is
left out.  Repeated rows: of equal ids one is the response, the others revisit it; if small, all are
responses.  A revisit names its response by the WARC-Record-ID, so any reader can resolve it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.tables import materialise

MAGIC, LEAST_REVISIT = 0x184D2A5D, 1000
#: Uncompressed bytes of an archive, and of the records from which its dictionary is trained.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 8_000_000, 1_500_000, 32_768
_LINE = b"\r\n"


def _clean(value: str) -> str:
    """A header value: control characters are percent-encoded, so that a value stays one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_name(page_id, digest: str, url=None) -> str:
    """The id of a record; a response is named by page and digest alone, so its revisits know its name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}' if url is None else f'{page_id}:{digest}:{url}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    plain = refers_to is None and page_id is not None
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_name(page_id, digest) if plain else record_name(page_id, digest, f"{kind}:{url}")),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", page_id),
        ("X-Payload-Bytes", len(payload)),
        ("WARC-Refers-To", refers_to if refers_to is None else record_name(refers_to, digest)),
        ("X-Refers-To-Page-ID", refers_to),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head if v is not None)]
    return _LINE.join(x.encode() for x in lines) + 2 * _LINE + block + 2 * _LINE


def parse(raw: bytes, where: str) -> dict:
    """A record's headers and payload, after all checks."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{where}: {what}")

    head, sep, rest = raw.partition(2 * _LINE)
    lines = head.split(_LINE)
    need(bool(sep) and lines[0] == b"WARC/1.1", "not a WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.decode().partition(": ")
        need(bool(colon) and k not in fields, f"bad header {line[:60]!r}")
        fields[k] = v
    for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "X-Payload-Bytes", "Content-Length"):
        need(k in fields, f"no {k}")
    n = int(fields["Content-Length"])
    need(len(rest) == n + 4 and rest[n:] == 2 * _LINE, "length differs from Content-Length")
    http, sep, payload = rest[:n].partition(2 * _LINE)
    need(bool(sep) and http.startswith(b"HTTP/1.1 "), "no HTTP header")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    need(kind in ("response", "revisit"), f"unknown type {kind}")
    if kind == "response":
        need(len(payload) == int(fields["X-Payload-Bytes"]), "payload length differs")
        need(hashlib.sha1(payload).hexdigest() == digest, "payload digest differs")
    else:
        need(not payload and "WARC-Refers-To" in fields, "revisit with payload or without reference")
        need(fields["WARC-Refers-To"] == record_name(fields.get("X-Refers-To-Page-ID"), digest), "reference to another record")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if kind == "response" else None,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
        "payload": payload if kind == "response" else None,
    }


def build(records: list[bytes]) -> bytes:
    """An archive; its dictionary is trained on its own first records, or empty if there are too few."""
    sample, n = [], 0
    for r in records:
        if n > SAMPLE_BYTES:
            break
        sample.append(r)
        n += len(r)
    try:
        trained = zstandard.train_dictionary(min(DICT_BYTES, max(1024, n // 10)), sample).as_bytes()
    except zstandard.ZstdError:  # too few or too short records
        trained = b""
    how = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    packer = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **how)
    return b"".join([struct.pack("<II", MAGIC, len(trained)), trained, *map(packer.compress, records)])


def read(content: bytes, where: str):
    """The records of an archive, one for each frame."""
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != MAGIC:
        raise ValueError(f"{where}: no dictionary frame")
    size = struct.unpack_from("<I", content, 4)[0]
    trained, at, i = content[8 : 8 + size], 8 + size, 0
    if len(trained) != size:
        raise ValueError(f"{where}: dictionary cut short")
    if trained[:4] == struct.pack("<I", 0xFD2FB528):  # the dictionary may be compressed itself
        trained = zstandard.ZstdDecompressor().decompress(trained, max_output_size=1 << 27)
    how = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    reader, view = zstandard.ZstdDecompressor(**how), memoryview(content)
    while at < len(content):
        step = reader.decompressobj()
        raw = step.decompress(view[at:])
        if not step.eof:
            raise ValueError(f"{where}, record {i}: frame cut short")
        yield parse(raw, f"{where}, record {i}")
        at, i = len(content) - len(step.unused_data), i + 1


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content) of one record for each row of *pages* (page_id, url, html), in the shared folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    large = known.where(F.col("n") >= LEAST_REVISIT)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("times")).where("times > 1")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    # what is repeated is joined by digest, a short row; the page itself moves once at most
    met = rows.join(groups.select("digest", "last"), "digest", "left")
    again = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
    same = pages.select("page_id").where("page_id is not null").groupBy("page_id").count().where("count > 1").limit(1)
    if same.count():  # equal ids: only one of them can be the response
        met = met.withColumn("again", F.when(F.col("page_id") == F.col("last"), again).otherwise(1))
    else:
        met = met.withColumn("again", F.lit(1))
    # a page without an id revisits the largest one; where no page has an id, all are responses
    other = F.col("last").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("last")) | (F.col("again") > 1))
    met = met.select("page_id", "url", "html", "digest", F.when(other, F.col("last")).alias("refers_to"))

    def body(batches):
        held, n = [], 0

        def flush():
            content = build(held)
            name = hashlib.sha1(content).hexdigest()
            return pa.record_batch([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page, url, text, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record(page, url, text.encode(), digest, refers)
                held.append(raw)
                n += len(raw)
                if n >= ARCHIVE_BYTES:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return materialise(met.mapInArrow(body, "archive string, content binary"))


_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of *archives* (name, content); payload_bytes of a revisit is its response's."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def body(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, n = [], 0
                for r in read(content.as_py(), name):
                    held.append(r)
                    n += len(r["payload"] or b"") + 200
                    if n > ARCHIVE_BYTES:
                        yield pa.record_batch([pa.array([x[k] for x in held], t) for k, t in zip(names, kinds, strict=True)], names)
                        held, n = [], 0
                yield pa.record_batch([pa.array([x[k] for x in held], t) for k, t in zip(names, kinds, strict=True)], names)

    rows = archives.select(*archives.columns[:2]).mapInArrow(body, _FIELDS + ", payload binary" * payloads)
    known = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("p"), F.col("payload_digest").alias("d")).agg(
        F.max("payload_bytes").alias("known")
    )
    met = rows.join(known, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    return met.withColumn("payload_bytes", F.coalesce("payload_bytes", "known")).drop("p", "d", "known")
