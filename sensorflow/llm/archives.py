"""Web archives in Zstandard: one frame per record, a dictionary in the leading frame.

`write` makes a record per page. Of pages whose payloads of at least `least` bytes are
equal, the smallest page_id is the response and the others revisit it without a body.
Each task writes one archive: a skippable frame with a dictionary trained on its first
payloads, then a frame per record. Spark's own text writer puts the frames into files,
with an empty skippable frame as line separator, so commits, retries and any file system
work as for other tables. `read` takes such files, or others of the same format.

Null html is an empty payload. A null url gives a record without a target. A null page_id
is kept; it revisits a page with an id, and is a response where no equal page has one.
Rows that repeat with the smallest page_id are all responses. An empty table gives an
archive folder without records. Other columns are not read. A damaged record comes back
with an `error` and no other field.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.llm.tables import in_workers, written

# Fixed values of the archive format and of the frame format.
VERSION = "WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Frames are lines of a text file; this empty skippable frame ends each.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
#: Bounds of what a dictionary is trained on; they change sizes, never content.
TRAIN_PAGES, TRAIN_BYTES, DICTIONARY_BYTES = 300, 1 << 20, 1 << 15
FEED = 1 << 16

RECORDS = (
    "page_id long, target string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary, error string"
)


# One record -----------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ValueError(f"no page record id: {name[:80]}")
    inner = name[len("<urn:page:") : -1]
    return int(inner) if inner else None


def record(page_id, url, payload: bytes, digest: str, size: int, revisit: bool, refers_to, date: str) -> bytes:
    """The bytes of a response, or of a revisit, which keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PLAIN = "".join(map(chr, range(33, 127)))


def _fields(lines: list[bytes]) -> dict[str, str]:
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or name != name.strip():
            raise ValueError(f"bad header line: {line[:80]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    return fields


def parsed(raw: bytes) -> dict:
    """The fields of one record; raises ValueError where header, length or digest is wrong."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] != VERSION.encode():
        raise ValueError("no record head")
    fields = _fields(lines[1:])
    missing = [name for name in REQUIRED if name.lower() not in fields]
    if missing:
        raise ValueError(f"no {', '.join(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, not {length}")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no HTTP head")
    size = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    kind = fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload length or digest differs")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a body")
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "target": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
        "error": None,
    }


# One archive ----------------------------------------------------------------


def trained(payloads: list[bytes]) -> bytes:
    """A dictionary from some payloads; none if they are too few or too short."""
    sample, size = [], 0
    for payload in payloads[:TRAIN_PAGES]:
        if size + len(payload) <= TRAIN_BYTES:
            sample.append(payload)
            size += len(payload)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _write(batches, date):
    compressor = None
    for batch in batches:
        rows = batch.to_pylist()
        frames = []
        if compressor is None and rows:
            dictionary = trained([r["payload"] for r in rows[:TRAIN_PAGES]])
            if dictionary:
                frames.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True)
        for r in rows:
            raw = record(
                r["page_id"], r["url"], r["payload"], r["digest"], r["size"], r["revisit"], r["refers_to"], date
            )
            frames.append(compressor.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])


def frames(archive: memoryview):
    """The decoded content of each frame; the leading dictionary serves all of them."""
    at, dictionary = 0, None
    while at < len(archive):
        if len(archive) - at < 8:
            raise ValueError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if at + 8 + size > len(archive):
                raise ValueError("the archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                content = bytes(archive[8 : 8 + size])
                if content[:4] == struct.pack("<I", 0xFD2FB528):  # itself a frame
                    content = zstandard.ZstdDecompressor().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            at += 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts = []
        while not decoder.eof:
            if at >= len(archive):
                raise ValueError("the archive ends inside a frame")
            feed = archive[at : at + FEED]
            parts.append(decoder.decompress(feed))
            at += len(feed) - len(decoder.unused_data)
        yield b"".join(parts)


_NOTHING = dict.fromkeys(f.split()[0] for f in RECORDS.split(", "))


def records(archive: memoryview):
    """Every record of an archive; a damaged frame ends it with an error record."""
    try:
        for raw in frames(archive):
            try:
                yield parsed(raw)
            except (ValueError, KeyError, UnicodeDecodeError) as wrong:
                yield _NOTHING | {"error": str(wrong)[:200] or "damaged"}
    except (ValueError, zstandard.ZstdError) as wrong:
        yield _NOTHING | {"error": str(wrong)[:200] or "damaged"}


def _read(batches, with_payload):
    schema = _schema()
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for row in records(memoryview(content.as_py())):
                rows.append(row if with_payload else row | {"payload": None})
                if len(rows) == 500:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in RECORDS.split(", "))])


# Tables ---------------------------------------------------------------------


def planned(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, size, revisit and refers_to of every page."""
    own = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size")
    )
    equal = written(
        own.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first"),
        "equal_payloads",
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return own.join(equal, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        "size",
        revisit.alias("revisit"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the pages as archives into a new folder."""
    lines = planned(pages, least).mapInArrow(in_workers(_write, date=date), "frame binary")
    lines.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(folder)


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in a folder."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(in_workers(_read, with_payload=with_payload), RECORDS)
