"""WARC archives in Zstandard frames.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary, plain or itself compressed; then one
Zstandard frame per record. `read_archives` loads the dictionary, decodes frame by frame and checks each record: version line,
mandatory headers, Content-Length against the block, the closing blank lines, HTTP length and payload digest. Empty skippable
frames between records are passed over.

`write_archives` writes a page per record, with a payload seen before as a `revisit` of the page with the smallest id. Spark's
own text writer puts the frames into files, so any file system that Spark knows will do; its line separator is an empty
skippable frame. An archive ends after ARCHIVE_ROWS frames or ARCHIVE_BYTES bytes, whichever comes first, and trains its
dictionary on its own first records, so neither writer nor reader holds more than an archive.

Null html is an empty payload; null urls become `urn:page:<id>`. Rows that repeat the smallest id of their payload are all
responses. Pages with null ids are responses unless a page with an id has the same payload. An empty table gives archives with
no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, join_known, new_path, written

ARCHIVE_ROWS = 4096
ARCHIVE_BYTES = 16_000_000
DICT_SAMPLE_BYTES = 1_000_000
DICT_BYTES = 32_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
DICT_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: An empty skippable frame; all its bytes are ASCII, so it can be a line separator.
NO_FRAME = "P*M\x18\x00\x00\x00\x00"
MANDATORY = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record; `first` is the page that it revisits, if any."""
    kind = "response" if first is None else "revisit"
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def dictionary_frame(data: bytes) -> bytes:
    return DICT_MAGIC + struct.pack("<I", len(data)) + data


def headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in lines:
        name, sep, value = x.decode("utf-8").partition(":")
        if not sep or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"bad header line {x[:60]!r}")
        out[name.lower()] = value.strip()
    return out


def _page(uri: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+|None)>", uri)
    if not m:
        raise WarcError(f"bad record id {uri[:60]!r}")
    return None if m[1] == "None" else int(m[1])


def parse(data: bytes) -> tuple:
    """The RECORD columns of one decoded record, checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not sep or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no WARC version line: {first[:40]!r}")
    h = headers(lines)
    for name in MANDATORY:
        if name.lower() not in h:
            raise WarcError(f"{name} is missing")
    size = h["content-length"]
    if not size.isdecimal() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size} doesn't match a block of {len(rest) - 4} bytes")
    kind = h["warc-type"]
    if kind not in ("response", "revisit"):
        return None, h.get("warc-target-uri"), kind, None, None, None, rest[:-4]
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not sep or not status.startswith(b"HTTP/"):
        raise WarcError("no HTTP header in the block")
    length = headers(lines).get("content-length", "")
    algorithm, _, declared = h.get("warc-payload-digest", "").partition(":")
    if not length.isdecimal() or algorithm != "sha1" or not re.fullmatch("[A-Z2-7]{32}", declared):
        raise WarcError("no HTTP length or payload digest")
    if kind == "response" and (int(length) != len(payload) or digest(payload) != declared):
        raise WarcError("the payload doesn't match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in h):
        raise WarcError("a revisit has no payload and refers to a record")
    return _page(h["warc-record-id"]), h.get("warc-target-uri"), kind, _page(h["warc-refers-to"]) if kind == "revisit" else None, declared, int(length), payload if kind == "response" else None


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, each in turn."""
    view, at, options = memoryview(data), 0, {}
    while at < len(data):
        magic = data[at : at + 4]
        if 0x50 <= magic[0] <= 0x5F and magic[1:] == DICT_MAGIC[1:]:
            if len(data) < at + 8 or len(data) < (end := at + 8 + struct.unpack_from("<I", data, at + 4)[0]):
                raise WarcError("a skippable frame is cut off")
            if at == 0 and magic == DICT_MAGIC:
                held = data[8:end]
                if held[:4] == FRAME_MAGIC:
                    held = zstandard.ZstdDecompressor().decompress(held, max_output_size=1 << 27)
                if held:
                    options = {"dict_data": zstandard.ZstdCompressionDict(held)}
            at = end
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        inflate, out, step = zstandard.ZstdDecompressor(**options).decompressobj(), [], 8192
        while not inflate.eof:
            chunk = view[at : at + step]
            if not chunk:
                raise WarcError("the last frame is cut off")
            try:
                out.append(inflate.decompress(chunk))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame before byte {at + step}: {e}") from e
            at += len(chunk) - len(inflate.unused_data)
            step = min(2 * step, 1 << 20)
        yield b"".join(out)


def archive_rows(records: Iterator[bytes]) -> Iterator[bytes]:
    """Frames, cut into archives of ARCHIVE_ROWS rows; an archive that is full earlier is filled up with empty rows."""
    held: list[bytes] = []
    pack, rows, size = None, 0, 0

    def opened() -> Iterator[bytes]:
        nonlocal pack
        options = {}
        try:
            data = zstandard.train_dictionary(DICT_BYTES, held).as_bytes()
            options = {"dict_data": zstandard.ZstdCompressionDict(data)}
        except zstandard.ZstdError:  # too few records to train on
            data = b""
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
        yield dictionary_frame(data)
        for x in held:
            yield pack.compress(x)
        held.clear()

    for r in records:
        if rows == ARCHIVE_ROWS - 1 or size >= ARCHIVE_BYTES:
            if pack is None:
                yield from opened()
            for _ in range(ARCHIVE_ROWS - 1 - rows):
                yield b""
            pack, rows, size = None, 0, 0
        rows, size = rows + 1, size + len(r)
        if pack is None:
            held.append(r)
            if size >= DICT_SAMPLE_BYTES:
                yield from opened()
        else:
            yield pack.compress(r)
    if pack is None:
        yield from opened()


def write_archives(pages: DataFrame, path: str) -> None:
    """Write every page to archives under path."""
    in_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.sha1(F.col("html").cast("binary"))
    # only payloads that occur twice have a row here, and copies are combined before the shuffle
    copies = p.groupBy(key.alias("key")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = written(copies, "payloads")
    dealt = join_known(p.withColumn("key", key), copies, ["key"], "n", F.col("page_id"))
    dealt = dealt.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for page, url, html, first in zip(*(c.to_pylist() for c in b.columns)):
                    yield record(page, url, html.encode("utf-8", "surrogatepass"), first)

        out, size = [], 0
        for x in archive_rows(records()):
            out.append(x)
            size += len(x)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", NO_FRAME).option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, as RECORD says; a record that breaks the format fails the query with WarcError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                try:
                    for x in frames(data.as_py()):
                        rows.append(parse(x))
                        size += len(x)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{name}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    in_batches(spark)
    # .zst makes Spark's other readers decode them; the names that the text writer gives are kept instead
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD)


def dangling_revisits(records: DataFrame) -> DataFrame:
    """Revisits whose record isn't there as a response with the same digest."""
    r = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return records.filter("record_type = 'revisit'").join(r, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    got = read_archives(pages.sparkSession, path)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
