"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm.common import keep, map_batches, prepare, scratch

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: The dictionary is trained on a bounded sample: so many pages, so many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES = 256, 8192
DICTIONARY_BYTES = 32 << 10
#: An archive is closed at about this size.
ARCHIVE_BYTES = 8 << 20
_HEADER_LINE = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)", re.S)


class BadArchive(ValueError):
    """An archive or a record that breaks the format."""


def train_dictionary(pages: DataFrame, payload: str = "payload", key: str = "page_id") -> bytes:
    """A dictionary from a bounded pseudo-random sample; empty where the sample is too small to train on."""
    ordered = F.xxhash64(F.col(key).cast("string"))
    rows = pages.select(F.substring(F.col(payload), 1, SAMPLE_BYTES).alias("s"), ordered.alias("o")).orderBy("o", "s").limit(SAMPLE_PAGES)
    sample = [bytes(r["s"]) for r in rows.collect() if len(r["s"]) >= 64]
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample).as_bytes()
    except zstandard.ZstdError:  # too little in common to train on
        return b""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One record, uncompressed; a revisit has the HTTP header of its payload, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)),
    ]
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return head + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading frame: skippable, with the compressed dictionary inside."""
    if not dictionary:
        return b""
    content = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: equal payloads of at least ``least`` bytes refer to the largest id with them."""
    hashed = pages.withColumn("_digest", F.sha1("payload")).withColumn("_bytes", F.octet_length("payload"))
    holders = (
        hashed.filter(F.col("_bytes") >= least).groupBy(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"))
        .agg(F.max("page_id").alias("_holder"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    )
    same = (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b"))
    return hashed.join(holders, same, "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("_holder")), F.col("_holder")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, folder: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Archives in ``folder`` and their list ``(file, records, bytes)``, itself written.

    Null pages are empty payloads; null ids and addresses are empty fields. Of pages with
    equal payloads of at least ``least`` bytes the largest id is the response and the others are
    revisits (pages without an id, and repeated rows of other ids, among them); smaller payloads are all responses. A file's
    name is new for each attempt of a task, and only files of attempts that ended well are in the
    list, so a repeated task leaves nothing that would be read. No pages, no archives.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    dictionary = train_dictionary(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        lead = dictionary_frame(dictionary)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
        held, size, listed = [lead], len(lead), []

        def close() -> None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for frame in held:
                    out.write(frame)
            listed.append((name, len(held) - 1, size))

        for batch in batches:
            for page in batch.to_pylist():
                revisit = page["refers_to"] is not None
                frame = compressor.compress(record(page["page_id"], page["url"], page["payload"], page["refers_to"], revisit, date))
                held.append(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    close()
                    held, size = [lead], len(lead)
        if len(held) > 1:
            close()
        names, records, sizes = zip(*listed) if listed else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, type=pa.string()), pa.array(records, type=pa.int64()), pa.array(sizes, type=pa.int64())],
            names=["file", "records", "bytes"],
        )

    return keep(mark_revisits(rows, least).mapInArrow(write, "file string, records long, bytes long"), "archives")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(folder)
    return store, root.rstrip("/")


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """``(magic, start, end)`` of each frame, by its headers: nothing is decoded."""
    at = 0
    while at < len(data):
        try:
            end = _frame_end(data, at)
        except (struct.error, IndexError):
            raise BadArchive(f"frame at byte {at} is cut off") from None
        if end > len(data):
            raise BadArchive(f"frame at byte {at} is cut off")
        yield struct.unpack_from("<I", data, at)[0], at, end
        at = end


def _frame_end(data: bytes, at: int) -> int:
    (magic,) = struct.unpack_from("<I", data, at)
    if magic in SKIPPABLE:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME_MAGIC:
        raise BadArchive(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        word = int.from_bytes(data[pos : pos + 3], "little")
        if pos + 3 > len(data):
            raise IndexError
        pos += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)
        if word & 1:
            return pos + 4 * (flags >> 2 & 1)


def load_dictionary(data: bytes) -> bytes:
    """The dictionary of the leading skippable frame, itself plain or compressed; empty without such a frame."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return b""
    content = data[8 : 8 + struct.unpack_from("<I", data, 4)[0]]
    if content[:4] == struct.pack("<I", FRAME_MAGIC):
        return zstandard.ZstdDecompressor().decompress(content)
    return content


def parse(data: bytes) -> dict:
    """The fields of one record, its headers, lengths and digests checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise BadArchive("no WARC version line")
    fields = {}
    for line in lines[1:]:
        found = _HEADER_LINE.fullmatch(line)
        if not found:
            raise BadArchive("malformed header")
        fields[found[1].decode().lower()] = found[2].decode()
    for name in REQUIRED:
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not re.fullmatch(r"\d+", fields["content-length"]):
        raise BadArchive("malformed content-length")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive("the block is not as long as content-length")
    block = rest[:length]
    if fields.get("warc-block-digest", _digest(block)) != _digest(block):
        raise BadArchive("the block does not have its digest")
    http, blank, payload = block.partition(b"\r\n\r\n")
    sized = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit") or not blank or not sized:
        raise BadArchive("not a response or a revisit over HTTP")
    if kind == "response":
        if int(sized[1]) != len(payload):
            raise BadArchive("the payload is not as long as its HTTP header says")
        if fields.get("warc-payload-digest", _digest(payload)) != _digest(payload):
            raise BadArchive("the payload does not have its digest")
    elif "warc-refers-to" not in fields or "warc-payload-digest" not in fields:
        raise BadArchive("a revisit without reference or digest")
    digest = fields.get("warc-payload-digest") or _digest(payload)
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
        "payload_bytes": int(sized[1]), "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(), "error": None,
    }


def _page(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d*)>", uri)
    if not found:
        raise BadArchive("not the id of a page")
    return int(found[1]) if found[1] else None


_FIELDS = [
    ("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string()),
]
_ROW = "file string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


def read_archive(file: str, data: bytes, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive; a damaged record is a row with ``error``, a damaged frame ends the archive with one."""
    dictionary = load_dictionary(data)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    view = memoryview(data)
    try:
        for magic, start, end in frames(data):
            if magic != FRAME_MAGIC:
                continue
            try:
                row = parse(decompressor.decompressobj().decompress(view[start:end])) | {"file": file}
                yield row if payloads else row | {"payload": None}
            except (BadArchive, zstandard.ZstdError, UnicodeDecodeError) as wrong:
                yield {"file": file, "error": f"byte {start}: {wrong}"}
    except BadArchive as wrong:
        yield {"file": file, "error": str(wrong)}


def read_archives(spark: SparkSession, folder: str, listed: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``folder`` (of those ``listed``, if given); ``payload`` is null for revisits.

    Each archive is read with its own dictionary. ``error`` tells what a record or archive breaks.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if listed is not None:
        files = files.join(listed.select("file"), "file", "left_semi")
    kinds = pa.schema(_FIELDS)

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for file, content in zip(batch.column("file"), batch.column("content")):
            held, size = [], 0
            for row in read_archive(file.as_py(), content.as_py(), payloads):
                held.append(row)
                size += len(row.get("payload") or b"")
                if len(held) >= 2000 or size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return map_batches(files, read, _ROW)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The records of ``pages`` as written to archives in the shared folder and read back."""
    spark = prepare(pages.sparkSession)
    folder = scratch(spark, "warc")
    listed = write_archives(pages, folder, least)
    if not listed.take(1):
        return spark.createDataFrame([], _ROW)
    return read_archives(spark, folder, listed)
