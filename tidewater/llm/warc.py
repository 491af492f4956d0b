"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, stored

#: Fixed values of the format: the magic number of the dictionary's skippable frame, that of a frame, and of a formatted dictionary.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = bytes.fromhex("28b52ffd")
DICT_MAGIC = bytes.fromhex("37a430ec")
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

HASHES = {"sha1": hashlib.sha1, "md5": hashlib.md5, "sha256": hashlib.sha256}

RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, refers_to_record string, payload binary"
_CHUNK = 1 << 16


class WarcError(ValueError):
    """An archive that does not hold what its headers say."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line: control characters and % are percent-encoded, so that field_value gets them back."""
    return "".join(f"%{b:02X}" if b < 32 or b in (37, 127) else chr(b) for b in value.encode("utf-8", "surrogatepass")).encode("latin-1").decode("utf-8", "surrogateescape")


def _unfield(value: str) -> str:
    out, raw, i = bytearray(), value.encode("utf-8", "surrogateescape"), 0
    while i < len(raw):
        if raw[i] == 37:
            out.append(int(raw[i + 1 : i + 3], 16))
            i += 3
        else:
            out.append(raw[i])
            i += 1
    return out.decode("utf-8", "surrogatepass")


def record_id(name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {name}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit's block has the HTTP headers only; its Content-Length there is still the full payload's. It names the record of the
    page that it refers to, as a page's response has a name of its page_id only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id) if page_id is not None and not revisit else record_id(f"{page_id} {revisit} {url} {digest}")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _field(url)))
        head.append(("X-URI-Encoding", "percent"))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "surrogateescape") for k, v in head)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample records; where there are too few to train one, their own bytes serve as a raw one; may be empty."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def skippable_frame(content: bytes) -> bytes:
    return SKIPPABLE_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    if not content:
        return None
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


class ArchiveWriter:
    """Writes one archive to a binary stream: the dictionary's skippable frame, then a frame for each record."""

    def __init__(self, out, dictionary: bytes, level: int = 3):
        self.out = out
        out.write(skippable_frame(dictionary))
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True, write_content_size=True)

    def write(self, record: bytes) -> None:
        self.out.write(self.frames.compress(record))


class _Feed:
    """Bytes of a stream in pieces, with a way to put some back."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.left = read, b""

    def more(self) -> bytes:
        got, self.left = self.left or self.read(_CHUNK), b""
        return got

    def exactly(self, n: int) -> bytes:
        while len(self.left) < n and (x := self.read(_CHUNK)):
            self.left += x
        got, self.left = self.left[:n], self.left[n:]
        return got


def read_frames(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The decoded frames of an archive, one by one, from read(n) of its stream. Further skippable frames are passed over."""
    feed, frames, first = _Feed(read), None, True
    while head := feed.exactly(4):
        if len(head) == 4 and 0x184D2A50 <= (magic := int.from_bytes(head, "little")) <= 0x184D2A5F:
            n = int.from_bytes(feed.exactly(4), "little")
            content = feed.exactly(n)
            if len(content) < n:
                raise WarcError("a skippable frame is cut off")
            if first and magic == SKIPPABLE_MAGIC:
                if content[:4] == FRAME_MAGIC:  # the dictionary may be compressed itself
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                frames = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        elif head == FRAME_MAGIC:
            frames = frames or zstandard.ZstdDecompressor()
            one, parts, data = frames.decompressobj(), [], head
            while data:
                try:
                    parts.append(one.decompress(data))
                except zstandard.ZstdError as e:
                    raise WarcError(f"a frame cannot be decoded: {e}") from e
                if one.eof:
                    break
                data = feed.more()
            if not one.eof:
                raise WarcError("a frame is cut off")
            feed.left = one.unused_data
            yield b"".join(parts)
        else:
            raise WarcError(f"no frame starts with {head.hex()}")
        first = False


def _headers(text: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with a blank goes on with the one before. Of repeated fields the first counts."""
    lines: list[bytes] = []
    for line in text.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and lines:
            lines[-1] += b" " + line.strip()
        elif line:
            lines.append(line)
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "surrogateescape"))
    return out


def _check_digest(value: str | None, data: bytes, what: str) -> None:
    """A digest in base32 or hexadecimal; of an unknown algorithm, or none, nothing can be said."""
    name, _, digest = (value or "").partition(":")
    if name.lower() in HASHES and digest:
        raw = HASHES[name.lower()](data).digest()
        if len(digest) == 2 * len(raw):
            fits = digest.lower() == raw.hex()
        else:
            fits = digest.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")
        if not fits:
            raise WarcError(f"the {what}'s digest does not fit")


def parse_record(record: bytes) -> dict | None:
    """The fields of a response or revisit; None for records of other types. WarcError where a header is missing, a length is wrong or a digest
    that is given does not fit.

    Versions 1.0 and 1.1. payload_bytes is the length that the HTTP header of a revisit tells (null: none), and the payload's own of a response, whose
    HTTP Content-Length has to agree unless the record is marked as truncated or the payload is encoded for transfer. payload_digest is the
    SHA-1 in base32, of the payload, or as a revisit gives it. A block that is not HTTP is its own payload where the record's Content-Type
    does not say that it is HTTP.
    """
    version, _, rest = record.partition(b"\r\n")
    if version not in VERSIONS:
        raise WarcError(f"not a record: {version[:40]!r}")
    head, gap, rest = rest.partition(b"\r\n\r\n")
    fields = _headers(head)
    if missing := [x for x in REQUIRED if x not in fields]:
        raise WarcError(f"missing headers: {missing}")
    n = fields["content-length"]
    if not gap or not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}; the block and its end have {len(rest)} bytes")
    block = rest[:-4]
    _check_digest(fields.get("warc-block-digest"), block, "block")
    kind = fields["warc-type"].lower()
    if kind not in ("response", "revisit"):
        return None
    truncated = "warc-truncated" in fields
    full, payload = None, block
    if block.startswith(b"HTTP/"):
        lines, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(lines.partition(b"\r\n")[2])
        length = http.get("content-length", "")
        full = int(length) if length.isdigit() else None
        if kind == "response" and full is not None and full != len(payload) and not truncated and not {"transfer-encoding", "content-encoding"} & set(http):
            raise WarcError(f"HTTP Content-Length is {full}; the payload has {len(payload)} bytes")
    elif block and fields.get("content-type", "application/http").startswith("application/http"):
        raise WarcError("the block is not an HTTP response")
    given = fields.get("warc-payload-digest", "")
    if kind == "response":
        if not truncated:
            _check_digest(given, payload, "payload")
        full, digest = len(payload), sha1_base32(payload)
    else:
        digest = given.partition(":")[2].upper() if given.lower().startswith("sha1:") else None
        if not {"warc-refers-to", "warc-refers-to-target-uri", "warc-payload-digest", "x-refers-to-page-id"} & set(fields):
            raise WarcError("a revisit does not say what it revisits")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"),
        "url": (_unfield(fields["warc-target-uri"]) if fields.get("x-uri-encoding") == "percent" else fields["warc-target-uri"].strip("<>")) if "warc-target-uri" in fields else None,
        "record_type": kind,
        "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": full,
        "payload_digest": digest,
        "record_id": fields["warc-record-id"],
        "refers_to_record": fields.get("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


def with_first_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with `first`: the smallest page_id of equal payloads of least_bytes bytes or more. Only digests are grouped. The join that brings `first` to the
    pages has its digest by another expression than the sum, so that it is a stage of two plain shuffles, whose hot payloads adaptive execution splits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("_sha1"), F.octet_length(payload).alias("_n"))
    again = keyed.where(F.col("_n") >= least_bytes).groupBy("_sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    again = again.select(F.concat("_sha1", F.lit("")).alias("_sha1"), "first", "_copies")
    return keyed.join(again, "_sha1", "left").drop("_copies", "_sha1", "_n")


def write_archives(pages: DataFrame, root: str | None = None, archive_mb: int = 16, dictionary_kb: int = 64, samples: int = 200, level: int = 3, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each page into archives of about archive_mb MB of records under root; returns (path, records) of those archives.

    Of equal payloads, that with the smallest page_id is a response and the others revisit it. Nulls: a null html is empty; a null url or page_id
    has no header. Where the smallest page_id is repeated, or none of the copies has one, all rows with it are responses. Empty table: no archive.
    Other columns are left out.

    Archives are named by attempt, and the list of them is written by Spark's own committer: what a lost executor leaves is in no list. root may
    be of any file system that Arrow reaches.
    """
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")

    def write(batches):
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        waiting: list[bytes] = []
        writer = None
        n = size = 0
        made = []

        def begin():
            name = f"{uuid.uuid4().hex}.warc.zst"
            out = files.open_output_stream(f"{base}/{name}", compression=None)
            made.append([f"{root}/{name}", 0])
            return out, ArchiveWriter(out, train_dictionary(waiting, dictionary_kb << 10), level)

        def end():
            out.close()

        out = None
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(k) for k in ("page_id", "url", "html", "first")), strict=True):
                page_id, first = page_id.as_py(), first.as_py()
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                revisit = first is not None and page_id != first
                record = record_bytes(page_id, url.as_py(), payload, sha1_base32(payload), revisit, first, date)
                size += len(record)
                if writer is None:
                    waiting.append(record)
                    if len(waiting) < samples and size < archive_mb << 20:
                        continue
                    out, writer = begin()
                    todo, waiting = waiting, []
                else:
                    todo = [record]
                for x in todo:
                    writer.write(x)
                made[-1][1] += len(todo)
                if size >= archive_mb << 20:
                    end()
                    writer, size = None, 0
        if waiting:
            out, writer = begin()
            for x in waiting:
                writer.write(x)
            made[-1][1] += len(waiting)
        if writer is not None:
            end()
        yield pa.RecordBatch.from_pydict({"path": pa.array([x for x, _ in made], pa.string()), "records": pa.array([x for _, x in made], pa.int64())})

    return stored(with_first_copies(pages, least_bytes).mapInArrow(write, "path string, records long"), "warc-list")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The responses and revisits of archives (path): page_id, url, record_type, refers_to, payload_bytes, payload_digest, record_id,
    refers_to_record and payload (null for revisits). page_id and refers_to are null in archives that others wrote; records of other types are
    passed over.

    Streams each archive frame by frame; fails with WarcError on a record that is not as its headers say. Null paths are left out.
    """
    keys = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(k, kinds[x.split(" ")[1]]) for k, x in zip(keys, RECORD_SCHEMA.split(", "), strict=True)])

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_stream(name, compression=None) as stream:
                    for frame in read_frames(stream.read):
                        if (row := parse_record(frame)) is None:
                            continue
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(frame)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    listed = archives.select("path").where("path is not null")
    return listed.repartition(max(1, min(4096, listed.count()))).mapInArrow(read, RECORD_SCHEMA)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = read_archives(write_archives(pages), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS copies FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST(('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
