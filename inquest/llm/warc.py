"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes its rows into archives of a bounded size, under names that no other attempt uses, and
returns a manifest; only archives in the stored manifest count, so lost or repeated tasks leave nothing behind.
Reading: Spark loads the archives as binary files; each is decoded frame by frame, and magic numbers, header
fields, declared lengths and payload digests are checked.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.llm.common import batch, in_arrow, shared_path, some_rows, stored, text_of

#: Payloads below this many bytes are never stored as revisits.
LEAST_REVISIT = 100
#: The dictionary is trained on this many pages at most (the first by a hash), on this many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 8192, 65536
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 16 << 20

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class ArchiveError(ValueError):
    """An archive that breaks the format or does not match its own headers."""


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP headers alone, and the length of the payload that it stands for."""
    block = HTTP if revisit else HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The checked fields of one record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ArchiveError("not a WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ArchiveError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing:
        raise ArchiveError(f"no {', '.join(sorted(missing))}")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the block is not as long as Content-Length says")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/1."):
        raise ArchiveError("the block is not an HTTP response")
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    length = int(fields["x-payload-length"])
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != length:
            raise ArchiveError("the payload is not the one that the headers describe")
    elif kind != "revisit" or payload or fields.get("warc-profile") != PROFILE:
        raise ArchiveError(f"bad {kind} record")
    refers = fields.get("x-refers-to-page-id")
    return {
        "page_id": int(fields["x-page-id"]) if fields.get("x-page-id") else None,
        "url": fields.get("warc-target-uri", ""),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers) if refers and refers != "None" else None,
        "payload": payload if kind == "response" else None,
    }


def compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True, write_checksum=True)


def archive_head(dictionary: bytes | None) -> bytes:
    """The skippable frame that holds the dictionary; nothing without one."""
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, in order. The dictionary may itself be compressed."""
    at, data, view = 0, None, memoryview(archive)
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", archive, 4)[0]
        at = 8 + size
        if at > len(archive):
            raise ArchiveError("the dictionary is cut off")
        raw = archive[8:at]
        data = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME else raw)
    reader = zstandard.ZstdDecompressor(dict_data=data)
    while at < len(archive):
        if view[at : at + 4] != FRAME:
            raise ArchiveError(f"no frame at byte {at}")
        one, parts, end = reader.decompressobj(), [], at
        while not one.eof:  # in steps: what lies behind the frame is handed back, and must not be copied each time
            if end >= len(archive):
                raise ArchiveError("the last frame is cut off")
            parts.append(one.decompress(view[end : end + 65536]))
            end += 65536
        at = min(end, len(archive)) - len(one.unused_data)
        yield b"".join(parts)


def train(pages: DataFrame, content: str = "html") -> bytes | None:
    """A dictionary from a bounded sample of the pages; None where they are too few or too small for one."""
    cut = F.encode(F.substring(text_of(content), 1, SAMPLE_BYTES), "UTF-8").alias("x")
    sample = some_rows(pages.where(F.length(content) > 0).select("page_id", "url", cut), SAMPLE_PAGES, "page_id", "url")
    parts = [bytes(r.x) for r in sample.select("x").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes() if len(parts) >= 16 else None
    except zstandard.ZstdError:
        return None


def revisits(pages: DataFrame, content: str = "html") -> DataFrame:
    """Digests of payloads that several pages share, with the smallest page_id: digest, first_id."""
    payload = F.encode(text_of(content), "UTF-8")
    small = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    shared = small.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return shared.where("n > 1").select("digest", "first_id")


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes `pages(page_id, url, html)` as archives below `folder` and returns the manifest: archive, n_records, n_bytes.

    Every row becomes a record. Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the smallest
    page_id is a response and the others are revisits of it; repeated rows with that same page_id are all responses.
    Null html is an empty payload, null url an empty one, null page_id an empty header (never the smallest).
    """
    dictionary = train(pages)
    shared = stored(revisits(pages), "revisits")
    keyed = pages.select("page_id", text_of("url").alias("url"), F.encode(text_of("html"), "UTF-8").alias("payload"))
    keyed = keyed.withColumn("sha", F.sha2("payload", 256)).join(shared, F.col("sha") == F.col("digest"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = keyed.select("page_id", "url", "payload", "sha", F.when(again, F.col("first_id")).alias("refers_to"))
    arrow = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")
        pack = compressor(dictionary)
        out, name, n, size, written = None, "", 0, 0, []

        def finish() -> None:
            nonlocal out
            if out is not None:
                written.append((name, n, out.tell()))
                out.close()
                out = None

        for b in batches:
            for page_id, url, payload, sha, refers in zip(*(b.column(i).to_pylist() for i in range(5))):
                if out is None:
                    files.create_dir(base, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(archive_head(dictionary))
                data = record(page_id, url, payload, sha, refers, refers is not None, date)
                out.write(pack.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    finish()
        finish()
        if written:
            yield batch(arrow, {k: [w[i] for w in written] for i, k in enumerate(arrow.names)})

    return stored(in_arrow(rows, run, "archive string, n_records long, n_bytes long"), "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of the archives below `folder`; with a manifest, of those archives only, and each must hold what it says.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits, or for all
    without `payloads`). Broken archives raise ArchiveError. An empty folder must come with an (empty) manifest.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    if manifest is not None and manifest.isEmpty():
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content", "length")
    if manifest is not None:
        found = found.join(manifest, "archive").select("archive", "content", "n_records", "n_bytes", "length")
    else:
        found = found.select("archive", "content", F.lit(None).cast("long").alias("n_records"), F.col("length").alias("n_bytes"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content, n, size, length in zip(*(b.column(i) for i in range(5))):
                if size.as_py() != length.as_py():
                    raise ArchiveError(f"{name}: {length} bytes, not {size}")
                rows, count, held = [], 0, 0
                for data in frames(content.as_buffer().to_pybytes()):
                    row = parse(data)
                    held += len(row["payload"] or b"")
                    rows.append(row if payloads else row | {"payload": None})
                    count += 1
                    if held > 4 << 20:
                        yield batch(pa.schema(fields), {k: [r[k] for r in rows] for k, _ in fields})
                        rows, held = [], 0
                if n.as_py() is not None and count != n.as_py():
                    raise ArchiveError(f"{name}: {count} records, not {n}")
                if rows:
                    yield batch(pa.schema(fields), {k: [r[k] for r in rows] for k, _ in fields})

    return in_arrow(found, run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page, from its record in the written and again read archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write_archives(pages.select("page_id", "url", "html"), folder)
    read = read_archives(pages.sparkSession, folder, manifest, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
