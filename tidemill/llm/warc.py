"""WARC archives as dictionary-compressed Zstandard files.

An archive starts with a skippable frame that holds a Zstandard dictionary built from the
archive's own records; each record then is a frame of its own, compressed with it, so that one
record can be read with the dictionary and the record's place alone. Archives are written as
rows of a table in shared scratch space (name, content, index): tasks that are lost or run
twice leave nothing behind, and any machine can read them. ``export_archives`` makes files.

Equal payloads are archived once. Grouping goes by the SHA-256 of the payload and is reduced
before the shuffle; the other records are revisits that name the response and hold its HTTP
header alone.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.session import ship, table

#: Fixed values of the formats: the skippable frame's magic number and the revisit profile.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record bytes of an archive, bytes of them that the dictionary is built from, and its size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16_000_000, 2_000_000, 65_536
ARCHIVES = "archive string, content binary, index array<struct<record_id:string,offset:long,length:long>>"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, serial: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """(record id, bytes) of a response, or of a revisit to the response of page ``refers_to``."""
    name = f"<urn:x-page:{'' if page_id is None else page_id}:{serial}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}:0>"]
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """From records spread evenly over the archive, SAMPLE_BYTES of them."""
    import zstandard

    step, samples, size = max(1, sum(map(len, records)) // SAMPLE_BYTES), [], 0
    for r in records[::step]:
        samples.append(r[:131_072])
        size += len(samples[-1])
        if size > SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), samples, k=64, d=8, level=3)
    except zstandard.ZstdError:  # too few records to learn from: their own beginnings serve
        return zstandard.ZstdCompressionDict(b"".join(s[:2048] for s in samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[tuple[str, bytes]]) -> tuple[bytes, list[dict]]:
    """(content, index) of an archive."""
    import zstandard

    learned = dictionary([r for _, r in records])
    held = zstandard.ZstdCompressor(level=3).compress(learned.as_bytes())
    out = io.BytesIO()
    out.write(struct.pack("<II", SKIPPABLE, len(held)) + held)
    squeeze, index = zstandard.ZstdCompressor(level=3, dict_data=learned), []
    for name, data in records:
        frame = squeeze.compress(data)
        index.append({"record_id": name, "offset": out.tell(), "length": len(frame)})
        out.write(frame)
    return out.getvalue(), index


def opened(content: bytes):
    """(decompressor, place of the first record) of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("not an archive that starts with its dictionary")
    learned = zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])
    trained = learned[:4] == b"\x37\xa4\x30\xec"
    held = zstandard.ZstdCompressionDict(learned, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdDecompressor(dict_data=held), 8 + size


def _headers(stream) -> dict[bytes, bytes]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.partition(b":")
        found[name.strip().lower()] = value.strip()
    return found


def records(content: bytes) -> Iterator[tuple]:
    """The records of an archive in order, as rows of RECORDS."""
    unpack, at = opened(content)
    stream = io.BufferedReader(unpack.stream_reader(io.BytesIO(content[at:]), read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("a record doesn't start where it should")
        head = _headers(stream)
        block = io.BytesIO(stream.read(int(head[b"content-length"])))
        stream.read(4)
        block.readline()
        http = _headers(block)
        payload, page = block.read(), lambda h: h.split(b":")[2] if h else b""
        ids = [int(x) if (x := page(head.get(h))) else None for h in (b"warc-record-id", b"warc-refers-to")]
        url = head.get(b"warc-target-uri")
        yield ids[0], url.decode() if url is not None else None, int(http[b"content-length"]), head[b"warc-payload-digest"].decode().removeprefix("sha1:"), head[b"warc-type"].decode(), ids[1], payload


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])

    def full() -> pa.RecordBatch:
        content, index = archive(held)
        return pa.RecordBatch.from_pylist([{"archive": f"pages-{part:06d}-{number:06d}.warc.zst", "content": content, "index": index}], schema)

    for batch in batches:
        for page_id, serial, url, refers_to, revisit, payload in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(5).cast(pa.large_binary())):
            held.append(record(page_id, serial, url, payload.as_py() or b"", refers_to, revisit))
            size += len(held[-1][1])
            if size >= ARCHIVE_BYTES:
                yield full()
                number, held, size = number + 1, [], 0
    if held:
        yield full()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for row in records(content.as_py()):
                rows.append(row)
                size += len(row[6])
                if size > 4_000_000:
                    yield _record_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _record_batch(rows)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives ``pages`` (page_id, url, html); returns the table of archives.

    A page's record has its html in UTF-8 as payload (null: empty). Of records with equal
    payloads of ``least`` bytes or more, that of the smallest page_id is the response and the
    others revisit it; of repeated rows that share that page_id, one is the response. Pages
    without page_id are always responses. No rows give no archives; other columns are ignored.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("sha"))
    known = pages.filter("page_id is not null").select("page_id", payload.alias("payload")).filter(F.octet_length("payload") >= least)
    groups = known.select("page_id", F.unhex(F.sha2("payload", 256)).alias("sha")).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("n").alias("n"), F.max("n").alias("most"))
    groups = table(groups.filter("n > 1"), "copies")
    joined = rows.join(groups, "sha", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.lit(False)) & (F.octet_length("payload") >= least))
    # Only repeated rows of the very same page need a number to tell them apart.
    repeats = joined.filter("most > 1 and page_id is not null")
    serial = F.row_number().over(W.partitionBy("sha", "page_id").orderBy("url")) - 1
    numbered = repeats.withColumn("serial", serial).withColumn("revisit", F.col("revisit") | ((F.col("serial") > 0) & (F.octet_length("payload") >= least)))
    once = joined.filter("most is null or most <= 1 or page_id is null").withColumn("serial", F.lit(0))
    columns = ["page_id", "serial", "url", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit", "payload"]
    ready = once.select(*columns)
    if not groups.filter("most > 1").isEmpty():
        ready = ready.union(numbered.select(*columns))
    return table(ready.mapInArrow(_write, ARCHIVES), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of a table of archives; payload is empty for revisits."""
    return archives.select("content").mapInArrow(_read, RECORDS)


def read_record(content: bytes, offset: int, length: int) -> bytes:
    """One record by its place in the index, without the others."""
    unpack, _ = opened(content)
    return unpack.decompress(content[offset : offset + length])


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive to ``folder``, a path that all machines mount; returns (archive, bytes).

    A file appears under its name only when it is whole, so a repeated task replaces it by the same.
    """

    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, os.path.join(folder, name))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], ["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(export, "archive string, bytes long")
