"""Dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the records. Each task writes
its rows to one archive: a skippable frame that holds the dictionary, then every record
compressed by itself, so a reader needs nothing but the archive and can start at any
record. Payloads seen before are written as revisits, without the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import required, short_batches, whole
from gleanery.session import scratch_path, stored

# Fixed values of the file format: the skippable frame for a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528

#: The dictionary is built from at most so many records, of at most so many bytes each.
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 32_768
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: The archives carry no clock time, so that writing twice gives the same bytes.
DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page}')}>"


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit when ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": DATE,
        # Control characters and spaces cannot stand in a header.
        "WARC-Target-URI": quote(url or "urn:none", safe="".join(map(chr, range(0x21, 0x7F)))),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http;msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if page is not None:
        head["X-Page-Id"] = page
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to)
        head["X-Refers-To-Page-Id"] = refers_to
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes when there are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with ``refers_to``: of equal payloads the largest page id is the response."""
    payload = whole("html")
    # Two digests and the length: equal payloads, and no others, agree in all three.
    keyed = pages.select(
        F.col("page_id").cast("string").alias("page"), "page_id", "url", payload.alias("html"),
        F.sha1(payload).alias("d1"), F.xxhash64(payload).alias("d2"), F.octet_length(payload).alias("n_bytes"),
    )
    same = ["d1", "d2", "n_bytes"]
    copies = stored(
        keyed.filter(F.col("n_bytes") >= least_bytes)
        .groupBy(*same)
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1"),
        "equal_payloads",
    )
    found = keyed.join(copies, same, "left")
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper").cast("string"))
    return found.select("page", "url", "html", refers.alias("refers_to"))


def _qualified(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/+", "file:///", full)


def _samples(pages: DataFrame) -> list[bytes]:
    """At most SAMPLE_RECORDS records of at most SAMPLE_BYTES, chosen by a hash of their id.

    Ids are chosen first, so that nothing but ids is compared over all pages.
    """
    small = pages.filter(F.octet_length(whole("html")).between(1, SAMPLE_BYTES) & F.col("page_id").isNotNull())
    ids = small.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_RECORDS).collect()
    if not ids:
        return []
    chosen = small.filter(F.col("page_id").isin([r.page_id for r in ids])).select("page_id", "url", "html").limit(SAMPLE_RECORDS)
    rows = sorted(chosen.collect(), key=lambda r: (r.page_id, r.html))
    return [record(str(r.page_id), r.url, r.html.encode(), None) for r in rows]


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write one archive per task and return (archive, n_records, n_bytes), already written.

    ``folder`` must be one that all executors share, by default in the session's shared
    folder. A task writes under a name of its own attempt and renames at the end, so a
    task that is run again, or twice, leaves one whole archive.
    """
    required(pages, "page_id", "url", "html")
    spark = pages.sparkSession
    short_batches(spark)
    root = _qualified(spark, folder or scratch_path(spark, "archives"))
    ready = _roles(pages, least_bytes)
    dictionary = build_dictionary(_samples(pages))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = pafs.FileSystem.from_uri(root)
        name = f"{base}/pages-{task.partitionId():06d}.warc.zst"
        own = f"{name}.{task.taskAttemptId()}.tmp"
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        out, records, size = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(own, compression=None)
                frame = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
                out.write(frame)
                size += len(frame)
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                frame = packer.compress(record(page, url, html.encode(), refers))
                out.write(frame)
                records, size = records + 1, size + len(frame)
        if out is not None:
            out.close()
            system.move(own, name)
            yield pa.RecordBatch.from_pydict(
                {"archive": [f"{root}/{name.rsplit('/', 1)[1]}"], "n_records": [records], "n_bytes": [size]}
            )

    return stored(ready.mapInArrow(write, "archive string, n_records long, n_bytes long"), "archive_list")


def _records(stream) -> Iterator[bytes]:
    """The records of an archive, one in memory at a time."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = stream.read(length)
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpacker = zstandard.ZstdDecompressor(dict_data=data)
    rest = stream.read(READ_BYTES)
    while rest:
        if len(rest) >= 4 and struct.unpack("<I", rest[:4])[0] != ZSTD_MAGIC:
            raise ValueError("not a Zstandard frame")
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(READ_BYTES)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(rest))
            rest = b""
        rest = frame.unused_data or stream.read(READ_BYTES)
        if len(rest) < 4:
            rest += stream.read(READ_BYTES)
        yield b"".join(parts)


_READ = "archive string, page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives named in column ``archive``, one row each.

    ``payload`` is null for revisits; their length and digest are those of the payload
    they repeat. A response whose payload does not match its digest is an error.
    """
    spark = archives.sparkSession
    names = archives.select("archive")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, {"binary": pa.binary(), "long": pa.int64()}.get(t, pa.string())) for n, t in (c.split() for c in _READ.split(", "))]
        )
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = pafs.FileSystem.from_uri(archive)
                held, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for data in _records(stream):
                        fields, block = parse(data)
                        response = fields["WARC-Type"] == "response"
                        payload = block.partition(b"\r\n\r\n")[2] if response else None
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and (payload_digest(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} in {archive} does not match its digest")
                        held.append(
                            (archive, fields.get("X-Page-Id"), fields["WARC-Target-URI"], payload, int(fields["X-Payload-Length"]),
                             digest, fields["WARC-Type"], fields.get("X-Refers-To-Page-Id"))
                        )
                        size += len(data)
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    # An archive is far larger than its name, so every one gets a task of its own.
    count = max(1, names.count())
    return names.repartition(count).mapInArrow(read, _READ)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page to archives, read them back, and report per page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). The payload is the
    html in UTF-8, null as empty. Rows repeated under the largest id are all responses; a
    null page id is a revisit where an equal payload has an id. An empty table gives no
    rows; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType
    return read_archives(write_archives(pages, least_bytes=least_bytes)).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
