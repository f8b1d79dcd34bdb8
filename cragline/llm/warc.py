"""WARC archives with records compressed one by one under a Zstandard dictionary.

Each task builds a dictionary from the records that it writes first (a bounded number of bytes), puts it into
a leading skippable frame of its archive, and writes every record as a frame of its own. A few records are too little
to train on: their own bytes are the dictionary then. Archives are written
under a name of the attempt and renamed when complete, so a task that is lost or runs twice leaves no half
archive under a final name, and only the archives that the finished tasks report are read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.llm.common import marked, materialize, scratch_dir
from cragline.sources.scratch import qualified

DICTIONARY_FRAME = 0x184D2A5D  # fixed value: magic number of the skippable frame for dictionaries in .warc.zst
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds no payload but its size, its digest and the page that it refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record does not end where its Content-Length says")
    return headers, rest[:size]


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of these records; of records that are too few or too alike to train on, their own first bytes."""
    if len(samples) >= 8:
        with contextlib.suppress(zstandard.ZstdError):
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8, level=LEVEL)
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes records to a stream; the first SAMPLE_BYTES of them wait until the dictionary is built."""

    def __init__(self, out):
        self.out, self.waiting, self.size, self.packer = out, [], 0, None

    def add(self, data: bytes) -> None:
        if self.packer:
            self.out.write(self.packer.compress(data))
            return
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        samples = [x[: 128 << 10] for x in self.waiting]
        trained = train(samples)
        raw = trained.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
        for x in self.waiting:
            self.out.write(self.packer.compress(x))
        self.waiting = []

    def close(self) -> None:
        if not self.packer:
            self.start()
        self.out.close()


def read_records(source) -> Iterator[bytes]:
    """The records of an archive, frame by frame; source has read()."""
    head = source.read(8)
    dictionary, pending = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        dictionary = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", head[4:])[0]))
        pending = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        frame, out, begun = unpacker.decompressobj(), io.BytesIO(), False
        while not frame.eof:
            chunk = pending or source.read(1 << 20)
            pending = b""
            if not chunk:
                if begun:
                    raise ValueError("the archive ends inside a record")
                return
            begun = True
            out.write(frame.decompress(chunk))
        pending = frame.unused_data
        yield out.getvalue()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html) -> archive paths, one row for each archive written under folder.

    The payload is html in UTF-8 (null: empty). Of records with equal payloads, that with the smallest page_id
    is the response and others are revisits of it; rows that repeat that page_id with that payload, and all of a
    group whose page_ids are null, are responses themselves. Payloads are told apart by SHA-1 and size. Only payloads that
    a bitmap of the repeated digests lets through are shuffled; the others are written where they are read.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload")).withColumn("_key", F.xxhash64("digest", "size"))
    groups = rows.groupBy("digest", "size", "_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = materialize(groups, "warc-groups")
    rows = marked(rows, "_key", groups.select("_key"), "_may")
    own = ["page_id", "url", "payload"]
    alone = rows.filter("NOT _may").select(*own, F.lit(None).cast(pages.schema["page_id"].dataType).alias("first_id"))
    twice = rows.filter("_may").join(groups.drop("_key"), ["digest", "size"], "left").select(*own, "first_id")
    pairs = alone.unionByName(twice)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        writer, name = None, uuid.uuid4().hex
        for batch in batches:
            for page_id, url, body, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first_id")), strict=True):
                if writer is None:
                    writer = Writer(store.open_output_stream(f"{base}/{name}.part", compression=None))
                revisit = first is not None and (page_id is None or page_id != first)
                writer.add(record(page_id, url, body, base32_sha1(body), first, revisit))
        if writer:
            writer.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}.warc.zst")
            yield pa.RecordBatch.from_pydict({"path": [f"{name}.warc.zst"]})

    return pairs.mapInArrow(write, "path string")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """archives(path) under folder -> page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact.

    url is null where it was. A response's size and digest are computed from the payload that was read; a revisit's come from its headers.
    intact says whether a response's digest is the one in its header (true for revisits).
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])

    def row(data: bytes) -> tuple:
        head, block = parse(data)
        said = head["warc-payload-digest"].removeprefix("sha1:")
        page = int(head["x-page-id"]) if "x-page-id" in head else None
        if head["warc-type"] == "revisit":
            return page, head.get("warc-target-uri"), int(head["x-payload-length"]), said, "revisit", int(head["x-refers-to-page-id"]), True
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base32_sha1(payload)
        return page, head.get("warc-target-uri"), len(payload), digest, "response", None, digest == said and len(payload) == int(head["x-payload-length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{path}", compression=None) as source:
                    for data in read_records(source):
                        rows.append(row(data))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages to archives and read them back, a row for each record.

    The list of archives is written as a table before it is read, so a retry of a reading task never writes
    again. Empty tables give no archive and an empty result.
    """
    folder = qualified(pages.sparkSession, folder or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    return read_archives(materialize(write_archives(pages, folder), "warc-list"), folder)
