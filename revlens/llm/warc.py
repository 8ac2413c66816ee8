"""WARC archives with one Zstandard dictionary each, and their reader.

A writing task keeps its first records back, trains a dictionary on slices of them, writes it in a
leading skippable frame and then every record as a frame of its own, so records can be read
one by one. An archive has no dictionary only where all its records together are too short to
train one (a few kilobytes). Of records with equal payloads one is stored, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.shared import fresh, sink, source
from revlens.session import scratch_path, written_table

#: Number that begins the frame of the dictionary, and the type of a revisit; fixed values.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY, LEVEL = 1 << 14, 3
#: Bytes of records a dictionary is trained on, and of payloads after which a new archive begins.
TRAINED, ARCHIVE = 1 << 20, 1 << 28
#: Bytes of a slice; long records make many samples, so that few of them are enough to train on.
SLICE = 1 << 14
DATE = "1970-01-01T00:00:00Z"


def _uri(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the payload's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """One file: the dictionary's frame, then a frame for each record."""

    def __init__(self, path: str, first: list[bytes]):
        self.path, self.records, self.size = path, 0, 0
        slices = [data[k:k + SLICE] for data in first for k in range(0, len(data), SLICE)]
        try:
            trained = zstandard.train_dictionary(DICTIONARY, slices, k=512, d=8)
        except zstandard.ZstdError:  # too little to learn from
            trained = None
        self.out = sink(path)
        if trained is not None:
            trained.precompute_compress(level=LEVEL)
            raw = trained.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)

    def add(self, data: bytes) -> None:
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.records, self.size = self.records + 1, self.size + len(frame)

    def close(self) -> dict:
        self.out.close()
        return {"path": [self.path], "records": pa.array([self.records], pa.int64()), "size": pa.array([self.size], pa.int64())}


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the pages whose payload, of at least ``least`` bytes, a page with a larger id has too."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).filter(F.col("size") >= least)
    rows = written_table(rows.select("id", "digest"), "digests")
    most = rows.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return rows.join(most, "digest").filter("id is null or id < refers_to").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record for every row; (path, records, size) of the archives.

    Null payloads are empty, a null url is left out. Rows that repeat id and payload are the
    same kind of record each. A file that a failed task left behind is named in no row.
    """
    again = written_table(revisits(pages, id_col, payload_col, least), "revisits")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    joined = rows.join(again.withColumnRenamed("id", "other").withColumnRenamed("digest", "same"), F.col("id").eqNullSafe(F.col("other")) & (F.col("digest") == F.col("same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, first, size = None, [], 0
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to"))):
                to = refers.as_py()
                data = record(page.as_py(), url.as_py(), payload.as_py().encode("utf-8"), to, to is not None)
                if archive is None:
                    first.append(data)
                    size += len(data)
                    if size < TRAINED:
                        continue
                    archive = Archive(fresh(folder, "pages") + ".warc.zst", first)
                    for held in first:
                        archive.add(held)
                    first, size = [], 0
                else:
                    archive.add(data)
                if archive.size > ARCHIVE:
                    yield pa.RecordBatch.from_pydict(archive.close())
                    archive = None
        if first:
            archive = Archive(fresh(folder, "pages") + ".warc.zst", first)
            for held in first:
                archive.add(held)
        if archive is not None:
            yield pa.RecordBatch.from_pydict(archive.close())

    out = joined.select("id", "url", "payload", "refers_to").mapInArrow(run, "path string, records bigint, size bigint")
    return written_table(out, "archives")


def frames(path: str) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    with source(path) as file:
        data = file.read(8)
        words, unpack = None, None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
            words = zstandard.ZstdCompressionDict(file.read(struct.unpack("<I", data[4:])[0]))
            data = b""
        unpack = zstandard.ZstdDecompressor(dict_data=words)
        while True:
            data = data or file.read(1 << 20)
            if not data:
                return
            one, parts = unpack.decompressobj(), []
            while True:
                parts.append(one.decompress(data))
                if one.eof:
                    data = one.unused_data
                    break
                data = file.read(1 << 20)
                if not data:
                    raise ValueError(f"{path} ends within a record")
            yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Headers (lower-case names) and payload of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    names = {k.lower(): v for k, v in names.items()}
    block = block[: int(names["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    return {"headers": names, "length": length, "payload": None if names["warc-type"] == "revisit" else payload}


def _page(uri: str | None) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d*)>", uri)[1] if uri else ""
    return int(number) if number else None


def read(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record of the archives (path).

    The digest of a response is computed from the stored payload and must be the one in its
    header; a revisit has a null payload and the length and digest of the one it refers to.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def rows(path: str) -> Iterator[dict]:
        for data in frames(path):
            r = parse(data)
            h, payload = r["headers"], r["payload"]
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            if payload is not None and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                raise ValueError(f"{path}: payload of {h['warc-record-id']} differs from its digest")
            yield {
                "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_bytes": r["length"],
                "payload_digest": digest, "refers_to": _page(h.get("warc-refers-to")), "payload": payload,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if size > 1 << 22 or len(held) >= 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    paths = archives.select("path")
    tasks = max(1, min(paths.count(), 4 * paths.sparkSession.sparkContext.defaultParallelism))
    return paths.repartition(tasks, "path").mapInArrow(run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages (page_id, url, html) to archives in the shared work folder and read them back, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, least=least)).drop("payload", "url")
