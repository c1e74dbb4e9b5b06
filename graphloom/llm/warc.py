"""WARC archives in Zstandard, with the dictionary in the archive itself.

An archive starts with a skippable frame that holds the dictionary. Every record after it is one frame.
Writing streams to the shared folder through Arrow's file systems; reading streams back, decodes frame by
frame and checks headers, lengths and digests. Records whose payload is stored elsewhere are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import cut, scratch
from graphloom.llm.common import read, slices

# Frame magics of the format, the revisit profile, header names.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


@dataclass(frozen=True)
class WarcParams:
    min_bytes: int = 0  #: payloads below this are always stored
    dictionary_bytes: int = 16 << 10
    dictionary_samples: int = 400  #: pages that the dictionary is fitted on, about, by hash of their id; twice as many at most
    level: int = 3
    roll_bytes: int = 48 << 20  #: an archive is closed beyond this
    max_record: int = 1 << 30  #: a decoded record beyond this is refused
    date: str = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def fit_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or plain sample content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[:size] + HTTP).ljust(64, b" ")


def record(kind: str, record_id: str, url: str | None, payload: bytes, p: WarcParams, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """One record. A revisit's block is the HTTP head alone; its digest and length are those of the full payload."""
    head = HTTP % len(payload)
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {p.date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _clean(url))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """Control characters can't stand in a header; they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one decoded record; ValueError if it isn't well formed."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in VERSIONS:
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.strip().decode().lower()] = value.strip().decode()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ValueError(f"missing header {missing[0]}")
    if not headers["content-length"].isdigit():
        raise ValueError("bad Content-Length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the block has {len(rest) - 4} bytes")
    block = rest[:n]
    if (d := headers.get("warc-block-digest")) and d != f"sha1:{digest(block)}":
        raise ValueError("the block doesn't match its digest")
    if headers["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if headers.get("warc-payload-digest") != f"sha1:{digest(payload)}":
            raise ValueError("the payload doesn't match its digest")
    return headers, block


def read_records(stream, max_record: int = 1 << 30, chunk: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, in order, one frame each; ``stream`` has ``read(n)``."""
    lead = stream.read(8)
    if not lead:
        return
    if len(lead) < 8 or struct.unpack("<I", lead[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    size = struct.unpack("<I", lead[4:])[0]
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary frame is cut short")
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    data = stream.read(chunk)
    while data:
        frame, parts, total = decoder.decompressobj(), [], 0
        while True:
            out = frame.decompress(data)
            total += len(out)
            if total > max_record:
                raise ValueError("a record is too large")
            parts.append(out)
            if frame.eof:
                data = frame.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the last frame is cut short")
        yield parse(b"".join(parts))


class Archives:
    """Archives of one task, closed and followed by another when they grow past a limit.

    Names are unique to the attempt, so a retried or doubled task never writes to a file in use.
    """

    def __init__(self, uri: str, dictionary: bytes, p: WarcParams) -> None:
        self.where, self.root = fs.FileSystem.from_uri(uri)
        self.where.create_dir(self.root, recursive=True)
        self.dictionary, self.p, self.done, self.out = dictionary, p, [], None
        self.encoder = zstandard.ZstdCompressor(level=p.level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name, self.records, self.size = f"{self.root}/{uuid.uuid4().hex}.warc.zst", 0, 0
            self.out = self.where.open_output_stream(self.name, compression=None)  # the suffix would otherwise compress once more
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary)
        frame = self.encoder.compress(raw)
        self.out.write(frame)
        self.records += 1
        self.size += len(frame)
        if self.size >= self.p.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def page_urn(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def write_archives(pages: DataFrame, uri: str, p: WarcParams = WarcParams()) -> DataFrame:
    """Archives of all pages below ``uri``; returns their manifest (path, records, bytes), materialised.

    Of equal payloads the one with the largest id is stored and the others point at it. Equal payloads are found by digest:
    only digests and ids shuffle to find the groups, and one row for each group with copies joins back.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("body")).withColumn("sha", F.unhex(F.sha1("body")))
    groups = rows.select("sha", "page_id").groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).filter((F.col("n") > 1) & F.col("kept").isNotNull())
    told = rows.join(groups.select("sha", "kept"), "sha", "left")
    copies = F.when((F.length("body") >= p.min_bytes) & (F.col("kept") != F.coalesce("page_id", F.col("kept") - 1)), F.col("kept"))
    told = told.select("page_id", "url", "body", copies.alias("refers_to"))
    share = max(1, pages.count() // p.dictionary_samples)
    sample = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(share)) == 0).select(F.substring(F.coalesce("html", F.lit("")), 1, 4096).alias("t")).limit(2 * p.dictionary_samples).collect()
    dictionary = fit_dictionary([r["t"].encode() for r in sample], p.dictionary_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Archives(uri, dictionary, p)
        for whole in batches:
            for b in slices(whole, 2):
                for i, url, payload, kept in zip(*(b.column(k).to_pylist() for k in range(4))):
                    extra = {} if i is None else {"X-Page-ID": str(i)}
                    kind, ref = ("response", None) if kept is None else ("revisit", page_urn(kept))
                    to.add(record(kind, page_urn(i), url, payload, p, ref, extra))
        to.close()
        if to.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*to.done)], ["path", "records", "bytes"])

    return cut(told.mapInArrow(run, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, uri: str, p: WarcParams = WarcParams(), with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record that the manifest counts."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def row(headers: dict[str, str], block: bytes) -> tuple:
        at = headers.get("x-page-id")
        ref = headers.get("warc-refers-to", "").strip("<>").rpartition(":")[2]
        got = (int(at) if at is not None else None, headers.get("warc-target-uri"), int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], int(ref) if ref else None)
        payload = block.partition(b"\r\n\r\n")[2]
        if headers["warc-type"] == "response" and len(payload) != got[2]:
            raise ValueError("the payload's length isn't what the record says")
        return (*got, payload if headers["warc-type"] == "response" else None) if with_payload else got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
        where, _ = fs.FileSystem.from_uri(uri)
        for b in batches:
            for path, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, seen, held = [], 0, 0
                with where.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_records(stream, p.max_record):
                        rows.append(row(headers, block))
                        seen += 1
                        held += len(block) if with_payload else 300
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if seen != count:
                    raise ValueError(f"{path} has {seen} records, not {count}")
                if rows:
                    yield pack(rows)

    tasks = min(10_000, max(1, manifest.count()))  # a number, as few rows would otherwise be coalesced into one task
    files = manifest.select("path", "records").repartition(tasks, "path")
    return files.mapInArrow(run, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; a null id never stands for others; rows repeated with the same id are all stored."""
    uri = scratch(spark, "warc")
    manifest = write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html"), uri)
    return read_archives(manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
