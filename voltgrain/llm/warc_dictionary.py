"""WARC archives of Zstandard records with a shared dictionary."""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltgrain.llm.store import Scratch

#: Payloads from this size on are written once.
MIN_SHARED = 1000
#: Payload bytes of one archive; records and their bytes that the dictionary is built from; its size.
ARCHIVE_BYTES, SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 32 << 20, 600, 16 << 10, 64 << 10, 3
#: Fixed values of the formats: the magic numbers of the dictionary's skippable frame and of an empty one, which stands between records as it is the text writer's line end.
DICTIONARY_MAGIC, SEPARATOR = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"


def _head(lines: list[tuple[str, object]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit with the headers alone that points to the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = [("WARC-Type", "response")] if refers_to is None else [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")]
    block = http + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = _head([*kind, ("WARC-Record-ID", f"<{PAGE}{'none' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))])
    return head + block + b"\r\n\r\n"


def decisions(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, digest, size, refers_to) of each distinct (page_id, payload); refers_to is null for a response.

    The largest page_id of each shared digest is a maximum combined before the shuffle; texts are not shuffled here.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    narrow = scratch.save(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size")).distinct())
    first = narrow.where(F.col("size") >= MIN_SHARED).groupBy("digest").agg(F.max("page_id").alias("response"))
    joined = narrow.join(first, "digest", "left")
    return scratch.save(joined.select("page_id", "digest", "size", F.expr("if(response is null or page_id <=> response, null, response)").alias("refers_to")))


def build_dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from the records of a bounded sample of pages, drawn by hash; empty if there is too little to learn from."""
    import zstandard

    ids = pages.where("page_id is not null and length(html) > 0").select("page_id").distinct().orderBy(F.xxhash64(F.lit(9), "page_id"), "page_id").limit(SAMPLES)
    rows = pages.join(F.broadcast(ids), "page_id").select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")).orderBy(F.xxhash64(F.lit(9), "page_id"), "page_id").limit(SAMPLES).collect()
    samples = [record(r["page_id"], r["url"], p := r["html"].encode(), len(p), hashlib.sha1(p).hexdigest(), None) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> None:
    """Write every page as a record; a task writes one archive: the dictionary frame, a warcinfo record, then records, each a frame of its own.

    Frames are written by Spark's text writer, so they reach any store that Spark can write and a lost task leaves nothing; its line end is an empty
    skippable frame, which readers pass over. Repeated rows of one page_id and payload are all written, alike.
    """
    import zstandard

    decided = decisions(pages, scratch)
    total = decided.agg(F.sum("size")).first()[0] or 0
    dictionary = build_dictionary(pages)
    n = max(1, ceil(total / ARCHIVE_BYTES))
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    d = decided.select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "size", "refers_to").repartition(n, "__d", F.coalesce("__p", F.lit(-1)))
    rows = rows.repartition(n, "digest", F.coalesce("page_id", F.lit(-1))).join(d, (F.col("digest") == F.col("__d")) & (F.coalesce("page_id", F.lit(-1)) == F.coalesce("__p", F.lit(-1))) & F.col("page_id").eqNullSafe(F.col("__p")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        info = b"software: voltgrain\r\nformat: WARC File Format 1.1\r\n"
        start = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        start += z.compress(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{PAGE}info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64).to_pylist()
                frames = [z.compress(record(r["page_id"], r["url"], r["payload"], r["size"], r["digest"], r["refers_to"])) for r in part]
                if start and frames:
                    frames[0], start = start + frames[0], b""
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = rows.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(folder)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an archive, in order."""
    import zstandard

    dictionary, at = None, 0
    if archive[:4] == struct.pack("<I", DICTIONARY_MAGIC):
        size = struct.unpack("<I", archive[4:8])[0]
        dictionary, at = zstandard.ZstdCompressionDict(archive[8 : 8 + size]), 8 + size
    z = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(z.stream_reader(io.BytesIO(memoryview(archive)[at:]), read_across_frames=True), 1 << 16)
    while (line := stream.readline()):
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip()):
            k, _, v = line.decode().partition(": ")
            headers[k] = v
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or len(block) != int(headers["Content-Length"]):
            raise ValueError("a record is cut short")
        yield headers, block


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, the payload of every record; digests of responses are checked."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def number(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").removeprefix(PAGE)
        return int(tail) if re.fullmatch(r"-?\d+", tail) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                rows: list[tuple] = []
                for h, block in records(archive.as_py()):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} does not match its digest")
                    rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], size, digest, h["WARC-Type"], number(h.get("WARC-Refers-To")), *([payload] if payloads else [])))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    names = arrow.names
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write the archives of ``pages`` and return their records as read back.

    Of records with equal payloads of at least ``MIN_SHARED`` bytes the one with the largest page_id is the response, the others revisit it; smaller
    ones are all responses. Rows alike in page_id and payload have one decision and are all written. Null html is an empty payload; a null page_id is written
    without number and comes back null; a null url becomes about:blank; an empty table gives no archive and no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = folder or scratch.path()
    write_archives(pages, folder, scratch)
    return read_archives(pages.sparkSession, folder, payloads)
