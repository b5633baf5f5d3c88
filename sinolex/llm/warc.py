"""WARC records in seekable Zstandard bundles.

``write`` makes one record for each page. Pages with equal payloads (SHA-1 and length) share one response record, that of
the largest page_id; the others are revisits without a body that refer to it. Records are packed into independent Zstandard
frames of about ``FRAME_BYTES``, frames into bundles of about ``BUNDLE_BYTES``. A bundle ends with a skippable frame that
holds the seek table (compressed and plain size of each frame) and its footer, as the seekable format states; any
Zstandard reader unpacks the bundle as one WARC file. Beside its bytes a bundle has an index from record ids to the frame
and the offset inside it, so ``fetch`` reads a record by unpacking one frame.

Bundles are rows with the file's bytes, which Spark writes to a shared folder with its own commits, so lost tasks leave no
half file; ``bundle`` names are stable while the pages are. ``read`` parses the bytes alone: it walks the seek table and
checks every response against its digest.

A null html is an empty payload. Equal page_ids are ordered by url, null before all; rows that are equal in both and in their
payload are told apart by a copy number, and only one is the response. A null page_id comes before all others. Line breaks in
a url are stored and read as %0D and %0A, all else in it as it is. Payloads of any length are kept whole; a record longer than a frame has a frame of its own. Empty tables
give no bundle. Only the three columns are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.llm.common import SALTS, small_batches

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable Zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

BUNDLE = "bundle string, data binary, entries array<struct<record_id:string,frame:int,offset:long,length:long>>"
RECORD = "page_id string, url string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC writes digests."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, url: str | None, digest: str, copy: int) -> str:
    """The same row gives the same id in every run."""
    name = hashlib.sha256(repr((url, digest, copy)).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return f"<urn:page:{'-' if page_id is None else '=' + quote(page_id, safe='')}:{name}>"


def page_of(name: str | None) -> str | None:
    """The page_id inside a record id."""
    part = name.split(":")[2] if name else "-"
    return None if part == "-" else unquote(part[1:])


def make_record(page_id: str | None, url: str | None, digest: str, size: int, copy: int, owner: str | None, payload: bytes | None, date: str = DATE) -> tuple[str, bytes]:
    """The id and the bytes of a record: a response with its payload, or where ``owner`` is given a revisit of that record."""
    name = record_id(page_id, url, digest, copy)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if payload is None else http + payload
    head = [f"WARC-Type: {'revisit' if owner else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if owner:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {owner}", f"X-Payload-Length: {size}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return name, ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


class Bundle:
    """Packs records into frames and frames into the bytes of one seekable file."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[bytes, int]] = []
        self.entries: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.plain = self.size = 0

    def add(self, name: str, record: bytes) -> None:
        if self.plain and self.plain + len(record) > self.frame_bytes:
            self.close_frame()
        self.entries.append((name, len(self.frames), self.plain, len(record)))
        self.open.append(record)
        self.plain += len(record)

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append((packed, self.plain))
            self.size += len(packed)
            self.open, self.plain = [], 0

    def done(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        self.close_frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        seek = struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer
        return b"".join(f for f, _ in self.frames) + seek, self.entries


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame of a bundle, read from its end."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 128 else 8
    out, start, at = [], 0, len(data) - 9 - n * width
    for i in range(n):
        packed, plain = struct.unpack("<II", data[at + i * width : at + i * width + 8])
        out.append((start, packed, plain))
        start += packed
    return out


def frame(data: bytes, table: list[tuple[int, int, int]], k: int) -> bytes:
    start, packed, plain = table[k]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)


def parse(plain: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at an offset, and where the next one begins."""
    end = plain.index(b"\r\n\r\n", at)
    lines = plain[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    body = plain[begin:stop]
    return head, body[body.index(b"\r\n\r\n") + 4 :], stop + 4


def row_of(head: dict[str, str], payload: bytes) -> tuple:
    """A row of RECORD; a response must have the digest that it states."""
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"digest of {head['WARC-Record-ID']} differs")
    size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
    target = head.get("WARC-Refers-To")
    return page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Record-ID"], kind, page_of(target), size, digest, payload if kind == "response" else None


def with_owner(pages: DataFrame) -> DataFrame:
    """Adds the greatest ``own`` of the rows with equal payload, and ``copy``, the number of the row among equal ones.

    Rows of one payload are dealt to ``SALTS`` tasks by their id, so neither a step has all of them.
    """
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(SALTS)))
    parts = salted.groupBy("sha1", "size", "salt").agg(F.max("own").alias("top"))
    first = parts.select(F.col("sha1").alias("s"), F.col("size").alias("z"), F.col("salt").alias("k"), F.max("top").over(Window.partitionBy("sha1", "size")).alias("owner"))
    joined = salted.join(first, (F.col("sha1") == F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("k"))).drop("s", "z", "k")
    return joined.withColumn("copy", F.row_number().over(Window.partitionBy("sha1", "size", "salt", "own").orderBy("own")) - 1)


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Bundles of the records of all pages: (bundle, data, entries). Cut lineage or write them before reading twice."""
    small_batches(pages.sparkSession)
    payload: Column = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.struct(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).alias("own"), payload.alias("payload"))
    rows = with_owner(rows.select("own", "payload", F.sha1("payload").alias("sha1"), F.length("payload").alias("size")))
    response = (F.col("own") == F.col("owner")) & (F.col("copy") == 0)
    rows = rows.select(
        F.col("own.page_id").cast("string").alias("page_id"), F.col("own.url").alias("url"), "sha1", "size", F.col("copy").alias("copy"),
        response.alias("response"), F.col("owner.page_id").cast("string").alias("owner_id"), F.col("owner.url").alias("owner_url"), F.when(response, F.col("payload")).alias("payload"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, names = Bundle(frame_bytes, level), hashlib.sha256()

        def ship() -> pd.DataFrame:
            data, entries = now.done()
            return pd.DataFrame({"bundle": [f"{names.hexdigest()[:32]}.warc.zst"], "data": [data], "entries": [[{"record_id": r, "frame": f, "offset": o, "length": n} for r, f, o, n in entries]]})

        for batch in batches:
            for r in batch.itertuples(index=False):
                digest = base64.b32encode(bytes.fromhex(r.sha1)).decode()
                owner = None if r.response else record_id(r.owner_id, r.owner_url, digest, 0)
                name, record = make_record(r.page_id, r.url, digest, r.size, r.copy, owner, r.payload if r.response else None)
                now.add(name, record)
                names.update(name.encode())
                if now.size >= bundle_bytes:
                    yield ship()
                    now, names = Bundle(frame_bytes, level), hashlib.sha256()
        if now.entries:
            yield ship()

    return rows.mapInPandas(run, BUNDLE)


def read(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of bundles of (bundle, data), in rows of RECORD; ids are text. Revisits have no payload of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                table = seek_table(data)
                for k in range(len(table)):
                    plain, at, rows = frame(data, table, k), 0, []
                    while at < len(plain):
                        head, payload, at = parse(plain, at)
                        row = row_of(head, payload)
                        rows.append(row if payloads else (*row[:-1], None))
                    yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in RECORD.split(", ")])

    return bundles.select("data").mapInPandas(run, RECORD)


def index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset, length) of every record."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.record_id", "bundle", "e.frame", "e.offset", "e.length")


def fetch(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with the given ``record_id``, from the bundles' indexes: of each bundle only their frames are unpacked."""
    wanted = index(bundles).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    places = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))  # of one bundle

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, places in zip(batch["data"], batch["places"], strict=True):
                table, last, plain, rows = seek_table(data), -1, b"", []
                for p in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                    if p["frame"] != last:
                        last, plain = p["frame"], frame(data, table, p["frame"])
                    rows.append(row_of(*parse(plain, p["offset"])[:2]))
                yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in RECORD.split(", ")])

    return bundles.select("bundle", "data").join(places, "bundle").select("data", "places").mapInPandas(run, RECORD)


def read_files(spark, path: str) -> DataFrame:
    """Bundles that lie as files in a folder: (bundle, data)."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("bundle"), F.col("content").alias("data"))
