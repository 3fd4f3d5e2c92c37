"""WARC archives in seekable Zstandard bundles.

Every page becomes one WARC record. Records are grouped into independent
Zstandard frames of about ``FRAME_BYTES``; frames are concatenated into
bundles of about ``BUNDLE_BYTES`` that end in the seekable format's footer (a
skippable frame with every frame's compressed and decompressed size). An index
maps each record id to (bundle, frame, offset in the frame, length), so one
record is read by decompressing one frame.

Bundles are rows of a Parquet table written by Spark's committer in the shared
folder (a retried task replaces its own output; nothing is written from Python
to a path); ``data`` of a row is a complete ``.warc.zst`` file.

Payloads that occur more than once (and have at least ``MIN_REVISIT`` bytes)
are stored once, by the row with the largest page id; the others are revisit
records that refer to it.

Defined results: null html is an empty payload, null url an empty target; a
null page id is kept (empty in the record id); rows that repeat the largest
page id of a payload are all responses; no pages give no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, materialize

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
MIN_REVISIT = 1000
SALTS = 16
DATE = "1970-01-01T00:00:00Z"     # the pages carry no capture time
# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

BUNDLE_SCHEMA = ("bundle string, data binary, record_ids array<string>, frames array<int>, offsets array<int>, "
                 "lengths array<int>")
RECORD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long")


# ------------------------------------------------------------ records
def _uri(page_id: str | None) -> str:
    return f"<urn:page:{page_id or ''}>"


def _record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=~%')}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_uri(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"type": warc["warc-type"], "id": warc["warc-record-id"], "uri": warc["warc-target-uri"],
            "digest": base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "refers_to": warc.get("warc-refers-to"), "payload": payload,
            "payload_bytes": int(_fields(http)["content-length"])}


# ------------------------------------------------------------ bundles
def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames (compressed bytes, decompressed size) and their seek table."""
    entries = b"".join(struct.pack("<II", len(data), size) for data, size in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return (b"".join(data for data, _ in frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer))
            + entries + footer)


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    out, start = [], 0
    for packed, size in struct.iter_unpack("<II", data[-9 - 8 * count:-9]):
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(data: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    start, packed, size = table[frame]
    return zstandard.ZstdDecompressor().decompress(data[start:start + packed], max_output_size=max(1, size))


def _bundles(frames_in: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    press = zstandard.ZstdCompressor(level=3)
    part, made = TaskContext.get().partitionId(), 0
    frames: list[tuple[bytes, int]] = []
    ids: list[str] = []
    at: list[tuple[int, int, int]] = []
    buffer = bytearray()

    def close_frame() -> None:
        if buffer:
            frames.append((press.compress(bytes(buffer)), len(buffer)))
            buffer.clear()

    def close_bundle() -> pd.DataFrame:
        nonlocal made, frames, ids, at
        close_frame()
        row = pd.DataFrame({"bundle": [f"bundle-{part:06d}-{made:04d}.warc.zst"], "data": [seal(frames)],
                            "record_ids": [ids], "frames": [[x[0] for x in at]], "offsets": [[x[1] for x in at]],
                            "lengths": [[x[2] for x in at]]})
        made, frames, ids, at = made + 1, [], [], []
        return row

    for pdf in frames_in:
        for row in pdf.itertuples(index=False):
            raw = _record(row.page_id, row.url, (row.html or "").encode("utf-8", "surrogatepass"), row.refers_to,
                          row.revisit)
            ids.append(_uri(row.page_id))
            at.append((len(frames), len(buffer), len(raw)))
            buffer += raw
            if len(buffer) >= FRAME_BYTES:
                close_frame()
                if sum(len(d) for d, _ in frames) >= BUNDLE_BYTES:
                    yield close_bundle()
    if ids:
        yield close_bundle()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The bundles of ``pages`` as a stored table (``BUNDLE_SCHEMA``)."""
    bound_arrow(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sha = F.unhex(F.sha2("html", 256)).alias("sha")
    firsts = (src.select("page_id", sha, F.octet_length("html").alias("bytes")).filter(F.col("bytes") >= MIN_REVISIT)
              .groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = src.select("*", sha, F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    tagged = (salted.join(firsts, ["sha", "salt"], "left")
              .select(F.col("page_id").cast("string").alias("page_id"), "url", "html",
                      F.when(revisit, F.col("first")).cast("string").alias("refers_to"), revisit.alias("revisit")))
    return materialize(tagged.mapInPandas(_bundles, BUNDLE_SCHEMA), "warc")


def index(bundles: DataFrame) -> DataFrame:
    """``record_id, bundle, frame, offset, length`` of every record."""
    zipped = F.arrays_zip("record_ids", "frames", "offsets", "lengths")
    return bundles.select("bundle", F.explode(zipped).alias("x")).select(
        F.col("x.record_ids").alias("record_id"), "bundle", F.col("x.frames").alias("frame"),
        F.col("x.offsets").alias("offset"), F.col("x.lengths").alias("length"))


def _page(uri: str | None) -> str | None:
    return (uri.removeprefix("<urn:page:").removesuffix(">") or None) if uri else None


def _read(frames_in: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames_in:
        for bundle in pdf.itertuples(index=False):
            table, held, raw, out = seek_table(bundle.data), -1, b"", []
            for frame, offset, length in zip(bundle.frames, bundle.offsets, bundle.lengths, strict=True):
                if frame != held:
                    held, raw = frame, read_frame(bundle.data, table, frame)
                x = parse_record(raw[offset:offset + length])
                if x["type"] == "response" and hashlib.sha1(x["payload"]).hexdigest() != x["digest"]:
                    raise ValueError(f"{bundle.bundle}: payload of {x['id']} does not match its digest")
                out.append((_page(x["id"]), x["uri"], x["payload_bytes"], x["digest"], x["type"], _page(x["refers_to"])))
            yield pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                             "refers_to"])


def read_archives(bundles: DataFrame) -> DataFrame:
    """Every record, read back through seek tables and index
    (``RECORD_SCHEMA``); stored payloads are checked against their digests."""
    text = RECORD_SCHEMA.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    rows = bundles.select("bundle", "data", "frames", "offsets", "lengths").mapInPandas(_read, text)
    return rows.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def read_records(bundles: DataFrame, record_ids: Column) -> DataFrame:
    """Raw records by id: one frame of one bundle is decompressed for each."""
    @F.pandas_udf("binary")
    def cut(data: pd.Series, frame: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([read_frame(d, seek_table(d), f)[o:o + n]
                          for d, f, o, n in zip(data, frame, offset, length, strict=True)], dtype=object)

    wanted = index(bundles).filter(record_ids)
    return (wanted.join(bundles.select("bundle", "data"), "bundle")
            .select("record_id", cut("data", "frame", "offset", "length").alias("record")))
