"""Ogg media column: whole payloads as 8-bit samples in an Ogg container, and a reader that verifies and demultiplexes.

Writer: the payload is cut into packets of PACKET samples, dealt in turn to STREAMS logical streams. A stream opens
with one header page (bos) and ends with an eos page; a page has at most 255 lacing values, and a packet longer than
what is left continues on the next page. A page's granule position is the sample index, in the whole payload, at
which its last complete packet ends, or -1 if no packet ends on it. Pages of all streams are interleaved.

Reader: finds pages, verifies each checksum and sequence number, rebuilds packets from lacing values, separates
streams by serial number, derives each packet's start from granule positions and puts the samples back in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.common import documents, text_or_empty

BLOCK = 192  # payloads are padded with spaces to a positive multiple of it
PACKET = 1920  # samples of a packet
STREAMS = 2
HEAD = struct.Struct("<4sBBqIIIB")  # capture pattern, version, flags, granule, serial, sequence, checksum, segments
MAGIC = b"PLpcm8\x00\x01"
CONTINUED, BOS, EOS = 1, 2, 4

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def ogg_crc(data: bytes) -> int:
    """The Ogg checksum (polynomial 0x04c11db7, most significant bit first, start 0): zlib's mirrored CRC on mirrored bytes."""
    state = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(state.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = ogg_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream_pages(packets: list[tuple[int, bytes]], serial: int, index: int, total: int) -> list[tuple[int, bytes]]:
    """Pages of one logical stream as (time, page); packets are (end sample, bytes)."""
    header = MAGIC + struct.pack("<BBIQ", index, STREAMS, PACKET, total)
    pages = [(-1, _page(BOS, 0, serial, 0, bytes([len(header)]), header))]
    segments: list[tuple[int, bytes, int]] = []  # lacing value, bytes, end sample or -1
    for end, data in packets:
        cuts = [data[i : i + 255] for i in range(0, len(data), 255)]
        if len(data) % 255 == 0:
            cuts.append(b"")
        segments += [(len(c), c, end if i == len(cuts) - 1 else -1) for i, c in enumerate(cuts)]
    continued, at = False, 0
    groups = [segments[i : i + 255] for i in range(0, len(segments), 255)] or [[]]
    for number, group in enumerate(groups, 1):
        done = [end for _, _, end in group if end >= 0]
        flags = CONTINUED * continued | EOS * (number == len(groups))
        granule = done[-1] if done else (-1 if group else 0)
        pages.append((at, _page(flags, granule, serial, number, bytes(n for n, _, _ in group), b"".join(c for _, c, _ in group))))
        continued = bool(group) and group[-1][2] < 0
        at = granule if granule >= 0 else at
    return pages


def mux(payload: bytes) -> bytes:
    """The payload as an Ogg physical stream. Equal payloads give equal bytes."""
    base = zlib.crc32(payload) & 0xFFFFFFF0
    dealt: list[list[tuple[int, bytes]]] = [[] for _ in range(STREAMS)]
    for number, start in enumerate(range(0, len(payload), PACKET)):
        data = payload[start : start + PACKET]
        dealt[number % STREAMS].append((start + len(data), data))
    pages = [(t, i, n, page) for i, packets in enumerate(dealt) for n, (t, page) in enumerate(_stream_pages(packets, base + i, i, len(payload)))]
    pages.sort(key=lambda x: x[:3])
    return b"".join(x[3] for x in pages)


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, sequence, lacing, body) of each page; raises OggError on a bad capture pattern or checksum."""
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("truncated page header")
        capture, version, flags, granule, serial, sequence, crc, count = HEAD.unpack_from(media, at)
        if capture != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        if len(lacing) != count or at + size > len(media):
            raise OggError("truncated page")
        page = media[at : at + size]
        if ogg_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"bad checksum in page {sequence} of stream {serial}")
        yield flags, granule, serial, sequence, lacing, page[27 + count :]
        at += size


def demux(media: bytes) -> tuple[bytes, dict]:
    """Payload and counts. Every page is verified; packets are timed by granule positions and merged over streams."""
    streams: dict[int, dict] = {}
    n_pages = 0
    for flags, granule, serial, sequence, lacing, body in read_pages(media):
        n_pages += 1
        if flags & BOS:
            streams[serial] = {"next": 0, "part": [], "timed": [], "ended": False}
        if serial not in streams:
            raise OggError(f"stream {serial} has no first page")
        s = streams[serial]
        if sequence != s["next"]:
            raise OggError(f"stream {serial}: page {s['next']} is missing")
        s["next"] += 1
        if bool(flags & CONTINUED) != bool(s["part"]):
            raise OggError(f"stream {serial}: a packet is broken off")
        done, at = [], 0
        for value in lacing:
            s["part"].append(body[at : at + value])
            at += value
            if value < 255:
                done.append(b"".join(s["part"]))
                s["part"] = []
        if flags & BOS:
            head = done[0]
            if head[:8] != MAGIC:
                raise OggError(f"stream {serial}: unknown codec")
            s["index"], s["of"], s["packet"], s["total"] = struct.unpack("<BBIQ", head[8:])
        else:
            end = granule
            for data in reversed(done):  # from the page's granule position back to its first packet
                s.setdefault("late", []).append((end - len(data), data))
                end -= len(data) + (s["of"] - 1) * s["packet"]
            s["timed"] += reversed(s.pop("late", []))
        s["ended"] |= bool(flags & EOS)
    for serial, s in streams.items():
        if s["part"] or not s["ended"]:
            raise OggError(f"stream {serial} is cut off")
    timed = sorted(x for s in streams.values() for x in s["timed"])
    at = 0
    for start, data in timed:
        if start != at:
            raise OggError(f"samples {at} to {start} are missing")
        at += len(data)
    if len({s["total"] for s in streams.values()}) > 1 or any(s["total"] != at for s in streams.values()):
        raise OggError("the sample count differs from the header's")
    return b"".join(data for _, data in timed), {"pages": n_pages, "packets": len(timed), "streams": len(streams), "last": at}


def features(payload: bytes, counts: dict) -> str:
    x = np.frombuffer(payload, dtype=np.uint8)
    centred = x.astype(np.float32) - 128
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"streams={counts['streams']};pages={counts['pages']};packets={counts['packets']};samples={counts['last']};mean={x.mean():.4f};rms={np.sqrt(np.square(centred, dtype=np.float64).mean()):.4f};peak={int(x.max())};crossings={crossings}"


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % BLOCK or BLOCK * (not data))


def ogg_column(df: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per input row: the digests of op10 and, if asked, the Ogg bytes themselves in `media`.

    Null text is the empty text, whose payload is one block of spaces. Rows are independent: repeated rows, ties and
    null keys pass through, an empty table gives an empty one, and other columns are not looked at.
    """
    key_type = df.schema[key].dataType.simpleString()
    schema = f"key {key_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def encode(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                size, payload = padded(value.as_py())
                media = mux(payload)
                back, counts = demux(media)
                row = [size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back, counts)]
                rows.append(row + [media] * keep_media)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media
            names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return df.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(encode, schema).withColumnRenamed("key", key)


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_column(documents(spark, sf_dir))
