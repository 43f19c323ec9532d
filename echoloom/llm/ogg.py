"""Ogg as a media column: texts stored as 8-bit samples in a multiplexed Ogg file, and read back.

Layout of the files written here: two logical streams. The audio stream has a header packet
(``PCM8`` magic, version, rate, channels) and packets of up to PACKET unsigned 8-bit mono samples;
its granule position is the number of samples that end on a page. The notes stream has a header
packet and one packet with the text's length before padding. Begin-of-stream pages come first, as
RFC 3533 asks. The reader takes any multiplexed file: it checks every page's checksum and
sequence number, rejoins packets from lacing values over page ends, and keeps streams apart by
serial number.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

RATE, PACKET, AUDIO, NOTES = 8000, 4096, 0x50434D38, 0x4E4F5445
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC of an Ogg page: polynomial 0x04C11DB7, from the top bit, start 0, no final inversion.

    That is the common CRC-32 of the bit-mirrored bytes, mirrored, with its inversions undone.
    """
    return int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


class Stream:
    """Pages of one logical stream; a packet too long for a page goes on in the next."""

    def __init__(self, serial: int):
        self.serial, self.number, self.lacing, self.body, self.granule, self.open = serial, 0, bytearray(), bytearray(), -1, False

    def flush(self, last: bool = False) -> bytes:
        flags = (1 if self.open else 0) | (2 if not self.number else 0) | (4 if last else 0)
        page = _page(self.serial, self.number, flags, self.granule, bytes(self.lacing), bytes(self.body))
        self.open = bool(self.lacing) and self.lacing[-1] == 255
        self.number += 1
        self.lacing, self.body, self.granule = bytearray(), bytearray(), -1
        return page

    def add(self, packet: bytes, granule: int) -> Iterator[bytes]:
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while lacing:
            if len(self.lacing) == 255:
                yield self.flush()
            part, lacing = lacing[: 255 - len(self.lacing)], lacing[255 - len(self.lacing) :]
            n = sum(part)
            self.lacing += part
            self.body += packet[at : at + n]
            at += n
        self.granule = granule


def padded(data: bytes, unit: int = 64) -> bytes:
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def write(data: bytes) -> bytes:
    """An Ogg file with the padded data as audio samples and its length as a note."""
    payload, audio, notes, out = padded(data), Stream(AUDIO), Stream(NOTES), []
    out += audio.add(struct.pack("<4sHIB", b"PCM8", 1, RATE, 1), 0)
    out.append(audio.flush())
    out += notes.add(b"NOTE\1\0", 0)
    out.append(notes.flush())
    out += notes.add(struct.pack("<Q", len(data)), len(payload))
    out.append(notes.flush(last=True))
    for at in range(0, len(payload), PACKET):
        part = payload[at : at + PACKET]
        out += audio.add(part, at + len(part))
    out.append(audio.flush(last=True))
    return b"".join(out)


def read(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, (granule, packets ended) of each page, pages, ended.

    Raises ValueError for a broken checksum, a page out of order, bad capture or cut-off data.
    """
    streams: dict[int, dict] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        start, end = at + 27 + n, at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise ValueError(f"bad page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        s = streams.get(serial)
        if s is None:
            if not flags & 2:
                raise ValueError(f"stream {serial} begins without a first page")
            s = streams[serial] = {"packets": [], "granules": [], "pages": 0, "ended": False, "rest": []}
        if number != s["pages"] or s["ended"] or bool(flags & 1) != bool(s["rest"]):
            raise ValueError(f"page {number} of stream {serial} out of order")
        done, pos = 0, start
        run = 0
        for x in lacing:
            run += x
            if x < 255:
                s["packets"].append(b"".join([*s["rest"], view[pos : pos + run]]))
                s["rest"], pos, run, done = [], pos + run, 0, done + 1
        if run or (n and lacing[-1] == 255):
            s["rest"].append(bytes(view[pos : pos + run]))
        if done:
            s["granules"].append((granule, done))
        s["pages"] += 1
        s["ended"] = bool(flags & 4)
        at = end
    if any(not s["ended"] or s["rest"] for s in streams.values()):
        raise ValueError("a stream is cut off")
    return streams


def payload(media: bytes) -> tuple[bytes, int, list[float], int]:
    """(samples, length before padding, end time of each audio page in seconds, pages)."""
    streams = read(media)
    audio, note = streams[AUDIO], streams[NOTES]
    _, _, rate, _ = struct.unpack("<4sHIB", audio["packets"][0])
    samples = b"".join(audio["packets"][1:])
    if audio["granules"][-1][0] != len(samples):
        raise ValueError("granule position and samples differ")
    return samples, struct.unpack("<Q", note["packets"][1])[0], [g / rate for g, _ in audio["granules"][1:]], audio["pages"] + note["pages"]


def feature(samples: bytes, times: list[float], pages: int) -> str:
    x = np.frombuffer(samples, np.uint8)
    mean, level = x.mean(), float(np.sqrt(np.mean((x.astype(np.float64) - 128.0) ** 2)))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"seconds={times[-1]:.6f};pages={pages};mean={mean:.4f};rms={level:.4f};crossings={crossings}"


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    One row for each row of docs: its text is written as an Ogg file, the file is read back with
    all checks, and every column but n_bytes and the two of the file comes from what was read.
    Null text counts as empty; ids may be null or repeated; an empty table gives no rows; other
    columns are not read. keep_media adds the files in a binary column ``media``.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cols: list[list] = [[] for _ in names[1:]]
            for t in b.column("text").to_pylist():
                data = (t or "").encode("utf-8")
                media = write(data)
                samples, n, times, pages = payload(media)
                row = [n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples, times, pages), media]
                for c, v in zip(cols, row, strict=False):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return cut(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema), texts=True)
