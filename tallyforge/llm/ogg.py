"""Ogg media columns: pages with checksums, packets by lacing values, logical streams and granule times.

`encode` lays a document's bytes out as two multiplexed logical streams, each packet 8-bit mono samples of up to PACKET bytes: even
packets go to the first stream, odd ones to the second, so that reading has to demultiplex. Packets run over pages where they don't
fit (lacing values of 255). `decode` reads any physical stream of such samples, also with many packets on a page: it verifies every
page's checksum, sequence number and serial, reassembles packets, demultiplexes and derives each packet's end time from its page's
granule position, counted back by the samples of the packets that end after it there.

Defined results: a null or empty text is a payload of one block of zero bytes; a damaged stream raises no error in `decode`, but gives
ok = false, the pages that fail and whatever packets are whole: of a packet that begins or ends on a lost page nothing is taken;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime

#: Bytes of a packet; lacing values on a page (255 at most); samples a second; bytes to which payloads are padded.
PACKET, SEGMENTS, RATE, BLOCK = 16_000, 255, 8_000, 64
_HEAD = struct.Struct("<4sBBqIIIB")
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_NONE = -1


def checksum(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04c11db7, most significant bit first, start 0. By zlib's, which takes bits in the other order."""
    x = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_FLIP), "big")


class Writer:
    """One logical stream: pages of at most SEGMENTS lacing values."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, continued: bool, first: bool = False, last: bool = False) -> bytes:
        flags = continued | first << 1 | last << 2
        head = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.number, 0, len(lacing)) + lacing)
        self.number += 1
        page = head + body
        page[22:26] = struct.pack("<I", checksum(bytes(page)))
        return bytes(page)

    def pages(self, packet: bytes, granule: int, last: bool) -> Iterator[bytes]:
        """The pages of one packet; only the last of them ends it, and has its granule position."""
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        for k in range(0, len(lacing), SEGMENTS):
            part, end = lacing[k : k + SEGMENTS], k + SEGMENTS >= len(lacing)
            yield self.page(part, packet[255 * k : 255 * k + sum(part)], granule if end else _NONE, k > 0, last=last and end)


def mux(payload: bytes) -> bytes:
    """The physical stream of a payload; the serials come from the payload, so equal payloads give equal bytes."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    streams = [Writer(serial), Writer(serial | 1)]
    out = [w.page(bytes([19]), b"\x01samples" + struct.pack("<BHII", k, 8, RATE, PACKET), 0, False, first=True) for k, w in enumerate(streams)]
    packets = [payload[a : a + PACKET] for a in range(0, len(payload), PACKET)]
    for n, packet in enumerate(packets):
        out += streams[n % 2].pages(packet, min((n + 1) * PACKET, len(payload)), n + 2 >= len(packets))
    if len(packets) < 2:
        out.append(streams[1].page(b"", b"", 0, False, last=True))
    return b"".join(out)


class Reader:
    """What is known of one logical stream while its pages are read: whole packets without headers, with their end times."""

    def __init__(self):
        self.packets, self.times, self.part = [], [], None  # part: pieces of a packet that is not whole yet
        self.next, self.gaps, self.lost, self.headers = 0, 0, 0, 0
        self.first = self.last = False

    def page(self, flags: int, granule: int, number: int, pieces: list[bytes]) -> None:
        if number != self.next:
            self.gaps += 1
            self.lost += self.part is not None
            self.part = None
        self.next = number + 1
        self.first |= bool(flags & 2)
        self.last |= bool(flags & 4)
        orphan = bool(flags & 1) and self.part is None  # the rest of a packet whose beginning is lost
        if not flags & 1 and self.part is not None:  # its end is lost
            self.lost += 1
            self.part = None
        ended = []
        for piece in pieces:
            if not orphan:
                self.part = self.part or []
                self.part.append(piece)
                if len(piece) < 255:
                    ended.append(b"".join(self.part))
                    self.part = None
            elif len(piece) < 255:
                orphan = False
                self.lost += 1
        if flags & 2 and ended:  # a stream's first packet says what it is
            self.headers += 1
            ended = ended[1:]
        if granule == _NONE:  # a page that says nothing: on from what came before
            at = self.times[-1] if self.times else 0
            times = [at := at + len(p) for p in ended]
        else:  # the page's position is the end of its last packet; those before it end earlier by the sizes that follow
            at, times = granule, []
            for p in reversed(ended):
                times.insert(0, at)
                at -= len(p)
        self.packets += ended
        self.times += times


def demux(media: bytes) -> dict:
    """Pages, bad pages and streams by serial. Nothing is taken from a page that is cut short, has another version or a wrong checksum."""
    streams: dict[int, Reader] = {}
    at, pages, bad = 0, 0, 0
    while 0 <= at < len(media):
        if media[at : at + 4] != b"OggS" or at + _HEAD.size > len(media):
            bad += 1
            at = media.find(b"OggS", at + 1)
            continue
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        body = at + _HEAD.size + n
        lacing = media[at + _HEAD.size : body]
        end = body + sum(lacing)
        page = bytearray(media[at:end])
        page[22:26] = bytes(4)
        pages += 1
        if version or len(lacing) < n or end > len(media) or checksum(bytes(page)) != crc:
            bad += 1
            at = media.find(b"OggS", at + 4)
            continue
        pieces = []
        for size in lacing:
            pieces.append(media[body : body + size])
            body += size
        streams.setdefault(serial, Reader()).page(flags, granule, number, pieces)
        at = end
    return {"pages": pages, "bad": bad, "streams": streams}


def payload(read: dict) -> bytes:
    """The samples of all streams: each stream's packets in their sequence, streams merged by end times (then by order of appearance)."""
    queues = [deque(zip(s.times, s.packets, strict=True)) for s in read["streams"].values()]
    heads = [(q[0][0], k) for k, q in enumerate(queues) if q]
    heapify(heads)
    out = []
    while heads:
        _, k = heads[0]
        out.append(queues[k].popleft()[1])
        if queues[k]:
            heapreplace(heads, (queues[k][0][0], k))
        else:
            heappop(heads)
    return b"".join(out)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, its Ogg stream, for each row of doc_id, text."""
    runtime.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = ([], [], []), 0
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                raw = batch.column(1)[i].as_py() or b""
                full = raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")
                for column, x in zip(rows, (doc_id, len(raw), mux(full)), strict=True):
                    column.append(x)
                size += len(full)
                if size > 4 << 20:
                    yield _encoded(rows)
                    rows, size = ([], [], []), 0
            if rows[0]:
                yield _encoded(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _encoded(rows: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["doc_id", "n_bytes", "media"])


_DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages long, bad_pages long, ok boolean"


def decode(media: DataFrame) -> DataFrame:
    """Digests and features of doc_id, n_bytes, media, from the payload read back. feature: streams, pages, packets, seconds by granules, mean and range of samples."""
    runtime.prepare(media.sparkSession)

    def one(doc_id, n_bytes, raw) -> tuple:
        read = demux(raw or b"")
        data, streams = payload(read), read["streams"].values()
        ok = not read["bad"] and bool(streams) and all(s.first and s.last and not s.gaps and not s.lost and s.part is None for s in streams)
        last = max((t for s in streams for t in s.times), default=0)
        n = sum(len(s.packets) for s in streams)
        a = np.frombuffer(data or b"\0", np.uint8)
        feature = f"streams={len(streams)};pages={read['pages']};packets={n};seconds={last / RATE:.6f};mean={a.mean(dtype=np.float64):.6f};low={a.min()};high={a.max()}"
        return doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), feature, read["pages"], read["bad"], ok

    names = [x.split()[0] for x in _DECODED.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in _DECODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [one(*(batch.column(k)[i].as_py() for k in range(3))) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DECODED)
