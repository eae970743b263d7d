"""Ogg columns: documents stored as 8-bit samples in an Ogg container, and such containers read back.

A stored file holds two logical streams, multiplexed page by page. The sample stream begins with a header packet and goes
on with packets of samples, its granule position being the samples so far; the cue stream has, for each run of sample
packets, a page of its own whose granule position is the sample that the run ends at, with the CRC-32 of the run. Reading
verifies the checksum of every page, takes the pages of each stream in sequence, reassembles packets from lacing values
across pages, and derives all timestamps from granule positions: a position that doesn't fit the samples is an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 8000
UNIT = 192
SAMPLES, CUES = 0x53414D50, 0x43554553  # serial numbers of the two streams
PACKET = 4800  # samples in a packet
RUN = 8  # sample packets to a cue
SEGMENTS = 48  # lacing values on a page at most, so that packets go on over page ends
HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, most significant bit first, no inversion) of a page whose checksum field is
    zero: zlib's reflected CRC over bit-reversed bytes, without its inversions, reversed."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


class StreamWriter:
    """Pages of one logical stream. add() takes packets with the granule position at their end."""

    def __init__(self, serial: int, segments: int = SEGMENTS):
        self.serial, self.segments, self.number = serial, segments, 0
        self.lacing, self.body, self.granule, self.goes_on = [], [], -1, False
        self.pages: list[bytes] = []

    def add(self, packet: bytes, granule: int) -> None:
        at, left = 0, len(packet)
        while True:
            size = min(255, left)
            self.lacing.append(size)
            self.body.append(packet[at : at + size])
            at, left = at + size, left - size
            ended = size < 255
            if ended:
                self.granule = granule
            if len(self.lacing) == self.segments:
                self.flush(goes_on=not ended)
            if ended:
                return

    def flush(self, last: bool = False, goes_on: bool = False) -> None:
        if not self.lacing and not last:
            return
        flags = (1 if self.goes_on else 0) | (2 if self.number == 0 else 0) | (4 if last else 0)
        lacing, body = bytes(self.lacing), b"".join(self.body)
        page = HEAD.pack(b"OggS", 0, flags, self.granule, self.serial, self.number, 0, len(lacing)) + lacing + body
        self.pages.append(page[:22] + struct.pack("<I", page_checksum(page)) + page[26:])
        self.lacing, self.body, self.granule, self.goes_on = [], [], -1, goes_on
        self.number += 1

    def taken(self) -> list[bytes]:
        pages, self.pages = self.pages, []
        return pages


def encode(payload: bytes) -> bytes:
    """An Ogg file with payload's bytes as unsigned 8-bit samples."""
    sound, cue, out = StreamWriter(SAMPLES), StreamWriter(CUES), []
    sound.add(b"\x80pcm8\x00\x00\x00" + struct.pack("<IIQ", RATE, 1, len(payload)), 0)
    cue.add(b"\x80cues\x00\x00\x00" + struct.pack("<I", RUN), 0)
    for stream in (sound, cue):  # the first pages of all streams stand before any others
        stream.flush()
        out += stream.taken()
    check, packets = 0, 0
    for at in range(0, len(payload), PACKET):
        packet = payload[at : at + PACKET]
        done = at + len(packet)
        sound.add(packet, done)
        check, packets = zlib.crc32(packet, check), packets + 1
        if packets % RUN == 0 or done == len(payload):
            cue.add(struct.pack("<I", check), done)
            cue.flush()
            check = 0
        out += sound.taken() + cue.taken()
    for stream in (sound, cue):
        stream.flush(last=True)
        out += stream.taken()
    return b"".join(out)


def demultiplex(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, granule position at each packet's end, pages, and whether the end was
    marked. A packet that ends on a page before that page's last packet has no granule position of its own: None.

    ValueError says what is wrong with a file: no page where one should begin, a checksum, a gap in a stream's pages, a
    packet that is left open.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEAD.size or media[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, checksum, n = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        body = at + HEAD.size + n
        end = body + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise ValueError(f"page at byte {at} is cut off or of another version")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise ValueError(f"checksum of the page at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": [], "ended": False})
        if number != s["pages"] or s["ended"] or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(s["open"]):
            raise ValueError(f"stream {serial}: page {number} after {s['pages']} pages")
        s["pages"] += 1
        finished = 0
        start = body
        for size in lacing:
            body += size
            if size < 255:
                s["packets"].append(b"".join([*s["open"], media[start:body]]))
                s["granules"].append(None)
                s["open"], start, finished = [], body, finished + 1
        if start < body:
            s["open"].append(media[start:body])
        if finished:
            s["granules"][-1] = granule
        s["ended"] = bool(flags & 4)
        at = end
    if left := [serial for serial, s in streams.items() if s["open"] or not s["ended"]]:
        raise ValueError(f"streams {left} don't end")
    return streams


def decode(media: bytes) -> tuple[bytes, dict]:
    """Payload and facts of a file made by encode(); timestamps are granule positions over the rate. ValueError if a
    granule position, the header or a cue doesn't fit the samples."""
    streams = demultiplex(media)
    sound, cue = streams[SAMPLES], streams[CUES]
    rate, _, total = struct.unpack_from("<IIQ", sound["packets"][0], 8)
    packets = sound["packets"][1:]
    ends = np.cumsum([0, *map(len, packets)]).tolist()
    stamped = [(g, e) for g, e in zip(sound["granules"][1:], ends[1:]) if g is not None]
    last = stamped[-1][0] if stamped else 0
    if sound["granules"][0] != 0 or any(g != e for g, e in stamped) or last != ends[-1] or total != last:
        raise ValueError("granule positions don't fit the samples")
    if cue["granules"][0] != 0 or any(g is None for g in cue["granules"]):
        raise ValueError("a cue has no granule position")
    k, cues = 0, []
    for packet, granule in zip(cue["packets"][1:], cue["granules"][1:]):
        check = 0
        while k < len(packets) and ends[k + 1] <= granule:
            check, k = zlib.crc32(packets[k], check), k + 1
        if ends[k] != granule or check != struct.unpack("<I", packet)[0]:
            raise ValueError("a cue doesn't fit the samples")
        cues.append(granule / rate)
    if k != len(packets):
        raise ValueError("samples after the last cue")
    return b"".join(packets), {
        "pages": sum(s["pages"] for s in streams.values()),
        "packets": sum(len(s["packets"]) for s in streams.values()),
        "streams": len(streams),
        "seconds": last / rate,
        "cue_seconds": cues,
    }


def pad(data: bytes) -> bytes:
    """data with blanks up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def feature(payload: bytes, facts: dict) -> str:
    """A fixed description of the stored sound: container counts, length, level, spread, sign changes, peak bin."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    mean = int(x.sum()) / len(x)
    power = int((x * x).sum()) / len(x)
    turns = int(np.count_nonzero(np.diff(np.signbit(x))))
    bins = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return f"pages={facts['pages']};packets={facts['packets']};streams={facts['streams']};seconds={facts['seconds']:.6f};cues={len(facts['cue_seconds'])};mean={mean:.6f};power={power:.6f};turns={turns};mode={int(bins.argmax())}"


def write_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for every row of docs: its text as UTF-8, padded and stored as an Ogg file.

    A null text is stored as an empty one: a payload of blanks. Other columns are ignored. Repeated rows give repeated
    files, an empty table an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(files, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of every stored file (doc_id, n_bytes, media), from the bytes read back.

    A file that isn't whole raises; null media give nulls beside doc_id and n_bytes. Repeated rows are read one by one; an empty table gives an empty one.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, n, stored in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                payload, facts = (None, None) if stored is None else decode(stored)
                values = (doc_id, n, *[None] * 6) if payload is None else (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, facts))
                for column, value in zip(rows, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)

    return media.mapInArrow(digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
