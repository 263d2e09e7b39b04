"""Media columns: a lossless byte payload as an uncompressed Matroska track.

``write`` stores 8-bit samples as an uncompressed greyscale video track: frames of
24 x 24 samples, grouped into laced SimpleBlocks and clusters, with cues.  ``packets``
reads any Matroska file of that element set: it walks variable-length EBML elements,
clusters (SimpleBlock and BlockGroup), all four kinds of lacing and the cues into a
packet table of timestamps, tracks and byte ranges.  Payload bytes are taken from the
stored bytes by those ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import by_batch, spread

FRAME_SIDE = 24
FRAME_BYTES = FRAME_SIDE * FRAME_SIDE
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32
FRAME_MS = 40

# Element ids of the Matroska and EBML specifications.
EBML = 0x1A45DFA3
EBML_VERSION = 0x4286
EBML_READ_VERSION = 0x42F7
EBML_MAX_ID_LENGTH = 0x42F2
EBML_MAX_SIZE_LENGTH = 0x42F3
DOC_TYPE = 0x4282
DOC_TYPE_VERSION = 0x4287
DOC_TYPE_READ_VERSION = 0x4285
SEGMENT = 0x18538067
INFO = 0x1549A966
TIMESTAMP_SCALE = 0x2AD7B1
MUXING_APP = 0x4D80
WRITING_APP = 0x5741
TRACKS = 0x1654AE6B
TRACK_ENTRY = 0xAE
TRACK_NUMBER = 0xD7
TRACK_UID = 0x73C5
TRACK_TYPE = 0x83
FLAG_LACING = 0x9C
CODEC_ID = 0x86
DEFAULT_DURATION = 0x23E383
VIDEO = 0xE0
PIXEL_WIDTH = 0xB0
PIXEL_HEIGHT = 0xBA
UNCOMPRESSED_FOURCC = 0x2EB524
CLUSTER = 0x1F43B675
TIMESTAMP = 0xE7
SIMPLE_BLOCK = 0xA3
BLOCK_GROUP = 0xA0
BLOCK = 0xA1
REFERENCE_BLOCK = 0xFB
CUES = 0x1C53BB6B
CUE_POINT = 0xBB
CUE_TIME = 0xB3
CUE_TRACK_POSITIONS = 0xB7
CUE_TRACK = 0xF7
CUE_CLUSTER_POSITION = 0xF1

_MASTERS = {SEGMENT, TRACKS, TRACK_ENTRY, VIDEO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, INFO}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = range(4)


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def vint(number: int, length: int = 0) -> bytes:
    """An EBML variable-length size; the value of all ones is kept for the unknown size."""
    need = length or next(n for n in range(1, 9) if number < (1 << 7 * n) - 1)
    return (number | 1 << 7 * need).to_bytes(need, "big")


def element(number: int, body: bytes) -> bytes:
    return _id(number) + vint(len(body)) + body


def _uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def write(payload: bytes, frame_bytes: int = FRAME_BYTES) -> bytes:
    """A Matroska file of ``payload``, whose length is a multiple of ``frame_bytes``."""
    if len(payload) % frame_bytes:
        raise ValueError("the payload must fill whole frames")
    head = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID_LENGTH, 4) + _uint(EBML_MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"planewise") + element(WRITING_APP, b"planewise"))
    video = element(VIDEO, _uint(PIXEL_WIDTH, FRAME_SIDE) + _uint(PIXEL_HEIGHT, frame_bytes // FRAME_SIDE) + element(UNCOMPRESSED_FOURCC, b"Y800"))
    entry = element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 1) + _uint(FLAG_LACING, 1) + element(CODEC_ID, b"V_UNCOMPRESSED") + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + video)
    parts, at, cues = [info, element(TRACKS, entry)], len(info), []
    at += len(parts[1])
    frames, view = len(payload) // frame_bytes, memoryview(payload)
    for first in range(0, frames, FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER):
        last = min(frames, first + FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER)
        start, blocks = first * FRAME_MS, []
        for f in range(first, last, FRAMES_PER_BLOCK):
            n = min(FRAMES_PER_BLOCK, last - f)
            flags = 0x80 | (FIXED_LACING if n > 1 else NO_LACING) << 1
            lace = bytes([n - 1]) if n > 1 else b""
            blocks.append(element(SIMPLE_BLOCK, vint(1) + ((f - first) * FRAME_MS).to_bytes(2, "big", signed=True) + bytes([flags]) + lace + bytes(view[f * frame_bytes : (f + n) * frame_bytes])))
        cluster = element(CLUSTER, _uint(TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Parsed:
    """Packets as (timestamp in nanoseconds, track, start byte, length, keyframe) and what else the features need.

    ``scale`` is the file's own: nanoseconds of one unit of its timestamps.
    """

    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    blocks: int = 0
    laced: int = 0
    segment: int = 0


def _read_id(data: bytes, at: int) -> tuple[int, int]:
    length = 9 - data[at].bit_length() if data[at] else 9
    if length > 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + length], "big"), at + length


def _read_vint(data: bytes, at: int) -> tuple[int | None, int, int]:
    """(value, next byte, length); None is the unknown size."""
    length = 9 - data[at].bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"no size at byte {at}")
    value = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (None if value == (1 << 7 * length) - 1 else value), at + length, length


def _lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a laced block's frames, and where the first begins."""
    n, at = data[at] + 1, at + 1
    if kind == FIXED_LACING:
        if (end - at) % n:
            raise ValueError("a fixed lace isn't divisible")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == XIPH_LACING:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        else:
            value, at, length = _read_vint(data, at)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * length - 1) - 1))
    return [*sizes, end - at - sum(sizes)], at


def packets(data: bytes) -> Parsed:
    """The packet table of a Matroska file; ValueError where the bytes aren't one.

    A frame of a lace comes its track's default duration after the one before it, at the
    same time if the track has none.  A block of a group is a keyframe unless the group
    refers to another block.
    """
    out = Parsed()
    grouped: list[int] = []  # packets of the group that is open
    track: dict = {}
    cue: dict = {}
    stack = [(0, len(data), 0)]
    cluster_time = 0
    while stack:
        at, end, parent = stack.pop()
        while at < end:
            start = at
            number, at = _read_id(data, at)
            size, at, _ = _read_vint(data, at)
            stop = end if size is None else at + size
            if stop > len(data):
                raise ValueError(f"the element at byte {start} is cut off")
            if number == SEGMENT:
                out.segment = at
            elif number == TIMESTAMP_SCALE:
                out.scale = int.from_bytes(data[at:stop], "big")
            elif number == BLOCK_GROUP:
                grouped = []
            elif number == REFERENCE_BLOCK:
                grouped.append(-1)
                for i in grouped:
                    if i >= 0:
                        out.packets[i] = (*out.packets[i][:4], False)
            elif number == CLUSTER:
                out.clusters.append(start)
                cluster_time = 0
            elif number == TRACK_ENTRY:
                track = {}
            elif number == TIMESTAMP:
                cluster_time = int.from_bytes(data[at:stop], "big")
            elif number in (TRACK_NUMBER, TRACK_TYPE, PIXEL_WIDTH, PIXEL_HEIGHT, DEFAULT_DURATION):
                track[number] = int.from_bytes(data[at:stop], "big")
                if number == TRACK_NUMBER:
                    out.tracks[track[number]] = track
            elif number == CODEC_ID:
                track[number] = data[at:stop].decode("ascii", "replace")
            elif number == CUE_TIME:
                cue[number] = int.from_bytes(data[at:stop], "big")
            elif number == CUE_TRACK:
                cue[number] = int.from_bytes(data[at:stop], "big")
            elif number == CUE_CLUSTER_POSITION:
                out.cues.append((cue.get(CUE_TIME, 0), cue.get(CUE_TRACK, 0), out.segment + int.from_bytes(data[at:stop], "big")))
            elif number in (SIMPLE_BLOCK, BLOCK):
                who, p, _ = _read_vint(data, at)
                when = cluster_time + int.from_bytes(data[p : p + 2], "big", signed=True)
                flags, p = data[p + 2], p + 3
                kind = flags >> 1 & 3
                sizes, p = ([stop - p], p) if kind == NO_LACING else _lace_sizes(data, p, stop, kind)
                out.blocks += 1
                out.laced += kind != NO_LACING
                step = out.tracks.get(who, {}).get(DEFAULT_DURATION, 0)
                key = bool(flags & 0x80) if number == SIMPLE_BLOCK else -1 not in grouped
                for k, n in enumerate(sizes):
                    grouped.append(len(out.packets))
                    out.packets.append((when * out.scale + k * step, who, p, n, key))
                    p += n
            if number in _MASTERS:
                stack.append((stop, end, parent))
                stack.append((at, stop, number))
                break
            at = stop
    return out


def payload_of(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    """The track's bytes, from the packets' byte ranges."""
    return b"".join([data[p : p + n] for _, who, p, n, _ in parsed.packets if who == track])


def feature(parsed: Parsed) -> str:
    """A summary of the packet table: track shape, packets, blocks, clusters, cues that point at clusters, duration."""
    t = parsed.tracks.get(1, {})
    starts = set(parsed.clusters)
    good = sum(p in starts for _, _, p in parsed.cues)
    step = t.get(DEFAULT_DURATION, 0)
    end = max((x[0] + step for x in parsed.packets), default=0)
    return f"{t.get(CODEC_ID, '')}:{t.get(PIXEL_WIDTH, 0)}x{t.get(PIXEL_HEIGHT, 0)}:packets={len(parsed.packets)}:blocks={parsed.blocks}:laced={parsed.laced}:clusters={len(parsed.clusters)}:cues={good}:ms={end // 1_000_000}"


def padded(raw: bytes, unit: int = FRAME_BYTES) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``unit``."""
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def encode_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the text of each row as a Matroska file; a null text is an empty one."""

    def make(c: dict) -> dict:
        raw = [(t or "").encode() for t in c["text"].to_pylist()]
        return {"doc_id": c["doc_id"], "n_bytes": [len(r) for r in raw], "media": [write(padded(r)) for r in raw]}

    return by_batch(spread(_read(docs)), "doc_id long, n_bytes long, media binary", make)


def packet_column(media: DataFrame) -> DataFrame:
    """(doc_id, packets): the packet table of each media value, as an array of structs with nanosecond timestamps; null for a null."""
    kind = pa.struct([("ts", pa.int64()), ("track", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("key", pa.bool_())])

    def make(c: dict) -> dict:
        rows = [None if x is None else [dict(zip(("ts", "track", "start", "length", "key"), p, strict=True)) for p in packets(x).packets] for x in c["media"].to_pylist()]
        return {"doc_id": c["doc_id"], "packets": pa.array(rows, pa.list_(kind))}

    ddl = "array<struct<ts: bigint, track: bigint, start: bigint, length: bigint, key: boolean>>"
    return by_batch(spread(media.select("doc_id", "media")), {"doc_id": ("long", pa.int64()), "packets": (ddl, pa.list_(kind))}, make)


def digests(docs: DataFrame) -> DataFrame:
    """Store each whole text, read it back from the stored bytes and digest both forms.

    Null and empty texts store one frame of padding.  Rows are independent: repeated
    rows give equal rows, an empty table gives none, further columns aren't read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")][1:]

    def make(c: dict) -> dict:
        rows = []
        for value in c["text"]:
            raw = (value.as_py() or "").encode()
            media = write(padded(raw))
            parsed = packets(media)
            back = payload_of(media, parsed)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed)))
        return {"doc_id": c["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return by_batch(spread(_read(docs)), schema, make)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
