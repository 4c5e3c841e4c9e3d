"""Matroska: EBML reader with clusters, lacing and cues, and a PCM writer for lossless storage.

``parse`` walks variable-length EBML elements and returns the packet table: one row per frame
with track, timestamp, byte offset and size, keyframe flag, lacing kind, and cluster number.
``write_pcm`` stores bytes as unsigned 8-bit mono samples (A_PCM/INT/LIT) in laced SimpleBlocks.

Defined results: null text counts as empty, whose payload is 192 blanks; equal texts give equal
files (nothing random or dated is written); malformed files give the packets before the fault
and ``complete`` false; repeated rows give repeated rows; an empty table gives an empty table; a very
long text is one file, and its packets are listed in parts of ``PACKETS_IN_PART``; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.llm.batches import map_rows
from vantloom.runtime import table

# Element identifiers of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACING = ("none", "xiph", "fixed", "ebml")
#: Containers that the reader enters; clusters of unknown size end at the next of TOP_LEVEL.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

#: Named as the muxing and the writing application.
APP = b"vantloom"
#: Packets that one array holds on their way to rows.
PACKETS_IN_PART = 4_096
FRAME = 192
RATE = 8000
FRAMES_IN_BLOCK = 8
BLOCKS_IN_CLUSTER = 64


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; ``width`` bytes, or as few as hold it (all ones is reserved)."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, next position); the value is -1 for an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("broken variable-length integer")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    value = raw & ((1 << 7 * width) - 1)
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """Frame count, sizes and data of one laced block body."""
    if kind == "none":
        (only,) = frames
        return only
    head = bytearray([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == "fixed":
        if len(set(sizes)) > 1:
            raise ValueError("fixed lacing needs equal sizes")
    elif kind == "xiph":
        for s in sizes[:-1]:
            head += b"\xff" * (s // 255) + bytes([s % 255])
    else:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            delta = b - a
            width = next(w for w in range(1, 9) if abs(delta) < (1 << 7 * w - 1) - 1)
            head += vint(delta + (1 << 7 * width - 1) - 1, width)
    return bytes(head) + b"".join(frames)


def unlace(data, at: int, end: int, kind: str) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block body that spans ``at`` to ``end``."""
    if kind == "none":
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == "fixed":
        each, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed lacing doesn't divide the block")
        return [(at + k * each, each) for k in range(n)]
    if kind == "xiph":
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            begin = at
            raw, at = read_vint(data, at)
            if raw < 0:  # all ones is the largest difference here, not an unknown size
                raw = (1 << 7 * (at - begin)) - 1
            sizes.append(sizes[-1] + raw - ((1 << 7 * (at - begin) - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced sizes exceed the block")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


def simple_block(track: int, relative: int, frames: list[bytes], lacing: str) -> bytes:
    flags = 0x80 | LACING.index(lacing) << 1
    return element(SIMPLE_BLOCK, vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([flags]) + lace(frames, lacing))


def write_pcm(payload: bytes, *, frame: int = FRAME, rate: int = RATE, lacing: str = "fixed") -> bytes:
    """A Matroska file whose samples are the bytes of ``payload``."""
    ms = frame * 1000 // rate
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, APP) + element(WRITING_APP, APP))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, _float(rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, ms * 1_000_000) + audio
    body = bytearray(info + element(TRACKS, element(TRACK_ENTRY, track)))
    cues = bytearray()
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    per = FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER
    for begin in range(0, len(frames), per):
        cues += element(CUE_POINT, uint(CUE_TIME, begin * ms) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, len(body))))
        blocks = bytearray(uint(CLUSTER_TIMESTAMP, begin * ms))
        group = frames[begin : begin + per]
        for k in range(0, len(group), FRAMES_IN_BLOCK):
            laced = group[k : k + FRAMES_IN_BLOCK]
            kind = "none" if len(laced) == 1 else "ebml" if lacing == "fixed" and len(laced[-1]) != frame else lacing
            blocks += simple_block(1, k * ms, laced, kind)
        body += element(CLUSTER, bytes(blocks))
    body += element(CUES, bytes(cues))
    return head + element(SEGMENT, bytes(body))


def _float(value: float) -> bytes:
    import struct

    return struct.pack(">d", value)


@dataclass
class Media:
    """What a file holds. Times are in nanoseconds, offsets count from the file's first byte."""

    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp_ns, offset, size, keyframe, lacing, cluster)
    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    #: (timestamp_ns, track, offset of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    complete: bool = True


def _children(data, at: int, end: int):
    """(id, body start, body end); an unknown size runs to the parent's end."""
    while at < end:
        ident, body = read_vint(data, at, keep_marker=True)
        size, body = read_vint(data, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError("element exceeds its parent")
        yield ident, body, stop, size < 0
        at = stop


def _number(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def parse(data: bytes) -> Media:
    media, view = Media(), memoryview(data)
    try:
        for ident, a, b, _ in _children(view, 0, len(view)):
            if ident == EBML:
                for i, c, d, _ in _children(view, a, b):
                    if i == DOC_TYPE:
                        media.doc_type = bytes(view[c:d]).decode("ascii", "replace")
            elif ident == SEGMENT:
                _segment(view, a, b, media)
    except (ValueError, IndexError):
        media.complete = False
    return media


def _segment(view, begin: int, end: int, media: Media) -> None:
    at, raw_cues = begin, []
    while at < end:
        start = at
        ident, body = read_vint(view, at, keep_marker=True)
        size, body = read_vint(view, body)
        stop = body + size if size >= 0 else end
        if stop > end:
            raise ValueError("element exceeds the segment")
        if ident == INFO:
            for i, c, d, _ in _children(view, body, stop):
                if i == TIMESTAMP_SCALE:
                    media.scale = _number(view, c, d)
        elif ident == TRACKS:
            for i, c, d, _ in _children(view, body, stop):
                if i == TRACK_ENTRY:
                    _track(view, c, d, media)
        elif ident == CUES:
            for i, c, d, _ in _children(view, body, stop):
                if i == CUE_POINT:
                    raw_cues += _cue(view, c, d)
        elif ident == CLUSTER:
            media.clusters.append(start)
            stop = _cluster(view, body, stop, size < 0, media)
        at = stop
    media.cues += [(t * media.scale, track, begin + position) for t, track, position in raw_cues]


def _track(view, begin: int, end: int, media: Media) -> None:
    import struct

    number, found = 0, {"type": 0, "codec": "", "default_ns": 0, "rate": 8000.0, "channels": 1, "bits": 0}
    for i, c, d, _ in _children(view, begin, end):
        if i == TRACK_NUMBER:
            number = _number(view, c, d)
        elif i == TRACK_TYPE:
            found["type"] = _number(view, c, d)
        elif i == CODEC_ID:
            found["codec"] = bytes(view[c:d]).decode("ascii", "replace").rstrip("\0")
        elif i == DEFAULT_DURATION:
            found["default_ns"] = _number(view, c, d)
        elif i == AUDIO:
            for j, e, f, _ in _children(view, c, d):
                if j == SAMPLING_FREQUENCY and f - e in (4, 8):
                    (found["rate"],) = struct.unpack(">f" if f - e == 4 else ">d", view[e:f])
                elif j == CHANNELS:
                    found["channels"] = _number(view, e, f)
                elif j == BIT_DEPTH:
                    found["bits"] = _number(view, e, f)
    media.tracks[number] = found


def _cue(view, begin: int, end: int) -> list[tuple[int, int, int]]:
    when, out = 0, []
    for i, c, d, _ in _children(view, begin, end):
        if i == CUE_TIME:
            when = _number(view, c, d)
        elif i == CUE_TRACK_POSITIONS:
            values = {j: _number(view, e, f) for j, e, f, _ in _children(view, c, d)}
            out.append((values.get(CUE_TRACK, 0), values.get(CUE_CLUSTER_POSITION, 0)))
    return [(when, track, position) for track, position in out]


def _cluster(view, begin: int, end: int, unknown: bool, media: Media) -> int:
    at, base, number = begin, 0, len(media.clusters) - 1
    while at < end:
        ident, body = read_vint(view, at, keep_marker=True)
        if unknown and ident in TOP_LEVEL:
            return at
        size, body = read_vint(view, body)
        stop = body + size
        if size < 0 or stop > end:
            raise ValueError("element exceeds its cluster")
        if ident == CLUSTER_TIMESTAMP:
            base = _number(view, body, stop)
        elif ident == SIMPLE_BLOCK:
            _block(view, body, stop, base, None, 0, number, media)
        elif ident == BLOCK_GROUP:
            block, key, lasts = None, True, 0
            for i, c, d, _ in _children(view, body, stop):
                if i == BLOCK:
                    block = (c, d)
                elif i == REFERENCE_BLOCK:
                    key = False
                elif i == BLOCK_DURATION:
                    lasts = _number(view, c, d)
            if block:
                _block(view, *block, base, key, lasts, number, media)
        at = stop
    return end


def _block(view, at: int, end: int, base: int, key: bool | None, lasts: int, cluster: int, media: Media) -> None:
    track, at = read_vint(view, at)
    relative, flags, at = int.from_bytes(view[at : at + 2], "big", signed=True), view[at + 2], at + 3
    kind = LACING[flags >> 1 & 3]
    frames = unlace(view, at, end, kind)
    when = (base + relative) * media.scale
    step = lasts * media.scale // len(frames) if lasts else media.tracks.get(track, {}).get("default_ns", 0)
    key = bool(flags & 0x80) if key is None else key
    media.packets += [(track, when + k * step, offset, size, key, kind, cluster) for k, (offset, size) in enumerate(frames)]


def read_payload(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p[2] : p[2] + p[3]] for p in media.packets if p[0] == track])


PACKETS = "packets array<struct<track:bigint,timestamp_ns:bigint,offset:bigint,size:bigint,keyframe:boolean,lacing:string,cluster:bigint>>"


def packet_table(files: DataFrame, *, id_col: str, media_col: str) -> DataFrame:
    """One row per packet of every file: (id, packet_no, track, timestamp_ns, offset, size, ...)."""
    kind = dict(files.dtypes)[id_col]
    names = ("track", "timestamp_ns", "offset", "size", "keyframe", "lacing", "cluster")

    def fn(ids, blobs):
        out: tuple[list, list, list] = ([], [], [])
        for i, blob in zip(ids, blobs):
            packets = parse(bytes(blob or b"")).packets
            for at in range(0, len(packets), PACKETS_IN_PART):
                out[0].append(i)
                out[1].append(at)
                out[2].append([dict(zip(names, p)) for p in packets[at : at + PACKETS_IN_PART]])
        return out

    found = map_rows(files.select(F.col(id_col).alias("id"), F.col(media_col)), lambda: fn, f"id {kind}, part bigint, {PACKETS}", step=16)
    numbered = found.select("id", "part", F.posexplode("packets").alias("at", "p"))
    return numbered.select(F.col("id").alias(id_col), (F.col("part") + F.col("at")).alias("packet_no"), "p.*")


def padded(raw: bytes, frame: int = FRAME) -> bytes:
    return raw + b" " * (frame - len(raw) % frame if len(raw) % frame or not raw else 0)


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): every text stored as PCM samples in a Matroska file."""
    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), lambda: lambda ids, texts: (ids, [write_pcm(padded((t or "").encode())) for t in texts]), f"`{id_col}` {kind}, media binary", step=64)


def features(media: Media, samples: bytes) -> str:
    """Packets, clusters, cues, duration, and mean, deviation and crossings of the samples."""
    import numpy as np

    s = np.frombuffer(samples, np.uint8)
    spent = len(media.packets) and media.packets[-1][1] // 1_000_000 + media.packets[-1][3] * 1000 // RATE
    above = s >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    mean, square = int(s.sum(dtype=np.int64)) / len(s), int(np.square(s, dtype=np.int64).sum()) / len(s)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={spent};mean={mean:.4f};dev={max(0.0, square - mean * mean) ** 0.5:.4f};crossings={crossings}"


def _digest(text: str | None):
    raw = (text or "").encode()
    stored = write_pcm(padded(raw))
    media = parse(stored)
    payload = read_payload(stored, media)
    indexed = {c[2] for c in media.cues} <= set(media.clusters)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, payload), len(media.packets), indexed


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint, cues_valid boolean"
    return map_rows(docs, lambda: lambda ids, texts: (ids, *zip(*map(_digest, texts), strict=True)) if ids else [[]] * 10, schema)
