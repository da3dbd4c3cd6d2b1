"""Media columns in Matroska: a writer, and a parser of EBML elements into packet tables.

The parser reads variable-length element ids and sizes (unknown sizes too),
tracks, clusters, simple blocks and block groups with no, Xiph, fixed-size or
EBML lacing, and cues. A packet row has its track, timestamp, key flag and byte
range, so that its bytes can be read back from the stored form alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, column, tidy

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
EBML_VERSION, EBML_READ, EBML_ID_MAX, EBML_SIZE_MAX, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
NUMBER, TRACK_UID, TRACK_TYPE, CODEC, RATE, CHANNELS, DEPTH, LACING, EACH_NS = 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264, 0x9C, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK, REFERENCE, CUE_TIME, CUE_TRACK, CUE_PLACE = 0xE7, 0xA3, 0xA1, 0xFB, 0xB3, 0xF7, 0xF1
PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
# Which open element a new one ends, where a size is unknown.
ENDS = {CLUSTER: {CLUSTER, CUES, TRACKS, INFO}, SEGMENT: {SEGMENT, EBML}}

FRAME = 576  # samples of one packet; 8-bit samples at FRAME_RATE make a packet 72 ms
FRAME_RATE = 8000
PER_BLOCK, PER_CLUSTER = 8, 64  # packets


def vint(value: int) -> bytes:
    n = 1
    while value >= (1 << 7 * n) - 1:  # all ones means an unknown size
        n += 1
    return ((1 << 7 * n) | value).to_bytes(n, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(packets: list[bytes], kind: int) -> bytes:
    """The packets of one block after its flags: 0 none, 1 Xiph, 2 fixed-size, 3 EBML lacing."""
    if kind == 0:
        return packets[0]
    head = bytes([len(packets) - 1])
    sizes = [len(p) for p in packets]
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            n = 1
            while abs(b - a) > (1 << (7 * n - 1)) - 1:
                n += 1
            head += ((1 << 7 * n) | (b - a + (1 << (7 * n - 1)) - 1)).to_bytes(n, "big")
    return head + b"".join(packets)


def block(track: int, relative: int, packets: list[bytes], key: bool = True, lacing: int | None = None) -> bytes:
    if lacing is None:
        lacing = 0 if len(packets) == 1 else 2 if len({len(p) for p in packets}) == 1 else 3
    return vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1]) + lace(packets, lacing)


def pack(payload: bytes) -> bytes:
    """A Matroska file with one track of 8-bit samples; the payload is a multiple of FRAME bytes."""
    packets = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    tick = FRAME * 1000 // FRAME_RATE  # 72 milliseconds
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_ID_MAX, 4) + uint(EBML_SIZE_MAX, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + element(MUXER, b"media columns") + element(WRITER, b"media columns"))
    rate = struct.pack(">d", float(FRAME_RATE))
    audio = element(AUDIO, element(RATE, rate) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING, 1) + uint(EACH_NS, tick * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [], [], len(info) + len(tracks)
    for first in range(0, len(packets), PER_CLUSTER):
        own = packets[first : first + PER_CLUSTER]
        blocks = [element(SIMPLE_BLOCK, block(1, k * tick, own[k : k + PER_BLOCK])) for k in range(0, len(own), PER_BLOCK)]
        part = element(CLUSTER, uint(TIMESTAMP, first * tick) + b"".join(blocks))
        cues.append(element(CUE, uint(CUE_TIME, first * tick) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_PLACE, at))))
        parts.append(part)
        at += len(part)
    return head + element(SEGMENT, info + tracks + b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    timestamp: int  # in ticks of the segment's scale
    key: bool
    start: int
    end: int


#: Levels of elements that a file may nest; the format itself needs fewer than ten.
LEVELS = 32


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)  # offsets in the segment
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, offset in the segment
    doc_type: str = ""
    scale: int = 1_000_000


def read_vint(data: memoryview, at: int, most: int = 8, keep: bool = False) -> tuple[int, int, bool]:
    """(value, next offset, whether all its bits are ones)."""
    if at >= len(data):
        raise ValueError("the data end inside an element")
    first = data[at]
    n = 9 - first.bit_length()
    if not 1 <= n <= most or at + n > len(data):
        raise ValueError(f"no variable-length integer at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    plain = value & ((1 << 7 * n) - 1)
    return (value if keep else plain), at + n, plain == (1 << 7 * n) - 1


def parse(stored: bytes) -> Media:
    """Raises ValueError where the bytes don't form elements, nest beyond LEVELS or hold impossible numbers."""
    data, media = memoryview(stored), Media()
    state = {"cluster": 0, "segment": 0, "track": None, "cue": [0, 0], "place": 0, "key": True, "depth": 0}
    _elements(data, 0, len(data), None, media, state)
    return media


def _elements(data: memoryview, at: int, stop: int, parent: int | None, media: Media, state: dict) -> int:
    while at < stop:
        name, body, _ = read_vint(data, at, 4, keep=True)
        if parent is not None and name in ENDS.get(parent, ()):
            return at
        size, body, unknown = read_vint(data, body)
        end = stop if unknown else body + size
        if end > stop:
            raise ValueError(f"element {name:x} at {at} is cut off")
        if name in PARENTS:
            if name == SEGMENT:
                state["segment"] = body
            elif name == CLUSTER:
                media.clusters.append(at - state["segment"])
            elif name == TRACK:
                state["track"] = {}
            elif name == GROUP:
                state["key"] = True
            elif name == CUE_AT:
                state["place"] = 0
            begun = len(media.packets)
            state["depth"] += 1
            if state["depth"] > LEVELS:
                raise ValueError(f"elements nest beyond {LEVELS} levels at {at}")
            end = _elements(data, body, end, name, media, state) if unknown else (_elements(data, body, end, name, media, state), end)[1]
            state["depth"] -= 1
            if name == TRACK:
                media.tracks[int(state["track"].get("number", 0))] = state["track"]
            elif name == GROUP:
                for p in media.packets[begun:]:
                    p.key = state["key"]
            elif name == CUE_AT:
                media.cues.append((state["cue"][0], state["cue"][1], state["place"]))
        else:
            _value(data, name, body, end, media, state)
        at = end
    return at


def _value(data: memoryview, name: int, a: int, b: int, media: Media, state: dict) -> None:
    def number() -> int:
        if b - a > 8:
            raise ValueError(f"a number of {b - a} bytes at {a}")
        return int.from_bytes(data[a:b], "big")

    if name in (SIMPLE_BLOCK, BLOCK):
        own = _block(data, a, b, state["cluster"])
        each = int(media.tracks.get(own[0].track, {}).get("each_ns", 0)) if own else 0
        for k, packet in enumerate(own):  # laced packets follow each other by the track's packet duration
            packet.timestamp += k * each // media.scale
        media.packets += own
    elif name == TIMESTAMP:
        state["cluster"] = number()
    elif name == REFERENCE:
        state["key"] = False
    elif name == CUE_TIME:
        state["cue"][0] = number()
    elif name == CUE_TRACK:
        state["cue"][1] = number()
    elif name == CUE_PLACE:
        state["place"] = number()
    elif name == SCALE:
        media.scale = number()
        if not media.scale:
            raise ValueError("a timestamp scale of 0")
    elif name == DOC_TYPE:
        media.doc_type = bytes(data[a:b]).decode()
    elif state["track"] is not None and name in _TRACK_VALUES:
        state["track"][_TRACK_VALUES[name]] = bytes(data[a:b]).decode() if name == CODEC else number()


_TRACK_VALUES = {NUMBER: "number", TRACK_TYPE: "type", CODEC: "codec", CHANNELS: "channels", DEPTH: "depth", EACH_NS: "each_ns"}


def _block(data: memoryview, a: int, b: int, base: int) -> list[Packet]:
    track, at, _ = read_vint(data, a)
    if at + 3 > b or (data[at + 2] & 6 and at + 3 == b):
        raise ValueError("a block without a head")
    time = base + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    lacing = flags >> 1 & 3
    sizes: list[int] = []
    if lacing:
        n, at = data[at] + 1, at + 1
        if lacing == 1:
            for _ in range(n - 1):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        elif lacing == 3 and n > 1:
            size, at, _ = read_vint(data, at)
            sizes.append(size)
            for _ in range(n - 2):
                before = at
                change, at, _ = read_vint(data, at)
                size += change - ((1 << (7 * (at - before) - 1)) - 1)
                sizes.append(size)
        if lacing == 2:
            if (b - at) % n:
                raise ValueError("fixed-size lacing of uneven packets")
            sizes = [(b - at) // n] * (n - 1)
    out = []
    for size in [*sizes, b - at - sum(sizes)]:
        if size < 0 or at + size > b:
            raise ValueError("a lace beyond its block")
        out.append(Packet(track, time, bool(flags & 0x80), at, at + size))
        at += size
    return out


def read_payload(stored: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(stored[p.start : p.end] for p in media.packets if p.track == track)


def store(text: bytes) -> bytes:
    """The text's bytes, filled up by bytes 255 to a positive multiple of FRAME."""
    return text + b"\xff" * (FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def digest(text: bytes) -> tuple:
    """What op9 returns of one text, all of it computed from the stored bytes."""
    stored = pack(store(text))
    media = parse(stored)
    payload = read_payload(stored, media)
    clusters = set(media.clusters)
    at_cue = sum(place in clusters for _, _, place in media.cues)
    loud = sum(payload) / len(payload)
    feature = f"{media.doc_type};tracks={len(media.tracks)};packets={len(media.packets)};clusters={len(media.clusters)};cues={at_cue};ms={media.packets[-1].timestamp * media.scale // 1_000_000};mean={loud:.3f}"
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Batches) -> Batches:
    names = ["doc_id", *(x.split()[0] for x in _DIGEST.split(", "))]
    for batch in batches:
        rows = [digest((t or "").encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as 8-bit samples in Matroska, parsed back and described.

    Null and empty texts store one packet of bytes 255. Equal texts give equal
    values. Repeated rows give repeated rows; other columns are ignored. An
    empty table gives an empty table.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col))
    return rows.mapInArrow(tidy(_digests), f"doc_id long, {_DIGEST}")


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media_col: str = "media") -> DataFrame:
    """The id and a binary column of Matroska files, one for each row; null texts give null."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = [None if t is None else pack(store(t.encode("utf-8", "replace"))) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], [id_col, media_col])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(tidy(run), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, `{media_col}` binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet: id, place, track, timestamp_ns, is_key, start and size in the stored bytes.

    Null files give no rows. A file that can't be parsed (cut off, no elements,
    nested too deep, a scale of 0, numbers beyond 64 bits) gives one row with its
    error and nulls. A file without blocks gives no rows.
    """

    def run(batches: Batches) -> Batches:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            of, rows = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = parse(data)
                    own = [(i, p.track, p.timestamp * found.scale, p.key, p.start, p.end - p.start, None) for i, p in enumerate(found.packets)]
                    if any(abs(r[2]) >> 63 or r[1] >> 63 for r in own):
                        raise ValueError("a timestamp or track beyond 64 bits")
                except (ValueError, IndexError) as error:
                    own = [(None, None, None, None, None, None, str(error) or "cut off")]
                rows += own
                of += [k] * len(own)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], [id_col, "place", "track", "timestamp_ns", "is_key", "start", "size", "error"])

    rows = media.select(id_col, media_col)
    return rows.mapInArrow(tidy(run), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, place long, track long, timestamp_ns long, is_key boolean, start long, size long, error string")
