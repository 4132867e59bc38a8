"""MPEG audio: a frame parser, and a container that keeps bytes in frames without loss.

Reading (`parse`): ID3v2 tags in front, ID3v1 and APE tags behind, with their fields; frame
headers of MPEG-1, -2 and -2.5 in layers I to III, free format included; resynchronising after
bytes that are no frame; Xing, Info and VBRI tables with an encoder's delay and padding; the
CRC-16 of protected frames: of the side information in layer III, of the bit allocation in layer
I, and of allocation and scale factor selection in layer II.

A header counts while the stream is out of step only if the next one agrees with it in version,
layer and rate, or the stream ends there.  What a lock of less than `FIRM` frames found is given
up when a lock with other parameters follows; a firm one stands, and other frames are skipped.

A stream's duration is exact: coded samples, less the delay and padding that an encoder's tag
names, over the sample rate, as whole numbers.  Seek offsets are the byte offsets of all audio
frames.

Writing (`build`): frames of MPEG-1 layer III, mono, 48 kHz, protected.  The side information
is zero, that is, no coded audio; the format then leaves the rest of the frame to ancillary
bytes, and these hold the payload, one byte in each 8-bit unit.  Frames take 937 bytes at 320
kbit/s; the last takes the least bit rate that holds what is left.  A Xing table (Info at one
bit rate) is the first frame; the payload's length is in a PRIV frame of the ID3v2 tag.

`media` builds the stored form from texts; `features` reads stored bytes back and needs
nothing else.  Null text is empty, whose payload is one block of 255s.  Bytes that hold no
frame give 0 frames, duration 0 and an empty payload; null bytes give nulls.  Texts of any
length are stored whole; rows are independent, so repeated rows give equal values.  Columns of
the caller that are named as results are replaced by them; all others come along.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeline.llm.common import joined_parts, whole_text

BLOCK = 576
OWNER = b"cubeline.payload"
# Fixed values of the format: kbit/s by index 1..14, and Hz by index.
_V1L1 = (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
_V1L2 = (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
_V1L3 = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_V2L1 = (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
_V2L23 = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_HZ = (44100, 48000, 32000)
_SIDE_MONO_V1 = 17
# Fixed values of layer II: bits of allocation by subband, as (bits, subbands) from the lowest up, of the five tables.
_ALLOCATION = (
    ((4, 11), (3, 12), (2, 4)),
    ((4, 11), (3, 12), (2, 7)),
    ((4, 2), (3, 6)),
    ((4, 2), (3, 10)),
    ((4, 4), (3, 7), (2, 19)),
)
#: Frames after which a lock is not given up.
FIRM = 3


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25
    layer: int
    protected: bool
    kbps: int  # 0: free format
    hz: int
    padding: int
    mono: bool
    samples: int
    size: int  # bytes of the frame; 0: free format
    side: int  # bytes of side information (layer III)
    bound: int  # subbands that have an allocation for each channel (layers I and II)

    @property
    def alike(self) -> tuple[int, int, int]:
        """What all frames of a stream share."""
        return self.version, self.layer, self.hz


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if four not in _HEADERS:
        if len(_HEADERS) > 1 << 16:
            _HEADERS.clear()
        _HEADERS[four] = _header(four)
    return _HEADERS[four]


def _header(h: bytes) -> Header | None:
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    v, lay, rate, hz = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3
    if v == 1 or lay == 4 or rate == 15 or hz == 3 or h[3] & 3 == 2:
        return None
    version = {3: 1, 2: 2, 0: 25}[v]
    table = (_V1L1, _V1L2, _V1L3)[lay - 1] if version == 1 else _V2L1 if lay == 1 else _V2L23
    kbps = table[rate - 1] if rate else 0
    f = _HZ[hz] // {1: 1, 2: 2, 25: 4}[version]
    pad = h[2] >> 1 & 1
    samples = 384 if lay == 1 else 1152 if lay == 2 or version == 1 else 576
    size = 0 if not kbps else (12_000 * kbps // f + pad) * 4 if lay == 1 else samples // 8 * 1000 * kbps // f + pad
    mono = h[3] >> 6 == 3
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    bound = 4 * ((h[3] >> 4 & 3) + 1) if h[3] >> 6 == 1 else 32
    return Header(version, lay, not h[1] & 1, kbps, f, pad, mono, samples, size, side if lay == 3 else 0, bound)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()
_CRCS: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """Polynomial 0x8005 from 0xFFFF, as frames carry it."""
    if (known := _CRCS.get(data)) is not None:
        return known
    c = 0xFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    if len(_CRCS) > 4096:
        _CRCS.clear()
    _CRCS[data] = c
    return c


def _allocation(h: Header) -> list[int]:
    """Bits of allocation of each subband in layer II: the table follows from rate and bits a channel."""
    channel = h.kbps // (1 if h.mono else 2)
    if h.version != 1:
        t = 4
    elif not h.kbps:
        t = 0 if h.hz == 48000 else 1
    elif 56 <= channel <= 80 or (h.hz == 48000 and channel >= 56):
        t = 0
    elif channel >= 96:
        t = 1
    else:
        t = 3 if h.hz == 32000 else 2
    return [bits for bits, n in _ALLOCATION[t] for _ in range(n)]


def _guarded(h: Header, body: bytes) -> int:
    """How many bits after the CRC word it covers."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (min(h.bound, 32) * channels + (32 - min(h.bound, 32)))
    bits = int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    at = selections = 0
    for sb, width in enumerate(_allocation(h)):
        own = channels if sb < h.bound else 1
        for _ in range(own):
            used = bits >> (512 - at - width) & (1 << width) - 1
            selections += (channels if own == 1 else 1) * bool(used)
            at += width
    return at + 2 * selections


def checksum(h: Header, four: bytes, body: bytes) -> int:
    """The CRC that a protected frame should carry; body: what follows the CRC word."""
    n = _guarded(h, body)
    c = crc16(four[2:] + body[: n // 8])
    for k in range(n // 8 * 8, n):
        top = (c >> 15 ^ body[k // 8] >> (7 - k % 8)) & 1 if k // 8 < len(body) else c >> 15
        c = (c << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return c


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsync(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    hz: int = 0
    version: int = 0
    layer: int = 0
    kbps: dict[int, int] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    bodies: list[tuple[int, int]] = field(default_factory=list)  # ancillary bytes, if the frame codes no audio
    crc_good: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    tags: dict[str, bytes] = field(default_factory=dict)
    id3v1: dict[str, str | int] | None = None
    ape: dict[str, bytes] | None = None
    delay: int = 0  # samples that an encoder put in front, and behind
    padding: int = 0

    @property
    def played(self) -> int:
        """Samples without an encoder's delay and padding."""
        return max(0, self.samples - self.delay - self.padding)

    @property
    def duration_us(self) -> int:
        return self.played * 1_000_000 // self.hz if self.hz else 0


def _id3v2(d: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Reads a tag at `at`; the position after it, or `at` if there is none."""
    if d[at : at + 3] != b"ID3" or len(d) < at + 10 or any(b & 128 for b in d[at + 6 : at + 10]):
        return at
    major, flags = d[at + 3], d[at + 5]
    end = at + 10 + _unsync(d[at + 6 : at + 10])
    body = d[at + 10 : end]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    k = 0
    if flags & 0x40 and len(body) >= 4:
        k = _unsync(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
    width = 3 if major == 2 else 4
    while k + 2 * width + 2 * (major > 2) <= len(body) and body[k]:
        name = body[k : k + width]
        raw = body[k + width : k + 2 * width]
        n = _unsync(raw) if major == 4 else int.from_bytes(raw, "big")
        k += 2 * width + 2 * (major > 2)
        tags.setdefault(name.decode("latin-1"), body[k : k + n])
        k += n
    return end + 10 * bool(flags & 0x10)


def _id3v1(tag: bytes) -> dict[str, str | int]:
    """The fields of the 128 bytes at the end; a comment of 28 bytes leaves room for a track."""
    text = lambda b: b.split(b"\0")[0].rstrip(b" ").decode("latin-1")
    out: dict[str, str | int] = {n: text(tag[a:e]) for n, a, e in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))}
    if not tag[125] and tag[126]:
        out["comment"], out["track"] = text(tag[97:125]), tag[126]
    return out | {"genre": tag[127]}


def _ape(items: bytes, count: int) -> dict[str, bytes]:
    """The items of an APE tag, as far as they are whole."""
    out, k = {}, 0
    for _ in range(count):
        n, end = int.from_bytes(items[k : k + 4], "little"), items.find(b"\0", k + 8)
        if k + 8 > len(items) or end < 0 or end + 1 + n > len(items):
            break
        out[items[k + 8 : end].decode("latin-1")] = items[end + 1 : end + 1 + n]
        k = end + 1 + n
    return out


def parse(d: bytes) -> Stream:
    """Everything a stream of frames tells, in one pass."""
    tags: dict[str, bytes] = {}
    at, end = 0, len(d)
    while (nxt := _id3v2(d, at, tags)) != at:
        at = nxt
    old = ape = None
    if end - at >= 128 and d[end - 128 : end - 125] == b"TAG":
        old, end = _id3v1(d[end - 128 : end]), end - 128
    if end - at >= 32 and d[end - 32 : end - 24] == b"APETAGEX":
        size, count = int.from_bytes(d[end - 20 : end - 16], "little"), int.from_bytes(d[end - 16 : end - 12], "little")
        ape = _ape(d[max(at, end - size) : end - 32], count)
        end = max(at, end - size - 32 * (d[end - 9] >> 7))
    begin, first, free, synced = at, None, 0, False
    s = Stream(tags=tags, id3v1=old, ape=ape)
    while at + 4 <= end:
        h = header(d[at : at + 4])
        size = h.size if h else 0
        if h and not size:  # free format: the frame ends where the next alike begins
            size = free + h.padding if free else _free_size(d, at, end, h)
        good = bool(size) and at + size <= end
        if good and synced:
            good = h.alike == first
        elif good:
            after = header(d[at + size : at + size + 4]) if at + size + 4 <= end else None
            good = at + size + 4 > end or (after is not None and after.alike == h.alike)
            if good and first is not None and h.alike != first:
                # another lock: a weak one before it was none
                good = s.frames < FIRM and after is not None
                if good:
                    s = Stream(tags=tags, id3v1=old, ape=ape, resyncs=s.resyncs, skipped=at - begin)
                    first, free = None, 0
                    size = h.size or _free_size(d, at, end, h)
        if not good:
            nxt = d.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.resyncs += synced or not s.skipped
            s.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        if not h.kbps:
            free = free or size - h.padding
        body = at + 4 + 2 * h.protected + h.side
        if first is None:
            first = h.alike
            s.version, s.layer, s.hz = first
            if _table(d, at, at + size, h, s):
                at += size
                continue
        if h.protected:
            if checksum(h, d[at : at + 4], d[at + 6 : at + size if h.layer < 3 else body]) == d[at + 4] << 8 | d[at + 5]:
                s.crc_good += 1
            else:
                s.crc_bad += 1
        if h.layer == 3 and not any(d[body - h.side : body]):
            s.bodies.append((body, at + size))
        s.offsets.append(at)
        s.frames += 1
        s.samples += h.samples
        rate = h.kbps or size * 8 * h.hz // (h.samples * 1000)
        s.kbps[rate] = s.kbps.get(rate, 0) + 1
        at += size
    s.skipped += max(0, end - at)
    return s


def _free_size(d: bytes, at: int, end: int, h: Header) -> int:
    """Bytes to the next free-format header that agrees; 0 if there is none."""
    nxt = at + 4 + h.side
    while 0 <= (nxt := d.find(b"\xff", nxt, end - 3)):
        g = header(d[nxt : nxt + 4])
        if g and not g.kbps and (g.version, g.layer, g.hz) == (h.version, h.layer, h.hz):
            return nxt - at
        nxt += 1
    return 0


def _table(d: bytes, at: int, end: int, h: Header, s: Stream) -> bool:
    """A Xing, Info or VBRI table in the first frame."""
    num = lambda k: int.from_bytes(d[k : k + 4], "big")
    for k in (at + 4 + h.side, at + 6 + h.side):
        if d[k : k + 4] in (b"Xing", b"Info") and k + 8 <= end:
            s.table, flags, k = d[k : k + 4].decode(), num(k + 4), k + 8
            for bit, name in ((1, "table_frames"), (2, "table_bytes")):
                if flags & bit:
                    setattr(s, name, num(k))
                    k += 4
            if flags & 4:
                s.toc = bytes(d[k : k + 100])
                k += 100
            k += 4 * bool(flags & 8)
            if d[k : k + 4] in (b"LAME", b"Lavc", b"Lavf") and k + 24 <= end:  # the encoder's tag; 12 bits each
                both = int.from_bytes(d[k + 21 : k + 24], "big")
                s.delay, s.padding = both >> 12, both & 0xFFF
            return True
    k = at + 36
    if d[k : k + 4] == b"VBRI" and k + 26 <= end:
        s.table, s.table_bytes, s.table_frames = "VBRI", num(k + 10), num(k + 14)
        return True
    return False


_SIDE = bytes(_SIDE_MONO_V1)
_OPEN = {}  # kbit/s -> header, CRC and side information
for _i, _k in enumerate(_V1L3, 1):
    _h = bytes((0xFF, 0xFA, _i << 4 | 1 << 2, 0xC0))
    _OPEN[_k] = _h + crc16(_h[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_ROOM = {k: 3 * k - len(o) for k, o in _OPEN.items()}
_TOP = _V1L3[-1]


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """Bytes 255 up to a positive multiple of `block`."""
    return data + b"\xff" * (-len(data) % block if data else block)


def build(payload: bytes) -> bytes:
    """The stored form of a payload."""
    room, start = _ROOM[_TOP], _OPEN[_TOP]
    whole = len(payload) // room * room
    frames = [start + payload[i : i + room] for i in range(0, whole, room)]
    if rest := payload[whole:]:
        k = next(k for k in _V1L3 if _ROOM[k] >= len(rest))
        frames.append(_OPEN[k] + rest + bytes(_ROOM[k] - len(rest)))
    ends, sum_ = [], 192
    for f in frames:
        ends.append(sum_)
        sum_ += len(f)
    toc = bytes(min(255, 256 * ends[min(len(ends) - 1, len(ends) * i // 100)] // sum_) for i in range(100)) if frames else bytes(100)
    rates = {len(f) for f in frames}
    table = bytes((0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0)) + _SIDE
    table += (b"Xing" if len(rates) > 1 else b"Info") + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (sum_ & 0xFFFFFFFF).to_bytes(4, "big") + toc + bytes(4)
    priv = OWNER + b"\0" + len(payload).to_bytes(8, "big")
    tag = b"PRIV" + _syncsafe(len(priv)) + bytes(2) + priv
    return b"".join((b"ID3\x04\0\0", _syncsafe(len(tag)), tag, table.ljust(192, b"\0"), *frames, b"TAG" + bytes(124) + b"\xff"))


def payload_of(media: bytes, s: Stream) -> bytes:
    """The bytes that `build` stored."""
    priv = s.tags.get("PRIV", b"")
    if not priv.startswith(OWNER + b"\0"):
        return b""
    n = int.from_bytes(priv[len(OWNER) + 1 :][:8], "big")
    return b"".join([media[a:b] for a, b in s.bodies])[:n]


def feature(s: Stream) -> str:
    rates = ",".join(f"{k}x{n}" for k, n in sorted(s.kbps.items()))
    return f"mpeg{s.version};layer={s.layer};hz={s.hz};frames={s.frames};samples={s.played};us={s.duration_us};kbps={rates};table={s.table}:{s.table_frames};crc={s.crc_good}/{s.crc_bad};resyncs={s.resyncs}"


def _build(batches):
    for b in batches:
        data = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([build(pad(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"]
        )


def media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, media: the stored form of each text."""
    return joined_parts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(_build, "doc_id long, n_bytes long, media binary")


_FEATURES = [
    ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"),
    ("n_frames", "long"), ("n_samples", "long"), ("sample_rate", "int"), ("duration_us", "long"), ("seek_offsets", "array<long>"), ("crc_good", "long"), ("crc_bad", "long"),
    ("resyncs", "long"), ("skipped_bytes", "long"), ("vbr_table", "string"), ("table_frames", "long"),
]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def read_back(m: bytes | None) -> tuple:
    if m is None:
        return (None,) * len(_FEATURES)
    s = parse(m)
    p = payload_of(m, s)
    return (
        len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(s),
        s.frames, s.samples, s.hz, s.duration_us, s.offsets, s.crc_good, s.crc_bad, s.resyncs, s.skipped, s.table, s.table_frames,
    )


def features(stored: DataFrame, column: str = "media") -> DataFrame:
    """Adds what the stored bytes of `column` tell to the other columns."""
    keep = [f for f in stored.schema.fields if f.name != column and f.name not in dict(_FEATURES)]
    source = stored.select(*[F.col(f"`{f.name}`") for f in keep], F.col(column).alias("_media"))

    def run(batches):
        for b in batches:
            cols = list(zip(*(read_back(m) for m in b.column("_media").to_pylist()), strict=True)) or [()] * len(_FEATURES)
            made = [pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(cols, _FEATURES, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [f.name for f in keep] + [n for n, _ in _FEATURES])

    from pyspark.sql.types import StructType, _parse_datatype_string

    return source.mapInArrow(run, StructType([*keep, *_parse_datatype_string(", ".join(f"{n} {t}" for n, t in _FEATURES)).fields]))
