import hashlib
import zlib


from hypothesis import given, settings
from hypothesis import strategies as st

from cubeline.llm import mpeg_audio as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_round_trip(data):
    p = M.pad(data)
    assert len(p) % 576 == 0 and len(p) >= max(576, len(data)) and p.startswith(data) and set(p[len(data) :]) <= {255}
    m = M.build(p)
    s = M.parse(m)
    assert M.payload_of(m, s) == p
    assert s.crc_bad == 0 and s.crc_good == s.frames == s.table_frames and s.skipped == 0 and s.id3v1
    assert s.duration_us == s.frames * 24_000  # 1152 samples at 48 kHz
    assert all(M.header(m[o : o + 4]) for o in s.offsets)


def test_bytes_like_headers():
    p = M.pad(bytes((0xFF, 0xFB, 0x90, 0x40)) * 500)
    m = M.build(p)
    assert M.payload_of(m, M.parse(m)) == p


def test_headers():
    h = M.header(bytes((0xFF, 0xFB, 0x90, 0x40)))
    assert (h.version, h.layer, h.kbps, h.hz, h.size, h.side, h.protected) == (1, 3, 128, 44100, 417, 32, False)
    h = M.header(bytes((0xFF, 0xF3, 0x82, 0xC0)))
    assert (h.version, h.layer, h.kbps, h.hz, h.size, h.samples) == (2, 3, 64, 22050, 209, 576)
    h = M.header(bytes((0xFF, 0xFF, 0x44, 0x00)))
    assert (h.layer, h.kbps, h.size, h.samples) == (1, 128, 128, 384)
    assert M.header(b"\xff\xff\xff\xff") is None and M.header(b"\xff\xeb\x90\x00") is None and M.header(b"\xff") is None


def test_resync_crc_and_tags():
    p = M.pad(b"x" * 5000)
    m = M.build(p)
    s = M.parse(m)
    second = s.offsets[1]
    junk = b"garbage \xff\xfb that is no frame"
    broken = m[:second] + junk + m[second:]
    t = M.parse(broken)
    assert t.frames == s.frames and t.resyncs == 1 and t.skipped == len(junk) and M.payload_of(broken, t) == p
    flipped = bytearray(m)
    flipped[second + 4] ^= 1
    assert (M.parse(bytes(flipped)).crc_good, M.parse(bytes(flipped)).crc_bad) == (s.frames - 1, 1)
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(4) + bytes(12)
    u = M.parse(m[:-128] + ape + m[-128:])
    assert u.ape == {} and u.id3v1 and u.frames == s.frames
    cut = M.parse(m[: second + 100])
    assert cut.frames == 1 and cut.skipped == 100


def test_vbri_and_free_format():
    one = bytes((0xFF, 0xFB, 0x90, 0xC0)) + bytes(413)
    vbri = bytearray(one)
    vbri[36:62] = b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes(8)
    s = M.parse(bytes(vbri) + one * 7)
    assert (s.table, s.table_bytes, s.table_frames, s.frames) == ("VBRI", 999, 7, 7)
    free = bytes((0xFF, 0xFB, 0x00, 0xC0)) + bytes(296)
    assert M.parse(free * 4).frames >= 3


def test_false_headers_before_a_stream():
    """A header in junk whose next header is another kind is none; a short false lock is given up."""
    m = M.build(M.pad(b"y" * 4000))
    s = M.parse(m)
    bare = m[s.offsets[0] - 192 : -128]  # the table's frame and the audio frames
    want = M.parse(bare)
    one = bytes((0xFF, 0xF3, 0x10, 0xC0)) + bytes(22)  # 26 bytes, 22,050 Hz: the next header disagrees
    t = M.parse(one + bare)
    assert (t.version, t.hz, t.frames, t.skipped, t.table) == (1, 48000, want.frames, 26, want.table)
    t = M.parse(one * 2 + bare)  # the first agrees with the second, but two frames are no firm lock
    assert (t.version, t.hz, t.frames) == (1, 48000, want.frames) and t.offsets == [o + 52 for o in want.offsets]
    t = M.parse(bare + one * 2 + bare[192:])  # a firm lock stands
    assert (t.hz, t.frames, t.skipped) == (48000, 2 * want.frames, 52)


def bits(*fields):
    """(value, width) pairs as bytes."""
    n = total = 0
    for v, w in fields:
        n, total = n << w | v, total + w
    return (n << -total % 8).to_bytes(-(-total // 8), "big"), total


def slow_crc(data, n):
    c = 0xFFFF
    for k in range(n):
        c = (c << 1) ^ (0x8005 if (c >> 15 ^ data[k // 8] >> (7 - k % 8)) & 1 else 0)
        c &= 0xFFFF
    return c


def test_checksums_of_layers_one_and_two():
    for mode, bound in ((0, 32), (1, 8), (3, 32)):
        # layer I: four bits for each subband and channel
        four = bytes((0xFF, 0xFE, 0x44, mode << 6 | (1 << 4 if mode == 1 else 0)))
        h = M.header(four)
        assert (h.layer, h.protected, h.bound) == (1, True, bound)
        alloc, n = bits(*[(k % 15, 4) for k in range((2 * bound + 32 - bound) if mode != 3 else 32)])
        frame = four + slow_crc(four[2:] + alloc, 16 + n).to_bytes(2, "big") + alloc
        frame = frame.ljust(h.size, b"\x5a")
        s = M.parse(frame * 4)
        assert (s.frames, s.crc_good, s.crc_bad, s.duration_us) == (4, 4, 0, 4 * 384 * 1_000_000 // 48000)
        bad = frame[:7] + bytes((frame[7] ^ 1,)) + frame[8:]
        assert (M.parse(frame + bad + frame).crc_bad, M.parse(frame[:-1] + b"x" + frame * 2).crc_bad) == (1, 0)
        # layer II at 192 kbit/s, 44.1 kHz: stereo has 96 a channel, mono more: both 30 subbands
        four = bytes((0xFF, 0xFC, 0xA0, mode << 6 | (1 << 4 if mode == 1 else 0)))
        h = M.header(four)
        width = [4] * 11 + [3] * 12 + [2] * 7
        fields, selections = [], 0
        for sb, w in enumerate(width):
            for _ in range(1 if mode == 3 or sb >= bound else 2):
                v = (sb * 5 + len(fields)) % (1 << w) if sb % 3 else 0
                fields.append((v, w))
                selections += (2 if mode != 3 and sb >= bound else 1) * (v > 0)
        info, n = bits(*fields, *[(2, 2)] * selections)
        frame = four + slow_crc(four[2:] + info, 16 + n).to_bytes(2, "big") + info
        frame = frame.ljust(h.size, b"\xa5")
        s = M.parse(frame * 4)
        assert (s.layer, s.frames, s.crc_good, s.crc_bad) == (2, 4, 4, 0), mode


def test_tags_behind():
    m = M.build(M.pad(b"z" * 100))
    item = lambda k, v: len(v).to_bytes(4, "little") + bytes(4) + k + b"\0" + v
    items = item(b"Title", "Öde".encode()) + item(b"Year", b"1999")
    foot = (2000).to_bytes(4, "little") + (len(items) + 32).to_bytes(4, "little") + (2).to_bytes(4, "little")
    ape = b"APETAGEX" + foot + bytes((0, 0, 0, 0xA0)) + bytes(8) + items + b"APETAGEX" + foot + bytes((0, 0, 0, 0x80)) + bytes(8)
    old = b"TAG" + b"Name".ljust(30, b"\0") + b"Who".ljust(30) + bytes(30) + b"2001" + b"said".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    s = M.parse(m[:-128] + ape + old)
    assert s.ape == {"Title": "Öde".encode(), "Year": b"1999"} and s.skipped == 0 and s.frames == 1
    assert s.id3v1 == {"title": "Name", "artist": "Who", "album": "", "year": "2001", "comment": "said", "track": 7, "genre": 17}
    assert M._ape(items[:-1], 9) == {"Title": "Öde".encode()}


def test_exact_duration_without_delay_and_padding():
    frame = bytes((0xFF, 0xFB, 0x94, 0xC0)) + bytes(380)
    table = bytearray(frame)
    table[21:29] = b"Info" + (9).to_bytes(4, "big")  # frames and quality
    table[29:33] = (5).to_bytes(4, "big")
    table[37:46] = b"LAME3.100"
    table[58:61] = (576 << 12 | 1000).to_bytes(3, "big")
    s = M.parse(bytes(table) + frame * 5)
    assert (s.table, s.table_frames, s.frames, s.delay, s.padding) == ("Info", 5, 5, 576, 1000)
    assert s.played == 5 * 1152 - 1576 and s.duration_us == s.played * 1_000_000 // 48000


def test_junk():
    for junk in (b"", b"\xff" * 700, b"ID3", b"abc" * 100):
        s = M.parse(junk)
        assert s.frames == 0 and s.duration_us == 0 and M.payload_of(junk, s) == b""


def test_columns(spark):
    rows = [(1, "ab", "m"), (2, None, "m"), (3, "", "m"), (3, "", "m"), (4, "é" * 100_000, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r.doc_id: r for r in M.features(M.media(df)).collect()}
    for i, t, _ in rows:
        p = M.pad((t or "").encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[2].media_sha256 == got[3].media_sha256 and len(got[4].seek_offsets) == got[4].n_frames > 200
    assert M.features(M.media(df.limit(0))).count() == 0
    other = spark.createDataFrame([(None, "keep", "clash"), (bytearray(b"no frames"), None, None)], "media binary, extra string, feature string")
    back = sorted(M.features(other).collect(), key=lambda r: r.extra or "")
    assert back[0].n_frames == 0 and back[1].n_frames is None and back[1].extra == "keep"
