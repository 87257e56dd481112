import hashlib
import struct
import zlib

import numpy as np
import pytest

from colloquy.llm import jpeg, media

TEXTS = [None, "", "a", "x" * 192, "x" * 193, "é\U0001f600 " * 500, "".join(map(chr, range(1, 255))) * 30]


def test_round_trip_is_lossless():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        data = rng.integers(0, 256, n * 192, dtype=np.uint8).tobytes()
        avi = media.encoded(data)
        assert media.decoded(avi).frames.tobytes() == data
        scan = avi[avi.index(b"\xff\xda") + 10 :]
        assert b"\xff\x00" not in scan[:384]
    with pytest.raises(ValueError):
        media.decoded(b"RIFF....WAVE")


def test_header_decodes_with_a_plain_huffman_reader():
    """One frame bit by bit, as any baseline decoder reads it."""
    data = bytes(range(0, 192))
    avi = media.encoded(data)
    scan = avi[avi.index(b"\xff\xda") + 10 :][:384]
    bits = "".join(f"{b:08b}" for b in scan)
    codes, code = {}, 0
    for length in range(4, 13):
        codes[f"{code:0{length}b}"] = 12 - length
        code = (code + 1) << 1
    at, last, out = 0, 0, []
    for _ in range(192):
        length = next(n for n in range(4, 13) if bits[at : at + n] in codes)
        category = codes[bits[at : at + length]]
        at += length
        value = int(bits[at : at + category] or "0", 2)
        last += value if category == 0 or value >> (category - 1) else value - (1 << category) + 1
        at += category
        assert bits[at : at + 4] == "0000"
        at += 4
        out.append(last + 128)
    assert bytes(out) == data


def test_shots_and_clips():
    frames = np.concatenate([np.full((10, 192), 40, np.uint8), np.full((8, 192), 200, np.uint8), np.full((6, 192), 90, np.uint8)])
    rows = media.clip_rows(media.decoded(media.encoded(frames.tobytes())))
    assert [(a, b) for _, a, b, *_ in rows] == [(0, 10), (10, 18), (18, 24)]
    assert [r[5] for r in rows] == [40, 200, 90] and rows[1][3:5] == (10 / 25, 18 / 25)


def test_digest_and_clip_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(2, "a"), (None, "a")], "doc_id long, text string").selectExpr("*", "1 as avi", "2 as feature")
    rows = media.digested(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = ("a" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        want = text + b" " * ((-len(text)) % 192 if text else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 1}) == 1
    clips = media.clips(media.media(docs)).collect()
    assert {r.doc_id for r in clips} == {r.doc_id for r in rows}
    assert media.digested(docs.filter("doc_id > 99")).count() == 0


def coded(height, width, parts, coefficients, quantisers, restart=0, tables=True):
    """A baseline frame of given coefficients (component, block row, block column, 64 in stream order), code by code."""
    book = {k: {s: f"{c:0{n}b}" for n, c, s in jpeg.codes(bytes.fromhex(a), bytes.fromhex(b))} for k, (a, b) in jpeg.STANDARD.items()}
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    out = b"\xff\xd8" + b"".join(seg(0xDB, bytes([i]) + bytes(q.tolist())) for i, q in enumerate(quantisers))
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, min(i, 1)]) for i, (h, v) in enumerate(parts)))
    if tables:
        out += b"".join(seg(0xC4, bytes([k]) + bytes.fromhex(a) + bytes.fromhex(b)) for k, (a, b) in jpeg.STANDARD.items())
    if restart:
        out += seg(0xDD, struct.pack(">H", restart))
    out += seg(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(len(parts))) + b"\x00\x3f\x00")
    number = lambda x: "" if x == 0 else f"{x if x > 0 else x + (1 << abs(x).bit_length()) - 1:0{abs(x).bit_length()}b}"
    wide, high = (parts[0] if len(parts) > 1 else (1, 1))
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    bits, last, mark = "", [0] * len(parts), 0

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            out += flushed(bits) + bytes([0xFF, 0xD0 + mark % 8])
            bits, last, mark = "", [0] * len(parts), mark + 1
        for k, (h, v) in enumerate(parts if len(parts) > 1 else [(1, 1)]):
            for block in range(h * v):
                c = coefficients[k][unit // across * v + block // h][unit % across * h + block % h]
                d, last[k] = int(c[0]) - last[k], int(c[0])
                bits += book[min(k, 1)][abs(d).bit_length()] + number(d)
                ac, run = book[0x10 | min(k, 1)], 0
                for x in map(int, c[1 : 1 + max(np.flatnonzero(c[1:]), default=-1) + 1]):
                    if x == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + ac[0xF0], run - 16
                    bits += ac[run << 4 | abs(x).bit_length()] + number(x)
                    run = 0
                if not c[63]:
                    bits += ac[0]
    return out + flushed(bits) + b"\xff\xd9"


def plain_levels(height, width, coefficients, quantiser):
    """Each pixel by the sum of its cosines."""
    order = jpeg.ZIGZAG
    assert order[:11].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32] and sorted(order) == list(range(64))
    out = np.zeros((8 * len(coefficients), 8 * len(coefficients[0])))
    for r, row in enumerate(coefficients):
        for c, block in enumerate(row):
            for k in np.flatnonzero(block):
                u, v = divmod(int(order[k]), 8)
                a, b = (np.sqrt(1 / 8) if f == 0 else 0.5 for f in (u, v))
                x = np.arange(8)
                out[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] += int(block[k]) * int(quantiser[k]) * a * b * np.outer(np.cos((2 * x + 1) * u * np.pi / 16), np.cos((2 * x + 1) * v * np.pi / 16))
    return np.clip(np.round(out + 128), 0, 255).astype(np.uint8)[:height, :width]


@pytest.mark.parametrize("height,width,parts,restart,tables", [(24, 40, [(1, 1)], 0, True), (21, 35, [(2, 2), (1, 1), (1, 1)], 0, False), (33, 50, [(2, 1), (1, 1), (1, 1)], 3, True), (16, 16, [(2, 2)], 1, True)])
def test_baseline_frames(height, width, parts, restart, tables):
    rng = np.random.default_rng(height)
    wide, high = parts[0] if len(parts) > 1 else (1, 1)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    coefficients = []
    for h, v in parts if len(parts) > 1 else [(1, 1)]:
        c = np.where(rng.random((down * v, across * h, 64)) < 0.12, rng.integers(-30, 31, (down * v, across * h, 64)), 0)
        c[..., 0] = rng.integers(-200, 200, c.shape[:2])
        c[0, 0, 63] = 5
        coefficients.append(c)
    quantisers = [rng.integers(1, 12, 64), rng.integers(1, 12, 64)]
    frame = coded(height, width, parts, coefficients, quantisers[: len(parts)], restart, tables)
    got = jpeg.grey(frame)
    assert np.array_equal(got, plain_levels(height, width, coefficients[0], quantisers[0]))
    with pytest.raises(ValueError):
        jpeg.grey(frame.replace(b"\xff\xc0", b"\xff\xc2"))


def test_clips_of_other_writers():
    """Frames of unequal size with colour; a frame of no bytes repeats the one before."""
    flat = lambda dc: [np.array([[[dc, *[0] * 63]] * 2] * 2), *[np.array([[[3, *[0] * 63]]])] * 2]
    quantiser = np.full(64, 8)
    dark, light = (coded(16, 16, [(2, 2), (1, 1), (1, 1)], flat(dc), [quantiser, quantiser], tables=False) for dc in (-60, 60))
    frames = [dark] * 6 + [b""] * 2 + [light] * 5
    movie, index = b"", b""
    for f in frames:
        index += b"00dc" + struct.pack("<III", 0x10, 4 + len(movie), len(f))
        movie += media._chunk(b"00dc", f)
    main = struct.pack("<14I", 100_000, 0, 0, 0x10, len(frames), 0, 1, 0, 16, 16, 0, 0, 0, 0)
    avi = media._chunk(b"RIFF", b"AVI " + media._chunk(b"LIST", b"hdrl" + media._chunk(b"avih", main)) + media._chunk(b"LIST", b"movi" + movie) + media._chunk(b"idx1", index))
    clip = media.decoded(avi)
    assert clip.rate == 10 and [int(f.mean()) for f in clip.frames] == [68] * 8 + [188] * 5
    assert [(a, b, start, end) for _, a, b, start, end, _ in media.clip_rows(clip)] == [(0, 8, 0.0, 0.8), (8, 13, 0.8, 1.3)]


def test_feature_tells_every_cut():
    frames = np.repeat(np.tile([30, 220], 40), 12)
    text = b"".join(bytes([level]) * 192 for level in frames)
    other = bytearray(text)
    other[70 * 12 * 192 : 70 * 12 * 192 + 6 * 192] = bytes([220]) * (6 * 192)  # one cut, the seventieth, later
    a, b = (media.described(bytes(t))[-1] for t in (text, other))
    assert a != b and a.split(";")[1] == "shots=80"
