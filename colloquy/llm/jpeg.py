"""Baseline JPEG frames as grey levels: Huffman codes, quantisation, restart intervals and subsampled colour.

Only the first component is transformed back; those of colour are read past. Frames without code tables, as motion JPEG has
them, use the standard ones. Progressive and arithmetic frames raise ValueError.
"""

from __future__ import annotations

import struct

import numpy as np


def _zigzag() -> np.ndarray:
    """The place in an 8 x 8 block of each coefficient in the order of the stream."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_COSINES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

#: The standard's typical code tables: codes of each length from 1 to 16, then the symbols.
STANDARD = {
    0x00: ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: ("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d",
           "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa"),
    0x11: ("00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
           "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa"),
}


def codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a code table, in its order."""
    out, code, at = [], 0, 0
    for length, count in enumerate(lengths, 1):
        for symbol in symbols[at : at + count]:
            out.append((length, code, symbol))
            code += 1
        code, at = code << 1, at + count
    return out


def _lookup(table: list[tuple[int, int, int]]) -> list[int]:
    """For each 16 bits that may come next the length and symbol, 256 * length + symbol; 0 where no code begins them."""
    out = np.zeros(1 << 16, np.int64)
    for length, code, symbol in table:
        out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return out.tolist()


def standard_tables() -> dict[int, list[int]]:
    return {k: _lookup(codes(bytes.fromhex(a), bytes.fromhex(b))) for k, (a, b) in STANDARD.items()}


class _Bits:
    """The entropy-coded bits of one restart interval, as the 16 bits from each place on."""

    def __init__(self, data: bytes) -> None:
        bits = np.concatenate([np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)), np.ones(48, np.uint8)]).astype(np.int64)
        self.next = sum(bits[k : len(bits) - 16 + k] << 15 - k for k in range(16)).tolist()
        self.at = 0

    def symbol(self, table: list[int]) -> int:
        found = table[self.next[self.at]] if self.at < len(self.next) else 0
        if not found:
            raise ValueError("a code that the tables do not have")
        self.at += found >> 8
        return found & 255

    def value(self, size: int) -> int:
        """A signed number of so many bits."""
        if not size:
            return 0
        if self.at >= len(self.next):
            raise ValueError("a scan that ends early")
        raw = self.next[self.at] >> 16 - size
        self.at += size
        return raw if raw >> size - 1 else raw - (1 << size) + 1


def grey(frame: bytes, tables: dict[int, list[int]] | None = None) -> np.ndarray:
    """The levels of a frame's first component at its own resolution, rows of bytes."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    tables, quantisers = dict(tables or standard_tables()), {}
    at, restart, parts = 2, 0, []
    width = height = 0
    while True:
        while at + 1 < len(frame) and frame[at] == 0xFF and frame[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(frame):
            raise ValueError("a frame without a scan")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                quantisers[number] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = _lookup(codes(body[1:17], body[17 : 17 + count]))
                body = body[17 + count :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples that are not of 8 bits")
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            chosen = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
            break
    if not parts or [p[0] for p in parts] != list(chosen):
        raise ValueError("not one scan of all components")
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # a single component is not interleaved
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        wide = high = 1
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    _, h, v, quantiser = parts[0]
    blocks = np.zeros((down * v, across * h, 64), np.int64)
    end = frame.rfind(b"\xff\xd9")
    intervals, begin = [], at
    while True:  # restart markers part the scan; an FF of the data has a 00 after it
        mark = frame.find(b"\xff", begin)
        while 0 <= mark < len(frame) - 1 and frame[mark + 1] == 0:
            mark = frame.find(b"\xff", mark + 2)
        if 0 <= mark < len(frame) - 1 and 0xD0 <= frame[mark + 1] <= 0xD7:
            intervals.append(frame[at:mark])
            at = begin = mark + 2
        else:
            intervals.append(frame[at : mark if mark >= 0 else end if end >= at else len(frame)])
            break
    units = across * down
    each = restart or units
    if len(intervals) < -(-units // each):
        raise ValueError("a scan that ends early")
    for first, data in zip(range(0, units, each), intervals):
        bits, last = _Bits(data), [0] * len(parts)
        for unit in range(first, min(first + each, units)):
            for k, (name, across_part, down_part, _) in enumerate(parts):
                dc, ac = tables[chosen[name] >> 4], tables[0x10 | chosen[name] & 15]
                for block in range(across_part * down_part):
                    last[k] += bits.value(bits.symbol(dc))
                    found, place = [(0, last[k])], 1
                    while place < 64:
                        symbol = bits.symbol(ac)
                        if symbol == 0:
                            break
                        place += symbol >> 4
                        if symbol & 15:
                            found.append((place, bits.value(symbol & 15)))
                        place += 1
                    if k == 0:
                        cell = blocks[unit // across * v + block // h, unit % across * h + block % h]
                        for place, level in found:
                            if place > 63:
                                raise ValueError("more coefficients than a block has")
                            cell[ZIGZAG[place]] = level * quantisers[quantiser][place]
    squares = blocks.reshape(down * v, across * h, 8, 8).astype(np.float64)
    pixels = np.einsum("ux,rcuv,vy->rxcy", _COSINES, squares, _COSINES).reshape(down * v * 8, across * h * 8)
    levels = np.clip(np.round(pixels + 128), 0, 255).astype(np.uint8)
    return levels[: -(-height * v // high), : -(-width * h // wide)]
