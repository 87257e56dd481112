"""AVI motion-JPEG columns: lossless storage of bytes, index parsing, intra decoding and shots as timed clip rows.

A payload byte becomes one 8 x 8 block of a baseline grey JPEG: its DC coefficient is quantised by 8, so the block is the
sample itself in each pixel, exactly. The entropy tables give every DC difference twelve bits in all (code plus magnitude)
and the end of a block four, so that a block is two bytes, no byte needs stuffing, and whole clips are written and read as
numpy arrays. A frame holds 192 blocks. The container has the usual RIFF lists and an idx1 index, which reading goes by.
Other motion-JPEG clips are read too: frames of any size and any baseline coding, whose levels are those of their pixels.

Shots: grey histograms of following frames are compared; a cut is where the difference exceeds the mean of the differences
before it by so many standard deviations, both over a sliding window.

Defined cases: a null or empty text is one frame of spaces; texts are stored whole (a RIFF file ends at 4 GB); equal texts
give equal bytes and features; repeated rows and null ids are converted each; an empty table gives an empty result; other
columns do not matter. Files without an index and frames that are not baseline JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import jpeg
from colloquy.llm.common import slices, utf8

COLUMNS, ROWS = 16, 12
FRAME = COLUMNS * ROWS
RATE = 25
#: Histogram bins, frames looked back on, standard deviations, least difference in blocks, least frames of a shot.
BINS, LOOKBACK, DEVIATIONS, LEAST_CHANGE, LEAST_SHOT = 16, 12, 3.0, 24, 3


def payload(text: bytes) -> bytes:
    """Filled up with spaces to a positive multiple of a frame."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def _tables() -> tuple[bytes, np.ndarray]:
    """The bytes of a frame before its scan, and the 16 bits of a block for each difference from -255 to 255."""
    quantisation = bytes([0, 8] + [1] * 63)
    frame = struct.pack(">BHHBBBB", 8, ROWS * 8, COLUMNS * 8, 1, 1, 0x11, 0)
    lengths = bytes(1 if 4 <= n <= 12 else 0 for n in range(1, 17))  # category c has a code of 12 - c bits
    dc = b"\x00" + lengths + bytes(range(8, -1, -1))
    ac = b"\x10" + bytes(1 if n == 4 else 0 for n in range(1, 17)) + b"\x00"
    head = b"\xff\xd8" + _segment(0xDB, quantisation) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    words, code = np.zeros(511, np.uint16), 0
    for category in range(8, -1, -1):
        for difference in range(-255, 256):
            if abs(difference).bit_length() == category:
                bits = difference if difference >= 0 else difference + (1 << category) - 1
                words[difference + 255] = ((code << category) | bits) << 4
        code = (code + 1) << 1
    return head, words


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encoded(data: bytes) -> bytes:
    """An AVI of a payload whose length is a multiple of a frame."""
    head, words = _tables()
    samples = np.frombuffer(data, np.uint8).reshape(-1, FRAME).astype(np.int16) - 128
    differences = np.diff(samples, axis=1, prepend=np.int16(0))
    scans = words[differences + 255].astype(">u2").view(np.uint8).reshape(len(samples), 2 * FRAME)
    size = len(head) + 2 * FRAME + 2
    movie = np.empty((len(samples), 8 + size), np.uint8)
    movie[:, : 8 + len(head)] = np.frombuffer(b"00dc" + struct.pack("<I", size) + head, np.uint8)
    movie[:, 8 + len(head) : -2] = scans
    movie[:, -2:] = (0xFF, 0xD9)
    index = np.empty(len(samples), [("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, size
    index["offset"] = 4 + np.arange(len(samples)) * (8 + size)
    n, width, height = len(samples), COLUMNS * 8, ROWS * 8
    main = struct.pack("<14I", 1_000_000 // RATE, size * RATE, 0, 0x10, n, 0, 1, size, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, RATE, 0, n, size, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IIIHH4sIIIII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", b"movi" + movie.tobytes()) + _chunk(b"idx1", index.tobytes()))


@dataclass(frozen=True)
class Clip:
    rate: float
    frames: np.ndarray | list[np.ndarray]  # samples of each frame, in an array of rows where all frames have as many


def _chunks(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= stop:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield name, start + 8, min(start + 8 + size, stop)
        start += 8 + size + size % 2


def _header(frame: bytes) -> tuple[int, np.ndarray, int] | None:
    """Where a frame's scan begins, the difference for each 16-bit block, and its quantiser; None for other frames."""
    at, codes, quantiser, blocks = 2, {}, 1, 0
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB and len(body) == 65:
            quantiser = body[1]
        elif marker == 0xC0:
            height, width, parts = struct.unpack_from(">HHB", body, 1)
            blocks = (height // 8) * (width // 8) if parts == 1 and height % 8 == width % 8 == 0 else 0
        elif marker == 0xC4:
            codes[body[0]] = jpeg.codes(body[1:17], body[17 : 17 + sum(body[1:17])])
        elif marker == 0xDD:
            return None
        elif marker == 0xDA:
            break
    dc, ac = codes.get(0x00, []), codes.get(0x10, [])
    if len(frame) != at + 2 * blocks + 2 or not blocks or len(ac) != 1 or ac[0][2] != 0 or {n + c for n, _, c in dc} != {16 - ac[0][0]}:
        return None
    lookup, end = np.full(1 << 16, -32768, np.int16), ac[0]
    for length, code, category in dc:
        bits = np.arange(1 << category)
        value = np.where(bits >> max(category - 1, 0) & 1, bits, bits - (1 << category) + 1) if category else bits
        lookup[(((code << category) | bits) << end[0]) | end[1]] = value
    return at, lookup, quantiser


def _at_once(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """All frames of a clip whose blocks are two bytes each and whose headers are equal; None for other clips."""
    size = int(sizes[0])
    header = _header(data[starts[0] : starts[0] + size]) if (sizes == size).all() else None
    if header is None:
        return None
    scan, lookup, quantiser = header
    whole = np.frombuffer(data, np.uint8)
    if len(starts) > 1 and (np.diff(starts) == starts[1] - starts[0]).all():
        frames = np.lib.stride_tricks.as_strided(whole[starts[0] :], (len(starts), size), (int(starts[1] - starts[0]), 1))
    else:
        frames = whole[starts[:, None] + np.arange(size)]
    differences = lookup[np.ascontiguousarray(frames[:, scan:-2]).view(">u2")]
    if (frames[:, :scan] != frames[0, :scan]).any() or (differences == -32768).any():
        return None
    levels = np.cumsum(differences, axis=1, dtype=np.int32) * quantiser // 8 + 128
    return levels.astype(np.uint8)


def decoded(data: bytes) -> Clip:
    """The frames that the index of an AVI lists, in its order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movie, index = float(RATE), 0, None
    for name, a, b in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, _ in _chunks(data, a + 4, b):
                if inner == b"avih" and struct.unpack_from("<I", data, c)[0]:
                    rate = 1_000_000 / struct.unpack_from("<I", data, c)[0]
        elif name == b"LIST" and data[a : a + 4] == b"movi":
            movie = a
        elif name == b"idx1":
            index = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")], (b - a) // 16, a)
    if index is None or not movie:
        raise ValueError("no index")
    # compressed or plain frames of the first stream; an empty one repeats the frame before it
    index = index[np.isin(index["id"], (b"00dc", b"00db"))]
    if not len(index):
        raise ValueError("no frames")
    offsets = index["offset"].astype(np.int64)
    base = movie if offsets[0] < movie else 0  # offsets count from the list, or from the file's start
    starts, sizes = base + offsets + 8, index["size"].astype(np.int64)
    if (frames := _at_once(data, starts, sizes)) is not None:
        return Clip(rate, frames)
    tables, read = jpeg.standard_tables(), []
    for a, size in zip(starts.tolist(), sizes.tolist()):
        if size or not read:
            read.append(jpeg.grey(data[a : a + size], tables).ravel())
        else:
            read.append(read[-1])
    return Clip(rate, np.stack(read) if len({len(f) for f in read}) == 1 else read)


def _histograms(frames: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """Samples by level, a row for each frame, as whole numbers out of ``FRAME``."""
    if isinstance(frames, np.ndarray) and frames.shape[1] == FRAME:
        key = (np.arange(len(frames))[:, None] * BINS + frames // (256 // BINS)).ravel()
        return np.bincount(key, minlength=len(frames) * BINS).reshape(len(frames), BINS)
    return np.stack([np.bincount(f // (256 // BINS), minlength=BINS) * FRAME // len(f) for f in frames])


def shots(frames: np.ndarray | list[np.ndarray]) -> list[int]:
    """First frames of the shots. All sums are of whole numbers, so equal clips have equal cuts."""
    histograms = _histograms(frames)
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    sums, squares = (np.concatenate([[0], np.cumsum(change**k)]) for k in (1, 2))
    at = np.arange(len(change))
    low = np.maximum(at - LOOKBACK, 0)
    seen = np.maximum(at - low, 1)
    mean = (sums[at] - sums[low]) / seen
    deviation = np.sqrt(np.maximum((squares[at] - squares[low]) / seen - mean**2, 0))
    cuts = [0]
    for k in np.flatnonzero((change > mean + DEVIATIONS * deviation) & (change >= LEAST_CHANGE) & (at >= 1)).tolist():
        if k + 1 - cuts[-1] >= LEAST_SHOT:
            cuts.append(k + 1)
    return cuts


def clip_rows(clip: Clip) -> list[tuple[int, int, int, float, float, float]]:
    """(clip, first frame, end frame, start and end in seconds, mean level) of each shot."""
    cuts = [*shots(clip.frames), len(clip.frames)]
    if isinstance(clip.frames, np.ndarray):
        totals, lengths = clip.frames.sum(axis=1, dtype=np.int64), np.full(len(clip.frames), clip.frames.shape[1])
    else:
        totals, lengths = ([int(f.sum(dtype=np.int64)) for f in clip.frames], [len(f) for f in clip.frames])
    sums, sizes = (np.concatenate([[0], np.cumsum(x)]) for x in (totals, lengths))
    return [(i, a, b, a / clip.rate, b / clip.rate, float(sums[b] - sums[a]) / float(sizes[b] - sizes[a])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, avi), the text's payload as an AVI."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text"), 1 << 22):
                data, offsets = utf8(batch.column("text").slice(first, last - first))
                files = [encoded(payload(data[a:b].tobytes())) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(files, pa.binary())], ["doc_id", "avi"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(b"").alias("avi")).schema)


def clips(stored: DataFrame) -> DataFrame:
    """(doc_id, avi) to a row for each clip."""
    schema = stored.select("doc_id", *(F.lit(0).cast(t).alias(c) for c, t in (("clip", "int"), ("first_frame", "int"), ("end_frame", "int"), ("start_s", "double"), ("end_s", "double"), ("level", "double")))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in enumerate(batch.column("avi")):
                found = clip_rows(decoded(data.as_py()))
                columns = [pa.array(c) for c in zip(*found)]
                kinds = [pa.int32()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([row] * len(found))), *(c.cast(k) for c, k in zip(columns, kinds))], schema.names)

    return stored.select("doc_id", "avi").mapInArrow(run, schema)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(text: bytes) -> tuple[int, int, str, int, int, str, str]:
    """What DIGEST names, from the stored bytes read back; the feature tells the clip rows: how many, and a hash of all."""
    avi = encoded(payload(text))
    clip = decoded(avi)
    back = clip.frames.tobytes()
    found = clip_rows(clip)
    told = ";".join(f"{a}-{b}@{start:.2f}-{end:.2f}:{level:.3f}" for _, a, b, start, end, level in found)
    feature = f"frames={len(clip.frames)};shots={len(found)};longest={max(b - a for _, a, b, *_ in found)};clips={hashlib.sha256(told.encode()).hexdigest()[:32]}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(avi), hashlib.sha256(avi).hexdigest(), feature


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, *DIGEST): stored, read back and measured in one task, so that no file crosses to Spark."""
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema
    for field in docs.sparkSession.createDataFrame([], DIGEST).schema:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [described(data[a:b].tobytes()) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*found))], schema.names)

    return rows.mapInArrow(run, schema)
