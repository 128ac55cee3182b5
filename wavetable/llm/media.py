"""Media columns: motion-JPEG in AVI, read back through its RIFF index and cut into shots.

A payload of 8-bit samples becomes grey frames of 24 x 24. Each frame is a
lossless JPEG (SOF3, predictor 1). Its Huffman table gives the difference
category c a code of 9 - c bits, so a code and its c extra bits always take
9 bits together: Kraft's sum is 511/512, which leaves just the all-ones code
unused, as the format demands. A frame is thus 648 bytes before byte stuffing
and both directions are array expressions. Frames with any other table are
decoded bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import groups, narrow, utf8

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Bits of a code and its extra bits together.
UNIT = 9
PACKED = FRAME * UNIT // 8
#: Histogram bins, frames in the moving window, and deviations above its mean that make a cut.
BINS, WINDOW, SIGMAS, FLOOR = 16, 8, 3.0, 0.10
#: Changes count in the window up to this, so that a cut does not hide the next one.
CAP = 0.5


def _tables() -> tuple[np.ndarray, np.ndarray]:
    d = np.arange(-255, 256)
    c = np.where(d == 0, 0, np.floor(np.log2(np.maximum(np.abs(d), 1))).astype(int) + 1)
    extra = np.where(d > 0, d, d + (1 << c) - 1)
    code = (((1 << (8 - c)) - 1) << (c + 1)) | extra
    back = np.zeros(512, np.int16)
    back[code] = d
    return code.astype(np.uint16), back


CODE, DIFF = _tables()
HEAD = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
    + b"\xff\xc4" + struct.pack(">H", 28) + b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    + b"\xff\xda" + struct.pack(">H", 8) + b"\x01\x01\x00\x01\x00\x00"
)
TAIL = b"\xff\xd9"


def pad(raw: np.ndarray) -> np.ndarray:
    """Bytes 255 appended up to a positive multiple of a frame."""
    size = max(FRAME, -(-len(raw) // FRAME) * FRAME)
    out = np.full(size, 255, np.uint8)
    out[: len(raw)] = raw
    return out


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG frames of (n, SIDE, SIDE) samples."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    v = CODE[d.reshape(-1, 8) + 255]
    out = np.empty((len(v), UNIT), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (v[:, k - 1] << (8 - k)) | (v[:, k] >> (k + 1))
    out[:, 8] = v[:, 7]
    flat = out.reshape(-1)
    full = np.flatnonzero(flat == 255)
    sizes = np.full(len(x), PACKED) + np.bincount(full // PACKED, minlength=len(x))
    stuffed = np.insert(flat, full + 1, 0).tobytes()
    ends = np.cumsum(sizes).tolist()
    return [HEAD + stuffed[a:b] + TAIL for a, b in zip([0, *ends], ends, strict=False)]


def write_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """An AVI 1.0 file: headers, the frames and their index."""
    most = max(map(len, frames))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(struct.pack("<4sI", b"00dc", len(f)) + f + b"\0" * (len(f) & 1))
        at += len(movi[-1])
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    chunk = lambda name, data: struct.pack("<4sI", name, len(data)) + data
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """Frames in index order and frames a second. ValueError on a broken file."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, None
    at, end = 12, 8 + struct.unpack_from("<I", media, 4)[0]
    while at + 8 <= min(end, len(media)):
        name, size = struct.unpack_from("<4sI", media, at)
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            micro = struct.unpack_from("<I", media, at + 20)[0]
            fps = 1e6 / micro if micro else fps
        elif name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(media, np.dtype("<u4"), size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    video = index[index[:, 0] == int.from_bytes(b"00dc", "little")]
    return [media[movi + o + 8 : movi + o + 8 + n] for o, n in video[:, 2:4].tolist()], fps


def _segments(frame: bytes) -> tuple[int, int, dict[tuple[int, int], int], int]:
    """Height, width, Huffman table {(length, code): category} and the start of the entropy-coded data."""
    at, size, table = 2, None, {}
    while True:
        if frame[at] != 0xFF:
            raise ValueError("marker expected")
        mark, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        if mark == 0xC3:
            size = struct.unpack_from(">HH", frame, at + 5)
        elif mark == 0xC4:
            counts, k, code = frame[at + 5 : at + 21], at + 21, 0
            for length, many in enumerate(counts, 1):
                for _ in range(many):
                    table[length, code] = frame[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif mark == 0xDA:
            if size is None or frame[at + 7] != 1:
                raise ValueError("only lossless frames with predictor 1")
            return size[0], size[1], table, at + 2 + n
        at += 2 + n


def _decode_any(frame: bytes) -> np.ndarray:
    """A frame with any Huffman table, bit by bit."""
    h, w, table, at = _segments(frame)
    bits = np.unpackbits(np.frombuffer(frame[at:-2].replace(b"\xff\x00", b"\xff"), np.uint8))
    out, k = np.empty(h * w, np.int64), 0
    for i in range(h * w):
        code, length = 0, 0
        while (length, code) not in table:
            code, length, k = code << 1 | int(bits[k]), length + 1, k + 1
        c, extra = table[length, code], 0
        for _ in range(c):
            extra, k = extra << 1 | int(bits[k]), k + 1
        out[i] = extra if c == 0 or extra >> (c - 1) else extra - (1 << c) + 1
    return _undo(out.reshape(1, h, w))[0]


def _undo(d: np.ndarray) -> np.ndarray:
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (n, height, width) of lossless JPEG frames of one size."""
    if not all(f.startswith(HEAD) for f in frames):
        return np.stack([_decode_any(f) for f in frames])
    raw = np.frombuffer(b"".join([f[len(HEAD) : -2] for f in frames]), np.uint8)
    stuffing = np.flatnonzero(raw == 255) + 1
    b = np.delete(raw, stuffing).reshape(-1, UNIT).astype(np.uint16)
    v = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        v[:, k] = ((b[:, k] << (k + 1)) | (b[:, k + 1] >> (7 - k))) & 511
    return _undo(DIFF[v].reshape(-1, SIDE, SIDE).astype(np.int32))


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """Clips as frame ranges [first, end).

    A cut falls where the histogram's change exceeds the mean of the up to
    WINDOW changes before it by SIGMAS deviations and by FLOOR; it needs two
    earlier changes at least, so a clip's first frames cannot cut.
    """
    n = len(samples)
    if n < 4:
        return [(0, n)]
    bins = (samples.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    h = np.bincount(bins.reshape(-1), minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(h, axis=0)).sum(axis=1) / samples[0].size
    held = np.minimum(change, CAP)
    s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (held, held * held))
    i = np.arange(n - 1)
    lo = np.maximum(0, i - WINDOW)
    m = np.maximum(1, i - lo)
    mean = (s[i] - s[lo]) / m
    dev = np.sqrt(np.maximum(0, (q[i] - q[lo]) / m - mean * mean))
    cut = (np.flatnonzero((i >= 2) & (change > mean + np.maximum(FLOOR, SIGMAS * dev))) + 1).tolist()
    return list(zip([0, *cut], [*cut, n], strict=True))


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, clips array<struct<clip:int,first_frame:int,end_frame:int,start_s:double,end_s:double>>"
)


def _run(batches: Iterable[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for part in groups(batches):
        raw, off = utf8(part.column("text"))
        payloads = [pad(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        frames = encode_frames(np.concatenate(payloads).reshape(-1, SIDE, SIDE))
        rows, at = [], 0
        for k, p in enumerate(payloads):
            n = len(p) // FRAME
            media = write_avi(frames[at : at + n])
            at += n
            stored, fps = read_avi(media)
            samples = decode_frames(stored)
            back = samples.tobytes()
            clips = [{"clip": c, "first_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps} for c, (a, b) in enumerate(shots(samples))]
            row = (int(off[k + 1] - off[k]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), clips)
            rows.append((*row, media) if keep else row)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "media"]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", *names[: len(cols)]])


def media_clips(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store each text as motion-JPEG in AVI, read it back, and list its shots.

    One row for each row of ``docs`` (``doc_id``, ``text``; other columns are
    ignored, whatever their names). A null text is empty; an empty one is a
    single frame of 255s. Repeated rows and repeated or null ids each give
    their own row; equal texts give equal values. ``keep_media`` adds the
    stored bytes as ``media``. Sizes in RIFF have 32 bits, which a string of
    Spark, two gigabytes at most, cannot exceed.
    """
    docs = narrow(docs).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(lambda it: _run(it, keep_media), SCHEMA + (", media binary" if keep_media else ""))


def op8_media_clips(spark, sf_dir: str) -> DataFrame:
    """The query: digests of every document's stored form, and its clips as text."""
    clips = media_clips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.array_join(F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"])), ";")
    return clips.withColumn("feature", F.concat(F.size("clips"), F.lit("|"), text)).drop("clips")
