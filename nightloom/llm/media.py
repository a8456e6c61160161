"""Media columns: AVI motion-JPEG.

A text's bytes become the quantised coefficients of baseline JPEG frames (64 bytes a block, zigzag
order) inside an AVI file with an idx1 index. A byte b is the coefficient whose eight additional bits are b: all such
coefficients have size category 8 (-255..-128, 128..255), so the Huffman step is one fixed code word and the
payload survives exactly. Each block is a restart interval of its own. The reader parses the RIFF tree and index, decodes the
frames (any baseline grey JPEG), rebuilds pixels by inverse DCT and cuts shots where the histogram difference of
successive frames exceeds an adaptive threshold.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from nightloom.llm.common import map_lists

SIDE = 8  # blocks along each side of a frame
FRAME = SIDE * SIDE  # blocks in a frame
FPS = 25

# Fixed values of the JPEG standard: zigzag scan order.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _idct_matrix() -> np.ndarray:
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    d = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    full = np.kron(d, d)  # pixels (y, x) from coefficients (v, u)
    return full[:, ZIGZAG].T.astype(np.float32)  # rows: coefficients in zigzag order


IDCT = _idct_matrix()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman_table(kind: int, codes: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(len(codes.get(n, [])) for n in range(1, 17)) + b"".join(bytes(codes[n]) for n in sorted(codes)))


# Both tables: '0' is size 8 without a run, '10' is size 0 (end of block).
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * SIDE, 8 * SIDE, 1) + b"\x01\x11\x00")
    + _huffman_table(0x00, {1: [8], 2: [0]})
    + _huffman_table(0x10, {1: [8], 2: [0]})
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
EMPTY = b"\xaf"  # a block of zeros: 10 10, filled with ones
RESTART = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that carry a payload of 64-byte blocks."""
    raw = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    bits = np.zeros((len(raw), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(raw[:, :, None], axis=2)
    coded = np.packbits(bits.reshape(len(raw), 576), axis=1)
    blocks = [coded[k].tobytes().replace(b"\xff", b"\xff\x00") for k in range(len(raw))]
    blocks += [EMPTY] * (-len(blocks) % FRAME)
    frames = []
    for at in range(0, len(blocks), FRAME):
        scan = bytearray()
        for k, block in enumerate(blocks[at : at + FRAME]):
            if k:
                scan += RESTART[(k - 1) % 8]
            scan += block
        frames.append(HEAD + bytes(scan) + b"\xff\xd9")
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of MJPG frames; the chunk 'plen' states the payload's length."""
    frames, side = encode_frames(payload), 8 * SIDE
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for frame in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        movi.append(chunk := _chunk(b"00dc", frame))
        at += len(chunk)
    body = (
        _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
        + _chunk(b"plen", struct.pack("<Q", len(payload)))
        + _list(b"movi", b"".join(movi))
        + _chunk(b"idx1", b"".join(index))
    )
    return _chunk(b"RIFF", b"AVI " + body)


def read_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames named by the index, seconds a frame, and the stated payload length (None in files of others)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros, movi, index, stated = 1_000_000 // FPS, None, b"", None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                micros = struct.unpack_from("<I", data, at + 8)[0]
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + size]
            elif name == b"plen":
                stated = struct.unpack_from("<Q", data, at + 8)[0]
            at += 8 + size + size % 2
    frames = []
    for k in range(0, len(index) - 15, 16):
        name, _, off, size = struct.unpack_from("<4sIII", index, k)
        if name[2:] in (b"dc", b"db"):
            at = off + (movi if data[movi + off : movi + off + 4] == name else 0)  # offsets count from 'movi' or from the file's start
            frames.append(data[at + 8 : at + 8 + size])
    return frames, micros / 1e6, stated


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, at, out = 0, 0, {}
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = 2 * v + int(b)
        self.at += n
        return v

    def symbol(self, codes: dict) -> int:
        v = 0
        for n in range(1, 17):
            v = 2 * v + self.take(1)
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("bad Huffman code")


def _extend(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def decode_jpeg(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (blocks, 64, in zigzag order) of a baseline grey JPEG, and its quantisation table."""
    at, quant, huff, every, shape = 2, {}, {}, 0, (8, 8)
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8)
                body = body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            shape = struct.unpack_from(">HH", body, 1)
            if body[5] != 1:
                raise ValueError("only grey frames are read")
            table = body[8]
        elif marker == 0xDA:
            dc_id, ac_id = body[2] >> 4, 16 + (body[2] & 15)
            break
    blocks = -(-shape[0] // 8) * -(-shape[1] // 8)
    scan = frame[at : frame.rindex(b"\xff\xd9")]
    parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", scan)]
    out = np.zeros((blocks, 64), np.int16)
    fixed = every == 1 and all(_codes(*huff[k]).get((1, 0)) == 8 for k in (dc_id, ac_id))
    if fixed:  # blocks whose coefficients all have the one-bit code for size 8
        full = np.array([len(p) == 72 for p in parts[:blocks]])
        if full.any():
            bits = np.unpackbits(np.frombuffer(b"".join(p for p in parts[:blocks] if len(p) == 72), np.uint8)).reshape(-1, 64, 9)
            plain = ~bits[:, :, 0].any(axis=1)
            v = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int16)
            at_full = np.flatnonzero(full)
            out[at_full[plain]] = np.where(v >= 128, v, v - 255)[plain]
            full[at_full[~plain]] = False
        rest = [k for k in np.flatnonzero(~full) if parts[k] != EMPTY]
    else:
        rest = range(len(parts))
    dc, ac = _codes(*huff[dc_id]), _codes(*huff[ac_id])
    for part in rest:
        bits, last = _Bits(parts[part]), 0
        for block in range(part * every, min(blocks, (part + 1) * every)) if every else range(blocks):
            size = bits.symbol(dc)
            last += _extend(bits.take(size), size)
            out[block, 0], k = last, 1
            while k < 64:
                s = bits.symbol(ac)
                run, size = s >> 4, s & 15
                if size == 0 and run != 15:
                    break
                k += run
                if size:
                    out[block, k] = _extend(bits.take(size), size)
                k += 1
    return out, quant[table]


def read_media(data: bytes) -> tuple[bytes, np.ndarray, float]:
    """The payload, a 16-bin histogram for each frame, and seconds a frame."""
    frames, seconds, stated = read_avi(data)
    coeffs = [decode_jpeg(f) for f in frames]
    hist = np.zeros((len(frames), 16), np.int64)
    for k, (c, quant) in enumerate(coeffs):
        pixels = np.clip(np.rint((c * quant).astype(np.float32) @ IDCT) + 128, 0, 255).astype(np.uint8)
        hist[k] = np.bincount((pixels >> 4).ravel(), minlength=16)
    every = np.concatenate([c for c, _ in coeffs]) if coeffs else np.zeros((0, 64), np.int16)
    payload = np.where(every > 0, every, every + 255).astype(np.uint8).tobytes()[:stated]
    return payload, hist, seconds


def shots(hist: np.ndarray, k: float = 3.0, least: float = 0.02, window: int = 12) -> list[tuple[int, int]]:
    """Frame ranges [first, end). A cut stands where the difference exceeds mean + k sigma of the differences before it (in a window of the shot)."""
    if not len(hist):
        return []
    share = hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    diff = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    cuts, since = [0], 0
    for j, d in enumerate(diff):
        past = diff[max(since, j - window) : j]
        limit = max(least, past.mean() + k * past.std()) if len(past) >= 2 else 0.25
        if d > limit:
            cuts.append(j + 1)
            since = j + 1
    return list(zip(cuts, [*cuts[1:], len(hist)], strict=True))


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\x00" * (max(64, -(-len(data) // 64) * 64) - len(data))


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_bytes, media (the AVI file).

    Null or empty text is stored as 64 zero bytes; repeated rows give repeated, equal rows; a null key stays null;
    other columns are not carried. An empty table gives an empty table.
    """

    def store(b):
        made = [padded(t) for t in b["t"]]
        return [(k, n, write_avi(p)) for k, (n, p) in zip(b["k"], made, strict=True)]

    kind = docs.schema[key].dataType.simpleString()
    return map_lists(docs.selectExpr(f"`{key}` k", f"cast(`{text}` as string) t"), store, f"k {kind}, n_bytes long, media binary").withColumnRenamed("k", key)


def _read_or_none(data: bytes | None):
    """As read_media; None of no file, or of one that isn't AVI with grey baseline frames and their own tables."""
    try:
        return None if data is None else read_media(data)
    except (ValueError, KeyError, IndexError, struct.error):
        return None


def clip_rows(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Timed clips of media columns: key, clip, first_frame, end_frame, start_s, end_s. A null file and one that can't be read have none."""

    def cut(b):
        rows = []
        for k, data in zip(b["k"], b["media"], strict=True):
            found = _read_or_none(data)
            if found is not None:
                _, hist, s = found
                rows += [(k, j, int(a), int(e), a * s, e * s) for j, (a, e) in enumerate(shots(hist))]
        return rows

    kind = media.schema[key].dataType.simpleString()
    return map_lists(media.selectExpr(f"`{key}` k", "media"), cut, f"k {kind}, clip int, first_frame int, end_frame int, start_s double, end_s double").withColumnRenamed("k", key)


def media_digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a reader of the stored files finds: payload and media digests, and the clips as a feature string. Of a file that can't be read (another
    colour space or coding, damage) only the stored form is known and feature is "unreadable"; of a null file all is null."""

    def digest(b):
        rows = []
        for k, n, data in zip(b["k"], b["n_bytes"], b["media"], strict=True):
            found = _read_or_none(data)
            if found is None:
                rows.append((k, n, None, None, None, *((None, None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest(), "unreadable"))))
                continue
            payload, hist, s = found
            clips = shots(hist)
            feature = f"frames={len(hist)};clips={len(clips)};" + ",".join(f"{a * s:.2f}-{e * s:.2f}" for a, e in clips)
            rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        return rows

    kind = media.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_lists(media.selectExpr(f"`{key}` k", "n_bytes", "media"), digest, schema).withColumnRenamed("k", key)
