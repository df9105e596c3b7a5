"""Media columns: AVI with motion-JPEG frames.

Writing stores a payload of 64-byte blocks without loss: byte b becomes the quantised coefficient b - 128 (or
b - 127 from 128 on, so that none is zero) of an 8x8 block, in zigzag order, entropy-coded as baseline JPEG. The
format's unit here is the coefficient: the 8-bit samples that a JPEG decodes to are rounded, its coefficients are
not. Frames are grayscale, 32 x 32 samples (16 blocks, 1024 payload bytes), with a restart marker after each block,
so all blocks of many frames decode at once. A ``plen`` chunk holds the payload's length; blocks of the last frame
beyond it are byte 0.

Reading parses the RIFF tree and its idx1 index, decodes the frames' entropy-coded data (any baseline grayscale JPEG
with a restart interval of one block), and from the samples (dequantised, inverse cosine transform) takes luminance
histograms. A shot ends where the histogram difference to the frame before exceeds the mean of the last ``WINDOW``
differences by ``FACTOR`` standard deviations, and ``FLOOR`` at least. Shots are clip rows with times.

Defined results: a null or empty text is one block of zero bytes; equal texts give equal bytes and features; a file
that isn't such an AVI raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, utf8

BLOCK, SIDE = 64, 32
FRAME_BLOCKS = (SIDE // 8) ** 2
FPS = 25
BINS = 16
WINDOW, FACTOR, FLOOR = 8, 2.5, 0.25
#: Blocks that are coded or decoded at once.
GROUP = 1 << 14

#: Code lengths of the magnitude categories 1 to 8, for DC and AC alike. Most of text falls into categories 5 and 6.
_LENGTHS = {5: 2, 6: 2, 4: 3, 7: 3, 3: 4, 2: 5, 1: 6, 8: 7}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes by symbol: (code, length), in the order of length, then of the table."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last, code = (code, n), n, code + 1
    return out


_CODES = _codes(_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int) -> bytes:
    order = sorted(_LENGTHS, key=_LENGTHS.get)
    return _segment(0xC4, bytes([kind, *(sum(n == k for n in _LENGTHS.values()) for k in range(1, 17)), *order]))


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _dht(0x00) + _dht(0x10)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _zigzag() -> np.ndarray:
    """Place in the 8x8 block of each coefficient of the zigzag order."""
    key = lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1])
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=key)])


_ZIGZAG = _zigzag()
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)], np.float32)


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code word and its bits for each payload byte."""
    word, bits = np.zeros(256, np.uint32), np.zeros(256, np.int64)
    for b in range(256):
        q = b - 128 if b < 128 else b - 127
        n = abs(q).bit_length()
        code, length = _CODES[n]
        word[b], bits[b] = code << n | (q if q > 0 else q + (1 << n) - 1), length + n
    return word, bits


_WORD, _BITS = _byte_codes()


def code_blocks(blocks: np.ndarray) -> list[bytes]:
    """Entropy-coded, byte-stuffed data of each block (n x 64 bytes), filled up with ones to whole bytes."""
    bits = _BITS[blocks]
    size = -(-bits.sum(1) // 8)
    begin = np.cumsum(size) - size
    ends = np.cumsum(bits, 1) + (begin * 8)[:, None]
    # each word of up to 15 bits ends at bit `ends`: shifted into a window of four bytes that starts at its first byte
    first = (ends - bits) >> 3
    window = (_WORD[blocks].astype(np.uint64) << (32 - (ends - (first << 3))).astype(np.uint64)).astype(np.uint64)
    total = int(size.sum())
    out = np.zeros(total + 4, np.uint8)
    # words share bytes, but never bits: sums of their bytes put them together
    for k in range(3):
        out[: total + 4] += np.bincount((first + k).ravel(), ((window >> np.uint64(24 - 8 * k)) & np.uint64(255)).ravel(), total + 4).astype(np.uint8)
    fill = ends[:, -1]
    rest = (8 - fill % 8) % 8
    out[begin + size - 1] |= ((1 << rest) - 1).astype(np.uint8)
    out = out[:total]
    full = out == 255
    if full.any():
        stuffed = np.insert(out, np.flatnonzero(full) + 1, 0)
        size = size + np.add.reduceat(full.astype(np.int64), begin)
        out, begin = stuffed, np.cumsum(size) - size
    raw = out.tobytes()
    return [raw[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]


def _frames(coded: list[bytes]) -> list[bytes]:
    """JPEG files of FRAME_BLOCKS coded blocks each."""
    marks = [bytes([0xFF, 0xD0 + k % 8]) for k in range(FRAME_BLOCKS - 1)] + [b"\xff\xd9"]
    return [_HEAD + b"".join(x for pair in zip(coded[lo : lo + FRAME_BLOCKS], marks, strict=True) for x in pair) for lo in range(0, len(coded), FRAME_BLOCKS)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def avi(frames: list[bytes], payload_bytes: int) -> bytes:
    n, most = len(frames), max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    pieces, index, at = [], [], 4
    for f in frames:
        pieces.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(pieces[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"plen", struct.pack("<Q", payload_bytes)) + _list(b"movi", b"".join(pieces)) + _chunk(b"idx1", b"".join(index)))


def write(payloads: list[bytes]) -> list[bytes]:
    """An AVI of each payload; payloads are positive multiples of 64 bytes."""
    blocks = [-(-len(p) // (BLOCK * FRAME_BLOCKS)) * FRAME_BLOCKS for p in payloads]
    data = np.frombuffer(b"".join(p.ljust(n * BLOCK, b"\0") for p, n in zip(payloads, blocks, strict=True)), np.uint8).reshape(-1, BLOCK)
    coded = [c for lo in range(0, len(data), GROUP) for c in code_blocks(data[lo : lo + GROUP])]
    out, at = [], 0
    for p, n in zip(payloads, blocks, strict=True):
        out.append(avi(_frames(coded[at : at + n]), len(p)))
        at += n
    return out


def parse(data: bytes) -> tuple[list[tuple[int, int]], int, float]:
    """(offset, size) of the frames by the index, the payload's length (0: not given), frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, plen, fps = 12, None, None, 0, 0.0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / max(struct.unpack_from("<I", data, at + 20)[0], 1)
        elif name == b"idx1":
            index = (at + 8, size // 16)
        elif name == b"plen":
            (plen,) = struct.unpack_from("<Q", data, at + 8)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    entries = np.frombuffer(data, "<u4", index[1] * 4, index[0]).reshape(-1, 4)
    return [(movi + o + 8, n) for o, n in entries[:, 2:].tolist()], plen, fps


def _parse_jpeg(data: bytes) -> tuple[int, dict, np.ndarray, tuple[int, int]]:
    """Where the entropy-coded data starts, Huffman tables, quantisation table (zigzag), size of a grayscale frame."""
    at, tables, quant, size, interval = 2, {}, np.ones(64, np.int32), (0, 0), 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        if marker == 0xDB:
            quant = np.frombuffer(body, np.uint8, 64, 1).astype(np.int32)
        elif marker == 0xC0:
            size = struct.unpack_from(">HH", body, 1)
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only 8-bit grayscale frames")
        elif marker == 0xC4:
            while body:
                counts, kind = body[1:17], body[0]
                symbols = body[17 : 17 + sum(counts)]
                lengths = [k + 1 for k, c in enumerate(counts) for _ in range(c)]
                tables[kind] = _codes(dict(zip(symbols, lengths, strict=True)))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if interval != 1:
                raise ValueError("only a restart interval of one block")
            return at + 2 + n, tables, quant, size
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames")
        at += 2 + n


def _lookup(codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, n) in codes.items():
        out[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbol
    return out


_parsed: dict[bytes, tuple] = {}


def _tables_of(head: bytes):
    if head not in _parsed:
        if len(_parsed) > 64:
            _parsed.clear()
        _, tables, quant, size = _parse_jpeg(head)
        _parsed[head] = _lookup(tables[0x00]), _lookup(tables[0x10]), quant, size
    return _parsed[head]


def decode_blocks(coded: bytes, starts: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Quantised coefficients (zigzag order) of blocks whose unstuffed data start at the given bytes; all at once,
    one coefficient or run of zeros a step."""
    b = np.frombuffer(coded + b"\xff" * 8, np.uint8).astype(np.uint32)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    n = len(starts)
    out = np.zeros((n, 64), np.int16)
    bit, k, rows = starts.astype(np.int64) * 8, np.zeros(n, np.int64), np.arange(n)
    table = dc
    while len(rows):
        w = window[bit >> 3] << (bit & 7).astype(np.uint32)
        found = table[w >> 16]
        if not found.all():
            raise ValueError("no code fits")
        bit = bit + (found >> 8)
        run, size = (found >> 4 & 15) if table is ac else 0, found & 15
        w = window[bit >> 3] << (bit & 7).astype(np.uint32)
        value = ((w >> 16) >> (16 - size).astype(np.uint32)).astype(np.int32)
        value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
        bit = bit + size
        if table is ac:
            k = k + run
            k = np.where((size == 0) & (run < 15), 64, k)  # end of block
        some = k < 64
        if some.all():
            out[rows, k] = value
        else:
            out[rows[some], k[some]] = value[some]
        k = k + 1
        table = ac
        on = k < 64
        if not on.all():
            rows, bit, k = rows[on], bit[on], k[on]
    return out


def read(files: list[bytes]) -> list[tuple[bytes, np.ndarray, float]]:
    """Of each file: the payload, the luminance histograms of its frames (n x BINS, rows sum to 1), frames a second."""
    out: list = [None] * len(files)
    waiting, blocks = [], 0
    parsed = [parse(f) for f in files]
    for k, (f, (frames, plen, fps)) in enumerate(zip(files, parsed, strict=True)):
        waiting.append((k, [f[o : o + n] for o, n in frames], plen, fps))
        blocks += len(frames) * FRAME_BLOCKS
        if blocks >= GROUP or k == len(files) - 1:
            _decode(waiting, out)
            waiting, blocks = [], 0
    return out


def _decode(files: list, out: list) -> None:
    by_head: dict[bytes, list[tuple[int, int, bytes]]] = {}
    for k, frames, _, _ in files:
        for j, f in enumerate(frames):
            n = len(_HEAD) if f.startswith(_HEAD) else _parse_jpeg(f)[0]
            by_head.setdefault(f[:n], []).append((k, j, f[n:]))
    coefs: dict[tuple[int, int], np.ndarray] = {}
    hist: dict[tuple[int, int], np.ndarray] = {}
    for head, frames in by_head.items():
        dc, ac, quant, (h, w) = _tables_of(head)
        each = -(-h // 8) * -(-w // 8)
        raw = b"".join(f for *_, f in frames)
        a = np.frombuffer(raw, np.uint8)
        mark = np.zeros(len(a), bool)
        mark[1:] = (a[:-1] == 255) & (a[1:] != 0)
        stuffed = np.zeros(len(a), bool)
        stuffed[1:] = (a[:-1] == 255) & (a[1:] == 0)
        lead = np.zeros(len(a), bool)
        lead[:-1] = mark[1:]
        keep = ~(mark | stuffed | lead)
        ends = np.cumsum(keep)[mark]  # each marker ends a block: RSTn, or EOI after the last
        starts = np.concatenate([[0], ends[:-1]])
        if len(starts) != each * len(frames):
            raise ValueError("wrong number of blocks")
        q = decode_blocks(a[keep].tobytes(), starts, dc, ac)
        natural = np.empty(q.shape, np.float32)
        natural[:, _ZIGZAG] = q * quant
        samples = np.matmul(np.matmul(_COS.T, natural.reshape(-1, 8, 8)), _COS)
        bins = (np.clip(np.rint(samples + 128), 0, 255).astype(np.int64) * BINS >> 8).reshape(len(frames), -1)
        counts = np.bincount((bins + np.arange(len(frames))[:, None] * BINS).ravel(), minlength=len(frames) * BINS).reshape(-1, BINS) / bins.shape[1]
        for i, (k, j, _) in enumerate(frames):
            coefs[k, j], hist[k, j] = q[i * each : (i + 1) * each], counts[i]
    for k, frames, plen, fps in files:
        q = np.concatenate([coefs[k, j] for j in range(len(frames))])
        data = np.where(q < 0, q + 128, q + 127).astype(np.uint8).tobytes()
        out[k] = data[: plen or len(data)], np.stack([hist[k, j] for j in range(len(frames))]), fps


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frame of each shot."""
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts = [k + 1 for k in range(len(d)) if d[k] > max(FLOOR, (p := d[max(0, k - WINDOW) : k]).mean() + FACTOR * p.std() if k else FLOOR)]
    return list(zip([0, *cuts], [c - 1 for c in cuts] + [len(hist) - 1], strict=True))


def payload(text: bytes) -> bytes:
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def store(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """(keep, n_bytes, media): each text as an AVI."""
    def rows(batches):
        for b in pieces(batches, "t", 1 << 20):
            texts = b["t"].to_pylist()
            yield pa.RecordBatch.from_arrays([b[keep], pa.array(map(len, texts), pa.int64()), pa.array(write([payload(t) for t in texts]), pa.binary())], [keep, "n_bytes", "media"])

    return docs.select(keep, utf8().alias("t")).mapInArrow(rows, f"`{keep}` {docs.schema[keep].dataType.simpleString()}, n_bytes long, media binary")


def clips(media: DataFrame, keep: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per shot: (keep, clip, first_frame, last_frame, start_ms, end_ms, histogram: mean of its frames)."""

    def rows(batches):
        for b in pieces(batches, column):
            ids, made = b[keep], []
            for k, (_, hist, fps) in enumerate(read(b[column].to_pylist())):
                made += [(k, c, a, z, round(a * 1000 / fps), round((z + 1) * 1000 / fps), hist[a : z + 1].mean(0).tolist()) for c, (a, z) in enumerate(shots(hist))]
            cols = list(zip(*made, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.list_(pa.float64()))], [keep, "clip", "first_frame", "last_frame", "start_ms", "end_ms", "histogram"])

    kind = media.schema[keep].dataType.simpleString()
    return media.select(keep, column).mapInArrow(rows, f"`{keep}` {kind}, clip long, first_frame long, last_frame long, start_ms long, end_ms long, histogram array<double>")


def digest(media: DataFrame) -> DataFrame:
    """Per stored file: digests of the payload read back and of the file, and its shots as text."""

    def rows(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "n_shots", "feature"]
        for b in pieces(batches, "media"):
            files, made = b["media"].to_pylist(), []
            for f, (data, hist, fps) in zip(files, read(files), strict=True):
                found = shots(hist)
                feature = ";".join(f"{a * 1000 / fps:.0f}-{(z + 1) * 1000 / fps:.0f}:" + "".join(f"{round(v * 255):02x}" for v in hist[a : z + 1].mean(0)) for a, z in found)
                made.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(f), hashlib.sha256(f).hexdigest(), len(hist), len(found), feature))
            cols = list(zip(*made, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["n_bytes"], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return media.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_shots long, feature string")


def op5_avi(spark, sf_dir: str) -> DataFrame:
    return digest(store(documents(spark, sf_dir)))
