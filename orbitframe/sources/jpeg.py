"""A baseline JPEG writer on numpy arrays: block transforms and entropy coding of a whole image at once."""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

#: Example quantisation tables of the standard (rows of eight), for luma and for both colour differences.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
#: Blue, green and red shares of luma, and of the two colour differences.
SHARES = np.array([[0.114, 0.587, 0.299], [0.5, -0.331264, -0.168736], [-0.081312, -0.418688, 0.5]])
END, ZEROS = 0x00, 0xF0


@lru_cache(maxsize=1)
def _zigzag() -> np.ndarray:
    """Places of a block (row * 8 + column) by diagonals, odd ones downwards."""
    cells = [(r + c, c if (r + c) % 2 == 0 else r, r * 8 + c) for r in range(8) for c in range(8)]
    return np.array([at for *_, at in sorted(cells)])


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k = np.arange(8)
    out = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    out[0] /= np.sqrt(2)
    return out


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Both tables for a quality of 1 to 100: 50 is the tables as they are, 100 all ones."""
    q = min(100, max(1, int(quality)))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA))


def _blocks(plane: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8) of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def _grown(plane: np.ndarray, side: int) -> np.ndarray:
    h, w = plane.shape[:2]
    return np.pad(plane, [(0, -h % side), (0, -w % side)] + [(0, 0)] * (plane.ndim - 2), mode="edge")


def _coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    d = _cosines().astype(np.float32)
    b = d @ (_blocks(plane).astype(np.float32) - 128) @ d.T
    return np.rint(b / table.reshape(8, 8)).astype(np.int16).reshape(*b.shape[:2], 64)[..., _zigzag()]


def _scan(px: np.ndarray, quality: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks x 64 coefficients in zigzag order, component of each block) in the order of the scan."""
    luma, chroma = quantisers(quality)
    if px.ndim == 2 or px.shape[2] == 1:
        c = _coefficients(_grown(px.reshape(px.shape[:2]), 8), luma).reshape(-1, 64)
        return c, np.zeros(len(c), np.int8)
    y, cb, cr = np.moveaxis(_grown(px[..., :3], 16).astype(np.float32) @ SHARES.T.astype(np.float32), 2, 0)
    half = lambda p: p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean(axis=(1, 3)) + 128
    y = _coefficients(y, luma)
    rows, columns = y.shape[0] // 2, y.shape[1] // 2
    y = y.reshape(rows, 2, columns, 2, 64).swapaxes(1, 2).reshape(rows, columns, 4, 64)
    units = [y, *(_coefficients(half(p), chroma)[:, :, None] for p in (cb, cr))]
    return np.concatenate(units, axis=2).reshape(-1, 64), np.tile(np.array([0, 0, 0, 0, 1, 2], np.int8), rows * columns)


def _symbols(blocks: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, symbol, extra bits, their number) of every code in order; tables: 0 and 1 first values, 2 and 3 the others, of luma and chroma."""
    n = len(blocks)
    first = np.empty(n, np.int32)
    for c in range(3):
        at = np.flatnonzero(component == c)
        first[at] = np.diff(blocks[at, 0].astype(np.int32), prepend=0)
    block, place = np.nonzero(blocks[:, 1:])
    value = blocks[block, place + 1].astype(np.int32)
    before = np.where(np.concatenate(([True], block[1:] != block[:-1])), -1, np.concatenate(([0], place[:-1]))) if len(block) else place
    run = place - before - 1
    width = lambda v: np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
    bits = lambda v, w: np.where(v < 0, v + (1 << w) - 1, v)
    chroma = (component > 0).astype(np.int64)
    zeros = np.repeat(np.arange(len(block)), run // 16)
    last = np.full(n, -1)
    last[block] = place  # in order, so the last one stays
    open_ = np.flatnonzero(last < 62)
    w0, w1 = width(first), width(value)
    none = lambda k: np.zeros(k, np.int64)
    parts = [  # order within the image, table, symbol, extra bits, their number
        (np.arange(n) * 256, chroma, w0, bits(first, w0), w0),
        (block[zeros] * 256 + 2 + place[zeros] * 2 - 1, 2 + chroma[block[zeros]], np.full(len(zeros), ZEROS), none(len(zeros)), none(len(zeros))),
        (block * 256 + 2 + place * 2, 2 + chroma[block], (run % 16) * 16 + w1, bits(value, w1), w1),
        (open_ * 256 + 255, 2 + chroma[open_], np.full(len(open_), END), none(len(open_)), none(len(open_))),
    ]
    key, *columns = map(np.concatenate, zip(*parts))
    order = np.argsort(key, kind="stable")
    return tuple(c[order] for c in columns)


def code_lengths(counts: np.ndarray, most: int = 16) -> dict[int, int]:
    """Bits of each symbol that occurs: those of a Huffman tree, held to ``most``, with one code of the greatest length left unused."""
    heap = [(int(counts[s]), k, (int(s),)) for k, s in enumerate(np.flatnonzero(counts))] + [(0, 1 << 20, (-1,))]
    depth = dict.fromkeys((s for *_, symbols in heap for s in symbols), 0)
    heapq.heapify(heap)
    k = 1 << 21
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, k := k + 1, x + y))
    # Too long codes are cut, and room for them is made below the shorter ones until the code is one again (Kraft's sum is 1 at most).
    order = sorted(depth, key=lambda s: (depth[s], s != -1 and -int(counts[s]), s == -1))
    lengths = {s: min(depth[s], most) for s in order}
    room = (1 << most) - sum(1 << (most - n) for n in lengths.values())
    for s in reversed(order):
        while room < 0 and lengths[s] < most:
            lengths[s] += 1
            room += 1 << (most - lengths[s])
    del lengths[-1]  # the code of ones alone, the longest one
    return lengths


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(code, length) by symbol, and the table's segment: counts of each length, then symbols in order of their codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    at, before = 0, 0
    for s in order:
        at <<= lengths[s] - before
        before = lengths[s]
        code[s], size[s] = at, before
        at += 1
    counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    return code, size, bytes(counts) + bytes(order)


def _packed(code: np.ndarray, size: np.ndarray) -> bytes:
    """The codes' bits one after the other, filled up with ones, a zero byte after each byte of ones."""
    total = int(size.sum())
    fill = -total % 8
    code, size = np.append(code, np.uint64((1 << fill) - 1)), np.append(size, fill)
    starts = np.cumsum(size) - size
    out = np.zeros(-(-total // 8) + 8, np.uint8)
    for lo in range(0, len(code), 1 << 20):
        c, n, s = code[lo : lo + (1 << 20)], size[lo : lo + (1 << 20)], starts[lo : lo + (1 << 20)]
        first = int(s[0]) >> 3
        at, word = (s >> 3) - first, c << (64 - (s & 7) - n).astype(np.uint64)
        for k in range(5):
            byte = (word >> np.uint64(56 - 8 * k)) & np.uint64(255)
            sums = np.bincount(at + k, weights=byte.astype(np.float64))  # no two codes share a bit, so sums are unions
            out[first : first + len(sums)] |= sums.astype(np.uint8)
    return out[: -(-total // 8)].tobytes().replace(b"\xff", b"\xff\x00")


def encode_jpeg(px: np.ndarray, quality: int = 95) -> bytes:
    """A baseline JFIF file of one channel, or of blue, green, red pixels with colour at half size.

    Codes are fitted to the image's own symbols. Sides are 65,535 pixels at most.
    """
    h, w = px.shape[:2]
    if not (0 < h < 65_536 and 0 < w < 65_536):
        raise ValueError("a JPEG has sides of 1 to 65,535 pixels")
    blocks, component = _scan(px, quality)
    table, symbol, extra, width = _symbols(blocks, component)
    color = px.ndim == 3 and px.shape[2] >= 3
    code, size, tables = np.zeros(len(symbol), np.uint64), np.zeros(len(symbol), np.int64), b""
    for t in (0, 1, 2, 3) if color else (0, 2):
        at = np.flatnonzero(table == t)
        codes, sizes, segment = _codes(code_lengths(np.bincount(symbol[at], minlength=256)))
        code[at], size[at] = codes[symbol[at]], sizes[symbol[at]]
        tables += bytes([(t >> 1) << 4 | (t & 1)]) + segment
    code = (code << width.astype(np.uint64)) | extra.astype(np.uint64)
    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    q = quantisers(quality)[: 2 if color else 1]
    parts = [(1, 0x22, 0), (2, 0x11, 1), (3, 0x11, 1)] if color else [(1, 0x11, 0)]
    head = b"\xff\xd8" + part(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])) + part(0xDB, b"".join(bytes([i, *t[_zigzag()].tolist()]) for i, t in enumerate(q)))
    head += part(0xC0, struct.pack(">BHHB", 8, h, w, len(parts)) + b"".join(map(bytes, parts))) + part(0xC4, tables)
    head += part(0xDA, bytes([len(parts)]) + b"".join(bytes([i, t << 4 | t]) for i, _, t in parts) + bytes([0, 63, 0]))
    return head + _packed(code, size + width) + b"\xff\xd9"
