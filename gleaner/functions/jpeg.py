"""Baseline JPEG files of RGB images, with Huffman tables made for each image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The quantisation tables of the JPEG standard (Annex K.1), row by row, for luminance and for colour.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Y, Cb and Cr of red, green and blue, before 128 is added to the last two.
_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
_WAVES = np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16) * np.where(np.arange(8) == 0, 8**-0.5, 0.5)[:, None]
#: Places of an 8 by 8 block along its diagonals, every other one upwards.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: Symbols whose bits are laid out at once.
_CHUNK = 1 << 18


def _quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255)[_ZIGZAG] for t in (LUMINANCE, COLOUR)]


def _coefficients(rgb: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Blocks by components by 64 quantised coefficients, in zigzag order."""
    height, width = rgb.shape[:2]
    padded = np.pad(rgb, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    ycc = padded.astype(float) @ _YCC.T - np.array([128.0, 0.0, 0.0])
    blocks = ycc.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3).reshape(-1, 3, 8, 8)
    waves = (_WAVES @ blocks @ _WAVES.T).reshape(-1, 3, 64)[..., _ZIGZAG]
    return np.rint(waves / np.stack([tables[0], tables[1], tables[1]])).astype(np.int64)


def _code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits; the code of all ones is left to the symbol 256, which no image has."""
    while True:
        heap = [(n, s, ((s, 0),)) for s, n in counts.items()] + [(0, 256, ((256, 0),))]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), tuple((s, d + 1) for s, d in a[2] + b[2])))
        lengths = dict(heap[0][2])
        if max(lengths.values()) <= 16:
            return lengths
        counts = {s: n // 2 + 1 for s, n in counts.items()}  # flatter counts make shorter codes


def _codes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length by symbol, and the table as it stands in the file."""
    values, n = np.unique(symbols, return_counts=True)
    lengths = _code_lengths(dict(zip(values.tolist(), n.tolist(), strict=True)))
    longest = max(lengths.values())
    lengths[256] = longest
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, at, last = np.zeros(257, np.int64), np.zeros(257, np.int64), 0, 0
    for s in ordered:
        at <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = at, last
        at += 1
    own = [s for s in ordered if s < 256]
    return code, size, bytes(sum(lengths[s] == k for s in own) for k in range(1, 17)) + bytes(own)


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(x) + 1)).astype(np.int64)


def _events(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In the order of the file: which table (luminance or colour, first or other coefficients), symbol, and the bits after it with their number."""
    n = len(coefficients)
    first = np.diff(coefficients[:, :, 0], axis=0, prepend=0).reshape(-1)
    rest = coefficients[:, :, 1:].reshape(n * 3, 63)
    colour = np.tile([0, 1, 1], n)
    block, at = np.nonzero(rest)
    before = np.where(np.concatenate([[True], block[1:] != block[:-1]]), -1, np.concatenate([[-1], at[:-1]])) if len(block) else at
    run, value = at - before - 1, rest[block, at]
    size = _bit_length(value)
    far = run // 16  # 16 zeros at once
    end = np.full(n * 3, -1)
    end[block] = at  # the last of each block stays
    open_ = np.flatnonzero(end < 62)
    none = np.zeros(0, np.int64)
    kinds = (
        (np.arange(n * 3) * 256, colour, _bit_length(first), first, _bit_length(first)),
        (np.repeat(block * 256 + 2 * at + 2, far), 2 + np.repeat(colour[block], far), np.full(far.sum(), 0xF0), none, none),
        (block * 256 + 2 * at + 3, 2 + colour[block], (run % 16) * 16 + size, value, size),
        (open_ * 256 + 255, 2 + colour[open_], np.zeros(len(open_), np.int64), none, none),
    )
    filled = [(p, t, s, v if len(v) else np.zeros(len(p), np.int64), b if len(b) else np.zeros(len(p), np.int64)) for p, t, s, v, b in kinds]
    place, table, symbol, value, bits = (np.concatenate(x) for x in zip(*filled, strict=True))
    order = np.argsort(place, kind="stable")
    value = np.where(value < 0, value + (1 << bits) - 1, value)
    return table[order], symbol[order], value[order], bits[order]


def jpeg(rgb: np.ndarray, quality: int = 85) -> bytes:
    """A JPEG file of a height by width by 3 image of bytes; colour has the resolution of luminance."""
    height, width = rgb.shape[:2]
    if not 1 <= quality <= 100 or not 1 <= height <= 65_500 or not 1 <= width <= 65_500:
        raise ValueError("quality is 1 to 100, sides are 1 to 65500")
    tables = _quantisers(quality)
    table, symbol, value, bits = _events(_coefficients(rgb, tables))
    made = [_codes(symbol[table == k]) for k in range(4)]
    code, size = np.stack([m[0] for m in made]), np.stack([m[1] for m in made])
    word, length = (code[table, symbol] << bits) | value, size[table, symbol] + bits
    parts = []
    for low in range(0, len(word), _CHUNK):
        w, n = word[low : low + _CHUNK], length[low : low + _CHUNK]
        after = np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1
        parts.append((np.repeat(w, n) >> after & 1).astype(np.uint8))
    laid = np.concatenate(parts)
    scan = np.packbits(np.pad(laid, (0, -len(laid) % 8), constant_values=1)).tobytes().replace(b"\xff", b"\xff\x00")
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    head = segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + b"".join(segment(0xDB, bytes([k]) + t.astype(np.uint8).tobytes()) for k, t in enumerate(tables))
    frame = segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    huffman = b"".join(segment(0xC4, bytes([k // 2 * 16 + k % 2]) + m[2]) for k, m in enumerate(made))
    return b"\xff\xd8" + head + frame + huffman + segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9"
