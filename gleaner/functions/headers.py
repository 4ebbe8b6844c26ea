"""What the first bytes of an image tell, without decoding it."""

from __future__ import annotations

import struct
from typing import BinaryIO

# JPEG's start-of-frame markers, and the number of EXIF's orientation tag.
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
ORIENTATION = 0x0112


def _segments(data: bytes):
    """Marker, and payload, of each segment of a JPEG before its scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP, JPEG or WebP file; None for anything else."""
    if not data:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            for marker, body in _segments(data):
                if marker in FRAMES:
                    h, w = struct.unpack(">HH", body[1:5])
                    return w, h
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
    except struct.error:
        pass
    return None


def head(f: BinaryIO, first: int = 64) -> bytes:
    """What ``header_size`` and ``orientation`` need of an open file: its first bytes, and of a JPEG or PNG the EXIF block and the
    frame, between which it goes from segment to segment without reading what they hold."""
    data = f.read(first)
    if data[:2] == b"\xff\xd8":
        out, at = data[:2], 2
        while True:
            f.seek(at)
            start = f.read(4)
            if len(start) < 4 or start[0] != 0xFF or start[1] == 0xDA:
                return out
            size = int.from_bytes(start[2:], "big")
            if start[1] in FRAMES or start[1] == 0xE1:
                body = f.read(max(0, size - 2) if start[1] == 0xE1 else 15)
                out += start if start[1] == 0xE1 else start[:2] + struct.pack(">H", len(body) + 2)
                out += body
            if start[1] in FRAMES:
                return out
            at += 2 + size
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        out, at = data[:33], 33
        while True:
            f.seek(at)
            start = f.read(8)
            size, name = int.from_bytes(start[:4], "big"), start[4:8]
            if len(start) < 8 or name == b"IDAT":
                return out
            if name == b"eXIf":
                return out + start + f.read(size)
            at += 12 + size
    return data


def _exif(data: bytes) -> bytes:
    """The EXIF block of a JPEG or PNG, from its TIFF header on; empty where there is none."""
    if data[:2] == b"\xff\xd8":
        return next((body[6:] for marker, body in _segments(data) if marker == 0xE1 and body[:6] == b"Exif\0\0"), b"")
    at = 8
    while data[:8] == b"\x89PNG\r\n\x1a\n" and at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if name == b"eXIf":
            return data[at + 8 : at + 8 + size]
        at += 12 + size
    return b""


def orientation(data: bytes | None) -> int:
    """The EXIF orientation of a JPEG or PNG, 1 to 8; 1 where there is none."""
    tiff = _exif(data) if data else b""
    order = ">" if tiff[:2] == b"MM" else "<"
    try:
        (at,) = struct.unpack(order + "I", tiff[4:8])
        (n,) = struct.unpack(order + "H", tiff[at : at + 2])
        for k in range(n):
            tag, _, _, value = struct.unpack(order + "HHIH", tiff[at + 2 + 12 * k : at + 12 + 12 * k])
            if tag == ORIENTATION and 1 <= value <= 8:
                return value
    except struct.error:
        pass
    return 1
